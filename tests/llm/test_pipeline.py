import random

import corpus_pipeline
from pyspark.sql import functions as F

from docevidence.llm import line_dedup, mixing, near_dup
from docevidence.llm.common import Scratch


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == seen[-1] and out.filter(F.col("n_tokens") < 0).count() == 0


def test_keys_hold_when_scans_split_otherwise(spark, tmp_path, monkeypatch):
    """Between two jobs the files of the input are dealt out otherwise, as where an executor is lost or joins."""
    rng = random.Random(22)
    text = lambda n: "\n".join(" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(n))
    texts = [text(rng.randint(1, 8)) for _ in range(60)]
    run = text(6)
    texts += [f"{t}\n{run}\n{text(1)}" for t in texts[:8]] + [texts[k] + " more" for k in range(10, 20)]
    rng.shuffle(texts)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(13).write.parquet(f"{tmp_path}/docs")
    docs = lambda: spark.read.parquet(f"{tmp_path}/docs")
    steps = [
        lambda: line_dedup.dedup_lines(docs()).selectExpr("doc_id", "text", "string(removed)"),
        lambda: near_dup.group(docs()),
        lambda: corpus_pipeline.drop_near_duplicates(spark, docs(), ""),
        lambda: mixing.mixed_documents(docs()),
    ]
    want = [sorted(map(tuple, s().collect())) for s in steps]

    count, save, names = [0], Scratch.save, ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def saved(self, df, name):
        out = save(self, df, name)
        count[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", "1" if count[0] % 2 else "40")
        return out

    monkeypatch.setattr(Scratch, "save", saved)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for step, rows in zip(steps, want, strict=True):
            spark.conf.set("spark.sql.files.minPartitionNum", "40")
            count[0] = 0
            assert sorted(map(tuple, step().collect())) == rows
    finally:
        for name in names:
            spark.conf.unset(name)


def test_near_copies_at_80(spark):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    texts, sets = [], []
    for edits in (0, 3, 4, 5, 6):
        w = list(base)
        for i in rng.sample(range(0, 200, 8), edits):
            w[i] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    like = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert any(0.8 <= x < 0.85 for x in like)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r[0] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == {0} | {i for i, s in enumerate(sets) if all(len(s & o) / len(s | o) < 0.8 for j, o in enumerate(sets) if j != i)}


def test_no_labels_reject_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    assert {r[0] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()} == {1, 2}


def test_counts_and_next_rows_when_scans_split_otherwise(spark, tmp_path):
    """While another thread changes how scans are split, every stored count is its text's, and each text's next one is right."""
    import hashlib
    import threading
    import time

    import public_tokenizers as P
    from tokenizers import Tokenizer

    from docevidence.llm import paragraph_sketch, token_counts

    rng = random.Random(23)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(13).write.parquet(f"{tmp_path}/docs")
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {hashlib.sha256(t.encode()).digest(): len(lib.encode(t, add_special_tokens=False).ids) for t in texts}
    stop = threading.Event()

    def change():
        k = 0
        while not stop.wait(0.05):
            k += 1
            spark.conf.set("spark.sql.files.minPartitionNum", "1" if k % 2 else "40")

    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    other = threading.Thread(target=change)
    other.start()
    try:
        for k in range(3):
            store = f"{tmp_path}/store{k}"
            try:
                token_counts.count_tokens(spark.read.parquet(f"{tmp_path}/docs"), P.path("byte_bpe_50k.json"), store).collect()
            except Exception as e:  # a row without a count is an error, never a wrong count
                assert "run again" in str(e)
            assert all(want[bytes(r["content_digest"])] == r["n_tokens"] for r in spark.read.parquet(store).collect())
            got = paragraph_sketch.edit_and_compare(spark.read.parquet(f"{tmp_path}/docs")).collect()
            for r in got:
                t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % len(texts)]
                assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()
            time.sleep(0.05)
    finally:
        stop.set()
        other.join()
        for name in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(name)
