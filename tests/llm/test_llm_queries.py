"""Each registered query and pipeline stage against a brute-force version, on small tables with odd rows: nulls, empty and very long texts,
ties and repeated rows, extra columns whose names clash with inner ones, and on empty tables."""

import base64
import hashlib
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import ODD, brute_groups, brute_likeness, brute_lines, brute_passages, words
from tokenizers import Tokenizer

from docevidence.llm import queries, toxicity

CLASHES = "row bigint, id string, digest string, score double, predicted int, n_lines int, removed string, ids string, decoded string, row_key string, kept boolean, size int"
DOCUMENTS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, formatted string, c string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, w int, qb int"
EXTRA = (7, "x", "x", 1.0, 1, 3, "x", "x", "x", "x", True, 1)


def make_texts():
    rng = random.Random(31)
    run = "\n".join(words(rng, 9) for _ in range(7))
    texts = [*ODD, words(rng, 9000)]
    for _ in range(25):
        texts.append("\n".join(words(rng, 8) for _ in range(rng.randint(1, 12))))
    texts += [f"{words(rng, 6)}\n{run}\n{words(rng, 5)}" for _ in range(4)]
    for k in (14, 15, 16):  # near copies, and a chain of them
        w = texts[k].split(" ")
        for n in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = f"edit{n}"
            texts.append(" ".join(w))
    return texts + ["you are a stupid loser", "You stupid, stupid loser!"] * 3


TEXTS = make_texts()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 5}", len(t) if t is not None else None, *EXTRA) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("stupid" in (t or ""))) for i, t in enumerate(TEXTS)] + [(None, 1, 1), (3, 0, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    turns = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "\\n<|im_start|>"), (1, 2, "assistant", None), (2, 1, "assistant", "b"), (2, 0, None, "a\n"), (2, 0, None, "a\n"), (3, 0, "odd\nrole", ""), (4, 0, "assistant", "w " * 9000)]
    spark.createDataFrame([(*t, "x", "x") for t in turns], CONVERSATIONS).write.parquet(f"{path}/conversations.parquet")
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 6)).astype(np.float32)
    v[30:60] = v[30]
    vectors = [(i, [float(x) for x in v[i]], 0, 1, 1) for i in range(120)] + [(200, None, 0, 1, 1), (250, [1.0, None], 0, 1, 1), (300, [float("inf")], 0, 1, 1)]
    spark.createDataFrame(vectors, EMBEDDINGS).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


def rows_of(spark, sf, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def bpe_ids():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: np.array(own.encode_ordinary(t or ""), "<u4").tobytes()


def test_op1(spark, sf):
    got = rows_of(spark, sf, "op1_paragraph_sketch")
    like = brute_likeness
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        t, nxt = t or "", TEXTS[(i - 1) % len(TEXTS)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = map(brute_passages, (t, edited, nxt))
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(edited))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (pytest.approx(like(a, b)), pytest.approx(like(a, c)))


def test_oracles(spark, sf):
    """The queries with SQL, on the odd rows too."""
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())), name


def test_op3(spark, sf):
    ids, got = bpe_ids(), rows_of(spark, sf, "op3_byte_bpe")
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in got.items()} == {i: (len(ids(t)) // 4, sha(ids(t)), sha(t or "")) for i, t in enumerate(TEXTS)}


def test_op4_op5(spark, sf):
    got = rows_of(spark, sf, "op4_line_dedup")
    assert [got[i]["removed"] for i in range(len(TEXTS))] == [",".join(map(str, g)) for g in brute_lines(TEXTS, 50)]
    assert sorted(map(tuple, queries.op5_near_dup(spark, sf).collect())) == brute_groups(TEXTS)


def test_op6(spark, sf):
    got = rows_of(spark, sf, "op6_toxicity")
    assert len(got) == len(TEXTS)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    alike = {}
    for i, t in enumerate(TEXTS):  # a score hangs on the text alone
        assert alike.setdefault(t or "", got[i]["score"]) == got[i]["score"]


def test_op7_op10(spark, sf):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [lib.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    got = rows_of(spark, sf, "op7_token_counts")
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 512) for i, t in enumerate(TEXTS)}
    at, want = 0, {}
    for i, x in enumerate(ids):
        want[i] = (at, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        at += len(x) + 1
    assert {i: tuple(r)[1:] for i, r in rows_of(spark, sf, "op10_id_store").items()} == want


def test_op8(spark, sf):
    got = rows_of(spark, sf, "op8_source_mix")
    size = {i: len((t or "").split()) for i, t in enumerate(TEXTS)}  # no text has other white space than the six
    size[6] = len([w for w in re.findall(r"[^\x20\x09-\x0D]+", TEXTS[6])])
    source = {i: None if i % 5 == 4 else f"s{i % 5}" for i in size}
    order = sorted({s for s in source.values() if s}) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in order}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(total.values()), set(order)
    while left > 1e-9 and free:
        share, left = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}, 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                free.discard(s)
    for i, r in got.items():
        assert (r["size"], r["source_size"], r["target"]) == (size[i], total[source[i]], pytest.approx(target[source[i]])) and 0 <= r["taken"] <= 2 * r["size"]
    for s in order:
        taken = sum(r["taken"] for i, r in got.items() if source[i] == s)
        assert abs(taken - target[s]) <= max(64, 0.03 * target[s]), s
    assert {i: tuple(r) for i, r in rows_of(spark, sf, "op8_source_mix").items()} == {i: tuple(r) for i, r in got.items()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == (name == "op2_chat_format")


def test_stages(spark, sf, nothing):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    scores = {r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, sf).collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(stages["toxicity"](spark, docs, sf)) == sorted(i for i, s in scores.items() if s < 0.5 or not model.terms)

    gone, out = brute_lines(TEXTS, 50), stages["line_dedup"](spark, docs, sf)
    want = {}
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        if not gone[i] or len(gone[i]) < sum(1 for x in lines if x.strip(" \t\n\x0b\x0c\r")):
            want[i] = t if not gone[i] else "\n".join(x for n, x in enumerate(lines) if n not in gone[i])
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want and out.columns == docs.columns

    near = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs.filter("doc_id = 20")), sf)
    assert ids(near) == [i for i, _, _, kept in brute_groups(TEXTS, 80) if kept] and near.columns == docs.columns

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in queries.op8_source_mix(spark, sf).collect()}
    assert ids(stages["source_mix"](spark, docs, sf)) == sorted(i for i, (n, size) in taken.items() if size for _ in range(int(n / size + 0.5)))

    encoded, bpe = {r["doc_id"]: r for r in stages["byte_bpe"](spark, docs, sf).collect()}, bpe_ids()
    assert all((encoded[i]["ids_sha256"], encoded[i]["decoded_sha256"]) == (sha(bpe(t)), sha(t or "")) for i, t in enumerate(TEXTS))
    empty = spark.read.parquet(f"{nothing}/documents.parquet")
    assert all(stage(spark, empty, nothing).count() == 0 for stage in stages.values())
    assert near.filter(F.col("row_key") == "x").count() == near.count()
