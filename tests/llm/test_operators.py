"""The training-data operators against brute force, round trips and held-out labels, on small fixtures with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docevidence.llm import bpe, chat_format, id_store, line_dedup, mixing, near_dup, paragraph_sketch, token_counts, topk_search, toxicity
from docevidence.llm.common import Scratch
from docevidence.llm.hf_counts import library_encoder

ODD = [None, "", " ", "\n\n", "a", "Don't  stop!\r\n\tnow ", "é ß 日本 😀  x  y", "x" * 20_000, "same text here.", "same text here.", "<|endoftext|> hi", "end.  "]


def docs(spark, texts, extra=""):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.withColumn("row", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("digest", F.lit(2))


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "zeta", "eta", "iota", "kappa", "mu"]) + str(rng.randint(0, 9)) for _ in range(n))


def test_bpe(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode_column(bpe.encode_column(docs(spark, ODD), "text", path, P.PATTERN, ["doc_id"]), "ids", path).collect()
    assert len(out) == len(ODD)
    for r in out:
        t = ODD[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()


def test_library_units():
    path, rng = P.path("byte_bpe_50k.json"), random.Random(2)
    lib, enc = Tokenizer.from_file(path), library_encoder(path)
    parts = ["a", " ", "\n", "\t", "é", "ß", "日", "'s", "12", "!", ".", "the", " ", "\x1c", " ", "<|endoftext|>"]
    for t in [x or "" for x in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]:
        assert np.frombuffer(enc(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_token_counts(spark):
    path = P.path("byte_bpe_50k.json")
    lib, store = Tokenizer.from_file(path), Scratch(spark, "t").path("store")
    want = sorted((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(ODD))
    for _ in range(2):  # the second run finds all counts in the store
        assert sorted(map(tuple, token_counts.count_tokens(docs(spark, ODD), path, store).collect())) == want
    assert spark.read.parquet(store).count() == len(set(t or "" for t in ODD))


def test_id_store(spark):
    path, where = P.path("byte_bpe_50k.json"), Scratch(spark, "t").path("ids")
    texts = [*ODD, words(random.Random(1), 6000)]
    lib = Tokenizer.from_file(path)
    id_store.write_store(docs(spark, texts), where, path, 2)
    at, want = 0, []
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, id_store.read_store(spark, where).collect())) == want


@pytest.mark.parametrize("table", ["recipes", "chunks", "manifest", "root"])
def test_id_store_damage(spark, table):
    """A file less, or a row less, of any of the store's tables is an error."""
    where = Scratch(spark, "t").path("ids")
    rng = random.Random(4)
    df = spark.createDataFrame([(i, words(rng, 400)) for i in range(300)], "doc_id bigint, text string").repartition(4)
    id_store.write_store(df, where, P.path("byte_bpe_50k.json"), 2)
    assert id_store.read_store(spark, where).count() == 300
    rows = spark.read.parquet(f"{where}/{table}")
    kept = spark.createDataFrame(rows.collect()[1:], rows.schema)
    kept.write.mode("overwrite").parquet(f"{where}/{table}")
    with pytest.raises(Exception, match="names|not in the store|match"):
        id_store.read_store(spark, where).collect()


def test_id_store_empty(spark):
    where = Scratch(spark, "t").path("ids")
    id_store.write_store(docs(spark, ODD).limit(0), where, P.path("byte_bpe_50k.json"), 2)
    assert id_store.read_store(spark, where).count() == 0


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", "\\n\\ <| 日本😀"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, "odd\nrole", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df, P.path("byte_bpe_50k.json"))).collect()}
    for c in (1, 2, 3):
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        assert out[c]["turns_text"] == "".join(f"{r}\n{x}\n" for _, r, x in own) and out[c]["n_turns"] == len(own)
        assert out[c]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 8))
    v[40:80] = v[40]
    rows = [(i, [float(x) for x in v[i]]) for i in range(150)] + [(150, None), (151, [1.0, None]), (152, [float("nan")])]
    ints = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, e array<double>"), "vec_id", "e")
    got = sorted(map(tuple, topk_search.search(ints.filter("vec_id % 10 = 0"), ints, 5, "vec_id", "weights", block_rows=40, query_rows=7).collect()))
    w = np.floor(256 * v).astype(int)
    want = []
    for q in range(0, 150, 10):
        s = sorted((-int(w[q] @ w[i]), i) for i in range(150) if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk_search.search(ints.limit(0), ints, 5, "vec_id", "weights").count() == 0


def brute_groups(texts, least=85):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    return [(i, len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)]


def test_distance_follows_percent():
    assert [(near_dup.largest_distance(p), near_dup.chunks(near_dup.largest_distance(p))[-1] + 1) for p in (100, 85, 80, 50)] == [(0, 1), (23, 12), (28, 15), (49, 25)]
    with pytest.raises(ValueError):
        near_dup.largest_distance(5)
    # Every pair within the distance shares a key: symbols changed at random places.
    rng = np.random.default_rng(7)
    for percent in (50, 80, 85):
        most = near_dup.largest_distance(percent)
        a = rng.integers(0, 1 << 16, (200, 64)).astype("<u2")
        b = a.copy()
        for x in b:
            x[rng.choice(64, most, replace=False)] += 1
        chunk = near_dup.chunks(most)
        assert (near_dup.index_keys(a, chunk) == near_dup.index_keys(b, chunk)).any(axis=1).all()


def test_near_dup(spark):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(4):
        base = words(rng, 150).split()
        for _ in range(25):  # a chain of edits: neighbours are linked, the ends are not
            base = list(base)
            base[rng.randrange(len(base))] = f"new{rng.randint(0, 999)}"
            texts.append(" ".join(base))
    texts += [words(rng, 60) for _ in range(40)]
    assert sorted(map(tuple, near_dup.group(docs(spark, texts)).collect())) == brute_groups(texts)
    assert near_dup.group(docs(spark, texts).limit(0)).count() == 0
    assert sorted(map(tuple, near_dup.group(docs(spark, texts), exact=True).collect())) == brute_groups(texts)


def brute_lines(texts, least):
    lines = [[(n, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for n, x in enumerate((t or "").split("\n"))] for t in texts]
    lines = [[x for x in ls if x[2]] for ls in lines]
    seen, gone = {}, [set() for _ in texts]
    for d, ls in enumerate(lines):  # every run of enough words, the plain way
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(x[2] for x in ls[a:b]) >= least:
                    key = tuple(x[1] for x in ls[a:b])
                    if seen.setdefault(key, (d, a)) != (d, a):
                        gone[d].update(x[0] for x in ls[a:b])
    return [sorted(g) for g in gone]


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = [words(rng, rng.choice([1, 3, 8, 20])) for _ in range(25)]
    texts = [*ODD] + ["\n".join(rng.choice(pool) if rng.random() < 0.8 else words(rng, 6) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    run = "\n".join(pool[:6])
    texts += [f"{run}\nown {i}\n\n{run}" for i in range(5)]
    for least in (1, 20, 50):
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts), min_words=least).collect()}
        assert [list(got[i]["removed"]) for i in range(len(texts))] == brute_lines(texts, least)
        assert all(got[i]["text"] == (t if not got[i]["removed"] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in got[i]["removed"])) for i, t in enumerate(texts))


def test_mix(spark):
    rng = random.Random(11)
    texts = [words(rng, rng.choice([0, 5, 40, 300])) for _ in range(400)] + [None]
    df = docs(spark, texts)
    mix = mixing.plan_mix(df, "doc_id", "source", mixing.word_count(F.col("text")))
    sources = {r["source"]: r for r in mix.sources.collect()}
    total = sum(r["source_size"] for r in sources.values())
    weights = {"s0": 3, "s1": 1, "s2": 2, None: 3}
    target = {s: 0.0 for s in weights}
    left, free = 1.5 * total, set(weights)
    while left > 1e-9 and free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 2 * sources[s]["source_size"]:
                left += target[s] - 2 * sources[s]["source_size"]
                target[s] = 2 * sources[s]["source_size"]
                free.discard(s)
    assert {s: pytest.approx(t) for s, t in target.items()} == {s: r["target"] for s, r in sources.items()}
    taken = [r.asDict() for r in mixing.taken_words(mix).collect()]
    assert len(taken) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] for r in taken)
    for r in sources.values():
        assert abs(sum(x["taken"] for x in taken if x["source_no"] == r["source_no"]) - r["target"]) <= 4 * r["block_size"]
    again = mixing.taken_words(mixing.plan_mix(df.repartition(3), "doc_id", "source", mixing.word_count(F.col("text")))).select("id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["id"], r["taken"]) for r in taken)
    assert mixing.taken_words(mixing.plan_mix(df.limit(0), "doc_id", "source", mixing.word_count(F.col("text")))).count() == 0


def brute_passages(text):
    """The set of (scale, passage) of a text."""
    runs = re.findall(r"[^\x20\x09-\x0D]+(?:(?<![.!?])[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){0,5}", text)
    scale = max(0, math.floor(math.log2(len(set(runs)) / 16))) if runs else 0
    out = set()
    for s in range(scale, scale + 3):
        passage = []
        for run in runs:
            passage.append(run)
            if xxhash.xxh64_intdigest(run.encode(), 42) % (1 << s) == 0:
                out.add((s, " ".join(passage)))
                passage = []
        if passage:
            out.add((s, " ".join(passage)))
    return out


def brute_likeness(a, b):
    """Shared passages over all, at the scales that both texts have; texts without words are alike."""
    if not a and not b:
        return 1.0
    scales = {s for s, _ in a} & {s for s, _ in b} if a and b else {s for s, _ in a | b}
    a, b = ({p for p in x if p[0] in scales} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("first_cells", [paragraph_sketch.FIRST_CELLS, 8])
def test_sketch(spark, first_cells):
    """With 8 cells a subtable most differences peel in a later try only."""
    rng = random.Random(13)
    texts = [*ODD] + ["\n".join(words(rng, 6) for _ in range(rng.choice([1, 4, 30, 120]))) for _ in range(30)]
    texts += [" ".join(f"{words(rng, 5)}{rng.choice('.!?')}" for _ in range(n)) for n in (1, 2, 12, 63, 64, 160)] + ["word " * 3000, "One. " * 40]
    got = {r["doc_id"]: r for r in paragraph_sketch.edit_and_compare(docs(spark, texts), first_cells=first_cells).collect()}
    like = brute_likeness
    assert len(got) == len(texts)
    for i in range(len(texts)):
        t, nxt = texts[i] or "", texts[(i - 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = map(brute_passages, (t, edited, nxt))
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i]["near_edited"], got[i]["near_next"]) == (pytest.approx(like(a, b)), pytest.approx(like(a, c))), i
        if len(set(t.split())) >= 20 and t != nxt:
            assert got[i]["near_edited"] > got[i]["near_next"], i
    assert got[8]["fingerprint"] == got[9]["fingerprint"] != got[4]["fingerprint"]


def test_sketch_of_half_a_text(spark):
    """A text and the one whose last half is another's are alike to about a third, whether or not they have the same number of runs."""
    rng = random.Random(17)
    texts = []
    for k in range(60):
        n = rng.choice([100, 200, 500, 2000, 6000])
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(n if k % 3 else 25)]
        texts.append(" ".join(own * (1 if k % 3 else n // 25)))  # every third repeats itself
    got = {r["doc_id"]: r for r in paragraph_sketch.edit_and_compare(docs(spark, texts)).collect()}
    plain = [got[i]["near_edited"] for i in range(60) if i % 3 and len(texts[i - 1]) * 2 > len(texts[i])]
    assert min(plain) >= 0.2 and 0.25 < sum(plain) / len(plain) < 0.6


def test_sketch_edges(spark):
    """No rows, one row (next to itself), null and repeated ids, columns of clashing names."""
    assert paragraph_sketch.edit_and_compare(docs(spark, ODD).limit(0)).count() == 0
    one = paragraph_sketch.edit_and_compare(docs(spark, ["alpha beta. gamma delta."])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "null id", 1), (3, "x y z", 2), (3, "x y z", 3), (1, None, 4)], "doc_id bigint, text string, row bigint")
    out = sorted(paragraph_sketch.edit_and_compare(odd).select("doc_id", "n_chars").collect(), key=lambda r: (r[0] is None, r))
    assert [tuple(r) for r in out] == [(1, 0), (3, 5), (3, 5), (None, 7)]


def test_automaton():
    lexicon = toxicity.Lexicon({"stupid": 2.0, "scum": 1.0, "lowei*": 3.0}, frozenset({"stupids"}))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(17)
    for _ in range(4000):
        w = list(rng.choice(["stupid", "scum", "loweix", "other"]))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["", "s", "t", "u", "x", "su"])
        w = "".join(w)
        want = toxicity.EXACT if w in ("stupid", "scum") else toxicity.STEM if w.startswith("lowei") else toxicity.FUZZY if distance(w, "stupid") == 1 and w != "stupids" else 0
        assert lexicon.find(w)[0] == want, w
    assert toxicity.hits(lexicon, 'he said "stupid" twice')[0][3] and not toxicity.hits(lexicon, "you are stupid and that is all there is")[0][3]


def test_toxicity(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(df, labels)
    out = toxicity.score(df, model, ["doc_id"]).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert out.filter((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 0.97 * out.count()
    odd = toxicity.score(docs(spark, ODD), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] < 0.5 for r in odd)
    none = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(docs(spark, ODD), none, ["doc_id"]).filter("score = 0.5").count() == len(ODD)
