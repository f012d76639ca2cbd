"""Merkle manifest, whitening and the k-means tree against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docevidence.llm import kmeans_tree, merkle_manifest, queries, toxicity, whitening

CLASHES = "g string, pos int, n int, level int, root string, leaf string, block int, digest string, x int, i int, v int, d int, part int, leaves int"
EXTRA = ("x", 1, 2, 3, "x", "x", 4, "x", 5, 6, 7, 8, 9, 10)


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_tree(leaves):
    """Root and, for each leaf, its siblings by level as (place, others)."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for way, i in enumerate(at):
            run = runs[i // 8]
            ways[way].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        at, nodes = [i // 8 for i in at], [h(*run) for run in runs]
    return nodes[0], ways


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) to {(doc_id, leaf): the query's other columns}, repeated rows in a list."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(told, r))
    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in langs]
    trees = [brute_tree([leaf(r) for r in g]) for g in groups]
    root, tops = brute_tree([t[0] for t in trees])
    out = []
    for g, (subroot, ways), top in zip(groups, trees, tops, strict=True):
        for r, way in zip(g, ways, strict=True):
            shown = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                shown = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for place, others in way + top:
                shown = h(*others[:place], shown, *others[place:])
            out.append((r[0], leaf(r), subroot, root, h(*(d for _, others in way + top for d in others)), shown, shown == root))
    return sorted(out, key=repr)


def documents(spark, rows, path):
    spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id bigint, source string, lang string, n_chars bigint, text string, {CLASHES}").repartition(5).write.mode("overwrite").parquet(f"{path}/documents.parquet")


def test_manifest(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en"] * 6 + ["de", "", None, "é"]), rng.randint(0, 9), rng.choice(["Some Text", "", None, "ÄB c", "x" * 30_000])) for i in range(300)]
    rows += [(None, None, None, None, None)] * 2 + [(7, "s", "en", 1, "Again")] * 3 + [(7, "s", "en", 1, "Once"), (-5, "s", "only", 1, "Lone")]
    documents(spark, rows, tmp_path)
    assert sorted(map(tuple, queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_manifest_in_small_blocks(spark, n):
    """Blocks of eight leaves, so that many rounds of appends are needed."""
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    df = spark.createDataFrame([(i, "a" if i < n - n // 3 else f"b{i}", leaves[i], i * 2) for i in range(n)], "id bigint, kind string, digest binary, other bigint").repartition(3)
    got = merkle_manifest.check_leaves(merkle_manifest.manifest(df, "kind", ["id"], "digest", ["id", "other"], block_levels=1)).collect()
    kinds = sorted({"a", *(f"b{i}" for i in range(n - n // 3, n))})
    trees = [brute_tree([leaves[i].hex() for i in range(n - n // 3)])] + [brute_tree([leaves[int(k[1:])].hex()]) for k in kinds[1:]]
    root, _ = brute_tree([t[0] for t in trees])
    assert len(got) == n and {r["folded_root"] for r in got} == {root} == {r["root"].hex() for r in got}
    assert all(bytes(r["leaf"]) == leaves[r["id"]] and r["other"] == 2 * r["id"] for r in got)


def test_manifest_witness(spark):
    """Another leaf, or another place, gives another root; nulls give nulls."""
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(20)]
    df = spark.createDataFrame([(i, leaves[i]) for i in range(20)], "id int, digest binary").withColumn("kind", F.lit(None).cast("string"))
    got = {r["id"]: r for r in merkle_manifest.manifest(df, "kind", ["id"], "digest", ["id"]).collect()}
    root, ways = brute_tree([x.hex() for x in leaves])
    assert merkle_manifest.fold(leaves[3], bytes(got[3]["witness"])).hex() == root != merkle_manifest.fold(leaves[4], bytes(got[3]["witness"])).hex()
    assert [(p, [d.hex() for d in o]) for p, o in merkle_manifest.steps(bytes(got[19]["witness"]))] == ways[19]
    odd = spark.createDataFrame([(None, b""), (leaves[0], None)], "leaf binary, witness binary")
    assert [(r["proof_sha256"], r["folded_root"]) for r in merkle_manifest.check_leaves(odd).collect()] == [(h(), None), (None, None)]


def vectors(spark, rows, path):
    spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id bigint, embedding array<float>, {CLASHES}").repartition(4).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")


ODD_VECTORS = [(901, None), (902, [1.0, None]), (903, [float("nan")] * 5), (904, [float("inf")] + [0.0] * 4)]


def sample_vectors(n=400, dims=5, seed=4):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dims)) * np.arange(1, dims + 1)).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[n // 2]  # a hot vector
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_whitening(spark, tmp_path):
    rows = sample_vectors()
    extra = [(500, [1.0, 2.0]), (501, []), (502, [1e30, -1e30, 0.0, 0.0, 0.0])]  # short, empty, beyond a long
    for table, kept in ((rows + ODD_VECTORS, rows), (rows + extra[:2], rows + extra[:2])):
        vectors(spark, table, tmp_path)
        got = queries.op12_whitening(spark, str(tmp_path)).collect()
        x = {i: [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (5 - len(v)) for i, v in kept}
        fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
        n, s = len(fit), fit.sum(axis=0)
        c = (fit * n - s).astype(float) / n
        values, vecs = np.linalg.eigh(c.T @ c / n)
        values, vecs = values[::-1], vecs[:, ::-1]
        assert len(got) == 5 * len(kept)
        by = {(r["vec_id"], r["component"]): r for r in got}
        signs = [np.sign(by[0, k + 1]["whitened"] * ((np.array(x[0]) - s / n).astype(float) @ vecs[:, k])) for k in range(5)]
        for (i, k), r in by.items():
            want = signs[k - 1] * ((np.array(x[i], dtype=object) * n - s).astype(float) / n @ vecs[:, k - 1]) / math.sqrt(values[k - 1])
            assert (r["n"], r["deviation"]) == (n, sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True)))
            assert r["whitened"] == pytest.approx(want, abs=1e-9) and r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    vectors(spark, rows + extra, tmp_path)
    assert queries.op12_whitening(spark, str(tmp_path)).count() == 5 * (len(rows) + 3)


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df, "vec_id", "embedding").collect()
    assert len(got) == 10 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, 0.0, 0.0)}
    flat = df.union(spark.createDataFrame([(9, [3.0, 2.0])], df.schema))  # the second dimension is constant
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(flat, "vec_id", "embedding").collect()}
    assert abs(got[9, 1]["whitened"]) == pytest.approx(1.0) and got[9, 2]["whitened"] is None and got[9, 1]["explained"] == 1.0
    assert whitening.whiten(df.limit(0), "vec_id", "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], df.schema), "vec_id", "embedding").count() == 0


def test_bit_planes():
    rng = np.random.default_rng(1)
    for low, high in ((0, 2), (-3, 90), (-(2**62), 2**62), (5, 6)):
        x = rng.integers(low, high, size=(130, 4))
        least = x.min(axis=0)
        bits = max(1, max(int(a) - int(b) for a, b in zip(x.max(axis=0), least, strict=True)).bit_length())
        out = np.zeros((4, 4, 2 * bits - 1), dtype=np.int64)
        for at in (0, 100):
            whitening.scatter_counts(whitening.planes(x[at : at + 100], least, bits), 4, bits, out)
        y = x.astype(object) - least.astype(object)
        for d in range(4):
            for e in range(d, 4):
                assert sum(int(c) << s for s, c in enumerate(out[d, e].tolist())) == (y[:, d] * y[:, e]).sum()


def brute_nearest(rows, k, every=20):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    dims = max(len(v) for _, v in usable)
    usable = [(i, np.pad(v, (0, dims - len(v)))) for i, v in usable if i is not None]
    out = {}
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-sum((v * w).tolist()), i) for i, w in usable if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_tree_in_full(spark, tmp_path):
    """With all leaves visited the results are the exact ones, ties, short, null and repeated vectors included."""
    rows = [*sample_vectors(), *ODD_VECTORS, (960, [0.0] * 5), (980, [2.0]), (981, [3.0, 1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id bigint, embedding array<float>, {CLASHES}").repartition(4)
    want = brute_nearest(rows, 20)
    for leaves, block in ((1, 4096), (30, 50)):
        got = found(kmeans_tree.search(df.filter("vec_id % 20 = 0"), df, 20, "vec_id", "embedding", recall=1.1, leaves=leaves, least_block=block))
        assert got.keys() == want.keys() and 960 not in got
        for q, own in want.items():
            assert [i for i, _ in got[q]] == [i for i, _ in own] and [s for _, s in got[q]] == pytest.approx([s for _, s in own], rel=1e-14)


def test_tree_recall(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors(spark, rows, tmp_path)
    got, want = found(queries.op13_kmeans_tree(spark, str(tmp_path))), brute_nearest(rows, 20)
    assert got.keys() == want.keys() and all(len(own) == 20 for own in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    by = dict(rows)
    for q, own in got.items():
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(np.dot(np.array(by[q]), np.array(by[i]))), rel=1e-12) for i, s in own)


def test_tree_visits_fewer(spark):
    """On clustered rows a part of the leaves is enough: most queries meet their own among the first."""
    rng = np.random.default_rng(9)
    x = np.repeat(np.eye(16) * 5, 100, axis=0) + 0.1 * rng.normal(size=(1600, 16))
    tree = kmeans_tree.grow(x, 32)
    assert 16 <= tree.leaves <= 32 and (np.bincount(tree.assign(x), minlength=tree.leaves) > 0).all()
    seen = tree.visits(x[::10], 8, np.ones(tree.leaves, bool))
    assert all(len(set(s)) == 8 for s in seen)
    assert np.mean([own in s for own, s in zip(tree.assign(x[::10]), seen, strict=True)]) > 0.75
    assert [sorted(s) for s in tree.visits(x[:3], 99, np.ones(tree.leaves, bool))] == [list(range(tree.leaves))] * 3


def test_repeated_queries_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in kmeans_tree.search(df.filter("vec_id = 0"), df, 20, "vec_id", "embedding").orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 0.0)]
    one = df.filter("vec_id = 2")
    assert kmeans_tree.search(one, one, 20, "vec_id", "embedding").count() == 0 == kmeans_tree.search(one, df.limit(0), 20, "vec_id", "embedding").count()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_whitening", "op13_kmeans_tree"])
def test_empty_tables(spark, tmp_path, name):
    documents(spark, [], tmp_path)
    vectors(spark, [], tmp_path)
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def brute_match(word, terms, spared):
    """(kind, weight) of a word by the definition: itself, a stem it begins with, or a long term one edit away."""
    if word in terms:
        return 3, terms[word]

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    stems = [w for t, w in terms.items() if t.endswith("*") and word.startswith(t[:-1])]
    if stems:
        return 2, max(stems)
    near = [w for t, w in terms.items() if not t.endswith("*") and len(t) >= 5 and one_edit(word, t)] if word not in spared else []
    return (1, max(near)) if near else (0, 0.0)


def brute_score(text, model, memo):
    """The logistic score of the counts of sure, misspelled and quoted hits, from whole-text positions."""
    low = (text or "").lower()
    spans = [m.span() for m in re.finditer(r"[^\W\d_]+", low)]
    words = [low[a:b] for a, b in spans]
    sure, fuzzy, quoted = [], 0, 0
    for i, w in enumerate(words):
        if w not in memo:
            memo[w] = brute_match(w, model.terms, model.spared)
        kind, weight = memo[w]
        if not kind:
            continue
        first, last = max(0, i - 6), min(len(words) - 1, i + 6)
        marks = lambda s: sum(s.count(q) for q in toxicity.QUOTES)
        inside = marks(low[spans[first][0] : spans[i][0]]) % 2 == 1 and marks(low[spans[i][1] : spans[last][1] + 1]) > 0
        if inside or any(x in toxicity.REPORTING for k, x in enumerate(words[first : last + 1], first) if k != i):
            quoted += 1
        elif kind == 1:
            fuzzy += 1
        else:
            sure.append(weight)
    x = [1.0, float(bool(sure)), math.log1p(len(sure)), math.log1p(fuzzy), math.log1p(quoted), max(sure, default=0.0) / 10]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_toxicity_score_by_brute_force(spark):
    """Every text's score, with a learned model and with one that has all kinds of terms."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    learned = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    made = toxicity.Model({"stupid": 2.0, "scum": 1.5, "lowei*": 3.0, "the": 0.5, "thoug": 1.0, "and*": 0.7}, frozenset({"those"}), [-1.0, 2.0, 0.5, 0.7, -0.4, 1.1])
    odd = [(10_001 + k, t) for k, t in enumerate([None, "", '"you stupid scum" he said', "stupld SCUM, loweird lowei", "„stupid“ x", "stupidd stpid stupib scun", "said stupid " + "a " * 9 + "stupid", "those thoug thoug1", "Thé the"])]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for model in (learned, made):
        memo = {}
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
        assert len(got) == len(texts)
        for i, t in texts.items():
            assert got[i] == pytest.approx(brute_score(t, model, memo), abs=1e-9), i
