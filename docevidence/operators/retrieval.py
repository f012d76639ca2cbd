"""Vectors, filtered top-k, floors, budgets and status."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.operators import blocks
from docevidence.plans.scratch import saved

# Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295
MEMO_WORDS, TEXTS_AT_ONCE = 200_000, 1000


def fnv1a(token: Column) -> Column:
    """Unsigned 32-bit FNV-1a of an ASCII token."""
    codes = F.transform(F.split(token, ""), lambda ch: F.ascii(ch))
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(FNV_START).cast("bigint"), lambda h, x: (h.bitwiseXOR(x.cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(MASK)))


def hash_embed(text: Column, dims: int = 256) -> Column:
    """V1: signed token hashing into ``dims`` buckets, of unit length (zeros if there is no token)."""
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)
    hits = F.transform(tokens, lambda t: fnv1a(t))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.aggregate(F.filter(hits, lambda h: h % dims == b), F.lit(0.0), lambda s, h: s + F.when(h % 2 == 1, 1.0).otherwise(-1.0)))
    sized = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))[0]
    return F.transform(F.array(sized), lambda s: F.transform(s["v"], lambda x: F.coalesce(F.try_divide(x, s["n"]), F.lit(0.0))))[0]


def embed_rows(df: DataFrame, key: str, text: str, dims: int = 256, keep: list[str] | None = None, out_col: str = "values") -> DataFrame:
    """V1 for many rows with a unique key: the vectors of hash_embed, row by row and without a shuffle; a word's hash is kept in a bounded memo."""
    buckets: dict[str, int] = {}

    def bucket(token: str) -> int:
        """Twice the word's bucket, and one more where it counts up."""
        h = FNV_START
        for c in token.encode():
            h = (h ^ c) * FNV_PRIME & MASK
        if len(buckets) >= MEMO_WORDS:
            buckets.clear()
        buckets[token] = found = 2 * (h % dims) + h % 2
        return found

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            words = [re.findall("[a-z0-9]{2,}", t or "") for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()]
            b = np.array([buckets[w] if w in buckets else bucket(w) for found in words for w in found], dtype=np.int64)
            row = np.repeat(np.arange(len(words)), [len(found) for found in words])
            part = np.bincount(row * dims + b // 2, weights=np.where(b % 2 == 1, 1.0, -1.0), minlength=len(words) * dims).astype(np.float64).reshape(len(words), dims)  # whole numbers where there is no word at all
            length = np.sqrt((part * part).sum(axis=1, keepdims=True))  # of whole numbers, so exact
            parts.append(np.divide(part, length, out=np.zeros_like(part), where=length > 0))
        out = np.concatenate(parts) if parts else np.zeros((0, dims))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dims, dtype=np.int32)), pa.array(out.ravel()))

    return df.select(key, *(keep or []), vectors(F.lower(text)).alias(out_col))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def vector_topk(queries: DataFrame, vectors: DataFrame, on: list[str], k: int, query_id: str = "query_id", vector_id: str = "id", values: str = "values", floor: float | None = None, digits: int | None = 6, skip_own: bool = False) -> DataFrame:
    """J1 + W1 + F6: of the vectors that agree on ``on`` (tenant, space) the k most similar per query, ties to the smaller id.

    Equal vectors score alike, so of a group's equal vectors, and of its equal queries, only the one with the smallest id takes part; a winner
    stands for the ``k`` smallest ids of its kind, and each query takes what its kind found. Representatives meet in blocks
    (``blocks.best_in_blocks``): one matrix product for a block, then the k best of each query; a group of any size is spread over as many
    blocks as its rows ask for. Only ids and values take part; texts are joined back to the k winners by the caller. Rank and ``floor`` go
    by the exact score, which is then rounded to ``digits`` if any. Vectors of another length than the query's are an error (F2 keeps spaces apart
    before). With ``skip_own`` a query is itself one of the vectors and that one is not ranked. A null vector is none, one with a null or
    non-finite component is like none (0); queries without vectors have no rows.
    """
    most = k + 1 if skip_own else k
    v, q = _kinds(vectors, on, vector_id, values), _kinds(queries, on, query_id, values)
    kind = [*on, "__1", "__2"]
    asking, there = (saved(_first(df, kind, [key], 1), "kinds") for df, key in ((q, query_id), (v, vector_id)))  # counted, then dealt
    tops = blocks.best_in_blocks(asking, there, on, most, query_id, vector_id, values)
    tops = _first(tops, [*on, query_id], [F.desc("score"), vector_id], most)
    members = _first(v.select(*kind, vector_id), kind, [vector_id], most)
    members = members.withColumn("__v", F.min(vector_id).over(Window.partitionBy(*kind))).select(*on, "__v", vector_id)
    found = tops.withColumnRenamed(vector_id, "__v").join(members, [*on, "__v"]).drop("__v")
    found = _first(found, [*on, query_id], [F.desc("score"), vector_id], most).withColumnRenamed(query_id, "__q")
    asked = q.select(*kind, query_id).join(asking.select(*kind, F.col(query_id).alias("__q")), kind)
    ranked = found.join(asked.select(*on, "__q", query_id), [*on, "__q"]).drop("__q")
    ranked = ranked.filter(F.col(query_id) != F.col(vector_id)) if skip_own else ranked
    ranked = _first(ranked, [query_id], [F.desc("score"), vector_id], k, "rank").select(query_id, *on, vector_id, "score", "rank")
    ranked = ranked.filter(F.col("score") >= floor) if floor is not None else ranked
    return ranked if digits is None else ranked.withColumn("score", F.round("score", digits))


def _first(rows: DataFrame, by: list[str], order: list, k: int, name: str = "__n") -> DataFrame:
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
    return out if name == "rank" else out.drop(name)


def _kinds(rows: DataFrame, on: list[str], key: str, values: str) -> DataFrame:
    """Rows (on, key, values) with a vector, and the 128-bit hash of the vector (__1, __2)."""
    there = F.col(values).isNotNull() & F.col(key).isNotNull()
    for c in on:
        there = there & F.col(c).isNotNull()
    return rows.filter(there).select(*on, key, values, *(F.xxhash64(values, F.size(values), F.lit(n)).alias(f"__{n}") for n in (1, 2)))


def same_space(vectors: DataFrame, space: str, dims: int, space_col: str = "embedding_space", values: str = "values") -> DataFrame:
    """the vectors of one space and length; others are never compared with its queries. Null vectors go."""
    return vectors.filter((F.col(space_col) == space) & (F.size(values) == dims))


def metadata_filter(rows: DataFrame, wanted: dict) -> DataFrame:
    """rows that meet all conditions: a literal or {"$eq": x} is equality, {"$in": [...]} membership; on a list column one element
    in common is enough. A null field meets no condition; any other operator is an error."""
    for field, want in wanted.items():
        is_list = rows.schema[field].dataType.typeName() == "array"
        kind, value = next(iter(want.items())) if isinstance(want, dict) else ("$eq", want)
        if kind not in ("$eq", "$in") or (isinstance(want, dict) and len(want) != 1):
            raise ValueError(f"unknown condition {want!r} on {field}")
        if kind == "$in":
            value = list(value)
            rows = rows.filter(F.arrays_overlap(F.col(field), F.array(*map(F.lit, value))) if is_list and value else F.col(field).isin(*value) if value else F.lit(False))
        else:
            rows = rows.filter(F.array_contains(F.col(field), F.lit(value)) if is_list else F.col(field) == F.lit(value))
    return rows


def prefix_budget(ranked: DataFrame, query_id: str, order: list, length: Column, most: int) -> DataFrame:
    """In order, until the next item would exceed ``most``; the first is always kept. ``order`` must be unique in a query; a null
    length counts as 0. A query's ranked items, few by the top-k before, meet in one task."""
    w = Window.partitionBy(query_id).orderBy(*order)
    rows = ranked.withColumn("__rn", F.row_number().over(w)).withColumn("__sum", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("__rn") == 1) | (F.col("__sum") <= most)).drop("__rn", "__sum")


def greedy_budget(items: DataFrame, query_id: str, item_id: str, score: str, length: str, max_items: int, max_chars: int) -> DataFrame:
    """W3 + W5: by score, ties to the smaller item id, items that don't fit are skipped and later ones tried; each item once; the first
    always. Adds ``n`` from 1. A request's items, few by the top-k before, are folded in one row."""
    best = items.groupBy(query_id, item_id).agg(F.max(F.struct(F.col(score), F.col(length))).alias("m"))
    ranked = best.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct((-F.col("m")[score]).alias("s"), F.col(item_id).alias("i"), F.col("m")[length].alias("l")))).alias("a"))
    kind = f"array<struct<s:{items.schema[score].dataType.simpleString()},i:{items.schema[item_id].dataType.simpleString()},l:int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = (F.size(state["kept"]) < max_items) & ((F.size(state["kept"]) == 0) | (state["used"] + x["l"] <= max_chars))
        return F.when(fits, F.struct((state["used"] + x["l"]).alias("used"), F.concat(state["kept"], F.array(x)).alias("kept"))).otherwise(state)

    kept = F.aggregate(F.col("a").cast(kind), start, step, lambda s: s["kept"])
    return ranked.select(query_id, F.posexplode(kept).alias("n", "k")).select(query_id, (F.col("n") + 1).alias("n"), F.col("k.i").alias(item_id), (-F.col("k.s")).alias(score), F.col("k.l").alias(length))


def best_per_item(hits: DataFrame, request: str, item: str, score: str) -> DataFrame:
    """The best score of each item over a request's queries; null scores do not count."""
    return hits.groupBy(request, item).agg(F.max(score).alias(score))


def top_score(queries: DataFrame, hits: DataFrame, query_id: str, score: str) -> DataFrame:
    """The best raw score per query, 0 without any."""
    return queries.select(query_id).join(hits.groupBy(query_id).agg(F.max(score).alias("top_score")), query_id, "left").withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))


def retrieval_status(queries: DataFrame, documents: Column, matches: Column, kept: Column) -> DataFrame:
    """no_documents, no_matches, below_threshold or ok, by the first count that is 0; counts must not be null."""
    return queries.withColumn("status", F.when(documents == 0, "no_documents").when(matches == 0, "no_matches").when(kept == 0, "below_threshold").otherwise("ok"))


def ordered_budget(items: DataFrame, query_id: str, item_id: str, order: list, length: str, max_items: int, max_chars: int) -> DataFrame:
    """As greedy_budget, in the caller's order: items that don't fit are skipped, each item once, the first always. Adds ``n``."""
    rank = items.withColumn("__r", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
    once = rank.groupBy(query_id, item_id).agg(F.min(F.struct("__r", F.col(length).alias("l")))["__r"].alias("r"), F.min(F.struct("__r", F.col(length).alias("l")))["l"].alias("l"))
    lists = once.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("r", F.col(item_id).alias("i"), F.col("l").cast("int").alias("l")))).alias("a"))
    kind = f"array<struct<r:int,i:{items.schema[item_id].dataType.simpleString()},l:int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["kept"]) < max_items) & ((F.size(s["kept"]) == 0) | (s["used"] + x["l"] <= max_chars))
        return F.when(fits, F.struct((s["used"] + x["l"]).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)

    kept = F.aggregate(F.col("a").cast(kind), start, step, lambda s: s["kept"])
    return lists.select(query_id, F.posexplode(kept).alias("n", "k")).select(query_id, (F.col("n") + 1).alias("n"), F.col("k.i").alias(item_id), F.col("k.l").alias(length))


def distinct_queries(queries: Column, most: int = 6, chars: int = 500) -> Column:
    """O2: trimmed, at most ``chars`` long, distinct in order, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(queries, lambda q: F.left(F.trim(q), F.lit(chars))), lambda q: q != "")), 1, most)


def servable_references(vectors: DataFrame, sources: DataFrame, space: str, synthetic: bool = False) -> DataFrame:
    """J3 + F4 + F10: reference vectors of registered, indexed sources in one space, with title and organisation; synthetic test
    sources only on request."""
    s = sources.filter((F.col("status") == "indexed") & (F.col("embedding_space") == space) & F.col("title").isNotNull() & F.col("organization").isNotNull())
    s = s if synthetic else s.filter(F.col("source_type") != "synthetic_test")
    return vectors.filter(F.col("embedding_space") == space).join(s.select("source_id", "title", "organization"), "source_id")


def merge_term_hits(exact: DataFrame, semantic: DataFrame, question: str, floor: float = 0.70) -> DataFrame:
    """O1 + W6: exact hits and semantic ones at or over the floor, once per record with the better rank, then score; ordered by match
    kind, dataset, score, id (``position`` from 1). Both have question, record_id, dataset, match, score."""
    kinds = F.create_map(F.lit("exact_term"), F.lit(0), F.lit("exact_alias"), F.lit(1), F.lit("semantic"), F.lit(2))
    both = exact.unionByName(semantic.filter(F.col("score") >= floor)).withColumn("__k", kinds[F.col("match")])
    one = both.withColumn("__n", F.row_number().over(Window.partitionBy(question, "record_id").orderBy("__k", F.desc("score")))).filter("__n = 1")
    order = Window.partitionBy(question).orderBy("__k", (F.col("dataset") != "medlineplus"), F.desc("score"), "record_id")
    return one.withColumn("position", F.row_number().over(order)).drop("__k", "__n")
