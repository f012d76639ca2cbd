"""Exact top-k inner products by term-at-a-time accumulation.

Rows become postings: for each term (vector component) the rows of a block that have it, with their weights. Each query
scatters its weights into a dense score array over the block, one term after the other; a partition selection takes the
block's best, and the blocks' best are merged per query. Query blocks meet candidate blocks by an equi-join of block
numbers, so a task holds one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES, BLOCKS = 64 << 20, 64  # of a block's weights; blocks are smaller where there would be fewer than BLOCKS of them
LEAST_ROWS = 8192


def postings(values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, rows, weights) of the non-zero components of ragged rows."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    keep = values != 0
    row, term, values = row[keep], term[keep], values[keep]
    order = np.argsort(term, kind="stable")
    row, term, values = row[order], term[order], values[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.array([], dtype=int)
    return [(int(term[s]), row[s:e], values[s:e]) for s, e in zip(starts, np.r_[starts[1:], len(term)], strict=False)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ``ids`` ascend, so of equal scores the first positions win."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > bar)
        at = np.r_[above, np.flatnonzero(scores == bar)[: k - len(above)]]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def _ragged(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = t.column(name).combine_chunks()
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets


def search(queries: DataFrame, rows: DataFrame, k: int, id_col: str, weights_col: str, block_rows: int | None = None, query_rows: int | None = None) -> DataFrame:
    """For each query the k rows of highest inner product, other ids only: query_id, rank, <id_col>, score.

    ``weights_col``: array of integers; a missing component counts as 0, so rows may differ in length. Ties go to the smaller
    id. Fewer rows than k give fewer results; no rows give none. Rows are dealt to blocks by hash of their id, so equal vectors (a
    hot vector) spread evenly. A block of either side holds about BLOCK_BYTES where the tables are large: each row is copied once for each block
    of queries, so large blocks keep the shuffle small. Other columns take no part; an id column that is called as a result is (query_id, rank,
    score) is an error. A null id or a null list takes no part either.
    """
    if id_col.lower() in ("query_id", "rank", "score"):
        raise ValueError(f"{id_col} would be there twice")
    queries, rows = (df.filter(F.col(id_col).isNotNull() & F.col(weights_col).isNotNull()) for df in (queries, rows))
    (n_rows, r_bytes), (n_queries, q_bytes) = (df.agg(F.count("*"), F.avg(8 * F.size(weights_col))).first() for df in (rows, queries))
    fits = lambda size: max(1, int(BLOCK_BYTES // max(8.0, size or 8.0)))
    block_rows = block_rows or min(fits(r_bytes), max(LEAST_ROWS, -(-n_rows // BLOCKS)))
    query_rows = query_rows or fits(q_bytes)
    r_blocks, q_blocks = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // query_rows))
    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, `{id_col}` {rows.schema[id_col].dataType.simpleString()}, score bigint"

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        df = df.select(F.col(id_col).alias("i"), F.col(weights_col).cast("array<bigint>").alias("w"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_own)).cast("int").alias(own))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.column("i").combine_chunks().to_numpy().argsort(kind="stable")
        right = right.take(pa.array(order))
        ids, q_ids = right.column("i").combine_chunks().to_numpy(), left.column("i").combine_chunks().to_numpy()
        lists = dict((t, (r, w)) for t, r, w in postings(*_ragged(right, "w")))
        q_values, q_at = _ragged(left, "w")
        q_at = q_at - q_at[0]
        out_q, out_i, out_s = [], [], []
        for j, q in enumerate(q_ids):
            acc = np.zeros(len(ids), dtype=np.int64)
            for t, v in enumerate(q_values[q_at[j] : q_at[j + 1]].tolist()):
                if v and t in lists:
                    r, w = lists[t]
                    acc[r] += v * w  # a row has a term once
            other = np.flatnonzero(ids != q)
            at = best(acc[other], ids[other], k)
            out_q.append(np.full(len(at), q))
            out_i.append(ids[other][at])
            out_s.append(acc[other][at])
        cat = lambda x, like: np.concatenate(x) if x else np.array([], dtype=like.dtype)
        return pa.table({"query_id": cat(out_q, q_ids), id_col: cat(out_i, ids), "score": cat(out_s, np.zeros(0, np.int64))})

    q = blocks(queries, "qb", q_blocks, "rb", r_blocks)
    r = blocks(rows, "rb", r_blocks, "qb", q_blocks)
    tops = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(id_col))
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id and floor(scale * x) per component; rows with a null id, a null vector or a null or non-finite component are left out. The id
    column must not be called weights (ValueError)."""
    if id_col.lower() == "weights":
        raise ValueError("weights would be there twice")
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return df.filter(fine).select(id_col, F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("weights"))
