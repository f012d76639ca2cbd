"""Cosine top-k by blocks: a group's vectors and queries meet in blocks of bounded size, each scored by one matrix product.

The number of a group's blocks follows from its counted rows. Only groups of more than one block are joined to their counts, so that
table is short; the join is salted, as one group may hold most rows. Rows of a block come sorted, queries first, and vectors stream past them
batch by batch, so a task holds a block's queries and one batch. The matrix product only chooses candidates; their scores are added up
component by component, so equal vectors score alike wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR_ROWS, QUERY_ROWS = 65_536, 4096  # of a block
SALTS = 32
SCORES_AT_ONCE, PRODUCTS_AT_ONCE = 1 << 21, 1 << 21
SLACK = 1e-9  # a matrix product's cosines differ from those added up in order by less


def _matrix(lists: pa.ListArray, dims: int | None) -> np.ndarray:
    """Rows of one length as doubles; nulls become NaN."""
    if (lengths := np.unique(np.diff(lists.offsets.to_numpy()))).size > 1 or dims not in (None, *lengths.tolist()):
        raise ValueError("query and vector have different dimensions")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added up component by component."""
    out = np.zeros(len(a))
    for at in range(0, len(a), step := max(1, PRODUCTS_AT_ONCE // max(1, a.shape[1]))):
        if a.shape[1]:
            out[at : at + step] = np.cumsum(a[at : at + step] * b[at : at + step], axis=1)[:, -1]
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(in_order(x, x))


def _safe(dots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Cosines; 0 where a length is 0 or anything is not a number."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = dots / lengths
    return np.where(np.isfinite(out), out, 0.0)


class _Best:
    """The k best so far of a block's queries: ``add`` takes a batch of vectors."""

    def __init__(self, k: int, skip_own: bool):
        self.k, self.skip_own = k, skip_own
        self.parts: list[pa.RecordBatch] = []
        self.kept: tuple | None = None

    def ask(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def close(self, names: list[str]) -> pa.Table | None:
        """(query columns, vector id, score) of the best."""
        if self.kept is None:
            return None
        row, found, score = self.kept
        asked = self.asked.take(pa.array(row)).select(names)
        return asked.append_column("found", found).append_column("score", pa.array(score))

    def add(self, ids: pa.Array, values: pa.ListArray) -> None:
        if not self.parts:
            return
        if self.kept is None:
            self.asked = pa.Table.from_batches(self.parts)
            self.q = _matrix(self.asked.column("values").combine_chunks(), None)
            self.qn = norms(self.q)
            self.own = self.asked.column("asker").combine_chunks() if self.skip_own else None
            self.kept = (np.zeros(0, np.int64), ids.slice(0, 0), np.zeros(0))
        v = _matrix(values, self.q.shape[1])
        vn = norms(v)
        rows, columns = [], []
        with np.errstate(invalid="ignore", over="ignore"):
            for at in range(0, len(self.q), step := max(1, SCORES_AT_ONCE // max(1, len(v)))):
                alike = _safe(self.q[at : at + step] @ v.T, self.qn[at : at + step, None] * vn)
                if self.skip_own:
                    mine = np.array(self.own.slice(at, step).to_pylist(), dtype=object)[:, None] == np.array(ids.to_pylist(), dtype=object)
                    alike[mine] = -np.inf
                bar = np.partition(alike, -self.k, axis=1)[:, -self.k] if alike.shape[1] > self.k else np.full(len(alike), -2.0)
                r, c = np.nonzero((alike >= bar[:, None] - SLACK) & (alike > -np.inf))
                rows.append(r + at)
                columns.append(c)
            row, column = np.concatenate(rows), np.concatenate(columns)
            score = np.empty(len(row))
            for at in range(0, len(row), step := max(1, PRODUCTS_AT_ONCE // max(1, v.shape[1]))):
                r, c = row[at : at + step], column[at : at + step]
                score[at : at + step] = _safe(in_order(self.q[r], v[c]), self.qn[r] * vn[c])
        self._merge(row, ids.take(pa.array(column)), score)

    def _merge(self, row: np.ndarray, found: pa.Array, score: np.ndarray) -> None:
        row, score = np.r_[self.kept[0], row], np.r_[self.kept[2], score]
        found = pa.concat_arrays([self.kept[1], found])
        t = pa.table({"row": row, "less": -score, "found": found}).sort_by([("row", "ascending"), ("less", "ascending"), ("found", "ascending")])
        r = t.column("row").to_numpy()
        place = np.arange(len(r)) - np.searchsorted(r, r)
        at = pa.array(np.flatnonzero(place < self.k))
        t = t.take(at)
        self.kept = (t.column("row").to_numpy(), t.column("found").combine_chunks(), -t.column("less").to_numpy())


def best_in_blocks(queries: DataFrame, vectors: DataFrame, on: list[str], k: int, query_id: str, vector_id: str, values: str, skip_own: bool = False, vector_rows: int = VECTOR_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, *on, vector_id, score): of each block of a query's group its k best at least, by cosine, ties to the smaller id."""
    group = F.to_json(F.struct(*on))
    placed = F.lit(True)
    for c in on:
        placed = placed & F.col(c).isNotNull()
    there = placed & F.col(values).isNotNull()
    own = [F.col(c).alias(f"on_{n}") for n, c in enumerate(on)]
    lists = F.transform(values, lambda x: x.cast("double")).alias("values")
    q = queries.filter(there & F.col(query_id).isNotNull()).select(group.alias("g"), F.col(query_id).alias("asker"), *own, lists)
    v = vectors.filter(there & F.col(vector_id).isNotNull()).select(group.alias("g"), F.col(vector_id).alias("found"), lists)

    sizes = [df.filter(placed).groupBy(group.alias("g")).agg(F.count("*").alias(n)) for df, n in ((vectors, "nv"), (queries, "nq"))]  # null values too: so they need not be made for this
    counts = sizes[0].join(sizes[1], "g")
    large = counts.select("g", F.ceil(F.col("nv") / vector_rows).cast("int").alias("v_blocks"), F.ceil(F.col("nq") / query_rows).cast("int").alias("q_blocks")).filter("v_blocks > 1 OR q_blocks > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def dealt(df: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        df = df.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(large, ["g", "salt"], "left")
        block = F.pmod(F.xxhash64(key, F.lit(1)), F.coalesce(f"{mine}_blocks", F.lit(1))).cast("int")
        return df.withColumn(f"{mine}_block", block).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_blocks", F.lit(1)) - 1))).drop("salt", "v_blocks", "q_blocks")

    kinds = {c: queries.schema[c].dataType.simpleString() for c in (query_id, *on)}
    q = dealt(q, "asker", "q", "v").withColumn("found", F.lit(None).cast(vectors.schema[vector_id].dataType)).withColumn("side", F.lit(0))
    v = dealt(v, "found", "v", "q").withColumn("asker", F.lit(None).cast(queries.schema[query_id].dataType)).withColumn("side", F.lit(1))
    for n, c in enumerate(on):
        v = v.withColumn(f"on_{n}", F.lit(None).cast(queries.schema[c].dataType))
    keys = ["g", "v_block", "q_block"]
    both = q.unionByName(v).repartition(*keys).sortWithinPartitions(*keys, "side")
    names = ["asker", *(f"on_{n}" for n in range(len(on)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None
        for b in batches:
            if not b.num_rows:
                continue
            labels = list(zip(*(b.column(c).to_pylist() for c in keys), b.column("side").to_pylist(), strict=True))
            ends = [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]] + [len(labels)]
            start = 0
            for end in ends:
                *own_key, side = labels[start]
                if own_key != key:
                    if best is not None and (out := best.close(names)) is not None:
                        yield from out.to_batches()
                    key, best = own_key, _Best(k, skip_own)
                part = b.slice(start, end - start)
                if side == 0:
                    best.ask(part.select(["values", *names]))
                else:
                    best.add(part.column("found"), part.column("values"))
                start = end
        if best is not None and (out := best.close(names)) is not None:
            yield from out.to_batches()

    schema = ", ".join([*(f"`{c}` {kinds[o]}" for c, o in zip(names, (query_id, *on), strict=True)), f"found {vectors.schema[vector_id].dataType.simpleString()}", "score double"])
    out = both.mapInArrow(run, schema)
    return out.select(F.col("asker").alias(query_id), *(F.col(f"on_{n}").alias(c) for n, c in enumerate(on)), F.col("found").alias(vector_id), "score")
