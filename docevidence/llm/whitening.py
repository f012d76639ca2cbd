"""Whitening of embeddings by a bit-sliced scatter matrix.

Components become integers. Over the distinct vectors each dimension is shifted to start at 0 and cut into bit planes; a plane's bits of many
rows are packed into words. The sum of products of two dimensions is then sum(2**(p + q) * popcount(plane p & plane q)), exact at any number of
rows, and what tasks send are the counts of ones by (dimension, dimension, p + q): their number does not grow with the rows. The
driver weighs them, centres them as integers (n * sum(xy) - sum(x) * sum(y)), divides by n squared, and takes eigenvectors of a matrix of the
dimensions' size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docevidence.llm.common import Scratch, map_batches

SCALE, OFFSET, LARGEST = 64, 1_000_000, 9e18
BLOCK_BYTES = 4 << 20
LEAST_SHARE = 1e-12  # a component with less of the trace than that is one without variance
LONG = 2**63


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


def integer_components(vector: Column, dims: int) -> Column:
    """floor(64 * c) + 1000000 for each component; a vector shorter than ``dims`` has zeros behind; products beyond 9e18 count as 9e18."""
    x = F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v.cast("double") * SCALE))) + OFFSET)
    return F.concat(x, F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(dims) - F.size(vector)))


def _matrix(b: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """Rows of equal length as an int64 matrix."""
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def planes(x: np.ndarray, least: np.ndarray, bits: int) -> np.ndarray:
    """The bit planes of x - least: row ``d * bits + p`` has bit p of dimension d for all rows of ``x``, 64 to a word."""
    shifted = x.view(np.uint64) - least.view(np.uint64)  # modulo 2**64, so any range of longs is right
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], bits, words * 8), dtype=np.uint8)
    for p in range(bits):
        packed = np.packbits(((shifted >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=0)
        out[:, p, : len(packed)] = packed.T
    return out.view(np.uint64).reshape(-1, words)


def scatter_counts(p: np.ndarray, dims: int, bits: int, out: np.ndarray) -> None:
    """Adds to ``out[d, e, s]``, for d <= e, the ones of plane a of d and plane b of e, over all a + b = s."""
    for d in range(dims):
        later = p[d * bits :]
        for a in range(bits):
            ones = np.bitwise_count(later & p[d * bits + a]).sum(axis=1, dtype=np.int64).reshape(-1, bits)
            out[d, d:, a : a + bits] += ones


@dataclass
class Whitening:
    """What was fitted: n distinct vectors, their sums, and the components by falling variance (eigenvalues, vectors as columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x - S / n as doubles, and sum((n * x - S)**2) as exact integers, None where a long can't hold it."""
        n, sums = self.n, self.sums
        most = max((abs(n * int(v) - s) for column, s in zip(x.T, sums, strict=True) for v in (column.min(), column.max())), default=0)
        if most * most * len(sums) < LONG and n * max(abs(int(x.min())), abs(int(x.max()))) < LONG:
            d = n * x - np.array(sums, dtype=np.int64)
            return d / n, (d * d).sum(axis=1).tolist()
        d = x.astype(object) * n - np.array(sums, dtype=object)
        squares = (d * d).sum(axis=1).tolist()
        return (d / n).astype(np.float64), [s if s < LONG else None for s in squares]

    def white(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the components' deviations; NaN along components without variance."""
        fine = self.values > LEAST_SHARE * self.trace
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(fine, (centred @ self.vectors) / np.sqrt(np.where(fine, self.values, np.nan)), np.nan)


def fit(vectors: DataFrame, dims: int, components: int) -> Whitening | None:
    """Components of the distinct integer vectors ``x`` (all of ``dims`` components); None for no vectors.

    Two passes: range and sums of each dimension, then the planes. Each task sends ``dims * (dims + 1) / 2 * (2 * bits - 1)`` counts at most.
    """

    def ranges(batches):
        n, low, high, total = 0, None, None, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                halves = [int(v) for v in (x >> 32).sum(axis=0)], [int(v) for v in (x & 0xFFFFFFFF).sum(axis=0)]
                own = [(h << 32) + v for h, v in zip(*halves, strict=True)]
                total = own if total is None else [a + c for a, c in zip(total, own, strict=True)]
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(low), pa.array(high), pa.array(map(str, total))], ["d", "n", "low", "high", "total"])

    found = vectors.mapInArrow(ranges, "d int, n bigint, low bigint, high bigint, total string")
    found = found.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).orderBy("d").collect()
    if not found:
        return None
    n, low, sums = found[0]["n"], np.array([r["low"] for r in found], dtype=np.int64), [int(r["total"]) for r in found]
    bits = max(1, max(r["high"] - r["low"] for r in found).bit_length())

    def counted(batches):
        out = np.zeros((dims, dims, 2 * bits - 1), dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, rows := max(64, BLOCK_BYTES // (8 * dims))):
                scatter_counts(planes(_matrix(b.slice(at, rows)), low, bits), dims, bits, out)
        d, e, s = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (d, e, s)] + [pa.array(out[d, e, s])], ["d", "e", "s", "ones"])

    ones = vectors.mapInArrow(counted, "d int, e int, s int, ones bigint").groupBy("d", "e", "s").agg(F.sum("ones").alias("ones"))
    products = [[0] * dims for _ in range(dims)]
    for r in ones.toLocalIterator():
        products[r["d"]][r["e"]] += r["ones"] << r["s"]
    shifted = [s - n * int(m) for s, m in zip(sums, low, strict=True)]
    v = np.zeros((dims, dims))
    for d in range(dims):
        for e in range(d, dims):
            v[d, e] = v[e, d] = (n * products[d][e] - shifted[d] * shifted[e]) / (n * n)  # integers up to the one division
    values, found_vectors = np.linalg.eigh(v)
    values, found_vectors = np.maximum(values[::-1], 0.0)[:components], found_vectors[:, ::-1][:, :components]
    signs = np.sign(found_vectors[np.abs(found_vectors).argmax(axis=0), np.arange(found_vectors.shape[1])])
    return Whitening(n, sums, values, found_vectors * signs, float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of (covariance of the whitened fit list - identity), over components with variance; 0 without any."""
    k = int((model.values > LEAST_SHARE * model.trace).sum())

    def products(batches):
        total, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for b in batches:
            for at in range(0, b.num_rows, rows := max(64, BLOCK_BYTES // (8 * len(model.sums)))):
                w = model.white(model.centred(_matrix(b.slice(at, rows)))[0])[:, :k]
                total, sums, n = total + w.T @ w, sums + w.sum(axis=0), n + len(w)
        if n:
            cells = [(i, j, float(total[i, j])) for i in range(k) for j in range(k)] + [(i, -1, float(sums[i])) for i in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["i", "j", "v"])

    if k == 0:
        return 0.0
    cells = {(r["i"], r["j"]): r["v"] / model.n for r in vectors.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max(abs(cells[i, j] - cells[i, -1] * cells[j, -1] - (i == j)) for i in range(k) for j in range(k))


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = 16) -> DataFrame:
    """For each row and component up to ``components``: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite components go; a null id stays. The longest vector has all dimensions, shorter
    ones (an empty one too) count as having zeros behind; products beyond 9e18 count as 9e18. The fit takes each distinct integer vector
    once, so copies weigh nothing; repeated rows and ids each get their rows. There are as many components as dimensions at most.
    Along a component without variance (one distinct vector, or constant dimensions) ``whitened`` is null and ``explained`` 0. ``deviation`` is
    null where a long can't hold it. No rows, or vectors without any component, give no rows.
    """
    work = Scratch(df.sparkSession, "whitening")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(finite(F.col("v")))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not dims:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.select("id", integer_components(F.col("v"), dims).alias("x"))
    distinct = work.save(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    model = fit(distinct, dims, components)
    error, k = identity_error(distinct, model), len(model.values)
    work.drop("fit")
    explained = model.values / model.trace if model.trace else np.zeros(k)

    def project(b: pa.RecordBatch) -> pa.RecordBatch:
        centred, deviation = model.centred(_matrix(b))
        which = np.repeat(np.arange(b.num_rows), k)
        white = pa.array(model.white(centred).ravel(), from_pandas=True)  # NaN becomes null
        repeated = lambda values: pa.array(np.tile(values, b.num_rows))
        return pa.RecordBatch.from_arrays(
            [b.column("id").take(pa.array(which)), repeated(np.arange(1, k + 1, dtype=np.int32)), repeated(np.full(k, model.n)), pa.array(deviation, pa.int64()).take(pa.array(which)), white, repeated(explained), repeated(np.full(k, error))],
            [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return map_batches(rows, project, schema, 2000)
