"""Token ids in a content-addressed store.

Rolling hashes cut each document's ids into chunks where the content says so. A chunk is named by the digest of its ids and
stored once; a document is a recipe, its chunk digests in order; recipes are written in ascending id order. A Merkle tree stands over
them: chunk digests under a document's root, document roots under a shard's, shard roots under a part's, part roots under the store's.
Reading back checks every level, both ways: what is there must be what the tree names, and all that the tree names must be there.

Files below ``path``, all Parquet in the shared folder: ``chunks`` (digest, n, payload), ``recipes`` (part, pos, id, row,
start_in_part, n_tokens, digests, root), ``manifest`` (part, shard, documents, ids, shard_root), ``root`` (one row: root, documents,
ids).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.llm.common import Scratch, map_batches, with_row_key
from docevidence.llm.hf_counts import library_encoder

WINDOW, LEAST, MEAN_BITS, MOST = 8, 256, 10, 8192
SHARD_DOCS = 4096
SEEN_CHUNKS = 100_000  # digests that a task remembers, so that it sends a payload about once
CRC_POLYNOMIAL = 0xEDB88320


def _gear(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 32-bit number for each id."""
    x = ids.astype(np.uint32) + np.uint32(0x9E3779B9)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(by)
    return x ^ (x >> np.uint32(16))


def cuts(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each document ids[start:end] the ends of its chunks. No window reaches over a document's start, since a chunk has
    at least LEAST > WINDOW ids."""
    g = _gear(ids)
    h = g.copy()
    for j in range(1, WINDOW):
        h[j:] += g[:-j] << np.uint32(j)
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        own, at = [], s
        near = marks[np.searchsorted(marks, s + LEAST) : np.searchsorted(marks, e)].tolist() if e - s > LEAST else []
        for m in [*near, e]:
            while m - at > MOST:
                at += MOST
                own.append(at)
            if m == e or m - at >= LEAST:
                if m > at:
                    own.append(m)
                at = m
        out.append(own)
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of crc32, bits reflected."""
    b, out = b.copy(), np.zeros_like(b)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(k)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(CRC_POLYNOMIAL), np.uint64(0))
    return out


def combine_crc(crc: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of the parts of each group end to end, from the parts' crc32 and sizes in bytes; ``starts``: each group's first part."""
    total = np.add.reduceat(size, starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(size)]))
    before = np.cumsum(size) - np.repeat((np.cumsum(size) - size)[starts], np.diff(np.r_[starts, len(size)]))
    after = (total[group] - before).astype(np.uint64)
    power = np.full(len(crc), 1 << 31, dtype=np.uint64)  # x^0
    square = np.array([1 << 23], dtype=np.uint64)  # x^8
    while after.any():
        odd = (after & np.uint64(1)).astype(bool)
        power[odd] = _times(np.repeat(square, odd.sum()), power[odd])
        square = _times(square, square)
        after >>= np.uint64(1)
    return np.bitwise_xor.reduceat(_times(power, crc.astype(np.uint64)), starts)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes, appends ``end_id`` to each document, and writes chunks, recipes, manifest and root.

    A null text counts as empty (the end id alone). Repeated ids and rows stay, each with its own recipe; rows of a null id come first.
    An empty table makes a store without documents. A task sends the payload of a chunk that it meets again once only, so a group of
    copies sends a payload per task, not per row.
    """
    spark = docs.sparkSession
    rows = with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row")

    def cut(b: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
        enc = library_encoder(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        packed = [enc(t) + end for t in b.column("text").to_pylist()]
        size = [len(p) // 4 for p in packed]
        ends = np.cumsum(size)
        starts = ends - size
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        wide = ids.astype("<u2") if ids.max() < 1 << 16 else ids
        recipe, recipe_ends, roots = [], [0], []  # all documents' digests end to end, and where each document's end
        digests, sizes, payloads, fresh_ends = [], [], [], [0]
        for start, own in zip(starts.tolist(), cuts(ids, starts, ends), strict=True):
            for e in own:
                digest = hashlib.sha256(ids[start:e]).digest()
                recipe.append(digest)
                if digest not in seen:
                    if len(seen) >= SEEN_CHUNKS:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    sizes.append(e - start)
                    payloads.append(wide[start:e].tobytes())
                start = e
            roots.append(hashlib.sha256(b"".join(recipe[recipe_ends[-1] :])).digest())
            recipe_ends.append(len(recipe))
            fresh_ends.append(len(digests))
        chunk = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary())], ["digest", "n", "payload"])
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(size, pa.int64()), lists(recipe_ends, pa.array(recipe, pa.binary())), pa.array(roots, pa.binary()), lists(fresh_ends, chunk)], ["id", "row", "n_tokens", "digests", "root", "fresh"])

    schema = "id bigint, row bigint, n_tokens bigint, digests array<binary>, root binary, fresh array<struct<digest binary, n int, payload binary>>"
    work = Scratch(spark, "id-store")
    encoded = work.save(map_batches(rows, cut, schema, 5000, 16 << 20, state=set), "encoded")

    chunks = encoded.select(F.explode("fresh").alias("c")).select("c.*")
    first = F.row_number().over(Window.partitionBy("digest").orderBy("n")) == 1  # equal digests, equal payloads
    chunks.withColumn("first", first).filter("first").drop("first").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = encoded.drop("fresh")

    def number(batches):
        part, pos, at = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(pos, pos + len(n))), b.column("id"), b.column("row"), pa.array(at + np.cumsum(n) - n), b.column("n_tokens"), b.column("digests"), b.column("root")],
                ["part", "pos", "id", "row", "start_in_part", "n_tokens", "digests", "root"],
            )
            pos, at = pos + len(n), at + int(n.sum())

    ordered = recipes.repartitionByRange(F.col("id").asc_nulls_first(), "row").sortWithinPartitions(F.col("id").asc_nulls_first(), "row")
    ordered.mapInArrow(number, "part int, pos bigint, id bigint, row bigint, start_in_part bigint, n_tokens bigint, digests array<binary>, root binary").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/recipes")
    work.drop("encoded")
    _shards(spark, path).write.mode("overwrite").parquet(f"{path}/manifest")
    _root(spark.read.parquet(f"{path}/manifest")).write.mode("overwrite").parquet(f"{path}/root")


def _over(roots: str, order: str) -> Column:
    """The digest over a group's digests in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, roots))), lambda s: F.hex(s[roots])), ""), 256)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """Shard roots over the document roots of at most SHARD_DOCS recipes."""
    shard = spark.read.parquet(f"{path}/recipes").select("part", F.floor(F.col("pos") / SHARD_DOCS).alias("shard"), "pos", "n_tokens", "root")
    return shard.groupBy("part", "shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"), F.unhex(_over("root", "pos")).alias("shard_root"))


def _root(shards: DataFrame) -> DataFrame:
    """The store's root over the roots of its parts, and what it holds. A part is one written file, so one row gathers a digest a file."""
    parts = shards.groupBy("part").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.unhex(_over("shard_root", "shard")).alias("part_root"))
    return parts.agg(_over("part_root", "part").alias("root"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"))


def check_store(spark: SparkSession, path: str) -> None:
    """Raises ValueError where the recipes are not those of the manifest, or the manifest is not that of the root."""
    found, kept = _shards(spark, path), spark.read.parquet(f"{path}/manifest")
    keys = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("part", "shard", "documents", "ids", "shard_root")]
    odd = found.alias("f").join(kept.alias("k"), (F.col("f.part") == F.col("k.part")) & (F.col("f.shard") == F.col("k.shard")), "full").filter(~(keys[0] & keys[1] & keys[2] & keys[3] & keys[4]))
    if (first := odd.select(F.coalesce("f.part", "k.part"), F.coalesce("f.shard", "k.shard")).first()) is not None:
        raise ValueError(f"shard {first[1]} of part {first[0]} is not what the manifest names")
    if sorted(map(tuple, _root(kept).collect())) != sorted(map(tuple, spark.read.parquet(f"{path}/root").collect())):
        raise ValueError("the manifest is not what the store's root names")


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone.

    The tree is checked first (check_store). Then, as rows are read, each payload is hashed against its digest and each recipe against
    its root; a mismatch or a missing chunk fails the job. The checksum of a document comes from its chunks' checksums, so no payload
    moves. A store without documents gives no rows.
    """
    check_store(spark, path)

    def verify(b: pa.RecordBatch) -> pa.RecordBatch:
        crc = []
        for digest, n, payload in zip(*(b.column(c).to_pylist() for c in ("digest", "n", "payload")), strict=True):
            ids = np.frombuffer(payload, dtype="<u2" if len(payload) == 2 * n else "<u4").astype("<u4").tobytes()
            if len(ids) != 4 * n or hashlib.sha256(ids).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not hold what its digest names")
            crc.append(zlib.crc32(ids))
        return pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    chunks = map_batches(spark.read.parquet(f"{path}/chunks").select("digest", "n", "payload"), verify, "digest binary, n int, crc bigint")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("row", F.posexplode("digests").alias("no", "digest")).join(chunks, "digest", "left")
    parts = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "digest", "n", "crc"))).alias("c"))

    def assemble(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("c")
        flat = lists.flatten()
        n, crc = flat.field("n"), flat.field("crc")
        if n.null_count or crc.null_count:
            raise ValueError("a recipe names a chunk that is not in the store")
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        n, digests = n.to_numpy().astype(np.int64), flat.field("digest").to_pylist()
        ends = np.r_[starts[1:], len(n)]
        roots = [hashlib.sha256(b"".join(digests[s:e])).digest() for s, e in zip(starts, ends, strict=True)]
        crc = combine_crc(crc.to_numpy(), 4 * n, starts).astype(np.int64)
        return pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.add.reduceat(n, starts)), pa.array(crc), pa.array(roots, pa.binary())], ["row", "read_tokens", "ids_crc32", "read_root"])

    docs = map_batches(parts, assemble, "row bigint, read_tokens bigint, ids_crc32 bigint, read_root binary")
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each file part; a window over them all is small
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    out = recipes.select("part", "id", "row", "start_in_part", "n_tokens", "root").join(docs, "row", "left").join(bases, "part", "left")
    holds = F.coalesce((F.col("root") == F.col("read_root")) & (F.col("n_tokens") == F.col("read_tokens")), F.lit(False))
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", F.when(holds, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a recipe does not match its root")).cast("bigint")).alias("ids_crc32"))
