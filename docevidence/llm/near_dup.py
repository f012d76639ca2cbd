"""Near-duplicates: MinHash signatures, a multi-index Hamming join, links confirmed on full shingle sets, components.

A signature has SYMBOLS min-wise hashes of 16 bits. The least similarity that links sets the largest distance: so many symbols that
at most MOST_MISSED of the pairs of just that similarity differ in more. Two signatures that differ in at most so many symbols
differ, by the pigeonhole principle, in at most one symbol of one of distance // 2 + 1 chunks; so each chunk is indexed once for each
symbol left out, and every pair under the threshold meets in a bucket. (At a similarity of 0.85 that is 23 of 64 symbols and 12
chunks, at 0.80 28 and 15.) ``exact`` indexes a prefix of the sets themselves instead, which misses no pair.

Equal shingle sets are one vertex. Vertices that meet in buckets are gathered around pivots: each goes to the bucket leader with which it
shares most buckets, and where the members of a bucket have gone to several pivots, those of the smaller parties are guests of the
largest one's as well. So each pair of a bucket is together around some pivot, while a vertex has a row for each pivot, not for each
bucket. It is compared with its pivot in full and keeps the difference of the two sets. Vertices linked with the pivot are one component;
any other, loose one is compared with all around the pivot by their differences alone: with D the difference of a set to the pivot's,
the sets of x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles. Blocks of loose ones meet blocks of all in a task, and only links that
join two components leave it. No group of copies is expanded into rows for its pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docevidence.llm.common import Scratch, map_batches, with_row_key

WORDS = 5
SYMBOLS, MOST_MISSED = 64, 1e-5
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20  # about what a block of differences holds at most
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _numbers(256, 1)
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = _numbers(WORDS, 2) | np.uint64(1)
_SHORT = _numbers(WORDS, 3)
_TIMES = _numbers(SYMBOLS, 4) | np.uint64(1)
_LEFT_OUT = _numbers(SYMBOLS, 5)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; the words of all texts are hashed together.

    Words are runs of anything but the six ASCII white space characters, A-Z in lower case. Fewer than WORDS words make one
    shingle, none make none.
    """
    data = [t.encode().lower() for t in texts]
    at = np.cumsum([0] + [len(d) + 1 for d in data])
    a = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    space = _SPACE[a]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    power = np.full(len(a), _BASE, dtype=np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * power)]
    word = total[ends] - total[starts]
    back = np.full(len(a), _BACK, dtype=np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    word = _mix(word * back[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, at)
    n = len(word) - WORDS + 1
    runs = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(WORDS):
        runs += word[k : k + len(runs)] * _PLACE[k]
    runs = _mix(runs)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= WORDS:
            out.append(np.unique(runs[s : e - WORDS + 1]))
        elif e > s:
            out.append(_mix((word[s:e] * _PLACE[: e - s]).sum(keepdims=True) + _SHORT[e - s]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SYMBOLS 16-bit min-wise hashes of each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SYMBOLS), dtype="<u2")
    for j in range(SYMBOLS):
        out[:, j] = _mix(np.minimum.reduceat(flat * _TIMES[j], starts)) >> np.uint64(48)
    return out


def largest_distance(least_percent: int) -> int:
    """The fewest symbols that at most MOST_MISSED of the pairs at ``least_percent`` differ in more of."""
    p = least_percent / 100
    most, beyond = SYMBOLS, 0.0
    while most and (beyond := beyond + comb(SYMBOLS, most) * (1 - p) ** most * p ** (SYMBOLS - most)) <= MOST_MISSED:
        most -= 1
    if most == SYMBOLS:
        raise ValueError(f"{SYMBOLS} symbols can't find pairs at {least_percent} percent")
    return most


def chunks(distance: int) -> np.ndarray:
    """Each symbol's chunk."""
    return np.arange(SYMBOLS) * (distance // 2 + 1) // SYMBOLS


def index_keys(sig: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """For each symbol the key of its chunk without it."""
    part = _mix(sig.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(16)) + np.uint64(0x51ED2701))
    bounds = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    whole = np.add.reduceat(part, bounds, axis=1)
    return _mix(whole[:, chunk] - part + _LEFT_OUT).view(np.int64)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)


def components(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(vid, comp): the smallest vertex that each vertex of ``edges`` (a, b) is connected with.

    Alternates large-star and small-star steps on the edge table until it no longer changes; each step is written to the
    shared folder. The least neighbours are written before they are joined, so that both sides of the join are shuffled for it alone and
    Spark can split the edges of a vertex that many others hang on.
    """

    def star(e: DataFrame) -> DataFrame:
        least = work.save(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        return e.join(least.hint("shuffle_merge"), "u")

    old, state, k = None, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), 0
    while True:
        both = state.union(state.select("v", "u"))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = work.save(large, f"{name}-{k}-large")
        small = star(large).select("u", "v", "m")
        state = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        state = work.save(state, f"{name}-{k}")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{k}-large", *([f"{name}-{k - 1}"] if k else []))
        work.drop(f"{name}-least")
        if mark == old:
            return state.groupBy(F.col("u").alias("vid")).agg(F.min("v").alias("comp"))
        old, k = mark, k + 1


def prefix_keys(sets: list[np.ndarray], least_percent: int) -> list[np.ndarray]:
    """So many of each set's smallest shingles that two sets of the least similarity share one of them."""
    return [s[: len(s) + len(s) * -least_percent // 100 + 1].view(np.int64) for s in sets]


def _lists(column: pa.Array, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    """All numbers of packed lists end to end, and each list's length."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), dtype=kind), np.array([len(p) // np.dtype(kind).itemsize for p in packed], dtype=np.int64)


def around_pivot(loose: pa.Table, others: pa.Table, least_percent: int) -> list[tuple[int, int]]:
    """Links between loose rows and others (vid, comp, n, d: packed difference to the pivot) that join their components."""
    vid, comp, n = (others.column(c).to_numpy().copy() for c in ("vid", "comp", "n"))
    flat, size = _lists(others.column("d").combine_chunks())
    order = np.argsort(flat, kind="stable")
    holder, (known, first, count) = np.repeat(np.arange(len(vid)), size)[order], np.unique(flat[order], return_index=True, return_counts=True)
    own, lengths = _lists(loose.column("d").combine_chunks())
    at = np.searchsorted(known, own) if len(known) else np.zeros(len(own), np.int64)
    hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own) if len(known) else np.zeros(len(own), bool)
    out, joined, stop = [], {}, np.cumsum(lengths)

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    for k, (x, x_comp, x_n) in enumerate(zip(*(loose.column(c).to_pylist() for c in ("vid", "comp", "n")), strict=True)):
        mine = slice(stop[k] - lengths[k], stop[k])
        found = at[mine][hit[mine]]
        c = count[found]
        rows = holder[np.repeat(first[found] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        apart = lengths[k] + size - 2 * np.bincount(rows, minlength=len(vid))
        linked = np.flatnonzero((100 * (x_n + n - apart) >= least_percent * (x_n + n + apart)) & (vid != x))
        for y in linked[np.unique(comp[linked], return_index=True)[1]].tolist():
            a, b = root(x_comp), root(int(comp[y]))
            if a != b:
                joined[max(a, b)] = min(a, b)
                out.append((min(x, int(vid[y])), max(x, int(vid[y]))))
    return out


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_percent: int = 85, row_col: str | None = None, exact: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the smallest id it is linked with over any number of links, its own
    included) and kept (id = component_id). Rows are linked if 100 * intersection >= least_percent * union of their sets.

    Null texts count as empty; a text without words is linked with nothing, so each such row is its own component. Repeated
    ids stay as rows of their own; all of a component's rows with its smallest id count as kept. An empty table gives none.
    ``row_col`` names a unique integer key of the rows, the same at every reading, which is then returned too. ``exact`` finds the pairs
    of a component without signatures, for about as many index rows.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "near-dup")
    distance = largest_distance(least_percent)
    chunk = chunks(distance)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = rows if row_col else work.save(with_row_key(rows, "row"), "rows")

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column("text").to_pylist())
        full = [i for i, s in enumerate(sets) if len(s)]
        if exact:
            index = dict(zip(full, prefix_keys([sets[i] for i in full], least_percent), strict=True))
        else:
            index = dict(zip(full, signatures([sets[i] for i in full]), strict=True)) if full else {}
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([index[i].tobytes() if i in index else None for i in range(len(sets))], pa.binary())], ["id", "row", "n", "digest", "sig"])

    kind = rows.schema["id"].dataType.simpleString()
    signed = work.save(map_batches(rows, sign, f"id {kind}, row bigint, n bigint, digest binary, sig binary", 500), "signed")
    vertices = work.save(signed.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("vid"), F.min("sig").alias("sig")), "vertices")

    def keys(b: pa.RecordBatch) -> pa.RecordBatch:
        if exact:
            flat, size = _lists(b.column("sig"), "<i8")
        else:
            k = index_keys(_sigs(b.column("sig")), chunk)
            flat, size = k.ravel(), np.full(len(k), SYMBOLS)
        return pa.RecordBatch.from_arrays([b.column("vid"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))], ["vid", "keys"])

    indexed = map_batches(vertices.select("vid", "sig"), keys, "vid bigint, keys array<bigint>").select("vid", F.explode("keys").alias("key"))
    leaders = indexed.groupBy("key").agg(F.min("vid").alias("leader"), F.max("vid").alias("last")).filter("leader < last").select("key", "leader")
    # What is joined to a hot key's rows is saved first, so that both sides are shuffled and Spark can split the hot side.
    leaders = work.save(leaders, "leaders")
    buckets = work.save(indexed.join(leaders.hint("shuffle_merge"), "key"), "buckets")

    # Each vertex's pivot; then, of buckets whose members have several, the largest party's pivot for the others too.
    pivots = buckets.groupBy("vid", "leader").agg(F.count("*").alias("n")).groupBy("vid").agg(F.max(F.struct("n", (-F.col("leader")).alias("p")))["p"].alias("p"))
    pivots = work.save(pivots.select("vid", (-F.col("p")).alias("pivot")), "pivots")
    placed = work.save(buckets.select("key", "vid").join(pivots, "vid"), "placed")
    parties = placed.groupBy("key", "pivot").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parties"), F.max(F.struct("n", (-F.col("pivot")).alias("p")))["p"].alias("p"))
    hosts = work.save(parties.filter("parties > 1").select("key", (-F.col("p")).alias("host")), "hosts")
    guests = placed.join(hosts, "key").filter("pivot <> host").select(F.col("host").alias("pivot"), "vid")
    entries = work.save(pivots.select("pivot", "vid").union(guests).distinct().filter("pivot <> vid"), "entries")

    met = entries.select(F.col("vid").alias("row")).union(entries.select("pivot")).distinct()
    texts = work.save(rows.select("row", "text").join(met.hint("shuffle_merge"), "row", "left_semi"), "texts")

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.column("tx").to_pylist() + b.column("tp").to_pylist()
        at = {t: i for i, t in enumerate(dict.fromkeys(names))}
        sets = shingle_sets(list(at))
        n, d, linked = [], [], []
        for x, p in zip(names[: b.num_rows], names[b.num_rows :], strict=True):
            x, p = sets[at[x]], sets[at[p]]
            apart = np.setxor1d(x, p, assume_unique=True)
            n.append(len(x))
            d.append(apart.tobytes())
            linked.append(100 * (len(x) + len(p) - len(apart)) >= least_percent * (len(x) + len(p) + len(apart)))
        return pa.RecordBatch.from_arrays([b.column("pivot"), b.column("vid"), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(linked, pa.bool_())], ["pivot", "vid", "n", "d", "linked"])

    both = entries.join(texts.select(F.col("row").alias("vid"), F.col("text").alias("tx")), "vid").join(texts.select(F.col("row").alias("pivot"), F.col("text").alias("tp")), "pivot")
    compared = work.save(map_batches(both, compare, "pivot bigint, vid bigint, n bigint, d binary, linked boolean", 200), "compared")
    links = work.save(compared.filter("linked").select(F.least("pivot", "vid").alias("a"), F.greatest("pivot", "vid").alias("b")), "links-1")
    comps = work.save(components(links, work, "c1"), "comps-1")

    # Around pivots with loose rows and more than one component: blocks of loose ones against blocks of all.
    around = compared.join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    cost = F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("d")) / BLOCK_BYTES)
    loose_cost = F.greatest(F.count_if(~F.col("linked")) / BLOCK_ROWS, F.sum(F.when(~F.col("linked"), F.octet_length("d"))) / BLOCK_BYTES)
    mixed = around.groupBy("pivot").agg(F.ceil(cost).alias("blocks"), F.ceil(loose_cost).alias("loose_blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = work.save(mixed.filter("lo <> hi AND loose_blocks > 0").drop("lo", "hi"), "mixed")
    around = work.save(around.join(mixed, "pivot"), "around")
    part = lambda n: F.pmod(F.xxhash64("vid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    right = around.select("pivot", every("loose_blocks").alias("i"), part("blocks").alias("j"), "vid", "comp", "n", "d")
    left = work.load("around").filter("NOT linked").select("pivot", part("loose_blocks").alias("i"), every("blocks").alias("j"), "vid", "comp", "n", "d")

    def meet(loose: pa.Table, others: pa.Table) -> pa.Table:
        found = around_pivot(loose, others, least_percent) if loose.num_rows and others.num_rows else []
        return pa.table({"a": np.array([x[0] for x in found], np.int64), "b": np.array([x[1] for x in found], np.int64)})

    joined = left.groupBy("pivot", "i", "j").cogroup(right.groupBy("pivot", "i", "j")).applyInArrow(meet, "a bigint, b bigint")
    links = work.save(links.union(joined), "links-2")
    comps = work.save(components(links, work, "c2"), "comps-2")

    lowest = signed.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("vid"), F.min("id").alias("least"))
    lowest = lowest.join(comps, "vid", "left").select("digest", F.coalesce("comp", "vid").alias("comp"), "least")
    ids = lowest.groupBy("comp").agg(F.min("least").alias("component"))
    classes = work.save(lowest.join(ids, "comp").select("digest", "component"), "classes")
    work.drop("vertices", "leaders", "buckets", "pivots", "placed", "hosts", "entries", "texts", "compared", "mixed", "around", "links-1", "comps-1", "links-2", "comps-2")
    out = signed.select("id", "row", "n", "digest").join(classes, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(*([F.col("row").alias(row_col)] if row_col else []), F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
