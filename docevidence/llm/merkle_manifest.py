"""A Merkle manifest of a data set, with incremental witnesses.

Leaves of a group stand in order; every ARITY consecutive nodes (the last run may have fewer, even one) have a parent, until one node remains,
the group's subroot. The subroots in order are the leaves of the same tree once more, which gives the root.

Positions are dealt to aligned blocks of ARITY**BLOCK_LEVELS leaves, and a task appends a block's leaves one after the other. A run of leaves that
completes opens a subtree, which holds one partial witness for all its leaves; each later completion of its siblings adds a level to the
witnesses of the subtrees beneath. What a block ends with, its root, is a further append of the next round, which so extends the
witnesses of whole blocks. Going down again, each round's witnesses are joined to the blocks beneath, and a leaf's own is its run, its
block's and those above, end to end. A round leaves a node for each 4,096, so few rounds do at any size; a task holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.llm.common import Scratch, fields, map_batches

ARITY = 8
BLOCK_LEVELS = 4  # a block has ARITY**4 leaves
DIGEST = 32


def over(digests: list[bytes]) -> bytes:
    """A parent's digest: over its children's in hexadecimal, end to end."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def levels_over(n: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def step(place: int, run: list[bytes]) -> bytes:
    """One level of a witness: the node's place in its run, how many the run has, and the others' digests."""
    return bytes((place, len(run))) + b"".join(run[:place] + run[place + 1 :])


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The levels of a witness as (place, the others' digests)."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        end = at + 2 + (n - 1) * DIGEST
        yield place, [witness[k : k + DIGEST] for k in range(at + 2, end, DIGEST)]
        at = end


def proof(witness: bytes) -> str:
    """The digest over all siblings of a witness, level by level."""
    return over([d for _, others in steps(witness) for d in others]).hex()


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for place, others in steps(witness):
        leaf = over([*others[:place], leaf, *others[place:]])
    return leaf


class Block:
    """The append of one aligned block. ``runs``: [leaves, witness from the second level on], in order; a run holds its leaves' first
    level itself."""

    def __init__(self, levels: int):
        self.levels, self.runs, self.root = levels, [], b""
        self.open: list[list[tuple[bytes, list]]] = [[] for _ in range(levels + 1)]  # of each level, nodes without a parent yet

    def append(self, digest: bytes) -> None:
        self._put(0, digest, [])

    def _put(self, level: int, digest: bytes, under: list) -> None:
        self.open[level].append((digest, under))
        if level == self.levels:
            self.root = digest
        elif len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        nodes, self.open[level] = self.open[level], []
        run = [d for d, _ in nodes]
        if level == 0:
            under = [[run, bytearray()]]
            self.runs += under
        else:
            for place, (_, subtrees) in enumerate(nodes):
                more = step(place, run)
                for own in subtrees:
                    own[1] += more
            under = [own for _, subtrees in nodes for own in subtrees]
        self._put(level + 1, over(run), under)

    def close(self) -> None:
        """Completes the runs that are still open."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        if self.levels == 0:
            self.runs = [[[self.root], bytearray()]]


def _positions(work: Scratch, name: str, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a node in its group ``g``, and ``n``, the group's size.

    A range partitioning gives the order, whatever a group's size; places are counted inside partitions, and what stands before a partition
    comes from a table with a row for each group and partition.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    ordered = work.save(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    so_far = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    bases = work.save(counts.select("g", "part", (F.sum("here").over(so_far) - F.col("here") - F.col("first")).alias("base"), F.sum("here").over(Window.partitionBy("g")).alias("n")), f"{name}-bases")
    return ordered.withColumn("part", part).join(bases, ["g", "part"]).withColumn("pos", F.col("at") + F.col("base")).drop("at", "part", "base")


def _append(nodes: DataFrame, kept: list[str], block_levels: int) -> DataFrame:
    """Rows (g, pos, n, digest, kept columns) to a row for each run of leaves: g, block, run, n, levels, digests, witness, block_root, and the kept
    columns as arrays. ``levels``: how many the block has."""
    rows = nodes.select("g", F.floor(F.col("pos") / ARITY**block_levels).alias("block"), "pos", "n", "digest", *kept).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    names = ["g", "block", "run", "n", "levels", "digests", "witness", "block_root", *kept]
    types = ["string", "bigint", "int", "bigint", "int", "binary", "binary", "binary", *(f"array<{nodes.schema[c].dataType.simpleString()}>" for c in kept)]
    arrow = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def closed(key: tuple, n: int, block: Block, own: list[list]) -> list[tuple]:
        block.close()
        out, at = [], 0
        for run, (leaves, witness) in enumerate(block.runs):
            out.append((*key, run, n, block.levels, b"".join(leaves), bytes(witness), block.root, *(x[at : at + len(leaves)] for x in own)))
            at += len(leaves)
        return out

    def appended(batches):
        key, n, block, own, kept_types, ready = None, 0, None, [], [], []
        for b in batches:
            kept_types = [pa.list_(b.schema.field(c).type) for c in kept]
            columns = [b.column(c).to_pylist() for c in ("g", "block", "n", "digest", *kept)]
            for g, number, size, digest, *values in zip(*columns, strict=True):
                if (g, number) != key:
                    if block is not None:
                        ready += closed(key, n, block, own)
                    key, n, own = (g, number), size, [[] for _ in kept]
                    block = Block(min(levels_over(size), block_levels))
                block.append(digest)
                for x, v in zip(own, values, strict=True):
                    x.append(v)
            if ready:
                yield batch(ready, kept_types)
                ready = []
        if block is not None:
            yield batch(closed(key, n, block, own), kept_types)

    def batch(rows: list[tuple], kept_types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow + kept_types, strict=True)], names)

    return rows.mapInArrow(appended, ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True)))


def _climb(work: Scratch, name: str, nodes: DataFrame, kept: list[str], block_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Appends until each group has one node: the runs of each round, and (g, digest) of the groups' roots."""
    rounds: list[DataFrame] = []
    while True:
        runs = work.save(_append(nodes, [] if rounds else kept, block_levels), f"{name}-runs-{len(rounds)}")
        rounds.append(runs)
        nodes = runs.filter("run = 0").select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / ARITY**block_levels).alias("n"), F.col("block_root").alias("digest"))
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds, nodes.select("g", "digest")


def _descend(rounds: list[DataFrame], above: DataFrame, block_levels: int) -> DataFrame:
    """The runs of the first round with ``witness`` and ``above``, which end to end lead from a run's block to the root.

    ``above``: (g, above, and what else each leaf of a group gets)."""
    more = [c for c in above.columns if c not in ("g", "above")]
    w = above.withColumn("block", F.lit(0).cast("long"))
    for runs in reversed(rounds[1:]):
        met = _leaf_witnesses(runs.join(w, ["g", "block"]).withColumnsRenamed({"block": "upper"}), [], ["g", "upper", "run", *more])
        pos = F.col("upper") * ARITY**block_levels + F.col("run") * ARITY + F.col("place")
        w = met.select("g", pos.alias("block"), F.col("witness").alias("above"), *more)
    return rounds[0].join(w, ["g", "block"])


def manifest(leaves: DataFrame, group_col: str, order: list[str], digest_col: str, keep: list[str], block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Leaves (``digest_col``: their 32-byte digests) to rows of ``keep``, leaf, subroot, root and witness (all binary; see ``steps``).

    Leaves of a group ascend by ``order``, nulls first; leaves that tie in it follow by digest, so repeated rows are leaves of their own next to each
    other and reruns agree. Groups are ordered by their UTF-8 bytes, null first; null is a group of its own, not that of the empty string. A group of one leaf
    has that leaf as its subroot, one group's subroot is the root. No leaves give no rows. One huge group is spread over all
    partitions like any other rows.
    """
    work = Scratch(leaves.sparkSession, "manifest")
    g = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    own = [f"own_{k}" for k in range(len(keep))]
    by = [f"by_{k}" for k in range(len(order))]
    nodes = leaves.select(g.alias("g"), *(F.col(c).alias(b) for c, b in zip(order, by, strict=True)), F.col(digest_col).alias("digest"), *(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)))
    nodes = work.save(nodes, "leaves")  # the range partitioning reads them twice
    rounds, subroots = _climb(work, "group", _positions(work, "ordered", nodes, [*by, "digest"]), own, block_levels)
    work.drop("leaves", "ordered", "ordered-bases")

    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    tops, roots = _climb(work, "top", _positions(work, "subroots", tops, ["name"]), ["name"], block_levels)
    above = _leaf_witnesses(_descend(tops, roots.select("g", F.lit(b"").alias("above"), F.col("digest").alias("root")), block_levels), ["name"], ["root"])
    above = work.save(above.select(F.col("name").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("witness").alias("above")), "above")
    out = _leaf_witnesses(_descend(rounds, above, block_levels), own, ["subroot", "root"])
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "leaf", "subroot", "root", "witness")


def _leaf_witnesses(runs: DataFrame, own: list[str], more: list[str]) -> DataFrame:
    """A row for each leaf: own columns, leaf, its place in its run, its witness, and ``more`` of the run's columns."""
    item = {c: runs.schema[c].dataType.elementType.simpleString() for c in own}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in item.items()), "leaf binary", "place int", "witness binary", *([fields(runs, more)] if more else [])])

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        which, places, leaves, witnesses = [], [], [], []
        for k, (digests, levels, witness, above) in enumerate(zip(*(b.column(c).to_pylist() for c in ("digests", "levels", "witness", "above")), strict=True)):
            run = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
            rest = witness + above
            which += [k] * len(run)
            places += range(len(run))
            leaves += run
            witnesses += [(step(place, run) if levels else b"") + rest for place in range(len(run))]
        flat = [b.column(c).flatten() for c in own]
        given = [b.column(c).take(pa.array(which)) for c in more]
        return pa.RecordBatch.from_arrays([*flat, pa.array(leaves, pa.binary()), pa.array(places, pa.int32()), pa.array(witnesses, pa.binary()), *given], [*own, "leaf", "place", "witness", *more])

    return map_batches(runs.select(*own, "digests", "levels", "witness", "above", *more), spread, schema, 1000, 2 << 20)


def check_leaves(rows: DataFrame, leaf_col: str = "leaf", witness_col: str = "witness", out: tuple[str, str] = ("proof_sha256", "folded_root")) -> DataFrame:
    """Adds the digest over a row's siblings and the root that ``leaf_col`` and the witness give, both in hexadecimal. A null leaf or
    witness gives nulls."""
    names = [c for c in rows.columns if c != witness_col]

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        pairs = list(zip(b.column(leaf_col).to_pylist(), b.column(witness_col).to_pylist(), strict=True))
        proofs = [None if w is None else proof(w) for _, w in pairs]
        roots = [None if leaf is None or w is None else fold(leaf, w).hex() for leaf, w in pairs]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(proofs, pa.string()), pa.array(roots, pa.string())], [*names, *out])

    return map_batches(rows, check, f"{fields(rows, names)}, {out[0]} string, {out[1]} string", 1000, 4 << 20)


def field_digest(columns: list[Column]) -> Column:
    """sha256 over columns as text: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. Binary, 32 bytes."""

    def marked(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(marked, columns)), 256))
