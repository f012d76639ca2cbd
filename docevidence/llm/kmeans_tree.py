"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample: each node's sample is split by k-means until the leaves are small enough. Every row goes down the
tree to a leaf. A query's traversal keeps the nodes that it has seen in a priority queue, by inner product with their means, and opens
the best one: an inner node gives its children to the queue, a leaf is visited. How many leaves a query visits is calibrated: for a
bounded set of queries the exact neighbours are found among all rows, and the number of visits widens until the neighbours in visited
leaves reach the wanted recall.

Leaves that follow each other in the tree share a block of rows, and a leaf of too many rows (a hot vector's) takes several blocks; a query
goes to each block with a leaf that it visits, once, and queries of a block are dealt to parts where there are many. A task holds one
block of rows and one part of its queries; the blocks' best are merged per query.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.llm.common import Scratch, map_batches

SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20  # the tree is fitted on so many rows at most
MOST_LEAVES = 4096
CALIBRATION_QUERIES = 256
RECALL = 0.95
BRANCHES, ROUNDS = 8, 10
LEAST_BLOCK, MOST_BLOCK, BLOCKS, QUERY_ROWS = 4096, 131_072, 64, 16_384
SCORES_AT_ONCE = 1 << 21
SLACK = 1e-9  # of a matrix product's scores against those added up in order, relative to the lengths


def usable(vector: Column) -> Column:
    """Whether a vector is there, has finite components only, and not zeros only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Ragged rows as a matrix of doubles, with zeros behind short ones."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, length = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
    if (length == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(length), dims))
    out[np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out


def split(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means of rows: at most k means, and each row's."""
    means = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    own = nearest(x, means)
    for _ in range(ROUNDS):
        kept = np.unique(own)
        means = np.stack([x[own == j].mean(axis=0) for j in kept])
        before, own = np.searchsorted(kept, own), nearest(x, means)
        if (before == own).all():
            break
    return means, own


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return (x @ means.T - 0.5 * (means * means).sum(axis=1)).argmax(axis=1)


@dataclass
class Tree:
    """Nodes by number, the root is 0: ``children`` (first, end; none for a leaf), ``leaf`` (its number among the leaves, -1 otherwise)."""

    means: np.ndarray
    children: list[tuple[int, int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf: down the tree to the nearest mean."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            first, end = self.children[node]
            if first == end:
                out[at] = self.leaf[node]
            else:
                own = nearest(x[at], self.means[first:end])
                todo += [(first + int(j), at[own == j]) for j in np.unique(own)]
        return out

    def visits(self, x: np.ndarray, most: int, filled: np.ndarray) -> list[list[int]]:
        """For each query the first ``most`` leaves with rows, best bin first."""
        out = []
        for scores in -(x @ self.means.T):
            s, queue, seen = scores.tolist(), [(0.0, 0)], []
            while queue and len(seen) < most:
                node = heapq.heappop(queue)[1]
                first, end = self.children[node]
                if first < end:
                    for child in range(first, end):
                        heapq.heappush(queue, (s[child], child))
                elif filled[self.leaf[node]]:
                    seen.append(self.leaf[node])
            out.append(seen)
        return out


def grow(x: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree with about ``leaves`` leaves: the node with the most rows is split next. Leaves are numbered in the order of the tree, so
    that neighbours in it have neighbouring numbers; rows that are all equal make one leaf."""
    rng = np.random.default_rng(seed)
    means, children, rows = [x.mean(axis=0)], [(0, 0)], {0: x}
    heap, n_leaves = [(-len(x), 0)], 1
    while heap and n_leaves < leaves:
        node = heapq.heappop(heap)[1]
        own = rows.pop(node)
        centres, which = split(own, min(BRANCHES, leaves - n_leaves + 1), rng)
        if len(centres) < 2:
            continue
        children[node] = (len(means), len(means) + len(centres))
        n_leaves += len(centres) - 1
        for j, centre in enumerate(centres):
            rows[len(means)] = own[which == j]
            heapq.heappush(heap, (-len(rows[len(means)]), len(means)))
            means.append(centre)
            children.append((0, 0))
    leaf, todo, n = [-1] * len(means), [0], 0
    while todo:
        node = todo.pop()
        first, end = children[node]
        if first == end:
            leaf[node], n = n, n + 1
        else:
            todo += reversed(range(first, end))
    return Tree(np.stack(means), children, leaf)


def in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, added up component by component, so that equal rows score alike wherever they stand."""
    return np.cumsum(x * q, axis=1)[:, -1]


def best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k nearest, from a matrix product's scores (-inf: not to be taken); ties to smaller ids. ``longest``: the
    greatest length of the rows, by which the product's rounding is bounded."""
    slack = SLACK * longest * float(np.sqrt(q @ q))
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        own = scores[at]
        bar = np.partition(own, len(own) - k)[len(own) - k]
        at = at[own >= bar - slack]
    exact = in_order(q, x[at])
    first = np.lexsort((ids[at], -exact))[:k]
    return at[first], exact[first]


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).sum(axis=1).max(initial=0.0)))


def search(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str, recall: float = RECALL, leaves: int | None = None, fit_rows: int = SAMPLE_ROWS, least_block: int = LEAST_BLOCK) -> DataFrame:
    """For each query about the k rows of largest inner product, other ids only: query_id, rank, <id_col>, score.

    Vectors that are null, all zeros or hold null or non-finite components take no part, nor do rows with a null id. Shorter vectors count as having zeros
    behind. Ties go to the smaller id; with fewer rows than k all come. Of query rows with one id, that with the least vector asks; rows with
    one id are candidates each. Equal vectors share a leaf, so a query meets all or none. Empty tables give no rows.
    ``fit_rows`` bounds the sample that the tree is fitted on (less for very long vectors), CALIBRATION_QUERIES the queries
    that the visits are calibrated on; every row is indexed. ``leaves``: about the square root of the rows by default, MOST_LEAVES at most.
    """
    spark = rows.sparkSession
    work = Scratch(spark, "kmeans-tree")
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, rank int, `{id_col}` {kind}, score double"

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
        return df.filter(F.col("i").isNotNull() & usable(F.col("v")))

    rows = clean(rows)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    asking = work.save(clean(queries).groupBy("i").agg(F.min("v").alias("v")), "queries")
    n_queries = asking.count()
    if not facts["n"] or not n_queries:
        return spark.createDataFrame([], schema)
    n, dims = facts["n"], max(facts["dims"], asking.agg(F.max(F.size("v"))).first()[0])

    def some(df: DataFrame, n: int, most: int) -> np.ndarray:
        """About ``most`` rows' ids and vectors at most, chosen by hash."""
        h = F.pmod(F.xxhash64("i", "v"), F.lit(1 << 40))
        found = df.withColumn("h", h).filter(F.col("h") < int(min(1.0, 2 * most / n) * (1 << 40))).orderBy("h", "i", "v").limit(most)
        return found.select("i", "v").toArrow()

    most = max(1, min(fit_rows, SAMPLE_BYTES // (8 * dims)))
    wanted = leaves or min(MOST_LEAVES, int(n**0.5) + 1)
    tree = grow(_matrix(some(rows, n, most).column("v"), dims), wanted)

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tree.assign(_matrix(b.column("v"), dims))), b.column("i"), b.column("v")], ["leaf", "i", "v"])

    element = rows.schema["v"].dataType.simpleString()
    indexed = work.save(map_batches(rows, assign, f"leaf int, i {kind}, v {element}"), "rows")
    size = np.zeros(tree.leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row for each leaf
        size[r["leaf"]] = r["count"]

    sample = some(asking, n_queries, CALIBRATION_QUERIES)
    visits = _calibrated(indexed, sample.column("i").combine_chunks(), _matrix(sample.column("v"), dims), tree, size > 0, k, recall, dims)

    block_rows = min(MOST_BLOCK, max(least_block, -(-n // BLOCKS)))
    first, parts, so_far, block = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
    for leaf, rows_in in enumerate(size):
        if so_far and so_far + rows_in > block_rows:
            block, so_far = block + 1, 0
        first[leaf], parts[leaf] = block, max(1, -(-rows_in // block_rows))
        so_far += rows_in
        if parts[leaf] > 1:
            block, so_far = block + parts[leaf], 0
    places = spark.createDataFrame([(leaf, int(first[leaf]), int(parts[leaf])) for leaf in range(len(size))], "leaf int, first bigint, parts bigint")

    def route(b: pa.RecordBatch) -> pa.RecordBatch:
        which, blocks, lists = [], [], []
        for j, seen in enumerate(tree.visits(_matrix(b.column("v"), dims), visits, size > 0)):
            to: dict[int, list[int]] = {}
            for leaf in seen:
                for p in range(parts[leaf]):
                    to.setdefault(int(first[leaf]) + p, []).append(leaf)
            which += [j] * len(to)
            blocks += to
            lists += to.values()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), b.column("i").take(pa.array(which, pa.int32())), b.column("v").take(pa.array(which, pa.int32())), pa.array(lists, pa.list_(pa.int32()))], ["block", "i", "v", "leaves"])

    routed = work.save(map_batches(asking, route, f"block bigint, i {kind}, v {element}, leaves array<int>"), "routed")
    dealt = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("n_parts"))
    left = routed.join(dealt, "block").withColumn("part", F.pmod(F.xxhash64("i"), F.col("n_parts")).cast("int")).drop("n_parts")
    right = indexed.join(F.broadcast(places), "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("i", "v"), F.col("parts")))  # a row for each leaf, MOST_LEAVES at most
    right = right.join(dealt, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).select("block", "part", "leaf", "i", "v")

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by([("leaf", "ascending"), ("i", "ascending")])
        ids, x, leaf = held.column("i").combine_chunks(), _matrix(held.column("v"), dims), held.column("leaf").to_numpy()
        order = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # ids as ranks, whatever their type
        q, q_ids, lists = _matrix(asked.column("v"), dims), asked.column("i").combine_chunks(), asked.column("leaves").to_pylist()
        own = {v: o for v, o in zip(ids.to_pylist(), order.tolist(), strict=True)}
        starts, ends = {}, {}
        if len(leaf):
            at = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            starts, ends = dict(zip(leaf[at].tolist(), at.tolist(), strict=True)), dict(zip(leaf[at].tolist(), np.r_[at[1:], len(leaf)].tolist(), strict=True))
        found_q, found_i, found_s = [], [], []
        longest = _longest(x)
        for low in range(0, len(q), step := max(1, SCORES_AT_ONCE // max(1, len(x)))):
            scores = np.full((len(q[low : low + step]), len(x)), -np.inf)
            by_leaf: dict[int, list[int]] = {}
            for j, seen in enumerate(lists[low : low + step]):
                for number in seen:
                    by_leaf.setdefault(number, []).append(j)
            for number, asking_it in by_leaf.items():
                if number in starts:
                    scores[asking_it, starts[number] : ends[number]] = q[low + np.array(asking_it)] @ x[starts[number] : ends[number]].T
            for j, line in enumerate(scores):
                if (mine := own.get(q_ids[low + j].as_py())) is not None:
                    line[order == mine] = -np.inf
                rows_of, s = best(line, q[low + j], x, order, k, longest)
                found_q.append(np.full(len(rows_of), low + j))
                found_i.append(rows_of)
                found_s.append(s)
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": q_ids.take(pa.array(cat(found_q, np.int64))), "found": ids.take(pa.array(cat(found_i, np.int64))), "score": cat(found_s, np.float64)})

    tops = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(score, f"query_id {kind}, found {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    out = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("found").alias(id_col), "score")


def _calibrated(indexed: DataFrame, q_ids: pa.Array, q: np.ndarray, tree: Tree, filled: np.ndarray, k: int, recall: float, dims: int) -> int:
    """The least number of visits, widened step by step, at which the calibration queries' exact neighbours reach ``recall``."""
    wanted = [v.as_py() for v in q_ids]

    def exact(batches):
        tops: list = [[] for _ in wanted]
        for b in batches:
            if not b.num_rows:
                continue
            ids, leaf, x = b.column("i"), b.column("leaf").to_numpy(), _matrix(b.column("v"), dims)
            plain = ids.to_pylist()
            order = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            scores, longest = q @ x.T, _longest(x)
            for j, line in enumerate(scores):
                line[np.fromiter((p == wanted[j] for p in plain), bool, len(plain)) if wanted[j] in plain else []] = -np.inf
                at, s = best(line, q[j], x, order, k, longest)
                tops[j] = heapq.nsmallest(k, [*tops[j], *((-v, plain[r], int(leaf[r])) for r, v in zip(at.tolist(), s.tolist(), strict=True))])
        flat = [(j, -s, i, n) for j, own in enumerate(tops) for s, i, n in own]
        if flat:
            j, s, i, n = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(s), pa.array(i, q_ids.type), pa.array(n, pa.int32())], ["j", "score", "i", "leaf"])

    kind = indexed.schema["i"].dataType.simpleString()
    tops = indexed.mapInArrow(exact, f"j int, score double, i {kind}, leaf int")
    place = F.row_number().over(Window.partitionBy("j").orderBy(F.desc("score"), "i"))
    true = tops.withColumn("place", place).filter(F.col("place") <= k).select("j", "leaf").collect()  # k rows for each calibration query
    rank = [{leaf: r for r, leaf in enumerate(seen)} for seen in tree.visits(q, tree.leaves, filled)]
    ranks = np.sort([rank[r["j"]][r["leaf"]] for r in true])
    visits, most = 1, int(filled.sum())
    while visits < most and len(ranks) and np.searchsorted(ranks, visits) < recall * len(ranks):
        visits = min(most, visits + max(1, visits // 16))
    return visits
