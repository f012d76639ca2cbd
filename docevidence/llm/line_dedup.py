"""Repeated runs of lines, by a suffix array over line ids.

Each document is its sequence of non-blank lines. Prefix doubling ranks all suffixes by their first 1, 2, 4, ... lines: the rank at
2**(k+1) lines orders the pairs (rank at 2**k here, rank 2**k lines on), and distinct pairs are ranked by a distributed sort. Suffixes
that no other one shares a prefix with drop out at once. Suffixes that agree on their first n lines are an interval of the suffix array
with a common prefix of n lines or more; two overlapping ranks, at its start and at its end, name it.

A run counts as repeated if it has ``min_words`` words. Every repeated run is covered by the shortest such windows that start, and that
end, at each of its lines, so doubling goes on to ``min_words`` lines only, however long the runs are: the maximal repeated runs are the
unions of the windows whose interval has an earlier suffix. All but the first copy, in the order of the ids, are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.llm.common import Scratch, map_batches, with_row_key

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """(no, line) of the lines with a word; no counts all lines from 0."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("line"))), lambda s: s["line"].rlike(WORD))


def _ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """The repeated keys, each with a rank that follows their order: after a range sort ids grow from row to row."""
    return keys.groupBy(*cols).count().filter("count > 1").orderBy(*cols).select(*cols, F.monotonically_increasing_id().alias("r"))


def windows(pos: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, lines) of the shortest windows of ``least`` words that start or end at each line, inside stretches of adjacent positions."""
    out = set()
    total = np.r_[0, np.cumsum(words)]
    breaks = np.r_[0, np.flatnonzero(np.diff(pos) != 1) + 1, len(pos)]
    for s, e in zip(breaks[:-1], breaks[1:], strict=True):
        reach = np.searchsorted(total, total[s:e] + least, "left")  # first end with enough words
        out.update((int(pos[i]), int(q - i)) for i, q in zip(range(s, e), reach, strict=True) if q <= e)
        back = np.searchsorted(total, total[s + 1 : e + 1] - least, "right") - 1  # last start with enough words
        out.update((int(pos[i]), int(q - i)) for i, q in zip(back, range(s + 1, e + 1), strict=True) if i >= s)
    return sorted(out)


def repeated_runs(docs: DataFrame, work: Scratch, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, start, lines): windows of lines of a row that an earlier place has too; positions count lines with a word.

    ``docs`` has a key ``row``. Earlier means a smaller id (null first), of equal ids a smaller row, then position.
    """
    least = max(1, min_words)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), "row", F.posexplode(_lines(text)).alias("pos", "s"))
    lines = lines.select("id", "row", "pos", F.xxhash64("s.line").alias("h"), F.xxhash64("s.line", F.lit(1)).alias("g"), F.regexp_count("s.line", F.lit(WORD)).alias("words"))
    lines = work.save(lines, "lines")

    suffixes = work.save(lines.join(_ranked(lines, "h", "g"), ["h", "g"]).select("id", "row", "pos", "words", "r"), "rank-0")
    ranks, k = [suffixes.select(F.lit(0).alias("k"), "row", "pos", "r")], 0
    while 2 ** (k + 1) <= least:
        ahead = Window.partitionBy("row").orderBy("pos").rangeBetween(2**k, 2**k)
        pairs = work.save(ranks[k].select("row", "pos", F.col("r").alias("a"), F.max("r").over(ahead).alias("b")).filter("b is not null"), f"pairs-{k}")
        k += 1
        level = pairs.join(_ranked(pairs, "a", "b"), ["a", "b"]).select(F.lit(k).alias("k"), "row", "pos", "r")
        level = work.save(level, f"rank-{k}")
        work.drop(f"pairs-{k - 1}")
        if level.isEmpty():
            break
        ranks.append(level)
    rank = ranks[0]
    for level in ranks[1:]:
        rank = rank.unionByName(level)

    def spans(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for s in b.column("s").to_pylist():
            pos, words = np.array([x["pos"] for x in s]), np.array([x["words"] for x in s])
            out.append([{"start": a, "lines": n} for a, n in windows(pos, words, least)])
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("lines", pa.int32())])))], ["id", "row", "w"])

    own = suffixes.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("s"))
    kind = docs.schema[id_col].dataType.simpleString()
    spans_of = map_batches(own, spans, f"id {kind}, row bigint, w array<struct<start int, lines int>>").select("id", "row", F.explode("w").alias("w"))
    spans_of = spans_of.select("id", "row", "w.start", "w.lines", F.floor(F.log2("w.lines")).cast("int").alias("k"))
    spans_of = spans_of.withColumn("tail", (F.col("start") + F.col("lines") - F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("int"))
    named = spans_of.join(rank.select("k", "row", F.col("pos").alias("start"), F.col("r").alias("a")), ["k", "row", "start"])
    named = work.save(named.join(rank.select("k", "row", F.col("pos").alias("tail"), F.col("r").alias("b")), ["k", "row", "tail"]).select("id", "row", "start", "lines", "a", "b"), "windows")
    firsts = named.groupBy("lines", "a", "b").agg(F.min(F.struct("id", "row", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = work.save(firsts, "firsts")  # both sides of the join are shuffled then, and Spark can split a hot passage's windows
    later = named.join(firsts.hint("shuffle_merge"), ["lines", "a", "b"]).filter((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    return later.select("row", "start", "lines").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, keep: list[str] | None = None, lines_col: str = "n_lines", removed_col: str = "removed") -> DataFrame:
    """All rows of ``docs`` with the columns ``keep`` (all by default), their text without the later copies of repeated line runs,
    ``lines_col`` (lines with a word) and ``removed_col`` (numbers of the deleted lines, from 0, ascending).

    Null texts stay null and empty ones empty; blank lines are never deleted. Copies inside one document count too. Repeated ids and
    rows are taken one by one; an empty table gives no rows. A new column must not have the name of a kept one (ValueError).
    """
    spark = docs.sparkSession
    work = Scratch(spark, "line-dedup")
    keep = keep or docs.columns
    if {lines_col, removed_col} & set(keep):
        raise ValueError(f"{lines_col} or {removed_col} would be there twice")
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]  # own names, so that no column of docs clashes
    rows = with_row_key(docs.select(F.struct(*own).alias("kept"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    rows = work.save(rows if text_col not in keep else rows.withColumn("kept", F.col("kept").dropFields(f"c{keep.index(text_col)}") if len(keep) > 1 else F.lit(None).cast("struct<c0:int>")), "rows")
    runs = repeated_runs(rows, work, "id", "text", min_words).groupBy("row").agg(F.collect_set(F.struct("start", "lines")).alias("runs"))
    runs = work.save(runs, "runs")
    work.drop(*(name for name in work.schemas if name not in ("rows", "runs")))
    out = rows.join(runs.hint("shuffle_merge"), "row", "left")
    # Lists that a lambda reads for each element are bound by an outer one, so that they are made once a row.
    numbers = F.transform(_lines(F.col("text")), lambda s: s["no"])
    gone = F.transform(F.array(numbers), lambda no: F.flatten(F.transform("runs", lambda w: F.slice(no, w["start"] + 1, w["lines"]))))[0]
    out = out.withColumn("gone", F.when(F.col("runs").isNotNull(), F.array_sort(F.array_distinct(gone))).otherwise(F.array().cast("array<int>")))
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    left = F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: p[i]), "\n"))[0]
    text = F.when(F.size("gone") > 0, left).otherwise(F.col("text"))
    values = [text if c == text_col else F.col(f"kept.c{k}") for k, c in enumerate(keep)]
    return out.select(*(v.alias(c) for v, c in zip(values, keep, strict=True)), F.size(_lines(F.coalesce("text", F.lit("")))).cast("long").alias(lines_col), F.col("gone").alias(removed_col))
