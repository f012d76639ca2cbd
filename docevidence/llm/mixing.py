"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The words of each source, its documents in a seeded shuffle, are cut into blocks of equal size. Slot n of the schedule takes the
point frac(n * golden ratio) through the cumulative target weights, in blocks, to a source; the slots of a source, ranked, take its
blocks in turn. Any stretch of the schedule so holds each source in its share. A source's blocks have ``block_size`` words, or fewer
where its target would not have LEAST_BLOCKS of them, so a small source meets its target as well beside large ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.llm.common import Scratch, free_name, with_row_key

GOLDEN = 0.6180339887498949
CHUNK_SLOTS = 1 << 16
LEAST_BLOCKS = 256
POINT_CELLS = 1024
BUCKET_DOCS = 2048
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """sources (source, source_no, source_size, weight, target, block_size), documents (row, id, size, source_no, block_size, at: first
    word in its source) and slots (slot, source_no, pass, block)."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source (source, source_size): its number in code point order (null last), weight and target.

    Targets share ``share`` of all sizes by weight and stop at ``cap`` times the source's size; what is over is shared again by
    weight. In closed form: with sources by cap * size / weight ascending, the stopped ones come first, and all others get the
    level (what is left) / (weights left) times their weight. The windows here run over one row per source.
    """
    own = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    own = own.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights)).cast("int") + 1))
    own = own.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", "source_no")
    every = Window.partitionBy()
    own = own.withColumn("stopped", F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    own = own.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    own = own.withColumn("level", (share * F.sum("source_size").over(every) - F.col("stopped")) / F.col("weight_left"))
    own = own.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(every)["level"])
    target = F.coalesce(F.least(cap * F.col("source_size"), F.col("level") * F.col("weight")), cap * F.col("source_size"))
    return own.select("source", "source_no", "source_size", "weight", target.cast("double").alias("target"))


def _running(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` before each row in its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w) - F.col(value))


def plan_mix(docs: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_size: int = 64, seed: int = 17, row_col: str | None = None) -> Mix:
    """Plans the mix of ``docs``. Null sizes count as 0, a null source is a source; repeated ids and rows are taken one by one.

    The order in a source is by a hash of id and seed, then id and size: the same rows give the same mix. Running positions go by
    hash buckets inside each source, and slot ranks by stretches of the schedule, so a source with a third of all rows is spread.
    A slot beyond ``cap`` passes over its source stays empty, so no document is taken more than ``cap`` (an integer) times. ``row_col``
    names a unique integer key of the rows, the same at every reading. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "mix")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = rows if row_col else with_row_key(rows, "row")
    rows = work.save(rows.withColumn("h", F.xxhash64(F.col("id"), F.lit(seed))), "rows")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, cap)
    fine = F.greatest(F.lit(1), F.least(F.lit(block_size), F.floor(F.col("target") / LEAST_BLOCKS))).cast("long")
    sources = work.save(sources.withColumn("block_size", fine).withColumn("slots", F.col("target") / F.col("block_size")), "sources")

    n_rows, total = rows.count(), float(sources.agg(F.sum("slots")).first()[0] or 0.0)
    n_slots = round(total)

    # Positions: documents in buckets of their hash, sums of buckets before, then sums within the bucket.
    bits = max(0, (n_rows // BUCKET_DOCS).bit_length())
    rows = rows.join(sources.select("source", "source_no", "block_size"), rows["source"].eqNullSafe(sources["source"])).drop("source")
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    buckets = _running(rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")), ["source_no"], ["bucket"], "n", "base")
    rows = _running(rows, ["source_no", "bucket"], ["h", "id", "size", "row"], "size", "within")
    documents = work.save(rows.join(buckets.select("source_no", "bucket", "base"), ["source_no", "bucket"]).select("row", "id", "size", "source_no", "block_size", (F.col("base") + F.col("within")).alias("at")), "documents")

    # Slots: the point of slot n, in two steps so that it stays exact for large n; then the source whose stretch holds it.
    low, high = F.pmod(F.col("slot"), F.lit(1 << 20)), F.floor(F.col("slot") / (1 << 20))
    point = high * F.lit((GOLDEN * (1 << 20)) % 1.0) + low * F.lit(GOLDEN)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * POINT_CELLS))
    ends = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    stretch = sources.filter("target > 0").withColumn("to", F.sum("slots").over(ends) / F.lit(total or 1.0)).withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("source_no")), F.lit(0.0)))
    last = F.max("source_no").over(Window.partitionBy()) == F.col("source_no")
    stretch = stretch.withColumn("to", F.when(last, F.lit(2.0)).otherwise(F.col("to")))
    cells = stretch.select("source_no", "from", "to", F.ceil(F.col("source_size") / F.col("block_size")).alias("blocks"), F.explode(F.sequence(F.floor(F.col("from") * POINT_CELLS), F.least(F.floor(F.col("to") * POINT_CELLS), F.lit(POINT_CELLS - 1)))).alias("cell"))
    placed = slots.join(cells, "cell").filter((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to"))).select("slot", "source_no", "blocks", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    placed = work.save(placed, "placed")
    chunks = _running(placed.groupBy("source_no", "chunk").agg(F.count("*").alias("n")), ["source_no"], ["chunk"], "n", "before")
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(chunks.select("source_no", "chunk", "before"), ["source_no", "chunk"]).withColumn("r", F.col("r") + F.col("before"))
    slots = ranked.filter(F.col("r") < cap * F.col("blocks")).select("slot", "source_no", (F.floor(F.col("r") / F.col("blocks")) + 1).alias("pass"), F.pmod(F.col("r"), F.col("blocks")).alias("block"))
    return Mix(sources, documents, slots)


def taken_words(mix: Mix) -> DataFrame:
    """Per document row: row, id, size, source_no and ``taken``, the words that the scheduled blocks take of it, repeats counted."""
    b = F.col("block_size")
    times = mix.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    last = F.col("at") + F.col("size")
    parts = mix.documents.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / b), F.floor((last - 1) / b)))))
    parts = parts.withColumn("part", F.least(last, (F.col("block") + 1) * b) - F.greatest(F.col("at"), F.col("block") * b))
    parts = parts.join(times, ["source_no", "block"], "left")
    return parts.groupBy("row", "id", "size", "source_no").agg(F.sum(F.coalesce(F.col("part") * F.col("times"), F.lit(0))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents that the mix takes, each as many times as its words are taken, rounded to whole documents (a half counts up).

    All columns of ``docs`` stay, whatever their names. Documents without words, null texts among them, and those whose source's share
    ends before them have no row.
    """
    row, times, copy = (free_name(x, docs.columns) for x in ("row_key", "mix_times", "mix_copy"))
    rows = Scratch(docs.sparkSession, "mixed").save(with_row_key(docs, row), "rows")
    mix = plan_mix(rows, id_col, source_col, word_count(F.col(text_col)), row_col=row, **options)
    copies = taken_words(mix).select(F.col("row").alias(row), F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5).cast("int").alias(times)).filter(F.col(times) > 0)
    out = rows.join(copies.hint("shuffle_merge"), row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
