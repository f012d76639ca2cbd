"""Streams: call statistics in event-time windows (ST2), rate limits in event-time order (ST1), incremental ingest (ST3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docevidence.operators.embedders import Embedder
from docevidence.plans import store, tables

SKETCH_K = 800  # a quantile of a KLL sketch of this size is off in rank by 0.5 % at most, with 99 % confidence
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def call_stats_stream(calls: DataFrame, ts: str, group: list[str], latency: str, failed: str, width: str = "1 day", late: str = "1 hour", fallback: str | None = None, tokens: list[str] | None = None, category: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """ST2: per window and group what A2 has: calls, errors, fallback calls, sums of ``tokens``, failed calls by category (a map of those named in
    ``categories`` and "other"), and the latency's percentiles, from a sketch that is in the row too; a window appears once it is closed by
    the watermark. ``merge_call_stats`` adds windows up.

    ``ts`` is cast to a zoned timestamp, since watermarks refuse other types; ``failed``, ``fallback`` and ``category`` are SQL expressions. Null latencies
    don't count for percentiles, null tokens count as 0."""
    rows = calls.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    bad = F.coalesce(F.expr(failed), F.lit(False))
    kind = F.coalesce(F.expr(category), F.lit("other")) if category else None
    known = list(categories or [])
    named = {c: bad & (kind == c) for c in known} | {"other": bad & ~kind.isin(*known) if known else bad} if category else {}
    sums = [F.count("*").alias("calls"), F.count_if(bad).alias("errors"), F.kll_sketch_agg_double(F.col(latency).cast("double"), SKETCH_K).alias("sketch")]
    sums += [F.count_if(F.expr(fallback)).alias("fallbacks")] if fallback else []
    sums += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens or []]
    sums += [F.count_if(c).alias(f"__c{n}") for n, c in enumerate(named.values())]
    out = rows.groupBy(F.window("__ts", width).alias("w"), *group).agg(*sums)
    more = [*(["fallbacks"] if fallback else []), *(tokens or [])]
    by_category = [F.map_filter(F.create_map(*(x for n, c in enumerate(named) for x in (F.lit(c), F.col(f"__c{n}")))), lambda _, n: n > 0).alias("failures")] if named else []
    return out.select(F.col("w.start").alias("start"), *group, "calls", "errors", *_percentiles("sketch"), *more, *by_category, "sketch")


def _percentiles(sketch: str) -> list[Column]:
    there = F.kll_sketch_get_n_double(sketch) > 0
    return [F.when(there, F.kll_sketch_get_quantile_double(sketch, F.lit(p))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))]


def merge_call_stats(stats: DataFrame, by: list[Column | str]) -> DataFrame:
    """Closed windows (rows of call_stats_stream, from one stream or several) added up by ``by``, such as a month and the group: counts and sums
    add, sketches merge, and the percentiles are those of the merged sketch."""
    added = [c for c in stats.columns if c in ("calls", "errors", "fallbacks") or (stats.schema[c].dataType.typeName() in ("long", "integer", "double", "decimal") and c not in ("p50", "p95"))]
    added = [c for c in added if c not in [b for b in by if isinstance(b, str)]]
    sums = [F.sum(c).alias(c) for c in added] + [F.kll_merge_agg_double("sketch").alias("sketch")]
    has_map = "failures" in stats.columns
    out = stats.groupBy(*by).agg(*sums, *([F.collect_list("failures").alias("maps")] if has_map else []))  # a small map for each window
    if has_map:
        zero = F.create_map().cast("map<string,bigint>")
        whole = F.aggregate("maps", zero, lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))
        out = out.withColumn("failures", whole).drop("maps")
    return out.select("*", *_percentiles("sketch"))


def _limiter(width: int, most: int, event: str) -> StatefulProcessor:
    """The processor is made here, so that the processes that run it get its code and need not import this module."""

    class Limiter(StatefulProcessor):
        """A key's events wait until the watermark has passed them, are then read in time order, and leave the fixed window's end and count."""

        def __init__(self, width: int, most: int, event: str):
            self.width, self.most, self.event = width, most, event

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", f"at bigint, e {self.event}")
            self.window = handle.getValueState("window", "reset bigint, n int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            new = pd.concat(list(rows))
            at = new["t"].tolist()
            self.waiting.appendList(list(zip(at, new["e"].tolist(), strict=True)))
            self._wake(min(at), timerValues)
            yield pd.DataFrame([], columns=["k", "e", "retry_after"], dtype=object)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            upto = timerValues.getCurrentWatermarkInMs() * 1000  # no event before it comes any more
            waiting = sorted(self.waiting.get())
            ready, rest = [w for w in waiting if w[0] < upto], [w for w in waiting if w[0] >= upto]
            reset, n = self.window.get() if self.window.exists() else (-1, 0)
            out = []
            for t, e in ready:
                if t > reset:
                    reset, n = t + self.width, 1
                elif n >= self.most:
                    out.append((key[0], e, -(-(reset - t) // 1_000_000)))
                else:
                    n += 1
            if rest:
                self.waiting.put(rest)
                self._wake(rest[0][0], timerValues)
            else:
                self.waiting.clear()
                if reset >= upto:
                    self._wake(reset, timerValues)  # to forget the key then
            if reset < upto and not rest:
                self.window.clear()
            else:
                self.window.update((reset, n))
            yield pd.DataFrame(out, columns=["k", "e", "retry_after"], dtype=object)

        def _wake(self, at: int, timer) -> None:
            self.handle.registerTimer(max(at // 1000 + 1, timer.getCurrentWatermarkInMs() + 1))

        def close(self) -> None:
            pass

    return Limiter(width, most, event)


def rate_violations_stream(events: DataFrame, key: str, ts: str, event_id: str, window_seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """ST1: as reports.rate_violations, over a stream, in the order of event time whatever the order of arrival: an event is judged once the
    watermark has passed it, so rows up to ``late`` behind are in their place and later ones are dropped. A key's state is its waiting events and its
    window's end and count, and goes when the window has run out. Rows without a key or time are left out. The session needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass`` = ROCKSDB); events after the last watermark wait for the next run."""
    kind = lambda c: events.schema[c].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), F.col(event_id).alias("e"), F.col(ts).cast("timestamp").alias("at")).filter("k is not null and at is not null")
    rows = rows.withColumn("t", F.unix_micros("at")).withWatermark("at", late)
    out = rows.groupBy("k").transformWithStateInPandas(_limiter(window_seconds * 1_000_000, most, kind(event_id)), f"k {kind(key)}, e {kind(event_id)}, retry_after bigint", "append", "eventTime")
    return out.select(F.col("k").alias(key), F.col("e").alias(event_id), "retry_after")


def incremental_ingest(files: DataFrame, ingest: Callable[[DataFrame], None], known: Callable[[], DataFrame], checkpoint: str, hash_col: str = "sha256"):
    """ST3 for any target: new files through ``ingest``, each content once: what ``known()`` (a table with the hash) already has is left out, so a
    batch that runs again after a failure adds nothing where ``ingest`` is one write. index_stream is for P1's two tables."""

    def each(batch: DataFrame, _: int) -> None:
        ingest(batch.dropDuplicates([hash_col]).join(known().select(hash_col), hash_col, "left_anti"))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(uploads: DataFrame, documents: tables.Table, vectors: tables.Table, checkpoint: str, name: str = "uploads", dims: int = 256, embedder: Embedder | None = None):
    """ST3 with P1, exactly once: each micro-batch of uploads (store.index_documents' columns) is indexed, and its number is part of each
    table's commit. A batch that failed between the vectors and the documents runs again: the vectors have its number and stay, the
    documents follow. Of equal contents, in a batch or over batches, the second is a duplicate and has no row of its own.
    One stream of a ``name`` writes to the tables, with one checkpoint."""

    def each(batch: DataFrame, number: int) -> None:
        store.index_documents(batch, documents, vectors, dims, embedder=embedder, mark=(name, number))

    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
