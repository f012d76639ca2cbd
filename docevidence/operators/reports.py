"""Operational reports (A1-A5, A11, A12, F8, F9, W7, W8) and rate-limit audits (ST1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = ("low", "medium", "high")


def has_conclusion(status: Column, level: Column) -> Column:
    """not running and not failed (an absent status counts as done), with a level."""
    return (status.isNull() | ~status.isin("processing", "failed")) & level.isin(*LEVELS)


def risk_dashboard(rows: DataFrame, tenant: str, status: str, level: str, score: str) -> DataFrame:
    """A1: per tenant and level the count and mean score (one decimal, halves to even)."""
    done = rows.filter(has_conclusion(F.col(status), F.col(level)))
    return done.groupBy(tenant, level).agg(F.count("*").alias("n"), F.bround(F.avg(score), 1).alias("mean_score"))


def dashboard_totals(rows: DataFrame, tenant: str, status: str, level: str) -> DataFrame:
    """A1: per tenant all, failed and inconclusive rows."""
    return rows.groupBy(tenant).agg(F.count_if(has_conclusion(F.col(status), F.col(level))).alias("total"), F.count_if(F.col(status) == "failed").alias("failed"), F.count_if(F.coalesce(F.col(status), F.lit("completed")).isin("completed") & ~F.coalesce(F.col(level).isin(*LEVELS), F.lit(False))).alias("inconclusive"))


def call_stats(calls: DataFrame, group: list[str], latency: str, failed: Column, fallback: Column | None = None, tokens: list[str] | None = None, newest: str | None = None, last: int = 2000) -> DataFrame:
    """A2 with A3: calls, errors, fallback calls, nearest-rank percentiles of the latency and sums of ``tokens`` (columns).

    With ``newest`` (a unique order, such as a sequence number) only the ``last`` calls count, as in a ring buffer of that size.
    """
    if newest:
        calls = calls.orderBy(F.desc(newest)).limit(last)
    at = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{latency}`)").alias(name)
    more = [*([F.count_if(fallback).alias("fallbacks")] if fallback is not None else []), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens or [])]
    return calls.groupBy(*group).agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), at(0.5, "p50"), at(0.95, "p95"), *more)


def failures_by_category(calls: DataFrame, group: list[str], failed: Column, category: Column) -> DataFrame:
    """A2: the failed calls of each group by category."""
    return calls.filter(failed).groupBy(*group, category.alias("category")).agg(F.count("*").alias("n"))


def failure_counts(events: DataFrame, category: Column) -> DataFrame:
    """A4: the number of events of each category; those without one are a category of their own."""
    return events.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def classify_error(name: Column, http_status: Column) -> Column:
    """Error name, then HTTP status, to a failure category."""
    # Names of schema errors.
    schema = ["AI_NoObjectGeneratedError", "AI_NoOutputGeneratedError", "AI_TypeValidationError", "AI_JSONParseError", "NoObjectGeneratedError", "NoOutputGeneratedError", "TypeValidationError", "JSONParseError", "ZodError", "OutputValidationError"]
    return (
        F.when(name == "AIConfigurationError", "configuration_error")
        .when(name.isin("AbortError", "TimeoutError") | name.rlike("(?i)aborted|timed? ?out"), "provider_timeout")
        .when(name.isin(schema), "schema_validation_failure")
        .when(http_status == 429, "provider_rate_limited")
        .when(http_status == 404, "model_unavailable")
        .otherwise("provider_failure")
    )


def attempt_outcome(attempts: DataFrame, run: str, category: str) -> DataFrame:
    """One category if all attempts of a run agree, a timeout where none has one (null ones don't count), else exhausted."""
    kinds = attempts.groupBy(run).agg(F.collect_set(category).alias("k"))
    return kinds.select(run, F.when(F.size("k") == 0, "provider_timeout").when(F.size("k") == 1, F.col("k")[0]).otherwise("fallback_exhausted").alias("outcome"))


def page_of(rows: DataFrame, tenant: str, newest: str, row_id: str, page: int, limit: int, name: Column | None = None, search: str | None = None) -> DataFrame:
    """W8 (with F8): one page of each tenant's rows, newest first, ties by id descending; ``limit`` is 50 at most."""
    limit = max(1, min(limit, 50))
    if search:
        rows = rows.filter(F.contains(F.lower(name), F.lit(search.lower())))
    rank = F.row_number().over(Window.partitionBy(tenant).orderBy(F.desc(newest), F.desc(row_id)))
    return rows.withColumn("position", rank).filter(F.col("position").between((page - 1) * limit + 1, page * limit))


def rate_violations(events: DataFrame, key: str, ts: str, event_id: str, window_seconds: int, most: int) -> DataFrame:
    """ST1, batch: events beyond ``most`` in a window of their key that its first event opens, with the seconds to wait.

    A window's start depends on where the one before ended, so a key is read in time order; its rows go through one task sorted, in
    constant state, and are never held together.
    """
    rows = events.select(F.col(key).alias("k"), F.col(event_id).alias("e"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    width = window_seconds * 1_000_000

    def audit(batches):
        last, reset, n = None, 0, 0
        for b in batches:
            out = []
            for k, e, t in zip(b["k"].tolist(), b["e"].tolist(), b["t"].tolist(), strict=True):
                if k != last or t > reset:
                    last, reset, n = k, t + width, 1
                elif n >= most:
                    out.append((k, e, -(-(reset - t) // 1_000_000)))
                else:
                    n += 1
            yield pd.DataFrame(out, columns=["k", "e", "retry_after"]).astype({"k": b["k"].dtype, "e": b["e"].dtype, "retry_after": "int64"})

    kind = lambda c: events.schema[c].dataType.simpleString()
    found = rows.filter("k is not null and t is not null").repartition("k").sortWithinPartitions("k", "t", "e").mapInPandas(audit, f"k {kind(key)}, e {kind(event_id)}, retry_after bigint")
    return found.select(F.col("k").alias(key), F.col("e").alias(event_id), "retry_after")
