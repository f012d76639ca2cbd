"""Findings, their queries, and rules on assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.functions.labs import lab_is_out
from docevidence.functions.text import fold_text
from docevidence.operators.evidence import inline_citations

# The score bands of the levels.
BANDS = {"low": (0, 39), "medium": (40, 69), "high": (70, 100)}


def lab_line(lab: Column) -> Column:
    """A lab (name, value, unit, normal_range, flag, is_abnormal) as one line."""
    out = F.concat_ws(" ", F.concat(lab["name"], F.lit(":")), lab["value"], lab["unit"])
    out = F.concat(out, F.coalesce(F.concat(F.lit(" (reference range "), lab["normal_range"], F.lit(")")), F.lit("")))
    return F.concat(out, F.when(lab_is_out(lab["flag"], lab["is_abnormal"]), F.concat(F.lit(" - "), F.coalesce(lab["flag"], F.lit("Abnormal")))).otherwise(""))


def finding_queries(labs: Column, impressions: Column, symptoms: Column, most: int = 6) -> Column:
    """Q4: search phrases of a case: labs out of range, written diagnoses, symptoms, other labs; each once, ``most`` at most."""
    out = F.filter(labs, lambda x: lab_is_out(x["flag"], x["is_abnormal"]))
    rest = F.filter(labs, lambda x: ~lab_is_out(x["flag"], x["is_abnormal"]))
    phrases = F.concat(F.transform(out, lambda x: F.concat_ws(" ", x["name"], F.coalesce(x["flag"], F.lit("abnormal")))), impressions, symptoms, F.transform(rest, lambda x: x["name"]))
    return F.slice(F.array_distinct(F.filter(F.transform(phrases, lambda p: F.trim(p)), lambda p: p != "")), 1, most)


def numbered_findings(cases: DataFrame, request: str, parts: list[Column], most: int = 90) -> DataFrame:
    """Q5: (request, finding_id F1.., text) of a case's parts (arrays of text, null or empty ones left out), in order."""
    lists = F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))
    rows = cases.select(request, F.posexplode(F.slice(F.filter(lists, lambda t: t.isNotNull() & (F.trim(t) != "")), 1, most)).alias("n", "text"))
    return rows.select(request, F.concat(F.lit("F"), (F.col("n") + 1).cast("string")).alias("finding_id"), "text")


def trace_findings(claims: DataFrame, findings: DataFrame, request: str, claim: str) -> DataFrame:
    """(request, claim, finding_id, share): each claim's finding that holds all its numbers and 60 % of its words, by the folded
    texts; the best share, then the first finding. A claim without words has none. Findings are as many as claims, whatever the estimate of
    their size says, so they are never broadcast."""
    words = lambda c: F.filter(F.split(fold_text(c), " "), lambda w: F.length(w) >= 2)
    c = claims.select(request, claim, words(F.col(claim)).alias("cw"))
    f = findings.select(request, "finding_id", F.split(fold_text(F.col("text")), " ").alias("fw"))
    number = F.filter("cw", lambda w: w.rlike("[0-9]"))
    share = F.try_divide(F.size(F.filter("cw", lambda w: F.array_contains("fw", w))), F.size("cw"))  # null without words
    both = c.join(f.hint("merge"), request).filter(F.size(F.array_except(number, "fw")) == 0).withColumn("share", share).filter(F.col("share") >= 0.6)
    rank = F.row_number().over(Window.partitionBy(request, claim).orderBy(F.desc("share"), F.substring("finding_id", 2, 9).cast("int")))
    return both.withColumn("__n", rank).filter("__n = 1").select(request, claim, "finding_id", "share")


def clamp_score(level: Column, score: Column) -> Column:
    """(score, adjusted): the rounded score (halves up) inside its level's band."""
    rounded = F.floor(score + 0.5)
    low, high = F.lit(0), F.lit(100)
    for name, (a, b) in BANDS.items():
        low, high = F.when(level == name, a).otherwise(low), F.when(level == name, b).otherwise(high)
    inside = F.greatest(low, F.least(high, rounded))
    return F.struct(F.when(score.isNotNull(), inside.cast("int")).alias("score"), F.coalesce(inside != rounded, F.lit(False)).alias("adjusted"))


def verify_assessments(outputs: DataFrame, evidence: DataFrame, findings: DataFrame | None = None, require_reference: bool = True) -> DataFrame:
    """Status and reason of assessments (request_id, risk_level, risk_score, summary, cited, insufficient, and where there are
    findings key_findings: array<struct<finding, ids>>) from evidence (request_id, domain, evidence_id) and findings (request_id,
    finding_id, text).

    Ids in the lists and in the prose count, upper case, each once; F ids name findings. A key finding without a valid id is traced to
    the finding it restates (J13). The model's own report decides first, then a case that cites no evidence and no finding, then missing
    and uncited reference evidence. An insufficient case has no level and no score; a summary of under ten characters is rejected.
    ``dropped`` counts ids that nothing has; ``findings_cited`` are the findings in use. Null lists count as empty.
    """
    none = F.array().cast("array<string>")
    ids = lambda c: F.array_distinct(F.transform(F.coalesce(c, none), lambda i: F.upper(F.trim(i))))
    have = evidence.groupBy("request_id").agg(F.collect_set("evidence_id").alias("ids"), F.collect_set(F.when(F.col("domain") == "reference", F.col("evidence_id"))).alias("refs"))
    a = outputs.join(have, "request_id", "left").withColumn("ids", F.coalesce("ids", none)).withColumn("refs", F.coalesce("refs", none))
    if findings is None:
        a = a.withColumn("own", none).withColumn("key_ids", none).withColumn("traced", none)
    else:
        a = a.join(findings.groupBy("request_id").agg(F.collect_set("finding_id").alias("own")), "request_id", "left").withColumn("own", F.coalesce("own", none))
        keys = a.select("request_id", "own", "ids", F.explode("key_findings").alias("k")).filter(F.trim("k.finding") != "").select("request_id", F.col("k.finding").alias("finding"), ids(F.col("k.ids")).alias("i"), F.concat("own", "ids").alias("known"))
        keys = keys.withColumn("fine", F.array_intersect("i", "known"))
        found = trace_findings(keys.filter(F.size("fine") == 0).select("request_id", "finding").distinct(), findings, "request_id", "finding").groupBy("request_id").agg(F.collect_set("finding_id").alias("traced"))
        listed = keys.groupBy("request_id").agg(F.flatten(F.collect_list("i")).alias("key_ids"))
        a = a.join(listed, "request_id", "left").join(found, "request_id", "left").withColumn("key_ids", F.coalesce("key_ids", none)).withColumn("traced", F.coalesce("traced", none))
    prose = inline_citations(F.coalesce("summary", F.lit("")))
    a = a.withColumn("all", F.array_distinct(F.concat(ids(F.col("cited")), F.col("key_ids"), prose if findings is not None else F.filter(prose, lambda i: ~i.startswith("F")))))
    a = a.withColumn("valid", F.array_intersect("all", "ids")).withColumn("dropped", F.size(F.array_except("all", F.concat("ids", "own"))))
    a = a.withColumn("findings_cited", F.array_sort(F.array_distinct(F.concat(F.array_intersect("all", "own"), "traced"))))
    reason = F.when(F.length(F.regexp_replace(F.coalesce("summary", F.lit("")), r"[\s.]", "")) < 10, "summary_too_short").when(F.coalesce("insufficient", F.lit(False)), "model_reported").when((F.size("valid") == 0) & (F.size("findings_cited") == 0), "no_valid_citation")
    if require_reference:
        reason = reason.when(F.size("refs") == 0, "no_reference_evidence").when(~F.arrays_overlap("valid", "refs"), "reference_not_cited")
    a = a.withColumn("reason", reason).withColumn("s", clamp_score(F.col("risk_level"), F.col("risk_score")))
    fine = F.col("reason").isNull()
    status = F.when(fine, "assessed").when(F.col("reason") == "summary_too_short", "rejected").otherwise("insufficient_evidence")
    return a.select("request_id", status.alias("status"), "reason", F.when(fine, F.col("risk_level")).alias("risk_level"), F.when(fine, F.col("s.score")).alias("risk_score"), F.when(fine, F.col("s.adjusted")).alias("adjusted"), "valid", "findings_cited", "dropped")


def lifecycle(inputs: DataFrame, results: DataFrame, row_id: str) -> DataFrame:
    """Inputs with what became of them: completed with its result, failed with its category (and no result), else processing."""
    r = results.select(row_id, "summary", "risk_level", "risk_score", "failure_category")
    out = inputs.join(r.withColumn("__there", F.lit(True)), row_id, "left")
    status = F.when(F.col("__there").isNull(), "processing").when(F.col("failure_category").isNotNull(), "failed").otherwise("completed")
    out = out.withColumn("status", status)
    for c in ("summary", "risk_level", "risk_score"):
        out = out.withColumn(c, F.when(F.col("status") == "completed", F.col(c)))
    return out.drop("__there")


def mark_legacy_failures(rows: DataFrame, placeholder: str) -> DataFrame:
    """Rows without status whose summary is the placeholder and whose score is 0 become failed; ``marked`` shows them (a dry run counts it)."""
    hit = F.col("status").isNull() & (F.col("summary") == placeholder) & (F.coalesce(F.col("risk_level"), F.lit("low")) == "low") & (F.coalesce(F.col("risk_score"), F.lit(0)) == 0)
    out = rows.withColumn("marked", F.coalesce(hit, F.lit(False))).withColumn("status", F.when(F.col("marked"), "failed").otherwise(F.col("status")))
    for c in ("risk_level", "risk_score"):
        out = out.withColumn(c, F.when(~F.col("marked"), F.col(c)))
    return out
