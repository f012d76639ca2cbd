"""Citations in answers against the evidence that was supplied."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docevidence.functions.text import fixed_round

# Fixed value: ids in brackets, P patient, R reference, T term, F finding.
GROUP = r"\[\s*([FPRTfprt]\d{1,3}(?:\s*[,;]\s*[FPRTfprt]\d{1,3})*)\s*\]"
_GROUP = re.compile(GROUP)


def inline_citations(text: Column) -> Column:
    """Ids written in brackets, upper case, each once, in order."""
    groups = F.regexp_extract_all(text, F.lit(GROUP), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, "[,;]"), lambda i: F.upper(F.trim(i))))))


@F.pandas_udf(StringType())
def strip_citations(text: pd.Series, allowed: pd.Series) -> pd.Series:
    """Ids that are not allowed go, with their brackets if none is left; neighbouring groups merge; spaces are tidied."""

    def one(t: str | None, ids) -> str | None:
        if t is None:
            return None
        fine = set(ids if ids is not None else ())

        def group(m: re.Match) -> str:
            kept = [i for i in (x.strip().upper() for x in re.split("[,;]", m[1])) if i in fine]
            return f"[{', '.join(kept)}]" if kept else ""

        t = re.sub(r"\]\s*\[(?=[FPRTfprt]\d)", ", ", _GROUP.sub(group, t))
        return re.sub(r"\s+([.,;:])", r"\1", re.sub(r"[ \t]{2,}", " ", t))

    return pd.Series([one(t, a) for t, a in zip(text, allowed, strict=True)])


def citation_record(evidence: DataFrame, most: int = 600) -> DataFrame:
    """Score to four digits, an excerpt, and 12 aliases at most where there are any. Nulls stay null."""
    cut = F.when(F.length("content") > most, F.concat(F.left("content", F.lit(most)), F.lit("…"))).otherwise(F.col("content"))
    if "aliases" in evidence.columns:
        evidence = evidence.withColumn("aliases", F.slice("aliases", 1, 12))
    return evidence.withColumn("similarity", fixed_round(F.col("similarity"), 4)).withColumn("excerpt", cut).drop("content")


def match_citations(cited: DataFrame, evidence: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, domain, id, valid) of the distinct cited ids; ``cited`` has request, domain and ids (array)."""
    ids = cited.select(request, "domain", F.explode(F.array_distinct(F.transform("ids", lambda i: F.upper(F.trim(i))))).alias("id"))
    there = evidence.select(request, "domain", F.col("evidence_id").alias("id")).distinct().withColumn("valid", F.lit(True))
    return ids.join(there, [request, "domain", "id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def verify_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status, reason and citations of each answer (request_id, kind, answer, patient_citations, reference_citations,
    insufficient) from the evidence (request_id, domain, evidence_id).

    The first rule that holds decides: no evidence, a clinical question without reference evidence, the model's own report,
    no valid citation, a clinical answer that cites no reference; else it is answered.
    """
    have = evidence.groupBy("request_id").agg(F.collect_set(F.when(F.col("domain") == "patient", F.col("evidence_id"))).alias("p"), F.collect_set(F.when(F.col("domain") == "reference", F.col("evidence_id"))).alias("r"), F.count("*").alias("n"))
    a = answers.join(have, "request_id", "left").withColumn("inline", inline_citations(F.col("answer")))
    none = F.array().cast("array<string>")
    ids = lambda own, letter: F.array_distinct(F.transform(F.concat(F.coalesce(F.col(own), none), F.filter("inline", lambda i: i.startswith(letter))), lambda i: F.upper(F.trim(i))))
    a = a.withColumn("pi", ids("patient_citations", "P")).withColumn("ri", ids("reference_citations", "R")).withColumn("p", F.coalesce("p", none)).withColumn("r", F.coalesce("r", none))
    a = a.withColumn("pv", F.filter("pi", lambda i: F.array_contains("p", i))).withColumn("rv", F.filter("ri", lambda i: F.array_contains("r", i)))
    other = F.filter("inline", lambda i: ~i.rlike("^[PR]"))
    a = a.withColumn("invalid", F.concat(F.array_except("pi", "p"), F.array_except("ri", "r"), other))
    clinical = F.col("kind") == "clinical"
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no_evidence")
        .when(clinical & (F.size("r") == 0), "no_verified_reference")
        .when(F.coalesce("insufficient", F.lit(False)), "model_reported")
        .when(F.size("pv") + F.size("rv") == 0, "uncited_answer")
        .when(clinical & (F.size("rv") == 0), "clinical_without_reference")
    )
    a = a.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "answered").otherwise("insufficient_context"))
    return a.select("request_id", "kind", "status", "reason", F.concat("pv", "rv").alias("valid"), "invalid", F.when(F.col("reason").isNull(), F.trim(strip_citations(F.col("answer"), F.concat("pv", "rv")))).alias("answer"))
