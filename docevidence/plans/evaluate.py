"""Evaluation runs: reading gold sets and writing reports."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docevidence.functions.text import eval_normalize, fuzzy_match, normalize_gender
from docevidence.operators import quality
from docevidence.operators.embedders import Embedder, chosen
from docevidence.plans import questions as asking
from docevidence.plans import store
from docevidence.plans.scratch import saved

GOLD = "documents array<struct<id:string,source:string,pages:array<string>>>, questions array<struct<id:string,question:string,answerable:boolean,expectedDocumentId:string,expectedPage:int>>"


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, questions, violations) of a nested JSON gold set: a question must name a document of the set, and a page it has."""
    raw = spark.read.schema(GOLD).json(path, multiLine=True)
    documents = raw.select(F.inline("documents"))
    questions = raw.select(F.inline("questions"))
    return documents, questions, gold_violations(documents, questions)


def gold_violations(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, violation) of questions (id, expectedDocumentId, expectedPage) against documents (id, source, pages)."""
    d = documents.select(F.col("id").alias("expectedDocumentId"), "source", F.size("pages").alias("n"), F.lit(True).alias("there"))
    rows = questions.filter("expectedDocumentId is not null").join(d, "expectedDocumentId", "left")
    page = F.col("expectedPage").isNotNull() & ((F.col("source") != "pdf_text") | (F.col("expectedPage") > F.col("n")) | (F.col("expectedPage") < 1))
    return rows.select("id", F.when(F.col("there").isNull(), "unknown_document").when(page, "invalid_page").alias("violation")).filter("violation is not null")


def rate(condition: Column) -> Column:
    """The share of rows that hold; rows where it is null do not count, and without any the rate is null."""
    return F.avg(condition.cast("double"))


def extraction_scores(cases: DataFrame) -> DataFrame:
    """E11 per case: whether name, age and gender match, counts of symptoms, medicines and labs matched loosely (E2), and of the matched labs
    how many have the value's digits and the mark of the gold one.

    cases: id, failure_category (null where it succeeded), predicted and gold, each struct<name, age, gender, symptoms: array<string>,
    medicines: array<string>, labs: array<struct<name, value, is_abnormal>>>. Failed cases are left out; null lists count as empty.
    """
    none = F.array().cast("array<string>")
    rows = cases.filter("failure_category is null")
    names = lambda c: F.transform(F.col(f"{c}.labs"), lambda x: x["name"])
    lists = rows.select("id", *(F.coalesce(F.col(f"{s}.{k}") if k != "labs" else names(s), none).alias(f"{s}_{k}") for s in ("predicted", "gold") for k in ("symptoms", "medicines", "labs")))
    out = rows.select("id", "predicted", "gold")
    for k in ("symptoms", "medicines", "labs"):
        counts = quality.greedy_counts(lists, "id", f"predicted_{k}", f"gold_{k}", fuzzy_match)
        out = out.join(counts.select("id", *(F.col(c).alias(f"{k}_{c}") for c in ("tp", "fp", "fn")), *([F.col("pairs")] if k == "labs" else [])), "id")
    digits = lambda c: F.regexp_replace(eval_normalize(c), "[^0-9.]", "")
    pair = lambda side, key: lambda p: F.get(F.col(f"{side}.labs"), p[key])
    predicted, gold = pair("predicted", "p"), pair("gold", "e")
    same = lambda what: F.size(F.filter("pairs", what))
    return out.select(
        "id", (eval_normalize(F.col("predicted.name")) == eval_normalize(F.col("gold.name"))).alias("name_match"), F.col("predicted.age").eqNullSafe(F.col("gold.age")).alias("age_match"),
        normalize_gender(F.col("predicted.gender")).eqNullSafe(normalize_gender(F.col("gold.gender"))).alias("gender_match"), *(f"{k}_{c}" for k in ("symptoms", "medicines", "labs") for c in ("tp", "fp", "fn")),
        same(lambda p: digits(predicted(p)["value"]) == digits(gold(p)["value"])).alias("value_matches"), same(lambda p: predicted(p)["is_abnormal"].eqNullSafe(gold(p)["is_abnormal"])).alias("flag_matches"),
    )


def extraction_report(cases: DataFrame) -> DataFrame:
    """One row: cases, succeeded, failure rates, field accuracies and the micro PRF of each list, null where nothing succeeded."""
    s = extraction_scores(cases)
    total = cases.agg(F.count("*").alias("cases"), F.count_if(F.col("failure_category").isNull()).alias("succeeded"), F.coalesce(rate(F.col("failure_category").isNotNull()), F.lit(0.0)).alias("failure_rate"), F.coalesce(rate(F.coalesce(F.col("failure_category") == "schema_validation_failure", F.lit(False))), F.lit(0.0)).alias("schema_failure_rate"))
    sums = s.agg(*(rate(F.col(f"{k}_match")).alias(f"{k}_accuracy") for k in ("name", "age", "gender")), F.try_divide(F.sum("value_matches"), F.sum("labs_tp")).alias("value_accuracy"), F.try_divide(F.sum("flag_matches"), F.sum("labs_tp")).alias("flag_accuracy"), *(F.sum(f"{k}_{c}").alias(f"{k}_{c}") for k in ("symptoms", "medicines", "labs") for c in ("tp", "fp", "fn")))
    both = total.join(F.broadcast(sums))  # one row each
    measures = [F.when(F.col("succeeded") > 0, x).alias(f"{k}_{n}") for k in ("symptoms", "medicines", "labs") for x, n in zip(quality.prf(*(F.col(f"{k}_{c}") for c in ("tp", "fp", "fn"))), ("precision", "recall", "f1"), strict=True)]
    return both.select("cases", "succeeded", "failure_rate", "schema_failure_rate", "name_accuracy", "age_accuracy", "gender_accuracy", "value_accuracy", "flag_accuracy", *measures)


def term_probes(probes: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per probe, summary) of probes (query_id, expected: null where it must miss) and their hits (query_id, term, aliases, score,
    position).

    A probe with an expectation is hit if a title or alias of its evidence holds the expected text, in any case; ``top`` is the first
    hit's score (0 without any). The summary has, for both kinds, their number, hits, and least and largest top.
    """
    text = F.lower(F.concat_ws(" ", "term", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")))
    both = probes.join(hits.select("query_id", text.alias("t"), "score", "position"), "query_id", "left")
    per = both.groupBy("query_id", "expected").agg(F.coalesce(F.bool_or(F.contains("t", F.lower("expected"))), F.lit(False)).alias("hit"), F.coalesce(F.min_by("score", "position"), F.lit(0.0)).alias("top"))
    return per, per.groupBy(F.col("expected").isNotNull().alias("must_hit")).agg(F.count("*").alias("probes"), F.count_if("hit").alias("hits"), F.min("top").alias("least"), F.max("top").alias("largest"))


class Stages:
    """How long the stages of a run took, in milliseconds (E9's latency, for a whole stage and per question)."""

    def __init__(self) -> None:
        self.ms: dict[str, float] = {}

    @contextmanager
    def time(self, name: str) -> Iterator[None]:
        start = time.monotonic()
        yield
        self.ms[name] = self.ms.get(name, 0.0) + 1000 * (time.monotonic() - start)

    def rows(self, spark: SparkSession, n: int) -> DataFrame:
        """(part, name, value): each stage's time, and its share of a question."""
        return spark.createDataFrame([("latency", f"{k}_ms{per}", v / by) for k, v in self.ms.items() for per, by in (("", 1), ("_per_question", max(n, 1)))], "part string, name string, value double")


def ranked_results(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits (query_id, document_id, page, rank, score) of gold questions (query_id, answerable, expected_document, expected_page), with relevant (of
    the expected document) and page_hit (on the expected page, too)."""
    both = hits.join(gold.select("query_id", "expected_document", "expected_page"), "query_id")
    relevant = F.coalesce(F.col("document_id") == F.col("expected_document"), F.lit(False))
    return both.withColumn("relevant", relevant).withColumn("page_hit", relevant & F.coalesce(F.col("page") == F.col("expected_page"), F.lit(False)))


def retrieval_measures(gold: DataFrame, results: DataFrame, floor: float, sweep: list[float], ks: tuple[int, ...]) -> DataFrame:
    """(part, name, value) over gold questions and ranked_results: hit rates, reciprocal rank and page hits over the answerable questions with an
    expected document, success (the expected document at or over the floor) and rejection (nothing there), both again for each threshold
    of ``sweep``, and the distribution of the top scores. A measure over no question has no row."""
    per = quality.ranking(gold, results, "query_id", ks)
    best = results.groupBy("query_id").agg(F.max("score").alias("top"), F.max(F.when(F.col("relevant"), F.col("score"))).alias("own"), F.bool_or("page_hit").alias("page_hit"))
    rows = saved(gold.join(per, "query_id").join(best, "query_id", "left"), "measured")
    asked = F.col("answerable") & F.col("expected_document").isNotNull()
    right = lambda t: F.when(F.col("answerable"), F.coalesce(F.col("own") >= t, F.lit(False)))
    refused = lambda t: F.when(~F.col("answerable"), ~F.coalesce(F.col("top") >= t, F.lit(False)))
    measures = {("retrieval", "answerable"): F.count_if("answerable").cast("double"), ("retrieval", "unanswerable"): F.count_if(~F.col("answerable")).cast("double")}
    measures |= {("retrieval", f"hit_{k}"): F.avg(F.when(asked, F.col(f"hit_{k}").cast("double"))) for k in ks}
    measures |= {("retrieval", "mrr"): F.avg(F.when(asked, F.col("rr"))), ("retrieval", "page_hit"): rate(F.when(asked & F.col("expected_page").isNotNull(), F.coalesce("page_hit", F.lit(False))))}
    measures |= {("retrieval", "success"): rate(right(floor)), ("retrieval", "rejection"): rate(refused(floor))}
    for t in sweep:
        measures |= {("sweep", f"success@{t:g}"): rate(right(t)), ("sweep", f"rejection@{t:g}"): rate(refused(t))}
    wide = rows.agg(*(m.alias(f"m{n}") for n, m in enumerate(measures.values())))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), F.col(f"m{n}").alias("value")) for n, (part, name) in enumerate(measures)))).alias("x")).select("x.*")
    tops = quality.distribution(rows.select("answerable", F.coalesce("top", F.lit(0.0)).alias("top")), ["answerable"], "top")
    kinds = ("least", "p25", "median", "p75", "largest")
    of = F.when(F.col("answerable"), "answerable_").otherwise("unanswerable_")
    similar = tops.select(F.explode(F.array(*(F.struct(F.lit("similarity").alias("part"), F.concat(of, F.lit(k)).alias("name"), F.col(k).alias("value")) for k in kinds))).alias("x")).select("x.*")
    return long.filter("value is not null").unionByName(similar)


def run_evaluation(documents: DataFrame, gold: DataFrame, path: str, embedder: Embedder | None = None, dims: int = 256, k: int = 6, floor: float = 0.5, sweep: list[float] | None = None, probes: DataFrame | None = None, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P19 end to end: (report, latency, results) of a gold set: its documents are indexed by P1 into tables below ``path`` (a new folder), its questions
    go through P4 without a floor, and E9's measures follow.

    ``documents``: id, source, pages (array of texts; numbered where the source is pdf_text). ``gold``: query_id, question, answerable,
    expected_document, expected_page. With ``probes`` (query_id, question, expected) and ``terms`` P7 runs over those and E16 follows. ``report`` is
    (part, name, value), ``latency`` the same with times, ``results`` the ranked hits.
    """
    spark, stages, embedder, user = documents.sparkSession, Stages(), chosen(embedder, None, dims), "evaluation"
    tables = store.Table(spark, f"{path}/documents", store.DOCUMENTS), store.Table(spark, f"{path}/vectors", store.VECTORS)
    uploads = documents.select(F.lit(user).alias("user_id"), F.col("id").alias("document_id"), F.col("id").alias("filename"), "source", F.sha2("id", 256).alias("sha256"))
    pages = documents.select("source", F.col("id").alias("document_id"), F.posexplode("pages").alias("seg_idx", "text"))
    pages = pages.withColumns({"content_type": F.lit("text"), "page": F.when(F.col("source") == "pdf_text", F.col("seg_idx") + 1), "table_id": F.lit(None).cast("string")}).drop("source")
    with stages.time("index"):
        store.index_documents(uploads, *tables, embedder=embedder, segments=pages)
    gold = saved(gold, "gold")
    vectors = tables[1].read()
    with stages.time("retrieve"):
        hits, _, _ = store.retrieve_patient(gold.select("query_id", "question"), vectors, tables[0].read(), user, embedder=embedder, k=k, floor=-1.0, max_chars=1 << 30)
        hits = saved(hits.join(vectors.select("id", "page"), "id").select("query_id", "id", "document_id", "page", "rank", "score"), "hits")
    results = ranked_results(gold, hits)
    with stages.time("measure"):
        report = saved(retrieval_measures(gold, results, floor, sweep or [], tuple(sorted({1, min(3, k), k}))), "report")
    if probes is not None and terms is not None:
        with stages.time("terms"):
            found, _ = asking.retrieve_terms(probes.select("query_id", "question"), terms, embedder=embedder)
            _, summary = term_probes(probes.select("query_id", "expected"), found.select("query_id", "term", "aliases", "score", "position"))
            kinds = F.when(F.col("must_hit"), "must_hit_").otherwise("must_miss_")
            summary = summary.select(F.explode(F.array(*(F.struct(F.lit("terms").alias("part"), F.concat(kinds, F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in ("probes", "hits", "least", "largest")))).alias("x")).select("x.*")
            report = saved(report.unionByName(summary), "report")
    return report, stages.rows(spark, gold.count()), results


def write_report(report: DataFrame, path: str, run_id: str) -> None:
    """One JSON file for a run, below ``path``; a run that is written again replaces its own file only."""
    report.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/run={run_id}")


def evaluate(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, row as JSON) of the reports that a run made, each with its own columns; empty reports give no rows."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("report"))
        out = rows if out is None else out.unionByName(rows)
    return out
