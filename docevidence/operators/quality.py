"""Quality metrics of retrieval, extraction and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; an empty denominator gives 1."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def set_counts(predicted: DataFrame, expected: DataFrame, case: str, key: str) -> DataFrame:
    """E2 by equality: (case, tp, fp, fn) of two multisets of keys; each item matches one item."""
    # Only keys that the other side has are counted by key; the rest needs each case's totals.
    there = expected.select(case, key).distinct()
    number = lambda df: df.groupBy(case, key).agg(F.count("*").alias("n"))
    both = number(predicted.select(case, key).join(there, [case, key], "left_semi")).join(number(expected).withColumnRenamed("n", "e"), [case, key])
    part = lambda df, p, e, hit: df.select(case, p.cast("long").alias("p"), e.cast("long").alias("e"), hit.cast("long").alias("tp"))
    zero = F.lit(0)
    total = lambda df: df.groupBy(case).agg(F.count("*").alias("n"))
    rows = part(total(predicted), F.col("n"), zero, zero).unionByName(part(total(expected), zero, F.col("n"), zero)).unionByName(part(both, zero, zero, F.least("n", "e")))
    sums = rows.groupBy(case).agg(*(F.sum(c).alias(c) for c in ("p", "e", "tp")))
    return sums.select(case, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("e") - F.col("tp")).alias("fn"))


def micro_prf(counts: DataFrame) -> DataFrame:
    """One row: the counts summed over all cases, then E1; without cases the sums are null and all measures 1, 1 and 1."""
    s = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def ranking(questions: DataFrame, results: DataFrame, question: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """E5 + E6 per question: hit_k and reciprocal rank; ``results`` has question, rank and relevant; no result is a miss."""
    rank = F.min(F.when(F.col("relevant"), F.col("rank")))
    first = results.groupBy(question).agg(rank.alias("first"))
    rows = questions.select(question).join(first, question, "left")
    return rows.select(question, *(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in ks), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def threshold_sweep(scores: DataFrame, thresholds: list[float], score: str, answerable: str) -> DataFrame:
    """Per threshold the answerable questions that pass and the others that are refused."""
    grid = scores.select(F.col(score).alias("s"), F.col(answerable).alias("a"), F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    passed = F.col("s") >= F.col("threshold")
    out = grid.groupBy("threshold").agg(F.count_if(F.col("a")).alias("answerable"), F.count_if(F.col("a") & passed).alias("found"), F.count_if(~F.col("a")).alias("unanswerable"), F.count_if(~F.col("a") & ~passed).alias("refused"))
    return out.withColumn("success", F.try_divide("found", "answerable")).withColumn("rejection", F.try_divide("refused", "unanswerable"))


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """N, least, nearest-rank quartiles, largest."""
    at = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(name)
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.min(value).alias("least"), at(0.25, "p25"), at(0.5, "median"), at(0.75, "p75"), F.max(value).alias("largest"))


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(expected, predicted).agg(F.count("*").alias("n"))


def classification(df: DataFrame, expected: str, predicted: str, classes: list) -> DataFrame:
    """E13 per class: support, precision and recall (null without any)."""
    e, p = F.col(expected), F.col(predicted)
    marks = F.array(*(F.struct(F.lit(c).alias("class"), (e == c).alias("is"), (p == c).alias("said")) for c in classes))
    rows = df.select(F.explode(marks).alias("m")).select("m.*")
    out = rows.groupBy("class").agg(F.count_if("is").alias("support"), F.count_if("said").alias("said"), F.count_if(F.col("is") & F.col("said")).alias("hit"))
    return out.select("class", "support", F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "support").alias("recall"))


def first_relevant(results: DataFrame, question: str) -> DataFrame:
    w = Window.partitionBy(question).orderBy("rank")
    return results.filter("relevant").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def greedy_counts(cases: DataFrame, case: str, predicted: str, expected: str, match) -> DataFrame:
    """E2 with a match predicate (a function of two Columns): predictions in order, each takes the first expected item left that matches.

    ``predicted`` and ``expected`` are arrays of one case. Returns (case, pairs: struct<p, e> positions from 0, tp, fp, fn)."""
    start = F.struct(F.array().cast("array<struct<p:int,e:int>>").alias("pairs"), F.lit(0).alias("i"))
    n = F.size(expected)

    def step(s: Column, p: Column) -> Column:
        taken = F.transform(s["pairs"], lambda x: x["e"])
        at = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ~F.array_contains(taken, j) & match(p, F.get(expected, j)))
        hit = F.when((n > 0) & (F.size(at) > 0), F.concat(s["pairs"], F.array(F.struct(s["i"].alias("p"), F.get(at, F.lit(0)).alias("e"))))).otherwise(s["pairs"])
        return F.struct(hit.alias("pairs"), (s["i"] + 1).alias("i"))

    pairs = cases.select(case, predicted, expected, F.aggregate(predicted, start, step, lambda s: s["pairs"]).alias("pairs"))
    tp = F.size("pairs")
    return pairs.select(case, "pairs", tp.alias("tp"), (F.size(predicted) - tp).alias("fp"), (n - tp).alias("fn"))


def retrieval_report(questions: DataFrame, results: DataFrame, question: str, floor: float, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """E9 (and E10 with sources as the relevant items): one row with hit rates, mean reciprocal rank and success over the answerable
    questions, and rejection over the others. ``questions`` has ``answerable``; ``results`` has rank, relevant and score."""
    per = ranking(questions, results, question, ks)
    top = results.groupBy(question).agg(F.max("score").alias("top"))
    rows = questions.select(question, "answerable").join(per, question).join(top, question, "left")
    passed = F.coalesce(F.col("top") >= floor, F.lit(False))
    yes = lambda c: F.avg(F.when(F.col("answerable"), c))
    return rows.agg(F.count_if("answerable").alias("answerable"), *(yes(F.col(f"hit_{k}").cast("double")).alias(f"hit_{k}") for k in ks), yes(F.col("rr")).alias("mrr"), yes(passed.cast("double")).alias("success"), F.avg(F.when(~F.col("answerable"), (~passed).cast("double"))).alias("rejection"))


def source_recall(expected: DataFrame, results: DataFrame, question: str, source: str) -> DataFrame:
    """Per question the share of expected sources that were found, and whether all were."""
    pair = lambda df, e, f: df.select(question, source, F.lit(e).alias("__e"), F.lit(f).alias("__f"))
    found = results.filter(F.col(question).isNotNull() & F.col(source).isNotNull())
    pairs = pair(expected, 1, 0).unionByName(pair(found, 0, 1)).groupBy(question, source).agg(F.max("__e").alias("__e"), F.max("__f").alias("__f")).filter("__e = 1")
    return pairs.groupBy(question).agg((F.sum("__f") / F.count("*")).alias("recall"), (F.sum("__f") == F.count("*")).alias("full"))


def table_report(gold: DataFrame, found: DataFrame, case: str, test: str, fields: list[str]) -> DataFrame:
    """Per case rows matched by their normalised test name, and field accuracy where the gold row has the field."""
    from docevidence.functions.text import eval_normalize

    number = lambda df, name: df.withColumn("__k", eval_normalize(F.col(test))).withColumn("__n", F.row_number().over(Window.partitionBy(case, "__k").orderBy(*fields, test))).withColumn(name, F.lit(1))
    g = number(gold, "__g").select(case, "__k", "__n", "__g", *(F.col(f).alias(f"g_{f}") for f in fields))
    p = number(found, "__p").select(case, "__k", "__n", "__p", *(F.col(f).alias(f"p_{f}") for f in fields))
    both = g.join(p, [case, "__k", "__n"], "full")
    pair = F.col("__g").isNotNull() & F.col("__p").isNotNull()
    asked = sum(((pair & F.col(f"g_{f}").isNotNull()).cast("int") for f in fields), F.lit(0))
    right = sum((F.coalesce(pair & (F.trim(F.col(f"g_{f}").cast("string")) == F.trim(F.col(f"p_{f}").cast("string"))), F.lit(False)).cast("int") for f in fields), F.lit(0))
    out = both.groupBy(case).agg(F.count_if(pair).alias("tp"), F.count_if(F.col("__g").isNull()).alias("fp"), F.count_if(F.col("__p").isNull()).alias("fn"), F.sum(asked).alias("asked"), F.sum(right).alias("right"))
    return out.select(case, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), F.try_divide("right", "asked").alias("field_accuracy"))


def answer_report(answers: DataFrame) -> DataFrame:
    """E14 over rows (answerable, status, cited, expected_source, answer, contains): rates over the rows that each concerns."""
    answered = F.col("status") == "answered"
    rate = lambda when, what: F.avg(F.when(when, what.cast("double")))
    text = F.lower("answer")
    return answers.agg(
        rate(F.col("answerable") & F.col("expected_source").isNotNull(), F.array_contains("cited", F.col("expected_source"))).alias("source_cited"),
        rate(F.col("answerable") & (F.size("contains") > 0), answered & F.forall("contains", lambda c: F.contains(text, F.lower(c)))).alias("contains_expected"),
        rate(~F.col("answerable"), ~answered).alias("unanswerable_handled"),
        rate(answered, F.size("cited") > 0).alias("answered_with_citation"),
    )


def failure_report(expected: DataFrame, observed: DataFrame, scenario: str, category: str) -> DataFrame:
    """Per expected category its scenarios and the share that was observed as it; a missing outcome is wrong."""
    o = observed.select(scenario, F.col(category).alias("__o"))
    rows = expected.join(o, scenario, "left")
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(category) == F.col("__o"), F.lit(False)).cast("double")).alias("accuracy"))
