"""Whether an extracted item stands in its document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docevidence.functions.labs import same_key, test_key
from docevidence.functions.text import fold_text

# Words that don't ground anything.
STOP_WORDS = "the and for with total test level levels count serum blood of in to at a".split()


def tokens(folded: Column) -> Column:
    """Significant words of a folded text."""
    return F.filter(F.split(folded, " "), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def fold_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Folds each page once: (doc, page, folded, words)."""
    folded = pages.select(doc, page, fold_text(F.col(text)).alias("folded"))
    return folded.select(doc, page, "folded", F.array_distinct(F.filter(F.split("folded", " "), lambda w: w != "")).alias("words"))


def stands_for(word: Column, token: Column) -> Column:
    """A word is a token's where it is the token or, from four letters on, one begins with the other."""
    return (word == token) | ((F.length(token) >= 4) & (F.length(word) >= 4) & (F.startswith(word, token) | F.startswith(token, word)))


def _any_word(words: Column, token: Column) -> Column:
    return F.array_contains(words, token) | F.exists(words, lambda w: stands_for(w, token))


def _met(facts: DataFrame, folded: DataFrame, doc: str, fact: str, page: str, holds) -> DataFrame:
    """(doc, fact, pages): a document's facts (struct f) meet each of its pages in one row, which keeps those that ``holds`` (a function of f, the
    page's folded text and its words). No word is a row, and one shuffle by document serves both steps."""
    lists = facts.groupBy(doc).agg(F.collect_list("f").alias("fs"))
    both = folded.select(doc, page, "folded", "words").join(lists.hint("merge"), doc)
    found = both.select(doc, page, F.explode(F.filter("fs", lambda f: holds(f, F.col("folded"), F.col("words")))).alias("f"))
    return found.groupBy(doc, F.col(f"f.{fact}").alias(fact)).agg(F.array_sort(F.collect_set(page)).alias("pages"))


def text_pages(facts: DataFrame, folded: DataFrame, doc: str, fact: str, value: str, page: str) -> DataFrame:
    """(doc, fact, pages): pages that hold the folded value, or all of its significant words. Facts meet only their own document's pages.

    A page that holds a value holds its significant words, so those are enough; a value without any is looked for whole.
    """
    f = facts.select(doc, fact, fold_text(F.col(value)).alias("needle")).filter(F.col(doc).isNotNull() & F.col(fact).isNotNull() & (F.col("needle") != ""))
    f = f.select(doc, F.struct(fact, "needle", F.array_distinct(tokens(F.col("needle"))).alias("tokens")).alias("f"))
    around = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return _met(f, folded, doc, fact, page, lambda f, text, words: F.when(F.size(f["tokens"]) > 0, F.forall(f["tokens"], lambda t: _any_word(words, t))).otherwise(F.contains(around(text), around(f["needle"]))))


def lab_pages(labs: DataFrame, folded: DataFrame, doc: str, fact: str, name: str, value: str, page: str) -> DataFrame:
    """Pages with the value's first token as a whole token and any significant word of the name."""
    f = labs.select(doc, fact, F.split(fold_text(F.col(value)), " ")[0].alias("word"), tokens(fold_text(F.col(name))).alias("tokens")).filter(F.col(doc).isNotNull() & F.col(fact).isNotNull() & (F.col("word") != ""))
    f = f.select(doc, F.struct(fact, "word", "tokens").alias("f"))
    return _met(f, folded, doc, fact, page, lambda f, _, words: F.array_contains(words, f["word"]) & ((F.size(f["tokens"]) == 0) | F.exists(f["tokens"], lambda t: _any_word(words, t))))


def range_is_printed(span: Column, words: Column) -> Column:
    """All numbers of a range stand on the page."""
    numbers = F.regexp_extract_all(span, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    return (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.array_contains(words, F.replace(n, F.lit(","), F.lit("."))))


def labs_not_in_tables(model_labs: DataFrame, table_rows: DataFrame, doc: str, name: str, test: str) -> DataFrame:
    """The model's labs that no table row of the document already has."""
    rows = table_rows.select(F.col(doc).alias("__doc"), test_key(F.col(test)).alias("__test")).groupBy("__doc").agg(F.collect_set("__test").alias("__tests"))
    labs = model_labs.withColumn("__name", test_key(F.col(name)))
    there = F.coalesce(F.exists("__tests", lambda t: same_key(F.col("__name"), t)), F.lit(False))
    return labs.join(rows.hint("merge"), F.col(doc) == F.col("__doc"), "left").filter(~there).drop("__doc", "__tests", "__name")
