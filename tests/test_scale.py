"""Plans and helpers that keep the work in step with the input: what is not broadcast, not expanded into pairs, and not held by Python."""

import random

import pandas as pd
from pyspark.sql import functions as F

from docevidence.functions import labs, sql, text
from docevidence.operators import assess, blocks, grounding, quality, retrieval, structure
from docevidence.operators.structure import _pieces
from docevidence.sources import vocabulary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_are_not_broadcast(spark):
    claims = spark.createDataFrame([(1, "Märker 11 is high"), (2, " "), (2, "marker 12")], "r long, claim string")
    findings = spark.createDataFrame([(1, "F1", "marker 11 is HIGH"), (2, "F1", "other"), (2, "F2", "marker 12 today")], "r long, finding_id string, text string")
    out = assess.trace_findings(claims, findings, "r", "claim")
    assert "Broadcast" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "Märker 11 is high", "F1", 1.0), (2, "marker 12", "F2", 1.0)]


def test_keys_of_names_at_once(spark):
    rows = spark.createDataFrame([(1, " Äbc\x1fd ", ["é-é", None, "ABC D", "  "]), (2, "x", None), (3, "-", ["?"]), (4, None, ["b", "a"])], "record_id int, term string, aliases array<string>")
    got = {r.record_id: r.alias_keys for r in vocabulary.alias_keys(rows).collect()}
    assert got == {1: ["abc d", "e e"], 2: None, 3: None, 4: ["b", "a"]}


def test_exact_terms_are_cut_before_they_meet_questions(spark):
    terms = spark.range(400).select(F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("alias_keys"))
    asked = spark.range(50).select(F.col("id").alias("q"), F.array(F.lit("b"), F.lit("a")).alias("keys"))
    out = vocabulary.exact_lookup(asked, terms, "q", "keys", most=3)
    assert "WindowGroupLimit [key" in plan(out)
    assert sorted(map(tuple, out.filter("q = 7").collect())) == [(7, 0, 1, "exact_term"), (7, 1, 2, "exact_term"), (7, 2, 3, "exact_term")]


def test_equal_vectors_meet_once(spark, monkeypatch):
    seen = []
    inner = blocks.best_in_blocks
    monkeypatch.setattr(retrieval.blocks, "best_in_blocks", lambda q, v, *a, **k: seen.extend((q.count(), v.count())) or inner(q, v, *a, **k))
    v = spark.range(300).select("id", F.lit("g").alias("g"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("values"))
    out = retrieval.vector_topk(v.withColumnRenamed("id", "query_id"), v, ["g"], 4, skip_own=True)
    assert seen == [3, 3]
    assert sorted(map(tuple, out.filter("query_id IN (3, 299)").select("query_id", "rank", "id", "score").collect())) == [*((3, n, i, 1.0) for n, i in enumerate((0, 6, 9, 12), 1)), *((299, n, i, 1.0) for n, i in enumerate((2, 5, 8, 11), 1))]


def test_entities_without_python(spark):
    rng = random.Random(5)
    parts = ["&amp;", "&#38;", "&#x26;", "amp;", "lt;", "#65;", "&#0;", "&#xD800;", "&#xFEFF;", "&#128512;", "&#00000000065;", "&#9999999;", "&#99999999999999999999;", "&#x110000;", "&nbsp;", "&hellip;", "&Lt;", "&;", "&", ";", "é ", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(500)]
    out = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", text.decode_entities(F.col("t")).alias("d"), text.html_to_text(F.col("t")).alias("h"))
    assert "Python" not in plan(out)
    got = [r.d for r in out.collect()]
    assert got == [*sql.decode_array(pd.Series(texts)), None]


def test_pieces_without_python(spark):
    rng = random.Random(6)
    made = ["".join(rng.choices(["word", " ", "é", ". ", "\n", "\n\n", "x" * 40, "日本"], k=rng.randint(0, 90))) for _ in range(300)]
    for size, overlap in ((50, 24), (90, 0), (200, 30)):
        out = spark.createDataFrame([(t,) for t in [*made, None]], "t string").select(text.normalize_text(F.col("t")).alias("n"), structure.chunk_text(F.col("t"), size, overlap).alias("p"))
        assert "Python" not in plan(out)
        for r in out.collect():
            assert [p.asDict() for p in r.p] == (_pieces(r.n, size, overlap) if r.n is not None else [])


def test_words_of_other_cases_are_not_dealt_by_word(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, "c"), (None, "a")], "c int, t string")
    e = spark.createDataFrame([(1, "a"), (1, "d"), (4, "a"), (None, "a")], "c int, t string")
    out = quality.set_counts(p, e, "c", "t")
    assert "FullOuter" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 1, 2, 1), (2, 0, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (None, 0, 1, 1)]


def test_sources_are_grouped_once(spark):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None), (None, "a")], "q int, s string")
    out = quality.source_recall(e, spark.createDataFrame([(1, "a"), (1, "c"), (2, None), (3, "a"), (None, "a")], "q int, s string"), "q", "s")
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0.5, False), (2, 0.0, False), (None, 0.0, False)]


def test_lines_are_keyed_once(spark):
    rows = [(1, n, f"Page {n} of 9\nDownloaded  from x\nown {'abcdefgh'[n]}" if n < 3 else f"Page {n} of 9\nown {'abcdefgh'[n]}") for n in range(8)]
    out = structure.running_lines(spark.createDataFrame(rows, "d int, p int, t string"), "d", "p", "t", share=0.5)
    assert sorted(map(tuple, out.collect())) == [(1, "Downloaded from x", 3), (1, "Page # of #", 8)]
    assert "LeftSemi" in plan(out)  # texts are read again from few pages


def test_flag_reads_its_value_once(spark):
    flag = labs.flag_from_range(F.col("v"), F.col("r"))
    out = spark.createDataFrame([("5 g", "1 - 4"), ("0,5", "1 to 4"), ("2", "<3"), ("x", "1 - 2"), ("2", "9 - 1"), (None, "1 - 2")], "v string, r string").select(labs.normalize_flag(F.left(flag, F.lit(1))).alias("f"))
    assert plan(out).count("<>=≤≥") == 1
    assert [r.f for r in out.collect()] == ["High", "Low", "Normal", None, None, None]


def test_facts_meet_pages_without_word_rows(spark):
    pages = grounding.fold_pages(spark.createDataFrame([(1, 1, "Iron 5.1 of the"), (1, 2, "irons at 7"), (2, 1, "iron")], "doc int, page int, t string"), "doc", "page", "t")
    facts = spark.createDataFrame([(1, "a", "IRON"), (1, "b", "of the"), (1, "c", "iron 7"), (2, "d", "zinc"), (3, "e", "iron")], "doc int, fact string, v string")
    out = grounding.text_pages(facts, pages, "doc", "fact", "v", "page")
    assert plan(out).count("Generate") == 1 and "Broadcast" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "a", [1, 2]), (1, "b", [1]), (1, "c", [1, 2])]
    labs_of = spark.createDataFrame([(1, 1, "Iron level", "5.1"), (1, 2, "at", "7"), (1, 3, "zinc", "7")], "doc int, item int, name string, value string")
    assert sorted(map(tuple, grounding.lab_pages(labs_of, pages, "doc", "item", "name", "value", "page").collect())) == [(1, 1, [1]), (1, 2, [2])]


def test_embedding_needs_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "Iron iron b 12 ÉTÉ-été"), (2, None), (3, ""), (4, "a b"), (5, "x1 x2 x3 " * 40)], "id int, t string")
    out = retrieval.embed_rows(rows, "id", "t", 16)
    assert "Exchange" not in plan(out)
    want = rows.select("id", retrieval.hash_embed(F.coalesce("t", F.lit("")), 16).alias("values"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
