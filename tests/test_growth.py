"""Steps that took more than their share on larger tables: joins back to embedded texts, keys of repeated questions, words as rows."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docevidence.functions import labs, text
from docevidence.operators import layout, retrieval
from docevidence.plans import extraction, ingest, questions, store, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_not_joined_back_to_their_texts(spark, tmp_path, monkeypatch):
    plans, writes = [], []
    upsert, write = tables.Table.upsert, tables.Table._write
    monkeypatch.setattr(tables.Table, "upsert", lambda self, rows, **k: plans.append(plan(rows)) or upsert(self, rows, **k))
    monkeypatch.setattr(tables.Table, "_write", lambda self, rows, folder: writes.append(folder) or write(self, rows, folder))
    uploads = spark.createDataFrame([("u", f"d{n}", "f", "text", f"iron {n} of\t the  liver") for n in range(5)], "user_id string, document_id string, filename string, source string, text string")
    documents, vectors = store.Table(spark, f"{tmp_path}/d", store.DOCUMENTS), store.Table(spark, f"{tmp_path}/v", store.VECTORS)
    store.index_documents(uploads, documents, vectors, dims=16)
    assert not any("Join" in p for p in plans)
    assert len(writes) == 2  # rows of a new table are written once
    got = vectors.read().select("id", "text", retrieval.hash_embed(F.col("text"), 16) == F.col("values")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(f"d{n}#0", f"iron {n} of the liver", True) for n in range(5)]
    store.index_documents(uploads.withColumn("text", F.lit("new text")).limit(1), documents, vectors, dims=16)
    assert vectors.read().count() == 5 and vectors.read().filter("text = 'new text'").count() == 1


def test_keys_of_questions_are_made_once(spark, monkeypatch):
    records = spark.createDataFrame([("a", "iron", ["Fe"], "metal"), ("b", "zinc", None, "metal too")], "record_id string, term string, aliases array<string>, definition string")
    records = records.withColumns({c: F.lit(None).cast("string") for c in ("url", "published", "mesh_id")})
    terms = ingest.term_vectors(records, "mesh", "M", "O", "1", "hash@16", 16)
    assert "Join" not in plan(terms)
    seen, topk = [], retrieval.vector_topk
    monkeypatch.setattr(retrieval, "vector_topk", lambda q, *a, **k: seen.append(plan(q)) or topk(q, *a, **k))
    asked = spark.createDataFrame([("What is iron?",)] * 9, "question string").distinct().withColumn("query_id", F.col("question"))
    hits, status = questions.retrieve_terms(asked, terms, "hash@16", 16)
    assert len(seen) == 2 and not any("decompose" in p for p in seen)
    assert [tuple(r) for r in hits.select("id", "match").collect()] == [("a", "exact_term")] and status.first()["status"] == "ok"


def test_cells_of_lines_without_word_rows(spark):
    rng = random.Random(9)
    rows = [(f"d{d}", p, rng.choice(["a", "bb", " ", " c", "Test", "Result"]), float(rng.choice([0, 5, 12, 30, 33, 90])), rng.choice([100.0, 99.0, 98.5, 97.5, 95.0, 60.0]), 0.0) for d in range(12) for p in (1, 2) for _ in range(rng.randint(0, 25))]
    rows = [(*r[:5], {"a": 3.0, "bb": 8.0, "Test": 20.0}.get(r[2], 11.0)) for r in rows]  # words at one place with one text have one width
    rows = list({r[:4]: r for r in rows}.values())  # layout_cells puts words of one text and place in one cell
    items = spark.createDataFrame(rows, "document_id string, page int, str string, x double, y double, width double")
    apart = layout.layout_cells(layout.layout_lines(items)).groupBy("document_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("c"))
    at_once = layout.line_cells(items)
    assert "Window" not in plan(at_once) and plan(at_once).count("Exchange") == 1
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, apart.collect()))


def test_even_texts_stay_as_they_are(spark):
    rng = random.Random(10)
    made = ["".join(rng.choices(["a", "b ", " ", "\n", "\t", "\r", "\x0b", "\x07", " ", " ", "é"], k=rng.randint(0, 9))) for _ in range(2000)]

    def always(c):
        for pattern, to in ((r"\r\n?", "\n"), (text.CONTROL, ""), (text.BLANKS, " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
            c = F.regexp_replace(c, pattern, to)
        return text.trim(c)

    out = spark.createDataFrame([(t,) for t in [*made, None]], "t string").select(text.normalize_text(F.col("t")).alias("a"), always(F.col("t")).alias("b"))
    assert out.filter("NOT a <=> b").count() == 0


def test_documents_are_not_broadcast_to_be_checked(spark, monkeypatch):
    plans, saved = [], extraction.saved
    monkeypatch.setattr(extraction, "saved", lambda df, name: plans.append(plan(df)) or saved(df, name))
    lab = "named_struct('name', 'iron', 'value', '12', 'unit', '', 'normal_range', '5 - 9', 'is_abnormal', false)"
    outputs = spark.range(3).selectExpr("id doc", f"array({lab}) labs", "array('cough') symptoms", "array(named_struct('name', 'BP', 'value', '120', 'unit', '')) measurements")
    pages = spark.range(3).selectExpr("id doc", "1 page", "'a' filename", "'iron 12 ref 5 - 9, cough, BP 120' text")
    tables_ = spark.range(1).selectExpr("id doc", "'1' item", "'zinc' test", "'3' result", "'' unit", "'1 - 2' reference_range", "CAST(NULL AS string) flag", "2 page")
    out = extraction.verify_extractions(outputs, pages, tables_, spark.range(3).selectExpr("id doc", "false model_only"))
    assert len(plans) == 8 and not any("Broadcast" in p for p in [*plans, plan(out)])
    got = out.selectExpr("doc", "transform(labs, x -> x.name || x.flag) labs", "symptoms", "measurements.value", "limitations").orderBy("doc").collect()
    assert [tuple(r) for r in got] == [(n, [*(["zincHigh"] if n == 0 else []), "ironHigh"], ["cough"], ["120"], []) for n in range(3)]


def test_clean_names_stay_as_they_are(spark):
    rng = random.Random(11)
    made = ["".join(rng.choices(["iron", " ", "  ", "\t", "\u00a0", "p. 3", "page 2", "·", "|", "12/3/24", "1", ".", "x.pdf", ".PNG y", "-", "µ", "\u2003"], k=rng.randint(0, 5))) for _ in range(3000)]

    def always(c):
        raw = out = text.trim(c)
        for tail in text.NAME_TAILS:
            out = F.regexp_replace(out, tail, "")
        out = text.trim(F.regexp_replace(out, rf"{text.WS}+", " "))
        return F.when(out == "", raw).otherwise(out)

    out = spark.createDataFrame([(t,) for t in [*made, None]], "t string").select(text.clean_lab_name(F.col("t")).alias("a"), always(F.col("t")).alias("b"), (text.trim(F.col("t")) == "").alias("empty"))
    assert out.filter("NOT a <=> b OR NOT (a = '') <=> empty").count() == 0


def test_ends_of_texts_and_cells(spark):
    rng = random.Random(12)
    made = ["".join(rng.choices([*text.BLANK, "a", "~", "~b", "!", "é", "\u2010", "\x1f", "\x85", "12"], k=rng.randint(0, 4))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in [*made, None]], "t string")
    always = F.col("t")
    for pattern, to in ((r"\r\n?", "\n"), (text.CONTROL, ""), (text.BLANKS, " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        always = F.regexp_replace(always, pattern, to)
    assert df.filter(~text.normalize_text(F.col("t")).eqNullSafe(text.trim(always))).count() == 0
    row = labs.map_row(F.array("t", F.lit("1")), F.array(F.lit("test"), F.lit("result")))
    trimmed = text.trim(F.col("t"))
    assert df.filter(~row["test"].eqNullSafe(F.when(trimmed != "", trimmed))).count() == 0


def test_lines_and_cells_of_pages(spark):
    """Against a walk over each page's words: places that are null or not finite, words in any order, ties, pages cut apart."""
    place = lambda v: (0, 0.0) if v is None else (1, v) if v == v else (2, 0.0)
    number = lambda *v: all(x is not None and x == x for x in v)

    def walk(words):
        lines, anchor, out = [], None, []
        for w in sorted(words, key=lambda w: (place(w["up"]), place(w["x"]), w["str"], place(w["width"]))):
            if number(w["up"], anchor) and abs(w["up"] - anchor) <= layout.LINE_GAP:
                lines[-1].append(w)
            else:
                lines.append([w])
                anchor = w["up"]
        for line in lines:
            cells = []
            for w in sorted(line, key=lambda w: (place(w["x"]), w["str"], place(w["width"]))):
                right = None if None in (w["x"], w["width"]) else w["x"] + w["width"]
                gap = w["x"] - cells[-1][2] if cells and None not in (w["x"], cells[-1][2]) else math.nan
                if -layout.OVERLAP <= gap <= layout.CELL_GAP:
                    cells[-1] = (cells[-1][0], cells[-1][1] + (" " if gap > layout.WORD_GAP else "") + w["str"], right)
                else:
                    cells.append((w["x"], w["str"], right))
            out.append([{"x": x, "text": t} for x, t in sorted(((x, t.strip(" ")) for x, t, _ in cells), key=lambda c: (place(c[0]), c[1]))])
        return out

    rng, kind = random.Random(13), pa.list_(pa.struct([("up", pa.float64()), ("x", pa.float64()), ("str", pa.string()), ("width", pa.float64())]))
    for odd in ([], [None, math.nan, math.inf, -math.inf]):
        pages = [[{"up": rng.choice([-100.0, -99.0, -98.5, -97.5, -95.0, 0.0, *odd]), "x": rng.choice([0.0, 5.0, 12.0, 30.0, 33.0, *odd]), "str": rng.choice(["a", "bb", " c", "é "]), "width": rng.choice([0.0, 3.0, 11.0, *odd])} for _ in range(rng.choice([0, 1, 2, 8, 25]))] for _ in range(300)]
        want = [walk(p) for p in pages]
        for at_once in (1, 40, layout.WORDS_AT_ONCE):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(layout, "WORDS_AT_ONCE", at_once)
                assert repr(layout.cells_of_pages(pa.array([[], *pages], kind).slice(1)).to_pylist()) == repr(want)
    items = spark.createDataFrame([("d", 1, "a", 0.0, 9.0, 1.0)], "document_id string, page int, str string, x double, y double, width double")
    assert "lambda" not in plan(layout.line_cells(items))  # no words in interpreted functions
