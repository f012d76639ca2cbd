from pyspark.sql import functions as F

from docevidence.functions import labs, routing, text
from docevidence.operators import evidence, structure


def one(spark, fn, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(fn(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.normalize_text, " a\r\n\r\n\r\n\r\nb  \tc\x07 \n d ") == "a\n\nb c\nd"
    assert one(spark, text.fold_text, "Crème 98. BRÛLÉE, 4.5%.") == "creme 98 brulee 4.5%"
    assert one(spark, text.term_key, "HEMOGLOBIN-A1c.") == "hemoglobin a1c"
    assert one(spark, text.decode_entities, "&amp;lt; &#65; &#x42; &unknown; &deg;") == "&lt; A B &unknown; °"
    assert one(spark, text.html_to_text, "<p>Hi<br>there</p><ul><li>x</li></ul><script>bad()</script>") == "Hi\nthere\n\n- x"
    assert one(spark, text.us_date_to_iso, "3/7/2024 10:00") == "2024-03-07" and one(spark, text.us_date_to_iso, "2024-03-07") is None
    assert one(spark, lambda c: text.truncate_sentence(c, 20), "One two. Three four five six") == "One two. Three four"[:0] + "One two. Three four"
    assert one(spark, text.clean_lab_name, "Glucose | page 3") == "Glucose" and one(spark, text.clean_lab_name, "report.pdf") == "report.pdf"
    assert one(spark, text.scrub_name, "Ann Smith met annie", "Ann Smith") == "[patient] [patient] met annie"
    assert one(spark, text.fuzzy_match, "ab", "abc") is False and one(spark, text.fuzzy_match, "Serum Glucose", "glucose") is True
    assert one(spark, text.normalize_text, None) is None


def test_labs(spark):
    flag = lambda v, r: one(spark, labs.flag_from_range, v, r)
    assert [flag("35.9 %", "36 - 46 %"), flag("12", "< 10"), flag("20", "> 40"), flag("5", "0 – 5"), flag("NEGATIVE", "0 - 1"), flag("1", "0 - 0 %"), flag("<5", "1 - 9")] == ["Low", "High", "Low", "Normal", None, None, None]
    assert one(spark, labs.result_number, "1,234 mg") == 1234.0 and one(spark, labs.result_number, "4,5") == 4.5
    assert one(spark, labs.normalize_flag, "WNL") == "Normal" and one(spark, labs.normalize_flag, "odd") == "odd"
    assert one(spark, labs.column_role, "Reference interval") == "referenceRange" and one(spark, labs.column_role, "foo") is None
    assert one(spark, labs.split_delimited, "| a | | b |") == ["a", "", "b"] and one(spark, labs.split_delimited, "|---|:--|") == [] and one(spark, labs.split_delimited, "a b") is None
    assert one(spark, labs.same_test, "HbA1c", "Hb A1c (blood)") is True


def test_questions(spark):
    kind = lambda q: tuple(one(spark, routing.classify_question, q))
    assert kind("What is a creatinine test?") == ("terminology", "creatinine test")
    assert kind("What does HbA1c mean?") == ("terminology", "hba1c")
    assert kind("What is the haemoglobin level?") == ("report", None)
    assert kind("Should I take more?") == ("clinical", None)
    assert one(spark, routing.lookup_keys, "What is a creatinine test?") == ["creatinine test", "creatinine"]


def test_citations(spark):
    assert one(spark, evidence.inline_citations, "a [P1, r2] b [X9] c [p1]") == ["P1", "R2"]
    row = spark.createDataFrame([("a [P1] b [R2; P3] c [F1][P1].", ["P1", "P3"])], "t string, a array<string>")
    assert row.select(evidence.strip_citations("t", "a").alias("x")).first()["x"] == "a [P1] b [P3] c [P1]."


def test_chunks_and_sections(spark):
    body = " ".join(f"Sentence number {i} ends here." for i in range(200))
    docs = spark.createDataFrame([("d", 0, body, "text"), ("d", 1, "row", "table"), ("e", 0, "", "text")], "document_id string, seg_idx int, text string, content_type string")
    rows = structure.prepare_chunks(docs, size=200, overlap=40, most=10).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(10)) and all(r["truncated"] and len(r["text"]) <= 200 for r in rows)
    page = spark.createDataFrame([("d", "intro\n# One\nbody\n\nRESULTS AND MORE\nlast")], "id string, text string")
    assert [(r["section"], r["text"]) for r in structure.split_sections(page, "id", "text").orderBy("part").collect()] == [(None, "intro"), ("One", "body"), ("RESULTS AND MORE", "last")]


def test_tables_and_identity(spark):
    doc = spark.createDataFrame([("d", "x\nTest | Result\nNa | 140\nK | \n\nTest | Result\nend")], "id string, text string")
    rows = structure.delimited_tables(doc, "id", "text").collect()
    assert [(r["table_no"], r["test"], r["numeric_result"]) for r in rows] == [(0, "Na", 140.0)]
    pages = spark.createDataFrame([("d", 2, "Patient Name: B"), ("d", 1, "Patient Name : Ann Lee | x\nAge/Sex: 58Y/F")], "id string, page int, text string")
    assert tuple(structure.extract_identity(pages, "id", "page", "text").first())[:4] == ("d", "Ann Lee", 58, "Female")
