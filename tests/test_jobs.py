"""Composite jobs and rules on small literal cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docevidence.functions import text
from docevidence.operators import assess, blocks, layout, retrieval, structure
from docevidence.plans import evaluate, extraction, ingest, questions, store
from docevidence.sources import vocabulary


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_fixed_round(spark):
    cases = [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (1.45, 1, 1.4), (0.125, 2, 0.13), (8.345, 2, 8.35), (1e12 + 0.5, 0, 1e12 + 0.5), (0.0, 3, 0.0)]
    for x, digits, want in cases:
        assert one(spark, text.fixed_round(F.lit(x), digits)) == want, x
    assert one(spark, text.fixed_round(F.lit(None).cast("double"), 2)) is None


def test_identity_in_page_order(spark):
    s = "d string, page int, text string"
    rows = [("a", 1, "Sex: F"), ("a", 2, "Age/Sex: 45/M"), ("b", 1, "Age: 50"), ("b", 2, "Age/Sex: 51/M"), ("c", 1, "Patient Name: John Doe\nDear John A Doe,"), ("c", 2, "Dear Ni Other (x"), ("c", 3, None)]
    out = {r["d"]: r for r in structure.extract_identity(spark.createDataFrame(rows, s), "d", "page", "text").collect()}
    assert (out["a"]["age"], out["a"]["gender"]) == (45, "Male") and (out["b"]["age"], out["b"]["gender"]) == (50, None)
    assert [tuple(x) for x in out["c"]["other_names"]] == [("Ni Other", 2)]


def test_topk_rules(spark):
    q = spark.createDataFrame([(1, "s", [1.0, 0.0])], "query_id int, space string, values array<double>")
    v = spark.createDataFrame([(1, "s", [1.0, 1.0]), (2, "s", [0.9999996, 1.0]), (3, "t", [1.0])], "id int, space string, values array<double>")
    hits = retrieval.vector_topk(q, v, ["space"], 2, floor=0.7071067)
    assert [(r["id"], r["rank"]) for r in hits.collect()] == [(1, 1)]  # 2 rounds to the floor but is under it
    with pytest.raises(Exception, match="dimensions"):
        retrieval.vector_topk(q.withColumn("space", F.lit("t")), v, ["space"], 2).collect()
    assert retrieval.same_space(v, "s", 2, "space").count() == 2


def test_topk_in_blocks(spark):
    """Small blocks, one group with most rows, ties, a null and a zero vector: as all pairs say."""
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 10 == 0), [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    rows[50:80] = [(i, s, [1.0, 2.0, 3.0, 4.0]) for i, s, _ in rows[50:80]]
    rows += [(300, 0, None), (301, 0, [0.0] * 4), (302, None, [1.0] * 4), (303, 0, [1.0, None, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "id int, space int, values array<double>").repartition(5)
    q = v.filter("id % 9 = 0 OR id > 299").withColumnRenamed("id", "query_id")

    def alike(a, b):
        if None in a or None in b:
            return 0.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    want = {}
    for i, s, a in rows:
        if (i % 9 == 0 or i > 299) and a is not None and s is not None:
            scored = sorted((-round(alike(a, b), 12), j) for j, t, b in rows if t == s and b is not None and j != i)[:5]
            want[i] = [j for _, j in scored]
    for sizes in ({}, {"vector_rows": 16, "query_rows": 4}):
        tops = blocks.best_in_blocks(q, v, ["space"], 5, "query_id", "id", "values", True, **sizes)
        got = {}
        for r in sorted(tops.collect(), key=lambda r: (r["query_id"], -round(r["score"], 12), r["id"])):
            got.setdefault(r["query_id"], []).append(r["id"])
        assert {i: own[:5] for i, own in got.items()} == want
    assert "NestedLoop" not in retrieval.vector_topk(q, v, ["space"], 3)._jdf.queryExecution().toString()


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"]), (3, None, None)], "i int, k string, l array<string>")
    ids = lambda w: sorted(r["i"] for r in retrieval.metadata_filter(df, w).collect())
    assert ids({"k": "a"}) == [1] and ids({"k": {"$in": ["a", "b"]}, "l": {"$in": ["z", "q"]}}) == [2] and ids({"l": "y"}) == [1] and ids({"k": {"$in": []}}) == []
    with pytest.raises(ValueError):
        retrieval.metadata_filter(df, {"k": {"$gt": "a"}})


def test_assessment_findings(spark):
    out = spark.createDataFrame(
        [(1, "high", 20.4, "A long enough summary", [], False, [("Iron 12 is low", [])]), (2, "high", 99.5, "A long enough summary [F9]", [], False, []), (3, "low", 10.0, "short [R1]", ["R1"], False, None), (4, "medium", None, "A long enough summary [F1]", ["r1"], False, [("x", ["F1", "R7"])])],
        "request_id int, risk_level string, risk_score double, summary string, cited array<string>, insufficient boolean, key_findings array<struct<finding:string,ids:array<string>>>",
    )
    ev = spark.createDataFrame([(1, "reference", "R1"), (4, "reference", "R1")], "request_id int, domain string, evidence_id string")
    fs = spark.createDataFrame([(1, "F1", "iron: 12 low"), (1, "F2", "iron 12 is low today"), (4, "F1", "x")], "request_id int, finding_id string, text string")
    got = {r["request_id"]: r for r in assess.verify_assessments(out, ev, fs, require_reference=False).collect()}
    assert (got[1]["status"], got[1]["risk_score"], list(got[1]["findings_cited"])) == ("assessed", 70, ["F2"])
    assert (got[2]["reason"], got[2]["dropped"]) == ("no_valid_citation", 1) and got[3]["reason"] == "summary_too_short"
    assert (got[4]["status"], got[4]["risk_score"], got[4]["dropped"], list(got[4]["valid"])) == ("assessed", None, 1, ["R1"])
    strict = {r["request_id"]: r["reason"] for r in assess.verify_assessments(out, ev, fs).collect()}
    assert strict[1] == "reference_not_cited"


def vocabulary_of(spark, space="hash@64"):
    rows = [("mesh:1", "Glucose", ["blood sugar"], "sugar in blood"), ("mesh:2", "Iron", [], "a metal"), ("mesh:3", "Sodium", ["natrium"], "a salt of blood sugar glucose")]
    df = spark.createDataFrame(rows, "record_id string, term string, aliases array<string>, definition string").withColumns({c: F.lit(None).cast("string") for c in ("url", "published", "mesh_id", "skip_reason")})
    return df, ingest.term_vectors(df, "mesh", "M", "NLM", "2025", space, 64)


def test_terms(spark):
    records, terms = vocabulary_of(spark)
    q = spark.createDataFrame([(1, "What is glucose?"), (2, "what does natrium mean"), (3, "  "), (4, "unrelated words here")], "query_id int, question string")
    hits, status = questions.retrieve_terms(q, terms, "hash@64", 64, floor=0.99)
    assert {(r["query_id"], r["id"], r["match"], r["position"]) for r in hits.collect()} == {(1, "mesh:1", "exact_term", 1), (2, "mesh:3", "exact_alias", 1)}
    assert {(r["query_id"], r["status"], r["exact"]) for r in status.collect()} == {(1, "ok", 1), (2, "ok", 1), (3, "no_match", 0), (4, "no_match", 0)}
    assert {r["mesh_id"] for r in terms.collect()} == {"1", "2", "3"}
    assert questions.valid_terms(terms.withColumn("organization", F.lit(" ")), "hash@64").count() == 0
    manifest = spark.createDataFrame([], "dataset string, file_sha string, embedding_space string, version string, records long, skipped long")
    stored = spark.createDataFrame([("mesh:1",), ("mesh:9",)], "id string")
    v, stale, row = ingest.ingest_terms(records, "sha", "mesh", "M", "NLM", "1", manifest, stored, "hash@64", 64)
    assert v.count() == 3 and [r["id"] for r in stale.collect()] == ["mesh:9"] and (row.first()["records"], row.first()["skipped"]) == (3, 0)
    again = ingest.ingest_terms(records, "sha", "mesh", "M", "NLM", "1", row, stored, "hash@64", 64)
    assert again[0] is None and again[1].count() == 0
    stats = {r["outcome"]: r["n"] for r in vocabulary.parse_stats(records.union(records.limit(1))).collect()}
    assert stats == {"parsed": 4, "seen": 4, "duplicates": 1}


def test_glossary(spark):
    terms = spark.createDataFrame([(1, questions.GLOSSARY["ldl"]), (2, "zzz")], "query_id int, term string")
    out = questions.retrieve_glossary(terms, questions.glossary(spark, "hash@64", 64), "hash@64", 64)
    assert [(r["query_id"], r["id"]) for r in out.collect() if r["rank"] == 1] == [(1, "ldl")] and len(questions.GLOSSARY) == 20


def test_question_to_evidence(spark, tmp_path):
    documents, vectors = store.Table(spark, str(tmp_path / "d"), store.DOCUMENTS), store.Table(spark, str(tmp_path / "v"), store.VECTORS)
    up = spark.createDataFrame([("u1", "a", "a.txt", "s", "the potassium result of the patient was high")], "user_id string, document_id string, filename string, source string, text string")
    store.index_documents(up, documents, vectors, dims=64)
    _, terms = vocabulary_of(spark)
    refs = spark.createDataFrame([("r#0", "r", "hash@64", "treat a high potassium result")], "id string, source_id string, embedding_space string, text string")
    refs = refs.join(retrieval.embed_rows(refs, "id", "text", 64), "id")
    sources = spark.createDataFrame([("r", "indexed", "hash@64", "T", "O", "other")], "source_id string, status string, embedding_space string, title string, organization string, source_type string")
    q = spark.createDataFrame([("1", "What is glucose?"), ("2", "treat the high potassium result"), ("3", "what is qzx")], "query_id string, question string")
    own = spark.createDataFrame([("2", "structured:9", "STRUCTURED REPORT")], "query_id string, chunk_id string, content string")
    ev, status = questions.route_and_retrieve(q, vectors.read(), documents.read(), terms, refs, sources, "u1", "hash@64", 64, own)
    got = {(r["query_id"], r["evidence_id"], r["chunk_id"]) for r in ev.collect()}
    assert {("1", "T1", "mesh:1"), ("2", "P1", "structured:9"), ("2", "R1", "r#0")} <= got
    kinds = {r["query_id"]: (r["kind"], r["terminology"]) for r in status.collect()}
    assert kinds == {"1": ("terminology", len([g for g in got if g[0] == "1"])), "2": ("clinical", 0), "3": ("report", 0)}
    many = spark.createDataFrame([(1, ["potassium result high", "patient potassium"]), (2, []), (3, ["nothing alike"])], "request_id int, queries array<string>")
    best, states = questions.retrieve_patient_multi(many, vectors.read(), documents.read(), "u1", "hash@64", 64, floor=0.3)
    assert [r["id"] for r in best.filter("request_id = 1").collect()] == ["a#0"] and {tuple(r) for r in states.collect()} == {(1, "ok"), (2, "no_documents"), (3, "below_threshold")}


def test_report_text(spark):
    lab = "array<struct<name:string,value:string,unit:string,normal_range:string,flag:string,is_abnormal:boolean,page:int,pages:array<int>>>"
    rows = [(1, [("Iron", "3", "g", "5 - 9", None, True, None, [1, 2]), ("Zinc", "1", None, None, "Normal", True, 1, None)], None), (2, None, None), (3, [], "low")]
    df = spark.createDataFrame(rows, f"i int, labs {lab}, level string")
    none = F.lit(None)
    details, report = none.cast("struct<age:int,gender:string>"), none.cast("struct<diagnoses:array<string>,scores:array<struct<name:string,result:string>>,measurements:array<struct<name:string,value:string,unit:string>>,dates:array<string>>")
    strings = none.cast("array<string>")
    out = {r["i"]: r["t"] for r in df.select("i", questions.structured_report_text(F.col("labs"), details, report, strings, strings, F.col("level"), none.cast("int"), strings).alias("t")).collect()}
    assert out[1].split("\n")[1:] == ["Lab values outside the range printed in the report (1 of 2):", "- Iron: 3 g (printed range 5 - 9) - abnormal [pp.1, 2]", "Lab values within range: Zinc 1"]
    assert out[2] is None and out[3].endswith("report): low")


def test_extraction(spark):
    pages = spark.createDataFrame([("d", 1, "Serum Iron 12 g/L ref 5 - 9\nJohn Doe, 50 years, male, cough"), ("d", 2, "Iron 12 again"), ("m", 1, "nothing")], "doc string, page int, text string")
    tables = spark.createDataFrame([("d", "t1", "Zinc", "3", None, "1 - 2", None, 2)], "doc string, item string, test string, result string, unit string, reference_range string, flag string, page int")
    documents = spark.createDataFrame([("d", False), ("m", True), ("n", True)], "doc string, model_only boolean")
    s = "doc string, item string, name string, value string, unit string, normal_range string, is_abnormal boolean"
    labs = spark.createDataFrame([("d", "a", "Iron", "12", "g/L", "5 - 9", False), ("d", "b", "zinc", "3", "", "", False), ("d", "c", "Gold", "7", "", "", True), ("m", "e", "Gold", "7", "", "", True), ("n", "f", "Gold", "7", "", "1 - 2", None)], s)
    got = {(r["doc"], r["item"]): r for r in extraction.verify_labs(labs, pages, tables, documents).collect()}
    assert ("d", "b") not in got and (got["d", "t1"]["flag"], got["d", "t1"]["flag_source"], got["d", "t1"]["source"]) == ("High", "printed_range", "table")
    iron = got["d", "a"]
    assert (iron["flag"], iron["is_abnormal"], iron["page"], list(iron["pages"]), iron["outcome"]) == ("High", True, 1, [1], "kept")
    assert [got[k]["outcome"] for k in (("d", "c"), ("m", "e"), ("n", "f"))] == ["dropped", "unverified", "kept"] and got["n", "f"]["flag"] == "High"
    claimed = spark.createDataFrame([("d", "Jane Roe", 50.0, "male"), ("m", "John", 3.0, "female")], "doc string, name string, age double, gender string")
    identity = structure.extract_identity(pages, "doc", "page", "text")
    who = {r["doc"]: tuple(r)[1:] for r in extraction.verify_identity(claimed, identity, pages, documents).collect()}
    assert who == {"d": ("", 50, "male", "dropped"), "m": ("", None, "", "unverified")}


def test_references(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Potassium levels\nA body of text.\n| Test | Result | Unit |\n| Potassium | 5 | mmol |\n| Sodium | 140 | mmol |\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("text without a sidecar", encoding="utf-8")
    (tmp_path / "c.txt").write_text("text", encoding="utf-8")
    meta = {"sourceId": "src-a", "title": "T", "organization": "O", "sourceType": "other", "authorization": "public", "medicalTopics": ["salts"]}
    (tmp_path / "a.meta.json").write_text(json.dumps(meta))
    (tmp_path / "c.meta.json").write_text(json.dumps(meta | {"sourceId": "Bad Id", "extra": 1}))
    texts, sidecars = ingest.read_reference_texts(spark, str(tmp_path)), ingest.read_sidecars(spark, str(tmp_path))
    registry = spark.createDataFrame([], "source_id string, sha256 string, embedding_space string, status string")
    outcome, chunks = ingest.ingest_references(texts, sidecars, registry, "hash@64", 64)
    got = {r["stem"]: (r["outcome"], list(r["reasons"])) for r in outcome.collect()}
    assert got == {"a": ("indexed", []), "b": ("skipped", ["missing_sidecar"]), "c": ("skipped", ["unknown_key", "sourceId"])}
    rows = sorted(chunks.collect(), key=lambda r: r["chunk_index"])
    assert [(r["id"], r["content_type"], r["section"]) for r in rows] == [("src-a#0", "text", "Potassium levels"), ("src-a#1", "table", None), ("src-a#2", "table", None)]
    assert rows[0]["text"] == "A body of text." and rows[1]["text"].startswith("Potassium:") and rows[0]["medical_topic"] == "salts" and len(rows[0]["values"]) == 64
    known = outcome.filter("outcome = 'indexed'").select("source_id", "sha256", F.lit("hash@64").alias("embedding_space"), F.lit("indexed").alias("status"))
    again = {r["stem"]: r["outcome"] for r in ingest.ingest_references(texts, sidecars, known, "hash@64", 64)[0].collect()}
    assert again["a"] == "unchanged"
    ingest.replace_partition(chunks.select("id", "text", "source_id"), str(tmp_path / "t"), "source_id")
    ingest.replace_partition(spark.createDataFrame([("x#0", "t", "x")], "id string, text string, source_id string"), str(tmp_path / "t"), "source_id")
    ingest.replace_partition(chunks.filter("chunk_index = 0").select("id", "text", "source_id"), str(tmp_path / "t"), "source_id")
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"x#0", "src-a#0"}


def test_model_embed(spark):
    def model():
        return lambda texts: np.array([[len(t), 0.0] if t else [0.0, 0.0] for t in texts])

    df = spark.createDataFrame([(1, "abc", "k"), (2, None, "k")], "i int, t string, k string")
    out = {r["i"]: (r["k"], list(r["values"])) for r in ingest.model_embed(df, "i", "t", model, 2, ["k"]).collect()}
    assert out == {1: ("k", [1.0, 0.0]), 2: ("k", [0.0, 0.0])} and ingest.space_id("m", 2) == "m@2"
    with pytest.raises(Exception, match="not"):
        ingest.model_embed(df, "i", "t", model, 3).collect()


def test_two_columns(spark):
    rows = [("d", page, f"w{k}", x + 10.0 * (k % 3), 700.0 - 12 * (k // 3), 9.0) for page, gap in ((1, 200.0), (2, 33.0)) for x in (0.0, gap) for k in range(45)]
    rows += [("s", 1, "few", 0.0, 1.0, 300.0)]
    items = spark.createDataFrame(rows, "document_id string, page int, str string, x double, y double, width double")
    out = layout.two_column_split(items).collect()
    assert [(r["document_id"], r["page"]) for r in out] == [("d", 1)] and 29 < out[0]["gutter"] < 200


def test_extraction_report(spark):
    who = "struct<name:string,age:int,gender:string,symptoms:array<string>,medicines:array<string>,labs:array<struct<name:string,value:string,is_abnormal:boolean>>>"
    p = ("Ann Lee", 5, "f", ["cough"], None, [("Serum Iron", "12 g", True), ("Zinc", "1", False)])
    g = ("ann lee", 5, "Female", ["cough", "fever"], [], [("iron", "12", False)])
    df = spark.createDataFrame([(1, None, p, g), (2, "schema_validation_failure", None, g)], f"id int, failure_category string, predicted {who}, gold {who}")
    r = evaluate.extraction_report(df).first()
    assert (r["cases"], r["succeeded"], r["failure_rate"], r["name_accuracy"], r["gender_accuracy"], r["value_accuracy"], r["flag_accuracy"]) == (2, 1, 0.5, 1.0, 1.0, 1.0, 0.0)
    assert (r["symptoms_recall"], r["labs_precision"]) == (0.5, 0.5)
    assert evaluate.extraction_report(df.filter("id = 2")).first()["symptoms_f1"] is None


def test_gold_and_report(spark, tmp_path):
    gold = {"documents": [{"id": "d", "source": "pdf_text", "pages": ["x"]}], "questions": [{"id": "q1", "question": "?", "answerable": True, "expectedDocumentId": "d", "expectedPage": 2}, {"id": "q2", "question": "?", "answerable": True, "expectedDocumentId": "e"}, {"id": "q3", "question": "?", "answerable": False}]}
    (tmp_path / "g.json").write_text(json.dumps(gold))
    _, asked, wrong = evaluate.read_gold(spark, str(tmp_path / "g.json"))
    assert asked.count() == 3 and {tuple(r) for r in wrong.collect()} == {("q1", "invalid_page"), ("q2", "unknown_document")}
    report = evaluate.evaluate({"gold": wrong, "none": wrong.limit(0)})
    evaluate.write_report(report, str(tmp_path / "r"), "one")
    evaluate.write_report(report, str(tmp_path / "r"), "one")
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert spark.createDataFrame([(True,), (None,)], "b boolean").agg(evaluate.rate(F.col("b"))).first()[0] == 1.0
