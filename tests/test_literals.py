"""Literal cases for functions that no registered query reaches."""

import numpy as np
from pyspark.sql import functions as F

from docevidence.functions import labs
from docevidence.operators import embedders, layout, prompting, retrieval
from docevidence.plans import evaluate, ingest, questions, store
from docevidence.sources import vocabulary


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_dataset_version_and_date(spark):
    assert [one(spark, vocabulary.dataset_version(F.lit(n))) for n in ("desc2025.xml", "topics.xml", "old/desc1999.gz")] == ["2025", None, "1999"]
    assert one(spark, vocabulary.dataset_date(F.lit('<health-topics date-generated="03/07/2025 02:30:47">'))) == "2025-03-07"


def test_row_text(spark):
    row = lambda *v: F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(v, ("test", "result", "unit", "reference_range", "flag", "date"), strict=True)))
    full = one(spark, labs.row_text(row("Iron", "12", "g/L", "5 - 9", "High", "1 May"), F.lit(3)))
    assert full == "Iron:\nResult = 12 g/L\nReference range = 5 - 9 g/L\nFlag = High\nDate = 1 May\nPage = 3"
    assert one(spark, labs.row_text(row("Iron", "12", "g/L", "5 - 9 g/L", None, None))) == "Iron:\nResult = 12 g/L\nReference range = 5 - 9 g/L"
    assert one(spark, labs.row_text(row("Iron", "12", None, None, None, None))) == "Iron:\nResult = 12"


def test_reference_table_segments(spark):
    rows = spark.createDataFrame([("s", 0, 1, "Iron", "12", None, None, None, None)], "doc string, no int, row_index int, test string, result string, unit string, reference_range string, flag string, date string")
    tables = spark.createDataFrame([("s", 0, "mapped"), ("s", 1, "a | b"), ("s", 2, " ")], "doc string, no int, text string")
    got = sorted(tuple(r) for r in layout.reference_table_segments(rows, tables, "doc", "no", "row_index").collect())
    assert got == [("s", 0, 1, "Iron:\nResult = 12"), ("s", 1, 0, "a | b")]


def test_reference_chunks(spark):
    text = "A plain sentence about salts. " * 50
    dense = " ".join(f"[{i}] Author A. Title. J Med. 20{i:02d};1:1-2. doi:10.1/{i}" for i in range(10, 40))
    segments = spark.createDataFrame([("a", 0, "text", "Intro", text), ("a", 1, "table", None, "T:\nResult = 1"), ("b", 0, "text", None, "short"), ("zz", 0, "text", None, "no source")], "source_id string, seg_idx int, content_type string, section string, text string")
    sources = spark.createDataFrame([("a", "T", "O", "other", "2024", None, "u", ["salts", "x"]), ("b", "B", "O", "other", None, None, None, None)], "source_id string, title string, organization string, sourceType string, publicationDate string, version string, url string, medicalTopics array<string>")
    got = ingest.reference_chunks(segments, sources, "s@1").orderBy("source_id", "chunk_index").collect()
    a = [r for r in got if r["source_id"] == "a"]
    assert len(a) == 3 and [r["content_type"] for r in a] == ["text", "text", "table"] and [r["id"] for r in a] == ["a#0", "a#1", "a#2"]
    assert (a[0]["medical_topic"], a[0]["title"], a[0]["domain"], a[0]["embedding_space"], a[0]["chunk_id"]) == ("salts", "T", "reference", "s@1", "a#0")
    assert [(r["id"], r["medical_topic"], r["text"]) for r in got if r["source_id"] == "b"] == [("b#0", None, "short")] and not [r for r in got if r["source_id"] == "zz"] and dense


def test_verbatim_text(spark):
    pages = spark.createDataFrame([(1, "b.pdf", 2, "two"), (1, "b.pdf", 1, "one"), (1, "a.txt", None, "plain"), (2, "c.pdf", 1, None)], "r int, f string, p int, t string")
    got = {r["r"]: r["text"] for r in prompting.verbatim_text(pages, "r", "f", "p", "t").collect()}
    assert got == {1: "--- a.txt ---\nplain\n\n--- b.pdf · page 1 ---\none\n\n--- b.pdf · page 2 ---\ntwo", 2: "--- c.pdf · page 1 ---\n"}


def test_servable_vectors(spark):
    documents = spark.createDataFrame([("u", "d", "f", "indexed", "s"), ("u", "e", "f", "failed", "s"), ("u", "o", "f", "indexed", "old")], "user_id string, document_id string, filename string, status string, embedding_space string")
    row = lambda i, **k: {"namespace": "user-u", "id": i, "domain": "patient", "user_id": "u", "document_id": "d", "chunk_index": 0, "embedding_space": "s", "text": "t"} | k
    rows = [row("d#0"), row("d#1"), row("d#2", chunk_index=2, text=" "), row("d#3", chunk_index=3, user_id="v"), row("d#4", chunk_index=4, embedding_space="old"), row("d#5", chunk_index=5, domain="reference"), row("e#0", document_id="e"), row("o#0", document_id="o"), row("d#6", chunk_index=6, namespace="user-v")]
    got = {r["id"]: r["valid"] for r in store.servable(spark.createDataFrame(rows, "namespace string, id string, domain string, user_id string, document_id string, chunk_index int, embedding_space string, text string"), documents, "u", "s").collect()}
    assert got == {"d#0": True, "d#1": False, "d#2": False, "d#3": False, "d#4": False, "d#5": False, "e#0": False, "o#0": False}


def references(spark):
    texts = [("r#0", "r", "s@16", "treat a high potassium result"), ("r#1", "r", "s@16", "potassium in the blood"), ("t#0", "t", "s@16", "treat a high potassium result"), ("n#0", "n", "s@16", "treat a high potassium result"), ("o#0", "r", "old", "x")]
    refs = spark.createDataFrame(texts, "id string, source_id string, embedding_space string, text string")
    refs = refs.join(retrieval.embed_rows(refs, "id", "text", 16), "id")
    sources = [("r", "indexed", "s@16", "T", "O", "other"), ("t", "indexed", "s@16", "T", "O", "synthetic_test"), ("n", "retired", "s@16", "T", "O", "other")]
    return refs, spark.createDataFrame(sources, "source_id string, status string, embedding_space string, title string, organization string, source_type string")


def test_servable_references(spark):
    refs, sources = references(spark)
    assert {r["id"] for r in retrieval.servable_references(refs, sources, "s@16").collect()} == {"r#0", "r#1"}
    assert {r["id"] for r in retrieval.servable_references(refs, sources, "s@16", synthetic=True).collect()} == {"r#0", "r#1", "t#0"}
    untitled = sources.withColumn("title", F.lit(None).cast("string"))
    assert retrieval.servable_references(refs, untitled, "s@16").count() == 0


def test_retrieve_reference(spark):
    refs, sources = references(spark)
    asked = spark.createDataFrame([(1, ["treat a high potassium result", " treat a high potassium result", "", "potassium"]), (2, ["zzz qqq"]), (3, [])], "request_id int, queries array<string>")
    hits, tops = questions.retrieve_reference(asked, refs, sources, "s@16", 16, floor=0.9)
    assert [(r["request_id"], r["id"], round(r["score"], 6), r["title"]) for r in hits.collect()] == [(1, "r#0", 1.0, "T")]
    t = {r["query_id"]: round(r["top_score"], 6) for r in tops.collect()}
    assert set(t) == {"1#0", "1#1", "2#0"} and t["1#0"] == 1.0


def test_distinct_queries(spark):
    asked = F.array(*map(F.lit, [" a ", "a", "", "b" * 600, "c", "d", "e", "f", "g"]))
    assert one(spark, retrieval.distinct_queries(asked)) == ["a", "b" * 500, "c", "d", "e", "f"]


def test_latest_documents(spark):
    df = spark.createDataFrame([("u", "a", 1, "k"), ("u", "b", 2, None), ("u", "c", 2, "k"), ("v", "d", 9, "k")], "user_id string, document_id string, at int, consultation_id string")
    assert [r["document_id"] for r in ingest.latest_documents(df, "u", "at").collect()] == ["c", "b", "a"]
    assert [r["document_id"] for r in ingest.latest_documents(df, "u", "at", consultation_id="k").collect()] == ["c", "a"]


def test_last_by_id(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "record_id string, ordinal int, v string")
    assert sorted(r["v"] for r in ingest.last_by_id(df, "ordinal").collect()) == ["y", "z"]


def test_chunk_to_evidence(spark):
    df = spark.createDataFrame([("d#0", "f.pdf", 2, 0.5, "text")], "id string, filename string, page int, score double, text string")
    assert prompting.chunk_to_evidence(df).first().asDict() == {"id": "d#0", "filename": "f.pdf", "page": 2, "similarity": 0.5, "content": "text"}


def test_ids_digest(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("id"))
    digest = lambda df: tuple(df.agg(*ingest.ids_digest()).first())
    assert digest(ids) == digest(ids.orderBy(F.rand(1)).repartition(7)) != digest(ids.limit(99)) and digest(ids.limit(0)) == (0, "0" * 32)


def test_evaluation_with_terms_and_times(spark, tmp_path):
    documents = spark.createDataFrame([("d1", "pdf_text", ["iron result low", "sodium result high"]), ("d2", "text", ["calcium"])], "id string, source string, pages array<string>")
    gold = spark.createDataFrame([(1, "sodium result high", True, "d1", 2), (2, "calcium", True, "d2", None), (3, "xylophone", False, None, None)], "query_id int, question string, answerable boolean, expected_document string, expected_page int")
    terms = spark.createDataFrame([("mesh:1", "Glucose", ["sugar"], "sweet")], "record_id string, term string, aliases array<string>, definition string").withColumns({c: F.lit(None).cast("string") for c in ("url", "published", "mesh_id")})
    terms = ingest.term_vectors(terms, "mesh", "M", "NLM", "1", "hash@64", 64)
    probes = spark.createDataFrame([(1, "What is glucose?", "glucose"), (2, "What is zzz?", None)], "query_id int, question string, expected string")
    report, latency, results = evaluate.run_evaluation(documents, gold, str(tmp_path), dims=64, sweep=[0.9], probes=probes, terms=terms)
    got = {(r["part"], r["name"]): r["value"] for r in report.collect()}
    for name in ("hit_1", "mrr", "page_hit", "success", "rejection"):
        assert got["retrieval", name] == 1.0, name
    assert got["sweep", "success@0.9"] == 1.0 and got["terms", "must_hit_hits"] == 1 and got["terms", "must_miss_hits"] == 0
    times = {r["name"]: r["value"] for r in latency.collect()}
    assert set(times) >= {"index_ms", "retrieve_ms", "measure_ms", "terms_ms", "retrieve_ms_per_question"} and min(times.values()) > 0
    assert results.filter("page_hit").count() == 1


def test_space_names():
    assert embedders.HashEmbedder(8).space == "hash@8" == embedders.chosen(None, None, 8).space
    assert embedders.ModelEmbedder("m", lambda: lambda t: np.zeros((len(t), 2)), 2).space == "m@2"
