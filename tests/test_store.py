import pytest
from pyspark.sql import functions as F

from docevidence.plans import store


@pytest.fixture
def tables(spark, tmp_path):
    return store.Table(spark, str(tmp_path / "d"), store.DOCUMENTS), store.Table(spark, str(tmp_path / "v"), store.VECTORS)


def test_index_retrieve_delete(spark, tables):
    documents, vectors = tables
    rows = [("u1", "a", "a.txt", "s", "sodium potassium chloride results"), ("u1", "b", "b.txt", "s", "sodium potassium chloride results"), ("u1", "c", "c.txt", "s", "  "), ("u2", "d", "d.txt", "s", "sodium potassium chloride results")]
    up = spark.createDataFrame(rows, "user_id string, document_id string, filename string, source string, text string")
    out = {r["document_id"]: (r["status"], r["failure_category"]) for r in store.index_documents(up, documents, vectors, dims=64).collect()}
    assert out == {"a": ("indexed", None), "b": ("duplicate", None), "c": ("failed", "no_extractable_text"), "d": ("indexed", None)}
    again = spark.createDataFrame([("u1", "e", "e.txt", "s", "sodium potassium chloride results")], up.schema)
    assert [tuple(r) for r in store.index_documents(again, documents, vectors, dims=64).collect()] == [("e", "duplicate", None)]
    q = spark.createDataFrame([(1, "sodium results"), (2, "unrelated words entirely")], "query_id int, question string")
    hits, status, _ = store.retrieve_patient(q, vectors.read(), documents.read(), "u1", "hash@64", dims=64)
    assert {r["document_id"] for r in hits.collect()} == {"a"} and {tuple(r) for r in status.collect()} == {(1, "ok", 1, 0), (2, "below_threshold", 1, 0)}
    ids = spark.createDataFrame([("a",), ("d",)], "document_id string")
    assert store.delete_documents("u1", ids, documents, vectors) == {"documents": 1, "vectors": 1}
    assert {r["document_id"] for r in documents.read().collect()} == {"c", "d"}
    _, status, _ = store.retrieve_patient(q, vectors.read(), documents.read(), "u1", "hash@64", dims=64)
    assert {r["status"] for r in status.collect()} == {"no_documents"}


def test_invalid_vectors_count(spark, tables):
    """A vector that breaks a rule takes its place among the best k, is counted, and is not served."""
    documents, vectors = tables
    up = spark.createDataFrame([("u1", "a", "a.txt", "s", "sodium potassium chloride results")], "user_id string, document_id string, filename string, source string, text string")
    store.index_documents(up, documents, vectors, dims=64)
    odd = vectors.read().withColumn("chunk_index", F.lit(7))
    q = spark.createDataFrame([(1, "sodium results")], "query_id int, question string")
    hits, status, scored = store.retrieve_patient(q, odd, documents.read(), "u1", "hash@64", dims=64)
    assert hits.count() == scored.count() == 0 and tuple(status.first()) == (1, "no_matches", 1, 1)


def test_consultation_cascade(spark, tables, tmp_path):
    documents, vectors = tables
    up = spark.createDataFrame([("u1", "a", "a.txt", "s", "some text"), ("u2", "b", "b.txt", "s", "some text")], "user_id string, document_id string, filename string, source string, text string")
    store.index_documents(up, documents, vectors, dims=64)
    cases = store.Table(spark, str(tmp_path / "c"), "user_id string, consultation_id string")
    cases.publish(spark.createDataFrame([("u1", "k"), ("u2", "m")], cases.schema))
    links = spark.createDataFrame([("k", "a"), ("m", "b")], "consultation_id string, document_id string")
    ids = spark.createDataFrame([("k",), ("m",)], "consultation_id string")
    assert store.delete_consultations("u1", ids, cases, links, documents, vectors) == {"consultations": 1, "documents": 1, "vectors": 1}
    assert [r["document_id"] for r in documents.read().collect()] == ["b"] and [r["document_id"] for r in vectors.read().collect()] == ["b"]
