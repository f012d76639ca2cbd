"""Bucketed tables: what a write touches, two writers, deletion from the disk, batches, and the jobs with a model of one's own."""

import os

import pytest
from pyspark.sql import functions as F

from docevidence.operators import embedders
from docevidence.plans import ingest, questions, store, tables

SCHEMA = "tenant string, id int, text string"
UPLOADS = "user_id string, document_id string, filename string, source string, text string"


@pytest.fixture
def table(spark, tmp_path):
    return tables.Table(spark, str(tmp_path / "t"), SCHEMA, keys=["tenant", "id"], by=["tenant"], groups=8, parts=2)


def files(t):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{t.path}/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_touches_own_buckets(spark, table):
    assert table.read().count() == 0 and table.version() == 0
    table.upsert(spark.createDataFrame([(f"t{k}", i, "old") for k in range(12) for i in range(5)], SCHEMA))
    before = set(table.state()["buckets"].values())
    table.upsert(spark.createDataFrame([("t3", 1, "new"), ("t3", 77, "new")], SCHEMA))
    after = set(table.state()["buckets"].values())
    assert len(before - after) <= 2 and len(after - before) <= 2  # a tenant has two buckets
    assert rows(table.read().filter("text = 'new'")) == [("t3", 1, "new"), ("t3", 77, "new")] and table.read().count() == 61
    assert table.read(version=1).count() == 60
    of = spark.createDataFrame([("t3",)], "tenant string")
    part = table.read(of=of)
    assert part.filter("tenant = 't3'").count() == 6 and len(part.inputFiles()) < len(table.read().inputFiles())


def test_last_of_a_batch_stays(spark, table):
    df = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "b", 3), ("a", 1, "z", 2), ("b", 1, "p", None)], SCHEMA + ", n int")
    table.upsert(df, order="n")
    assert rows(table.read()) == [("a", 1, "b"), ("b", 1, "p")]
    with pytest.raises(ValueError, match="keys"):
        table.upsert(df, ["id"])


def test_two_writers(spark, table, monkeypatch):
    """The second writer on the same buckets fails and nothing of it is seen; on other buckets both stay."""
    table.upsert(spark.createDataFrame([(t, 1, "old") for t in "abcdefgh"], SCHEMA))
    bucket = {r["tenant"]: r["b"] for r in table.read().select("tenant", table.bucket().alias("b")).collect()}
    other = next(t for t in "bcdefgh" if bucket[t] // 2 != bucket["a"] // 2)
    write = table._write

    def with_rival(tenant):
        def slow(df, folder):
            monkeypatch.setattr(table, "_write", write)
            table.upsert(spark.createDataFrame([(tenant, 1, "rival")], SCHEMA))
            return write(df, folder)

        return slow

    monkeypatch.setattr(table, "_write", with_rival("a"))
    with pytest.raises(tables.Conflict):
        table.upsert(spark.createDataFrame([("a", 1, "mine")], SCHEMA))
    assert rows(table.read().filter("tenant = 'a'")) == [("a", 1, "rival")]
    monkeypatch.setattr(table, "_write", with_rival(other))
    table.upsert(spark.createDataFrame([("a", 1, "mine")], SCHEMA))
    assert rows(table.read().filter("text <> 'old'")) == sorted([("a", 1, "mine"), (other, 1, "rival")]) and table.read().count() == 8


def test_dead_writer(spark, table):
    """A version number that was claimed by a writer that died is an error until it is freed."""
    table.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    open(f"{table.path}/_versions/{2:012d}.json.claim", "w").close()
    with pytest.raises(tables.Conflict, match="claimed"):
        table.upsert(spark.createDataFrame([("a", 2, "y")], SCHEMA))
    table.release()
    table.upsert(spark.createDataFrame([("a", 2, "y")], SCHEMA))
    assert table.read().count() == 2


def test_deleted_rows_leave_the_disk(spark, table):
    table.upsert(spark.createDataFrame([("a", 1, "secretword"), ("a", 2, "stays"), ("b", 1, "stays")], SCHEMA))
    assert table.delete(spark.createDataFrame([("a", 1), ("a", 9)], "tenant string, id int"), ["tenant", "id"]) == 1
    assert table.delete(spark.createDataFrame([(9,)], "id int"), ["id"]) == 0
    assert table.vacuum() == 0  # young folders stay
    assert table.vacuum(older_than=-1) > 0
    assert rows(table.read()) == [("a", 2, "stays"), ("b", 1, "stays")]
    kept = [spark.read.parquet(f).select("text").collect() for f in files(table)]
    assert all(r["text"] != "secretword" for own in kept for r in own) and len(os.listdir(f"{table.path}/_versions")) <= 4
    table.publish(spark.createDataFrame([("c", 1, "all")], SCHEMA))
    assert rows(table.read()) == [("c", 1, "all")]


def test_batches_once(spark, table):
    table.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), mark=("s", 0))
    table.upsert(spark.createDataFrame([("a", 1, "again")], SCHEMA), mark=("s", 0))
    assert rows(table.read()) == [("a", 1, "x")] and table.applied("s") == 0 and table.applied("other") == -1


def letters(seen):
    """A model of 26 letter counts; ``seen`` is a folder where it leaves a file for each text."""

    def model():
        import uuid

        import numpy as np

        def embed(texts):
            for t in texts:
                with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                    f.write(t)
            return np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], dtype=float)

        return embed

    return model


def test_own_model_through_the_jobs(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    inner = embedders.ModelEmbedder("letters", letters(str(seen)), 26, query_prefix="")
    own = embedders.StoredEmbedder(inner, str(tmp_path / "vectors"))
    documents, vectors = store.Table(spark, str(tmp_path / "d"), store.DOCUMENTS), store.Table(spark, str(tmp_path / "v"), store.VECTORS)
    up = spark.createDataFrame([("u1", "a", "a.txt", "s", "sodium result"), ("u2", "b", "b.txt", "s", "sodium result"), ("u1", "c", "c.txt", "s", "zzz")], UPLOADS)
    assert {r["status"] for r in store.index_documents(up, documents, vectors, embedder=own).collect()} == {"indexed"}
    assert {r["embedding_space"] for r in vectors.read().collect()} == {"letters@26"} and vectors.read().count() == 3
    assert sorted((seen / f).read_text() for f in os.listdir(seen)) == ["sodium result", "zzz"]  # equal texts reach the model once
    more = spark.createDataFrame([("u3", "e", "e.txt", "s", "sodium result")], UPLOADS)
    store.index_documents(more, documents, vectors, embedder=own)
    assert len(os.listdir(seen)) == 2
    q = spark.createDataFrame([(1, "result sodium")], "query_id int, question string")
    hits, status, _ = store.retrieve_patient(q, vectors.read(), documents.read(), "u1", embedder=own, floor=0.9)
    assert [(r["document_id"], round(r["score"], 6)) for r in hits.collect()] == [("a", 1.0)] and status.first()["status"] == "ok"
    with pytest.raises(ValueError, match="space"):
        store.retrieve_patient(q, vectors.read(), documents.read(), "u1", "hash@64", embedder=own)
    entries = questions.glossary(spark, embedder=own)
    assert entries.first()["embedding_space"] == "letters@26" and len(entries.first()["values"]) == 26
    short = embedders.ModelEmbedder("letters", letters(str(seen)), 25)
    with pytest.raises(Exception, match="not"):
        store.index_documents(up, store.Table(spark, str(tmp_path / "d2"), store.DOCUMENTS), store.Table(spark, str(tmp_path / "v2"), store.VECTORS), embedder=short)


def test_pages_and_tables_in_the_index(spark, tmp_path):
    documents, vectors = store.Table(spark, str(tmp_path / "d"), store.DOCUMENTS), store.Table(spark, str(tmp_path / "v"), store.VECTORS)
    up = spark.createDataFrame([("u1", "a", "a.pdf", "pdf_text", None), ("u1", "b", "b.txt", "s", "plain"), ("u1", "c", "c.txt", "s", " "), ("u1", "e", "e.txt", "s", None)], UPLOADS)
    up = up.withColumn("sha256", F.col("document_id"))
    table = "Lab results table (t1)\n\nIron: 12"
    segments = spark.createDataFrame([("a", 0, "text", 1, None, "page one " * 200), ("a", 1, None, 2, None, " "), ("a", 2, "table", 2, "t1", table), ("x", 0, "text", 1, None, "of no upload")], store.SEGMENTS)
    out = {r["document_id"]: r["status"] for r in store.index_documents(up, documents, vectors, dims=16, segments=segments).collect()}
    assert out == {"a": "indexed", "b": "indexed", "c": "failed", "e": "failed"}
    d = {r["document_id"]: r for r in documents.read().collect()}
    v = sorted((r["document_id"], r["chunk_index"], r["content_type"], r["page"], r["table_id"]) for r in vectors.read().collect())
    assert v == [("a", 0, "text", 1, None), ("a", 1, "text", 1, None), ("a", 2, "table", 2, "t1"), ("b", 0, "text", None, None)]
    assert (d["a"]["page_count"], d["a"]["chunk_count"], d["b"]["page_count"], d["c"]["failure_category"]) == (2, 3, None, "no_extractable_text")
    assert vectors.read().filter("content_type = 'table'").first()["text"] == table
    ids = spark.createDataFrame([("a",)], "document_id string")
    assert store.delete_documents("u1", ids, documents, vectors) == {"documents": 1, "vectors": 3} and store.erase(documents, vectors, older_than=-1) > 0
    assert not any("page one" in (r["text"] or "") for f in files(vectors) for r in spark.read.parquet(f).select("text").collect())


def test_terms_and_manifest_in_one_version(spark, tmp_path, monkeypatch):
    t = store.Table(spark, str(tmp_path / "terms"), store.TERMS)
    columns = "record_id string, term string, aliases array<string>, definition string, url string, published string, mesh_id string, skip_reason string, ordinal bigint"
    records = [("mesh:1", "Glucose", ["sugar"], "first", None, None, None, None, 1), ("mesh:1", "Glucose", ["sugar"], "last", None, None, None, None, 2), ("mesh:2", "Iron", [], "a metal", None, None, None, None, 3), ("mesh:3", "X", [], None, None, None, None, "no_definition", 4)]
    df = spark.createDataFrame(records, columns)
    put = lambda df, sha: ingest.store_terms(df, sha, "mesh", "M", "NLM", "1", t, 16)
    note = put(df, "f1")
    assert (note["outcome"], note["records"], note["skipped"], note["ids"]) == ("stored", 3, 1, 2) and t.read().filter("id = 'mesh:1'").first()["text"] == "last"
    assert put(df, "f1")["outcome"] == "unchanged" and t.version() == 1
    ingest.store_terms(df, "g", "topics", "T", "NLM", "1", t, 16)  # another dataset keeps its own manifest
    commit = t._commit
    monkeypatch.setattr(t, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        put(df.filter("record_id <> 'mesh:2'"), "f2")
    monkeypatch.setattr(t, "_commit", commit)
    assert t.state()["note"]["mesh"]["file_sha"] == "f1" and t.read().filter("dataset = 'mesh'").count() == 2  # the broken run left nothing
    assert put(df.filter("record_id <> 'mesh:2'"), "f2")["ids"] == 1 and {r["id"] for r in t.read().filter("dataset = 'mesh'").collect()} == {"mesh:1"}
    assert set(t.state()["note"]) == {"mesh", "topics"}
    t.delete(spark.createDataFrame([("mesh:1",)], "id string"), ["id"])  # rows lost in another way are seen
    assert put(df.filter("record_id <> 'mesh:2'"), "f2")["outcome"] == "stored" and t.read().filter("dataset = 'mesh'").count() == 1


def test_smaller_tables(spark, tmp_path):
    """Users, consultations and the registry of reference sources."""
    users = store.Table(spark, str(tmp_path / "u"), store.USERS)
    users.upsert(spark.createDataFrame([("u1", "a@b", "A", None), ("u2", "c@d", "C", None)], store.USERS))
    users.upsert(spark.createDataFrame([("u1", "a@new", "A", None)], store.USERS))
    assert {r["user_id"]: r["email"] for r in users.read().collect()} == {"u1": "a@new", "u2": "c@d"}
    registry = store.Table(spark, str(tmp_path / "r"), store.REGISTRY)
    row = ("src", "sha", "T", "O", "other", None, None, None, "indexed", "hash@16", 3)
    registry.upsert(spark.createDataFrame([row], store.REGISTRY))
    registry.upsert(store.retire_source(registry.read(), "src"))
    assert registry.read().first()["status"] == "retired"
    cases = store.Table(spark, str(tmp_path / "c"), store.CONSULTATIONS)
    cases.upsert(spark.createDataFrame([("u1", "k", "completed", "low", 7, "r", None)], store.CONSULTATIONS))
    assert cases.read().first()["risk_score"] == 7
