"""Operational tables and the jobs on them: ingest, retrieve, retire, delete.

Documents are published last, and retrieval trusts only them, so vectors that were written alone are never served.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docevidence.functions.text import normalize_text
from docevidence.operators import retrieval, structure
from docevidence.operators.embedders import Embedder, chosen
from docevidence.plans import tables
from docevidence.plans.scratch import saved

DOCUMENTS = "user_id string, document_id string, filename string, mime_type string, sha256 string, source string, status string, failure_category string, text_chars bigint, page_count bigint, chunk_count bigint, truncated boolean, embedding_space string, consultation_id string"
VECTORS = "namespace string, id string, domain string, user_id string, document_id string, chunk_index int, source string, mime_type string, content_type string, page int, table_id string, embedding_space string, text string, values array<double>"
CONSULTATIONS = "user_id string, consultation_id string, status string, risk_level string, risk_score int, report string, created_at timestamp"
USERS = "user_id string, email string, name string, created_at timestamp"
REGISTRY = "source_id string, sha256 string, title string, organization string, source_type string, publication_date string, version string, url string, status string, embedding_space string, chunk_count bigint"
TERMS = "id string, domain string, chunk_id string, dataset string, dataset_name string, organization string, version string, term string, term_key string, alias_keys array<string>, aliases array<string>, text string, content_hash string, embedding_space string, url string, published string, mesh_id string, values array<double>"
#: Keys and tenant columns of each table.
LAYOUT = {
    DOCUMENTS: (["user_id", "document_id"], ["user_id"]), VECTORS: (["namespace", "id"], ["namespace"]), CONSULTATIONS: (["user_id", "consultation_id"], ["user_id"]),
    USERS: (["user_id"], ["user_id"]), REGISTRY: (["source_id"], ["source_id"]), TERMS: (["dataset", "id"], ["dataset"]),
}
SEGMENTS = "document_id string, seg_idx int, content_type string, page int, table_id string, text string"


def Table(spark: SparkSession, path: str, schema: str, **layout) -> tables.Table:  # noqa: N802
    """A table of one of the schemas above with its keys, or of any other with the keys given (the first column if none)."""
    keys, by = LAYOUT.get(schema, (None, None))
    return tables.Table(spark, path, schema, **({"keys": keys, "by": by} | layout))


def split_new(uploads: DataFrame, documents: DataFrame, space: str) -> tuple[DataFrame, DataFrame]:
    """Uploads to index, and those that an indexed document of the same user, content, source and space already answers."""
    there = documents.filter((F.col("status") == "indexed") & (F.col("embedding_space") == space)).groupBy("user_id", "sha256", "source").agg(F.min("document_id").alias("existing_id"))
    keys = ["user_id", "sha256", "source"]
    return uploads.join(there, keys, "left_anti"), uploads.join(there, keys).withColumn("duplicate", F.lit(True))


def document_segments(uploads: DataFrame, segments: DataFrame | None) -> DataFrame:
    """SEGMENTS of uploads, normalised, without empty ones: those given, and the ``text`` of documents without any as one."""
    plain = uploads.select("document_id", F.lit(0).alias("seg_idx"), F.lit("text").alias("content_type"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("table_id"), *(["text"] if "text" in uploads.columns else [F.lit(None).cast("string").alias("text")]))
    if segments is None:
        rows = plain
    else:
        given = segments.select("document_id", "seg_idx", F.coalesce("content_type", F.lit("text")).alias("content_type"), "page", "table_id", "text").join(uploads.select("document_id").hint("shuffle_merge"), "document_id", "left_semi")  # ids of a whole batch are no broadcast
        rows = given.unionByName(plain.join(given.select("document_id").distinct().hint("shuffle_merge"), "document_id", "left_anti"))
    return rows.withColumn("text", normalize_text(F.coalesce("text", F.lit("")))).filter("text <> ''")


def index_documents(uploads: DataFrame, documents: tables.Table, vectors: tables.Table, dims: int = 256, space: str | None = None, embedder: Embedder | None = None, segments: DataFrame | None = None, mark: tuple[str, int] | None = None) -> DataFrame:
    """Uploads (user_id, document_id, filename, source, text; mime_type and sha256 if known) to chunks, vectors and document rows;
    returns document_id, status, failure_category.

    ``segments`` (SEGMENTS) are a document's pages and tables: table segments stay whole, chunks keep page and table; a document without any has its
    ``text`` as one. Vectors come from ``embedder`` (the hash of ``dims`` without one). A document without text fails with its category. A
    content that is there already, or stands in the same batch under a smaller id, is reported as duplicate and not indexed again. With
    ``mark`` (stream, batch) each table takes the batch once, however often it is tried.
    """
    embedder = chosen(embedder, space, dims)
    space, spark = embedder.space, uploads.sparkSession
    sha = F.sha2(F.coalesce("text", F.lit("")), 256) if "text" in uploads.columns else F.lit(None).cast("string")
    up = uploads.withColumn("sha256", F.coalesce("sha256", sha) if "sha256" in uploads.columns else sha)
    up = up.withColumn("mime_type", F.col("mime_type") if "mime_type" in uploads.columns else F.lit(None).cast("string"))
    new, old = split_new(up, documents.read(), space)
    pieces = saved(document_segments(new, segments), "segments")
    full = pieces.groupBy("document_id").agg(F.sum(F.length("text")).alias("text_chars"), F.nullif(F.count_distinct("page"), F.lit(0)).alias("page_count"))
    # Of equal contents in one batch the smallest id is indexed; documents without text fail each.
    keys = ["user_id", "sha256", "source"]
    first = new.join(full.select("document_id"), "document_id", "left_semi").groupBy(*keys).agg(F.min("document_id").alias("first_id"))
    new = new.join(first, keys, "left").withColumn("again", F.coalesce(F.col("first_id") != F.col("document_id"), F.lit(False)))
    new = saved(new.select("user_id", "document_id", "filename", "mime_type", "sha256", "source", "again"), "uploads")
    fresh = new.filter("NOT again")
    chunks = structure.prepare_chunks(pieces.join(fresh.select("document_id"), "document_id", "left_semi"), "document_id")
    chunks = chunks.join(pieces.select("document_id", "seg_idx", "content_type", "page", "table_id"), ["document_id", "seg_idx"]).join(fresh.select("document_id", "user_id", "source", "mime_type"), "document_id")
    rows = saved(
        chunks.select(
            F.concat(F.lit("user-"), "user_id").alias("namespace"), F.col("chunk_id").alias("id"), F.lit("patient").alias("domain"), "user_id", "document_id", "chunk_index", "source", "mime_type", "content_type", "page", "table_id",
            F.lit(space).alias("embedding_space"), "text", "truncated",
        ), "chunks",
    )
    vectors.upsert(embedder.embed(rows, "id", "text", [c for c in rows.columns if c != "id"]), mark=mark)  # no join back to the texts
    counted = rows.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.bool_or("truncated").alias("truncated"))
    done = fresh.join(full, "document_id", "left").join(counted, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    blank = F.col("text_chars").isNull()
    failure = F.when(blank, "no_extractable_text").when(F.col("chunk_count") == 0, "chunking_failure")
    done = done.withColumn("failure_category", failure).select(
        "user_id", "document_id", "filename", "mime_type", "sha256", "source", F.when(F.col("failure_category").isNull(), "indexed").otherwise("failed").alias("status"), "failure_category",
        F.coalesce("text_chars", F.lit(0)).alias("text_chars"), "page_count", "chunk_count", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.lit(space).alias("embedding_space"), F.lit(None).cast("string").alias("consultation_id"),
    )
    done = saved(done, "documents")
    documents.upsert(done, mark=mark)
    again = old.select("document_id").unionByName(new.filter("again").select("document_id"))
    again = again.select("document_id", F.lit("duplicate").alias("status"), F.lit(None).cast("string").alias("failure_category"))
    return done.select("document_id", "status", "failure_category").unionByName(again)


def servable(vectors: DataFrame, documents: DataFrame, user_id: str | Column, space: str) -> DataFrame:
    """F3 + J2: a tenant's vectors, each with ``valid``: own namespace and owner, the current space, text, and an indexed document."""
    user = user_id if isinstance(user_id, Column) else F.lit(user_id)
    own = documents.filter((F.col("user_id") == user) & (F.col("status") == "indexed") & (F.col("embedding_space") == space)).select("document_id", "filename")
    v = vectors.filter(F.col("namespace") == F.concat(F.lit("user-"), user)).join(own, "document_id", "left")
    fine = F.col("filename").isNotNull() & (F.col("user_id") == user) & (F.col("domain") == "patient") & (F.col("embedding_space") == space) & (F.trim("text") != "") & (F.col("id") == F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")))
    return v.withColumn("valid", F.coalesce(fine, F.lit(False)))


def retrieve_patient(questions: DataFrame, vectors: DataFrame, documents: DataFrame, user_id: str, space: str | None = None, dims: int = 256, k: int = 6, floor: float = 0.5, max_chars: int = 8000, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, status, scored) of questions (query_id, question) over one tenant.

    The k best of the tenant's vectors in indexed documents (F1), then those that are valid (F3), the floor, and the budget. ``status`` has
    a row per question with candidates (found), invalid, and why there is nothing; ``scored`` the valid ones' scores before the floor.
    """
    embedder, k = chosen(embedder, space, dims), max(1, min(k, 10))
    space, dims = space or embedder.space, embedder.dims
    mine = servable(vectors, documents, user_id, space).filter("filename is not null")
    mine = retrieval.metadata_filter(retrieval.same_space(mine, space, dims), {"domain": "patient", "user_id": {"$eq": user_id}})
    q = questions.withColumn("embedding_space", F.lit(space)).withColumn("question", F.left("question", F.lit(1000)))
    q = saved(embedder.embed(q, "query_id", "question", ["embedding_space"], query=True), "questions")
    top = retrieval.vector_topk(q, mine, ["embedding_space"], k, digits=9).join(mine.select("id", "document_id", "filename", "text", "valid"), "id")
    scored = top.filter("valid").select("query_id", "id", "document_id", "score")
    above = top.filter(F.col("valid") & (F.col("score") >= floor)).drop("valid")
    kept = retrieval.prefix_budget(above, "query_id", ["rank"], F.length("text"), max_chars)
    n_docs = documents.filter((F.col("user_id") == user_id) & (F.col("status") == "indexed") & (F.col("embedding_space") == space)).count()
    found = top.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("valid").alias("m"), F.count_if(F.col("valid") & (F.col("score") >= floor)).alias("f"))
    counts = questions.select("query_id").join(found, "query_id", "left").na.fill(0, ["candidates", "invalid", "m", "f"])
    status = retrieval.retrieval_status(counts, F.lit(n_docs), F.col("m"), F.col("f")).select("query_id", "status", "candidates", "invalid")
    return kept, status, scored


def delete_documents(user_id: str, ids: DataFrame, documents: tables.Table, vectors: tables.Table) -> dict[str, int]:
    """A tenant's documents and their vectors; ids of others are left alone."""
    spark = ids.sparkSession
    mine = spark.createDataFrame([(user_id,)], "user_id string")
    own = documents.read(of=mine).filter(F.col("user_id") == user_id).join(ids.select("document_id"), "document_id", "left_semi").select("user_id", "document_id")
    own = saved(own.withColumn("namespace", F.concat(F.lit("user-"), "user_id")), "deleted")
    removed = vectors.delete(own, ["namespace", "document_id"])
    return {"documents": documents.delete(own, ["user_id", "document_id"]), "vectors": removed}


def erase(*stores: tables.Table, older_than: float = 3600.0) -> int:
    """What was deleted leaves the disk: folders that the newest version does not name (see Table.vacuum); returns their number."""
    return sum(t.vacuum(older_than=older_than) for t in stores)


def delete_consultations(user_id: str, ids: DataFrame, consultations: Table, links: DataFrame, documents: tables.Table, vectors: tables.Table) -> dict[str, int]:
    """A tenant's consultations (consultation_id), the documents that ``links`` (consultation_id, document_id) ties to them, and
    their vectors, vectors first; returns how many of each went. Ids of others are left alone."""
    own = consultations.read().filter(F.col("user_id") == user_id).join(ids.select("consultation_id"), "consultation_id", "left_semi").select("consultation_id")
    n = delete_documents(user_id, links.join(own, "consultation_id", "left_semi").select("document_id").distinct(), documents, vectors)
    return {"consultations": consultations.delete(own, ["consultation_id"]), **n}


def retire_source(sources: DataFrame, source_id: str) -> DataFrame:
    """A retired source is not served, whatever vectors exist."""
    return sources.withColumn("status", F.when(F.col("source_id") == source_id, "retired").otherwise(F.col("status")))
