"""Reference texts and vocabularies to stored vectors (S5, S6, S12, D3, D8, V2, V5, P2, P3), and rules on input rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.functions import labs
from docevidence.functions.text import content_hash, normalize_text, term_key, trim
from docevidence.operators import layout, structure
from docevidence.operators.embedders import Embedder, chosen, model_embed, space_id
from docevidence.plans.scratch import saved
from docevidence.plans.tables import Table
from docevidence.sources import vocabulary

SIDECAR = "sourceId string, title string, organization string, sourceType string, authorization string, publicationDate string, version string, url string, medicalTopics array<string>"
# The kinds of reference sources.
SOURCE_TYPES = ("clinical_guideline", "public_health_guidance", "medical_reference", "professional_society", "synthetic_test", "other")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(stem, the SIDECAR fields, violations) of ``*.meta.json`` files; an unknown key, a missing or odd field is a violation."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta.json").load(path).select(F.regexp_extract("path", r"([^/]+)\.meta\.json\z", 1).alias("stem"), F.col("content").cast("string").alias("raw"))
    rows = raw.withColumn("s", F.from_json("raw", SIDECAR)).withColumn("keys", F.json_object_keys("raw"))
    return rows.select("stem", "s.*", sidecar_violations(F.col("keys")).alias("violations"))


def sidecar_violations(keys: Column) -> Column:
    """The names of the rules that a sidecar's fields (columns s.*) break; ``keys``: its keys, null if it is no JSON object."""
    known = [part.split()[0] for part in SIDECAR.split(", ")]
    text = lambda c, least, most: F.coalesce(F.length(F.trim(f"s.{c}")).between(least, most), F.lit(False))
    option = lambda c, most: F.col(f"s.{c}").isNull() | text(c, 1, most)
    topics = F.coalesce(F.col("s.medicalTopics"), F.array().cast("array<string>"))
    rules = {
        "malformed": keys.isNotNull(),
        "unknown_key": F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, known)))) == 0,
        "sourceId": F.coalesce(F.col("s.sourceId").rlike(r"^[a-z0-9][a-z0-9._-]{1,99}\z"), F.lit(False)),
        "title": text("title", 1, 500), "organization": text("organization", 1, 300), "authorization": text("authorization", 3, 1000),
        "sourceType": F.coalesce(F.col("s.sourceType").isin(*SOURCE_TYPES), F.lit(False)),
        "publicationDate": option("publicationDate", 50), "version": option("version", 100),
        "url": option("url", 2000) & (F.col("s.url").isNull() | F.col("s.url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://\S+\z")),
        "medicalTopics": (F.size(topics) <= 20) & F.forall(topics, lambda t: F.length(F.trim(t)).between(1, 100)),
    }
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())))


def read_reference_texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, sha256, text) of the .txt and .md files below a folder, whole and as UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+\z", 1).alias("stem"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def reference_segments(texts: DataFrame, key: str) -> DataFrame:
    """(key, seg_idx, content_type, section, text): the sections of each text without table lines, then a segment for each table row."""
    plain = texts.withColumn("text", normalize_text(F.col("text")))
    rows = structure.delimited_tables(plain, key, "text")
    tables = layout.reference_table_segments(rows, plain.select(key, F.lit(0).alias("table_no"), "text").limit(0), key, "table_no", "row_index")
    bars = F.filter(F.split("text", "\n"), lambda x: F.coalesce(F.size(labs.split_delimited(x)), F.lit(0)) < 3)
    sections = structure.split_sections(plain.withColumn("text", F.array_join(bars, "\n")), key, "text").select(key, F.lit("text").alias("content_type"), "section", "text", F.struct(F.lit(0).alias("k"), F.col("part").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("o"))
    of_tables = tables.select(key, F.lit("table").alias("content_type"), F.lit(None).cast("string").alias("section"), "text", F.struct(F.lit(1).alias("k"), F.col("table_no").cast("bigint").alias("a"), F.col("part").cast("bigint").alias("b")).alias("o"))
    both = sections.unionByName(of_tables)
    return both.withColumn("seg_idx", F.row_number().over(Window.partitionBy(key).orderBy("o")) - 1).drop("o")


def reference_chunks(segments: DataFrame, sources: DataFrame, space: str) -> DataFrame:
    """D8 with D1 and D7: chunks with provenance of segments (source_id, seg_idx, content_type, section, text): tables whole, texts cut,
    citation-dense texts dropped, a dense index. ``sources`` has the SIDECAR fields by source_id; absent ones stay null."""
    whole = F.array(F.struct(F.lit(0).alias("idx"), F.col("text").alias("text"), F.lit(0).alias("start"), F.length("text").alias("end")))
    pieces = F.when(F.col("content_type") == "table", whole).otherwise(structure.chunk_text(F.col("text")))
    rows = segments.select("source_id", "content_type", "section", "seg_idx", F.explode(pieces).alias("p"))
    rows = rows.withColumn("text", F.col("p.text")).withColumn("chunk_index", F.row_number().over(Window.partitionBy("source_id").orderBy("seg_idx", "p.idx")) - 1)
    kept = structure.drop_bibliography(rows.drop("p", "seg_idx"), "source_id", "chunk_index", "text", "content_type")
    s = sources.select("source_id", "title", "organization", F.col("sourceType").alias("source_type"), F.col("publicationDate").alias("publication_date"), "version", "url", F.coalesce("medicalTopics", F.array().cast("array<string>")).alias("medical_topics"))
    out = kept.join(s, "source_id").withColumn("id", F.concat_ws("#", "source_id", F.col("chunk_index").cast("string")))
    return out.withColumn("chunk_id", F.col("id")).withColumn("domain", F.lit("reference")).withColumn("embedding_space", F.lit(space)).withColumn("medical_topic", F.get("medical_topics", F.lit(0)))


def chunk_metadata(chunks: DataFrame, owners: DataFrame, space: str) -> DataFrame:
    """D3: one flat record a chunk (document_id, chunk_index, text and, where known, page and table_id) with its owner's columns
    (document_id, user_id, filename): namespace, id, domain, space. Chunks without an owner are left out."""
    extra = [F.col(c) if c in chunks.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("page", "int"), ("table_id", "string"))]
    rows = chunks.select("document_id", "chunk_index", "text", *extra).join(owners.select("document_id", "user_id", "filename"), "document_id")
    return rows.select(F.concat(F.lit("user-"), "user_id").alias("namespace"), F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")).alias("id"), F.lit("patient").alias("domain"), "user_id", "document_id", "filename", "chunk_index", F.lit(space).alias("embedding_space"), "text", "page", "table_id")


def ingest_references(texts: DataFrame, sidecars: DataFrame, registry: DataFrame, space: str, dims: int = 256, force: bool = False, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcome, chunks) of texts (stem, sha256, text) with sidecars (read_sidecars) against the registry (source_id, sha256,
    embedding_space, status).

    ``outcome`` has stem, source_id, sha256 and indexed, unchanged (same content and space, not retired, unless ``force``), empty, or
    skipped with its reasons. ``chunks`` are the new ones of the indexed sources, with vectors; they replace all of a source's old ones
    (replace_partition).
    """
    embedder = chosen(embedder, space, dims)
    both = texts.join(sidecars, "stem", "left")
    same = registry.filter((F.col("embedding_space") == space) & (F.col("status") == "indexed")).select(F.col("source_id").alias("sourceId"), "sha256", F.lit(True).alias("same"))
    both = both.join(same, ["sourceId", "sha256"], "left")
    missing = F.coalesce("violations", F.array(F.lit("missing_sidecar")))
    outcome = F.when(F.size(missing) > 0, "skipped").when(F.coalesce("same", F.lit(False)) & F.lit(not force), "unchanged").when(trim(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("indexed")
    both = both.withColumn("reasons", missing).withColumn("outcome", outcome).withColumnRenamed("sourceId", "source_id")
    taken = both.filter("outcome = 'indexed'")
    chunks = saved(reference_chunks(reference_segments(taken.select("source_id", "text"), "source_id"), taken, space), "reference-chunks")
    return both.select("stem", "source_id", "sha256", "outcome", "reasons"), embedder.embed(chunks, "id", "text", [c for c in chunks.columns if c != "id"])


def replace_partition(rows: DataFrame, path: str, by: str) -> None:
    """S11 by partition: the rows replace those of their values of ``by`` in the Parquet table at ``path``; other partitions are not touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def last_by_id(records: DataFrame, order: str) -> DataFrame:
    """O3 before storing: of records with one id the last in the order stays."""
    return records.withColumn("__n", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc(order)))).filter("__n = 1").drop("__n")


def term_vectors(records: DataFrame, dataset: str, dataset_name: str, organization: str, version: str, space: str, dims: int = 256, embedder: Embedder | None = None) -> DataFrame:
    """V5 with V3 and V4: one typed record with its vector for each term (record_id, term, aliases, definition, url, published, mesh_id).

    The content hash is over term, aliases and definition; a descriptor's mesh id is its own. Skipped records are left out.
    """
    rows = records.filter("skip_reason is null") if "skip_reason" in records.columns else records
    rows = rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).repartition("record_id")  # short records: one file has many
    rows = vocabulary.alias_keys(rows).withColumn("to_embed", vocabulary.embedding_text(F.col("term"), F.col("aliases"), F.col("definition")))
    digest = content_hash(F.concat_ws("\n", "term", F.array_join("aliases", "|"), "definition"), 16)
    own = F.when(F.lit(dataset == "mesh"), F.regexp_replace("record_id", "^mesh:", "")).otherwise(F.col("mesh_id"))
    out = rows.select(F.col("record_id").alias("id"), F.lit("terminology").alias("domain"), F.col("record_id").alias("chunk_id"), F.lit(dataset).alias("dataset"), F.lit(dataset_name).alias("dataset_name"), F.lit(organization).alias("organization"), F.lit(version).alias("version"), "term", term_key(F.col("term")).alias("term_key"), F.coalesce("alias_keys", F.array().cast("array<string>")).alias("alias_keys"), "aliases", F.col("definition").alias("text"), digest.alias("content_hash"), F.lit(space).alias("embedding_space"), "url", "published", own.alias("mesh_id"), "to_embed")
    return chosen(embedder, space, dims).embed(out, "id", "to_embed", [c for c in out.columns if c not in ("id", "to_embed")])  # no join back


def stale_ids(known: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Ids that were stored and the current set no longer has."""
    return known.select(key).distinct().join(current.select(key), key, "left_anti")


def ingest_terms(records: DataFrame, file_sha: str, dataset: str, dataset_name: str, organization: str, version: str, manifest: DataFrame, stored: DataFrame, space: str, dims: int = 256, order: str | None = None, embedder: Embedder | None = None) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(vectors, stale, manifest row) of one dataset's parsed records; ``stored``: ids now in the table.

    A dataset whose file and space are those of the manifest is unchanged: no vectors (None), nothing stale, the old row. The manifest row
    (S12) has dataset, file_sha, embedding_space, version, the numbers of records and skipped, and the written ids' digest.
    """
    old = manifest.filter((F.col("dataset") == dataset) & (F.col("file_sha") == file_sha) & (F.col("embedding_space") == space))
    if not old.isEmpty():
        return None, stored.select("id").limit(0), old
    kept = records.filter("skip_reason is null")
    vectors = term_vectors(last_by_id(kept, order) if order else kept, dataset, dataset_name, organization, version, space, dims, embedder)
    counts = records.agg(F.count_if(F.col("skip_reason").isNull()).alias("records"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"))
    ids = kept.select(F.col("record_id").alias("id")).distinct().agg(*ids_digest())
    row = counts.crossJoin(ids).select(F.lit(dataset).alias("dataset"), F.lit(file_sha).alias("file_sha"), F.lit(space).alias("embedding_space"), F.lit(version).alias("version"), "records", "skipped", "ids", "ids_digest")  # a row each
    return vectors, stale_ids(stored, vectors), row


def ids_digest(id_col: str = "id") -> list[Column]:
    """Aggregates ``ids`` (how many) and ``ids_digest``: one for a set of ids, whatever their order and partitions."""
    halves = [F.hex(F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), id_col)), F.lit(0).cast("bigint"))) for seed in (1, 2)]
    return [F.count("*").alias("ids"), F.concat(*(F.lpad(h, 16, "0") for h in halves)).alias("ids_digest")]


def store_terms(records: DataFrame, file_sha: str, dataset: str, dataset_name: str, organization: str, version: str, table: Table, dims: int = 256, embedder: Embedder | None = None, order: str = "ordinal") -> dict:
    """P3 with S12 as one commit: a dataset's term vectors, the deletion of its stale ids and its manifest become one version of ``table``
    (store.TERMS); returns the manifest with ``outcome``: stored or unchanged.

    The manifest, kept with the version, has file_sha, space, version, records, skipped, ids and the written ids' digest. A file is unchanged where its
    manifest has its sha and space and the stored ids still have the manifest's digest; a table that lost rows in another way is stored again. A
    run that breaks leaves the version before. O3: of records with one id the last by ``order`` (the readers' ordinal) stays.
    """
    embedder = chosen(embedder, None, dims)
    number = table.version()
    old = table.state(number)["note"].get(dataset)
    of = table.spark.createDataFrame([(dataset,)], "dataset string")
    stored = table.read(number, of).filter(F.col("dataset") == dataset).select("dataset", "id")
    wanted = {"file_sha": file_sha, "embedding_space": embedder.space, "version": version}
    if old is not None and {k: old[k] for k in wanted} == wanted and stored.agg(*ids_digest()).first().asDict() == {k: old[k] for k in ("ids", "ids_digest")}:
        return old | {"outcome": "unchanged"}
    kept = records.filter("skip_reason is null")
    kept = last_by_id(kept, order) if order in records.columns else kept
    rows = saved(term_vectors(kept, dataset, dataset_name, organization, version, embedder.space, embedder.dims, embedder), "terms")
    counts = records.agg(F.count_if(F.col("skip_reason").isNull()).alias("records"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped")).first().asDict()
    note = wanted | counts | rows.select("id").distinct().agg(*ids_digest()).first().asDict()
    table.upsert(rows, note={dataset: note}, gone=stored.join(rows.select("id"), "id", "left_anti").select("dataset", "id"))
    return note | {"outcome": "stored"}


def link_documents(wanted: DataFrame, documents: DataFrame, user_id: str, consultation_id: str) -> tuple[DataFrame, DataFrame]:
    """(documents with the tenant's wanted ones linked, wanted ids that are not the tenant's)."""
    own = documents.filter(F.col("user_id") == user_id)
    ids = wanted.select("document_id").distinct()
    linked = documents.join(ids.withColumn("__hit", F.lit(True)), "document_id", "left")
    mine = (F.col("user_id") == user_id) & F.coalesce("__hit", F.lit(False))
    current = F.col("consultation_id") if "consultation_id" in documents.columns else F.lit(None).cast("string")
    return linked.withColumn("consultation_id", F.when(mine, F.lit(consultation_id)).otherwise(current)).drop("__hit"), ids.join(own, "document_id", "left_anti")


def latest_documents(documents: DataFrame, user_id: str, newest: str, row_id: str = "document_id", consultation_id: str | None = None) -> DataFrame:
    """A tenant's documents, newest first, ties by id descending."""
    own = documents.filter(F.col("user_id") == user_id)
    own = own.filter(F.col("consultation_id") == consultation_id) if consultation_id else own
    return own.orderBy(F.desc(newest), F.desc(row_id))


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that hold all rules, the others with ``violations``); a rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    judged = rows.withColumn("violations", broken)
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)


def case_rules(age: str = "age", gender: str = "gender", lists: tuple[str, ...] = ("symptoms", "medicines", "labs"), text: str = "text", voice: str = "voice") -> dict[str, Column]:
    """F11 for a case: an age of 0 to 150 and a known gender where given, at most 100 items in a list, and text, voice or a list item."""
    some = F.lit(False)
    for c in (text, voice):
        some = some | (F.trim(F.coalesce(c, F.lit(""))) != "")
    for c in lists:
        some = some | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return {
        "age": F.col(age).isNull() | F.col(age).between(0, 150), "gender": F.col(gender).isNull() | F.col(gender).isin("Male", "Female", "Other", ""),
        **{c: F.coalesce(F.size(c), F.lit(0)) <= 100 for c in lists}, "something": some,
    }
