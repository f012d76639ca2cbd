"""From a question to its evidence, and from an answer to what of it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.functions.labs import lab_is_out, lab_text
from docevidence.functions.routing import classify_question, definition_term, lookup_keys
from docevidence.functions.text import trim
from docevidence.operators import retrieval
from docevidence.operators.embedders import Embedder, chosen
from docevidence.operators.evidence import inline_citations, strip_citations
from docevidence.plans import store
from docevidence.plans.scratch import saved

# The budgets of assemble_evidence: items and characters of each domain.
BUDGETS = {"patient": (6, 9000), "reference": (8, 7000), "terminology": (4, 7000)}
LETTERS = {"patient": "P", "reference": "R", "terminology": "T"}

GLOSSARY = {
    "anemia": "Anemia: fewer red blood cells, or less hemoglobin in them, than usual, so the blood carries less oxygen.",
    "bilirubin": "Bilirubin: a yellow substance that is left when old red blood cells are broken down; the liver removes it.",
    "blood-pressure": "Blood pressure: the force of the blood against the vessel walls, as the heart beats and as it rests.",
    "bmi": "Body mass index: the weight in kilograms divided by the square of the height in meters.",
    "calcium": "Calcium: a mineral in bones and blood that muscles, nerves and clotting need.",
    "cholesterol": "Cholesterol: a fat in the blood that the body makes and takes from food.",
    "creatinine": "Creatinine: a waste product of muscles; its level shows how well the kidneys filter.",
    "crp": "C-reactive protein: a protein of the liver that rises with inflammation.",
    "ecg": "Electrocardiogram: a recording of the heart's electrical activity.",
    "egfr": "Estimated glomerular filtration rate: how much blood the kidneys clean in a minute, computed from creatinine.",
    "glucose": "Glucose: the sugar in the blood that cells use for energy.",
    "hba1c": "HbA1c: the share of hemoglobin with sugar bound to it; it reflects the blood sugar of about three months.",
    "hdl": "HDL: particles that carry cholesterol back to the liver.",
    "hemoglobin": "Hemoglobin: the protein of red blood cells that carries oxygen.",
    "hypertension": "Hypertension: blood pressure that stays above the usual range.",
    "ldl": "LDL: particles that carry cholesterol to the tissues.",
    "platelets": "Platelets: small cell pieces in the blood that help it to clot.",
    "tsh": "TSH: the hormone that tells the thyroid gland how much hormone to make.",
    "triglycerides": "Triglycerides: the most common fat of the body, measured in the blood.",
    "white-cells": "White blood cells: the cells of the blood that defend against infections.",
}


def glossary(spark: SparkSession, space: str | None = None, dims: int = 256, embedder: Embedder | None = None) -> DataFrame:
    """The fixed definitions as vectors (id, text, embedding_space, values)."""
    embedder = chosen(embedder, space, dims)
    rows = spark.createDataFrame(list(GLOSSARY.items()), "id string, text string").withColumn("embedding_space", F.lit(space or embedder.space))
    return rows.join(embedder.embed(rows, "id", "text"), "id")


def retrieve_glossary(terms: DataFrame, entries: DataFrame, space: str | None = None, dims: int = 256, k: int = 2, floor: float = 0.70, embedder: Embedder | None = None) -> DataFrame:
    """(query_id, id, score, text, rank) of the entries at or over the floor among each term's best ``k``; terms: query_id, term."""
    embedder = chosen(embedder, space, dims)
    space = space or embedder.space
    q = embedder.embed(terms.withColumn("embedding_space", F.lit(space)), "query_id", "term", ["embedding_space"], query=True)
    hits = retrieval.vector_topk(q, retrieval.same_space(entries, space, embedder.dims), ["embedding_space"], k, floor=floor)
    return hits.join(entries.filter("text is not null").select("id", "text"), "id").select("query_id", "id", "score", "text", "rank")


def valid_terms(terms: DataFrame, space: str) -> DataFrame:
    """term vectors of the terminology domain and space whose id, text, term, dataset, its name and organisation are there."""
    there = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("text", "term", "dataset", "dataset_name", "organization")]
    fine = (F.col("domain") == "terminology") & (F.col("embedding_space") == space) & (F.col("chunk_id") == F.col("id"))
    for t in there:
        fine = fine & t
    return terms.filter(F.coalesce(fine, F.lit(False)))


def retrieve_terms(questions: DataFrame, terms: DataFrame, space: str | None = None, dims: int = 256, k: int = 4, floor: float = 0.70, most_exact: int = 6, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, status) of questions (query_id, question) over term vectors (ingest.term_vectors).

    Exact: terms that share a lookup key, the ``most_exact`` most similar of them. Semantic: the ``k`` most similar of all, at or over
    ``floor``. Once per record by the better kind, then score; ``position`` orders kind, dataset, score, id. ``status`` has ok or
    no_match, the counts of both kinds and the best score. A blank question matches nothing.
    """
    embedder = chosen(embedder, space, dims)
    space, dims = space or embedder.space, embedder.dims
    cleaned = F.left(trim(F.coalesce("question", F.lit(""))), F.lit(300))
    q = questions.select("query_id", cleaned.alias("cleaned")).withColumn("keys", lookup_keys(F.col("cleaned"))).withColumn("asked", F.coalesce(definition_term(F.col("cleaned")), F.col("cleaned"))).withColumn("embedding_space", F.lit(space))
    q = saved(q, "questions")  # read from here, no filter on keys moves below the caller's distinct, where each row's keys would be made
    asked = q.filter("cleaned <> ''")
    vectors = saved(embedder.embed(asked, "query_id", "asked", ["embedding_space"], query=True), "asked")
    own = retrieval.same_space(terms, space, dims)
    # Of each key's terms the most similar ones hold those of all of a question's keys.
    keyed = own.select("id", F.explode("alias_keys").alias("key"), "values")
    asking = asked.select("query_id", F.explode("keys").alias("key")).distinct().join(vectors.select("query_id", "values"), "query_id")
    best = retrieval.vector_topk(asking.select(F.struct("query_id", "key").alias("query_id"), "key", "values"), keyed, ["key"], most_exact, digits=None)
    best = best.select("query_id.query_id", "id", "score").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    exact = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= most_exact)
    exact = exact.select("query_id", "id", F.round("score", 6).alias("score"), F.lit(True).alias("by_key"))
    near = retrieval.vector_topk(vectors, own, ["embedding_space"], k).select("query_id", "id", "score", F.lit(False).alias("by_key"))
    fine = valid_terms(terms, space).drop("values", "embedding_space")
    hits = exact.unionByName(near).join(fine, "id").join(q.select("query_id", "keys"), "query_id")
    kind = F.when(F.array_contains("keys", F.col("term_key")), 0).when(F.arrays_overlap("alias_keys", "keys"), 1).otherwise(2)
    hits = hits.withColumn("kind", F.coalesce(kind, F.lit(2)))
    top = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    taken = hits.filter((F.col("kind") < 2) | (~F.col("by_key") & (F.col("score") >= floor)))
    one = taken.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("kind", F.desc("score")))).filter("n = 1")
    order = Window.partitionBy("query_id").orderBy("kind", F.col("dataset") != "medlineplus", F.desc("score"), "id")
    match = F.element_at(F.array(F.lit("exact_term"), F.lit("exact_alias"), F.lit("semantic")), F.col("kind") + 1)
    one = one.withColumn("position", F.row_number().over(order)).withColumn("match", match)
    counts = one.groupBy("query_id").agg(F.count_if(F.col("kind") < 2).alias("exact"), F.count_if(F.col("kind") == 2).alias("semantic"))
    status = questions.select("query_id").join(counts, "query_id", "left").join(top, "query_id", "left").na.fill(0, ["exact", "semantic"])
    status = status.select("query_id", F.when(F.col("exact") + F.col("semantic") > 0, "ok").otherwise("no_match").alias("status"), "exact", "semantic", "top_score")
    return one.drop("n", "kind", "by_key", "keys"), status


def retrieve_patient_multi(requests: DataFrame, vectors: DataFrame, documents: DataFrame, user_id: str, space: str | None = None, dims: int = 256, k: int = 3, floor: float = 0.5, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """P5: (hits, status) of requests (request_id, queries): P4 for each query, then each chunk's best score in its request.

    A request without queries, or a tenant without documents, is no_documents; valid candidates under the floor are below_threshold.
    """
    embedder = chosen(embedder, space, dims)
    space = space or embedder.space
    q = requests.select("request_id", F.posexplode(F.coalesce("queries", F.array())).alias("no", "question"))
    q = q.withColumn("query_id", F.concat_ws("#", F.col("request_id").cast("string"), F.col("no").cast("string")))
    hits, _, scored = store.retrieve_patient(q.select("query_id", "question"), vectors, documents, user_id, space, dims, k, floor, embedder=embedder)
    of = q.select("query_id", "request_id")
    best = retrieval.best_per_item(hits.join(of, "query_id"), "request_id", "id", "score").join(hits.select("id", "document_id", "filename", "text").distinct(), "id")
    any_scored = scored.join(of, "query_id").groupBy("request_id").agg(F.count("*").alias("m"))
    kept = best.groupBy("request_id").agg(F.count("*").alias("f"))
    counts = requests.select("request_id", F.size(F.coalesce("queries", F.array())).alias("asked")).join(any_scored, "request_id", "left").join(kept, "request_id", "left").na.fill(0, ["m", "f"])
    n_docs = documents.filter((F.col("user_id") == user_id) & (F.col("status") == "indexed") & (F.col("embedding_space") == space)).count()
    docs = F.when(F.col("asked") > 0, F.lit(n_docs)).otherwise(0)
    return best, retrieval.retrieval_status(counts, docs, F.col("m"), F.col("f")).select("request_id", "status")


def retrieve_reference(requests: DataFrame, vectors: DataFrame, sources: DataFrame, space: str | None = None, dims: int = 256, k: int = 4, floor: float = 0.66, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, tops) of requests (request_id, queries): per query the top k, valid ones at or over the floor, the best score of each
    chunk over a request's queries; ``tops`` has each query's best raw score."""
    embedder = chosen(embedder, space, dims)
    space = space or embedder.space
    q = requests.select("request_id", F.posexplode(retrieval.distinct_queries(F.col("queries"))).alias("no", "query"))
    q = q.select("request_id", F.concat_ws("#", F.col("request_id").cast("string"), F.col("no").cast("string")).alias("query_id"), F.lit(space).alias("embedding_space"), "query")
    q = saved(embedder.embed(q, "query_id", "query", ["request_id", "embedding_space"], query=True), "queries")
    top = retrieval.vector_topk(q, vectors, ["embedding_space"], k)
    valid = top.join(retrieval.servable_references(vectors, sources, space).select("id", "source_id", "title", "organization", "text"), "id").filter(F.col("score") >= floor)
    best = retrieval.best_per_item(valid.join(q.select("query_id", "request_id"), "query_id"), "request_id", "id", "score")
    return best.join(valid.select("id", "source_id", "title", "organization", "text").distinct(), "id"), retrieval.top_score(q, top, "query_id", "score")


def assemble_evidence(patient: DataFrame | None, reference: DataFrame | None, terminology: DataFrame | None = None, budgets: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(request_id, domain, evidence_id, n, chunk_id, similarity, content) of the three domains' items (request_id, chunk_id,
    similarity, content; terminology also position).

    Patient and reference items go by similarity, then id, terminology in its order; an item that does not fit is skipped and later ones
    are tried, each once, and the first always fits. Ids are P1.., R1.., T1... A null content counts as empty.
    """
    out = None
    for domain, items in (("patient", patient), ("reference", reference), ("terminology", terminology)):
        if items is None:
            continue
        most, chars = (budgets or BUDGETS)[domain]
        items = items.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("chars", F.length("content"))
        if domain == "terminology":
            kept = retrieval.ordered_budget(items, "request_id", "chunk_id", ["position", "chunk_id"], "chars", most, chars)
        else:
            kept = retrieval.greedy_budget(items, "request_id", "chunk_id", "similarity", "chars", most, chars)
        best = items.groupBy("request_id", "chunk_id").agg(F.max_by("content", "similarity").alias("content"), F.max("similarity").alias("similarity"))
        kept = kept.select("request_id", "n", "chunk_id").join(best, ["request_id", "chunk_id"])
        kept = kept.select("request_id", F.lit(domain).alias("domain"), F.concat(F.lit(LETTERS[domain]), F.col("n").cast("string")).alias("evidence_id"), "n", "chunk_id", "similarity", "content")
        out = kept if out is None else out.unionByName(kept)
    return out


def structured_report_text(labs: Column, details: Column, report: Column, symptoms: Column, medicines: Column, level: Column, score: Column, key_findings: Column, most: int = 6000) -> Column:
    """A10: a consultation's structured report as one text of at most ``most`` characters, null if there is nothing to say.

    labs: array<struct<name, value, unit, normal_range, flag, is_abnormal, page, pages>>; details: struct<age, gender>; report:
    struct<diagnoses: array<string>, scores: array<struct<name, result>>, measurements: array<struct<name, value, unit>>, dates:
    array<string>>. Null fields and empty lists leave their line out; the patient's name is no part of it.
    """
    none = F.array().cast("array<string>")
    joined = lambda a, sep="; ": F.array_join(F.coalesce(a, none), sep)
    line = lambda head, items: F.when(F.size(F.coalesce(items, none)) > 0, F.concat(F.lit(head), joined(items)))
    labs = F.coalesce(labs, F.filter(labs, lambda x: F.lit(False)))
    outside = lambda x: lab_is_out(x["flag"], x["is_abnormal"])
    out, rest = F.filter(labs, outside), F.filter(labs, lambda x: ~outside(x))
    who = F.array_join(F.array_compact(F.array(F.when(details["age"] > 0, F.concat(details["age"].cast("string"), F.lit(" years"))), F.nullif(details["gender"], F.lit("")))), ", ")
    unit = lambda x: F.coalesce(F.concat(F.lit(" "), F.nullif(x["unit"], F.lit(""))), F.lit(""))
    own = F.concat(F.lit("Own assessment (for clinician review, not part of the report): "), level, F.coalesce(F.concat(F.lit(" (score "), score.cast("string"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(". Key findings: "), F.nullif(joined(key_findings), F.lit(""))), F.lit("")))
    parts = [
        F.when(who != "", F.concat(F.lit("Patient: "), who)),
        F.when(F.size(labs) > 0, F.concat(F.lit("Lab values outside the range printed in the report ("), F.size(out).cast("string"), F.lit(" of "), F.size(labs).cast("string"), F.lit("):"))),
        F.when(F.size(out) > 0, F.array_join(F.transform(out, lab_text), "\n")),
        line("Lab values within range: ", F.transform(rest, lambda x: F.concat(x["name"], F.lit(" "), x["value"], unit(x)))),
        line("Impressions written in the report: ", report["diagnoses"]),
        line("Risk scores printed in the report: ", F.transform(report["scores"], lambda x: F.concat(x["name"], F.lit(": "), x["result"]))),
        line("Measurements: ", F.transform(report["measurements"], lambda x: F.concat(x["name"], F.lit(" "), x["value"], unit(x)))),
        line("Report dates: ", report["dates"]),
        line("Symptoms: ", symptoms),
        line("Medicines: ", medicines),
        F.when(F.coalesce(level, F.lit("")) != "", own),
    ]
    lines = F.array_compact(F.array(*parts))
    return F.when(F.size(lines) > 0, F.left(F.concat(F.lit("STRUCTURED REPORT extracted from the uploaded document\n"), F.array_join(lines, "\n")), F.lit(most)))


def route_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    """Q3 for rows: adds ``kind`` and ``term``."""
    return questions.withColumn("route", classify_question(F.col(question))).select("*", "route.kind", "route.term").drop("route")


def route_and_retrieve(questions: DataFrame, vectors: DataFrame, documents: DataFrame, terms: DataFrame, references: DataFrame, sources: DataFrame, user_id: str, space: str | None = None, dims: int = 256, structured: DataFrame | None = None, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """P10: (evidence, status) of questions (query_id, question) of one tenant.

    A terminology question takes terms only; where none is found it is a report question after all. Report and clinical questions take
    the tenant's chunks, its structured report (``structured``: query_id, chunk_id, content) and references. ``status`` has the kind in
    the end, the patient status and what each domain found.
    """
    embedder = chosen(embedder, space, dims)
    space = space or embedder.space
    routed = route_questions(questions)
    hits, found = retrieve_terms(routed.filter("kind = 'terminology'").select("query_id", "question"), terms, space, embedder=embedder)
    routed = routed.join(found.select("query_id", F.col("status").alias("terms")), "query_id", "left")
    routed = routed.withColumn("kind", F.when((F.col("kind") == "terminology") & (F.coalesce("terms", F.lit("no_match")) != "ok"), "report").otherwise(F.col("kind")))
    rest = routed.filter("kind <> 'terminology'").select("query_id", "question")
    chunks, patient_status, _ = store.retrieve_patient(rest, vectors, documents, user_id, space, embedder=embedder)
    refs, _ = retrieve_reference(rest.select(F.col("query_id").alias("request_id"), F.array("question").alias("queries")), references, sources, space, embedder=embedder)
    items = chunks.select(F.col("query_id").alias("request_id"), F.col("id").alias("chunk_id"), F.col("score").alias("similarity"), F.col("text").alias("content"))
    if structured is not None:
        items = items.unionByName(structured.filter("content is not null").join(rest.select("query_id"), "query_id").select(F.col("query_id").alias("request_id"), "chunk_id", F.lit(1.0).alias("similarity"), "content"))
    reference = refs.select("request_id", F.col("id").alias("chunk_id"), F.col("score").alias("similarity"), F.col("text").alias("content"))
    of_terms = hits.select(F.col("query_id").alias("request_id"), F.col("id").alias("chunk_id"), F.col("score").alias("similarity"), F.col("text").alias("content"), "position")
    evidence = assemble_evidence(items, reference, of_terms).withColumnRenamed("request_id", "query_id")
    counts = evidence.groupBy("query_id").agg(*(F.count_if(F.col("domain") == d).alias(d) for d in LETTERS))
    status = routed.select("query_id", "kind").join(patient_status.select("query_id", "status", "candidates"), "query_id", "left").join(counts, "query_id", "left")
    return evidence, status.select("query_id", "kind", F.coalesce("status", F.lit("no_matches")).alias("patient_status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", *LETTERS)))


def verify_term_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status, reason, valid and invalid ids and the cleaned answer of term answers (request_id, answer, citations, insufficient).

    Only the terminology ids of the request's evidence (request_id, domain, evidence_id) are valid. No evidence, the model's own report and
    an answer without a valid id are insufficient, in this order. Null citations count as none.
    """
    none = F.array().cast("array<string>")
    have = evidence.filter("domain = 'terminology'").groupBy("request_id").agg(F.collect_set("evidence_id").alias("have"))
    a = answers.join(have, "request_id", "left").withColumn("have", F.coalesce("have", none))
    claimed = F.array_distinct(F.concat(F.transform(F.coalesce("citations", none), lambda i: F.upper(F.trim(i))), inline_citations(F.coalesce("answer", F.lit("")))))
    a = a.withColumn("claimed", claimed).withColumn("valid", F.filter("claimed", lambda i: F.array_contains("have", i)))
    reason = F.when(F.size("have") == 0, "no_evidence").when(F.coalesce("insufficient", F.lit(False)), "model_reported").when(F.size("valid") == 0, "uncited_answer")
    a = a.withColumn("reason", reason)
    answered = F.col("reason").isNull()
    return a.select("request_id", F.when(answered, "answered").otherwise("insufficient_context").alias("status"), "reason", "valid", F.array_except("claimed", "have").alias("invalid"), F.when(answered, F.trim(strip_citations(F.col("answer"), F.col("valid")))).alias("answer"))
