"""What a model extracted from documents against the documents' own text and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docevidence.functions import labs as lab_rules
from docevidence.functions.text import clean_lab_name, clean_strings, trim
from docevidence.operators import grounding, prompting, structure
from docevidence.plans.scratch import saved


def by_document(df: DataFrame) -> DataFrame:
    """The right side of a join by document: it has rows for all documents, so it is merged. Constant columns make its files so small that Spark would
    take it for a broadcast, which the driver builds from every document's key."""
    return df.hint("merge")


@dataclass
class FoldedPages:
    """Pages (doc, page, text), folded once and written."""

    pages: DataFrame
    folded: DataFrame


def fold(pages: DataFrame) -> FoldedPages:
    """What the checks below read; pages without text count as none."""
    pages = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    folded = saved(grounding.fold_pages(pages, "doc", "page", "text"), "folded")
    return FoldedPages(pages, folded)


def outcome(pages: Column, readable: Column, model_only: Column) -> Column:
    """kept where the item stands on a page or the document has no text; else unverified where only a model could read part of it; else dropped."""
    return F.when(readable.isNull() | (F.size(pages) > 0), "kept").when(F.coalesce(model_only, F.lit(False)), "unverified").otherwise("dropped")


def verify_items(items: DataFrame, text: FoldedPages, documents: DataFrame) -> DataFrame:
    """Adds pages (those that hold the item) and outcome to items (doc, item, kind, name, value): kept, unverified or dropped.

    Symptoms and other plain texts stand by their name (J8), labs and measurements by value and name (J9). What is not found is
    dropped, or unverified where only a model could read part of the document; where a document has no text at all everything is kept.
    ``documents``: doc, model_only.
    """
    pairs = items.filter(F.col("kind").isin("lab", "measurement"))
    plain = items.filter(~F.col("kind").isin("lab", "measurement"))
    found = grounding.lab_pages(pairs, text.folded, "doc", "item", "name", "value", "page").unionByName(grounding.text_pages(plain, text.folded, "doc", "item", "name", "page"))
    readable = text.folded.select("doc").distinct().withColumn("readable", F.lit(True))
    out = items.join(by_document(found), ["doc", "item"], "left").join(by_document(readable), "doc", "left").join(by_document(documents.select("doc", "model_only")), "doc", "left")
    return out.withColumn("outcome", outcome(F.col("pages"), F.col("readable"), F.col("model_only"))).drop("readable", "model_only")


def verify_labs(labs: DataFrame, pages: DataFrame | FoldedPages, tables: DataFrame, documents: DataFrame) -> DataFrame:
    """P11 for labs: (doc, item, name, value, unit, normal_range, flag, is_abnormal, flag_source, page, pages, source, outcome).

    Table rows (doc, item, test, result, unit, reference_range, flag, page) are taken as they are, with the table's flag or one computed from
    their range. A model's lab (doc, item, name, value, unit, normal_range, is_abnormal) goes where a row of its document is the same test
    (J7); else it must stand on a page (J9), its range counts only if a page of it prints all its numbers (J10), and a flag comes from that
    range. ``page`` is claimed only where it is the only one; of several pages those that print the range are preferred.
    """
    given = F.col("flag").isNotNull()
    computed = lab_rules.flag_from_range(F.col("result"), F.col("reference_range"))
    flag = F.coalesce("flag", computed)
    rows = tables.select(
        "doc", "item", clean_lab_name(F.col("test")).alias("name"), F.col("result").alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), F.col("reference_range").alias("normal_range"), flag.alias("flag"), lab_rules.lab_is_out(flag, F.lit(False)).alias("is_abnormal"),
        F.when(given, "table").when(computed.isNotNull(), "printed_range").otherwise("model").alias("flag_source"), "page", F.array("page").alias("pages"), F.lit("table").alias("source"), F.lit("kept").alias("outcome"),
    )
    named = labs.filter((trim(F.col("name")) != "") & (trim(F.col("value")) != ""))  # by what is read at once: a cleaned name is empty where the name is
    model = named.select("doc", "item", clean_lab_name(F.col("name")).alias("name"), trim(F.col("value")).alias("value"), trim(F.coalesce("unit", F.lit(""))).alias("unit"), trim(F.coalesce("normal_range", F.lit(""))).alias("normal_range"), "is_abnormal", F.lit("lab").alias("kind"))
    model = saved(grounding.labs_not_in_tables(model, tables, "doc", "name", "test"), "labs")
    text = pages if isinstance(pages, FoldedPages) else fold(pages)
    checked = saved(verify_items(model, text, documents), "checked-labs")
    printed = checked.select("doc", "item", "normal_range", F.explode("pages").alias("page")).join(by_document(text.folded.select("doc", "page", "words")), ["doc", "page"])
    printed = printed.filter(grounding.range_is_printed(F.col("normal_range"), F.col("words"))).groupBy("doc", "item").agg(F.array_sort(F.collect_set("page")).alias("range_pages"))
    out = checked.join(by_document(printed), ["doc", "item"], "left")
    untested = F.col("pages").isNull() & (F.col("outcome") == "kept")  # a document without any text: nothing to test against
    span = F.when(untested | F.col("range_pages").isNotNull(), F.nullif("normal_range", F.lit("")))
    found = F.when((F.size("pages") > 1) & F.col("range_pages").isNotNull(), F.col("range_pages")).otherwise(F.col("pages"))
    out = out.withColumn("normal_range", span).withColumn("pages", found).withColumn("flag", lab_rules.flag_from_range(F.col("value"), F.col("normal_range")))
    out = out.withColumn("is_abnormal", F.when(F.col("flag").isNotNull(), F.col("flag") != "Normal").otherwise(F.coalesce("is_abnormal", F.lit(False))))
    out = out.select("doc", "item", "name", "value", "unit", "normal_range", "flag", "is_abnormal", F.when(F.col("flag").isNotNull(), "printed_range").otherwise("model").alias("flag_source"), F.when(F.size("pages") == 1, F.col("pages")[0]).alias("page"), "pages", F.when(F.size("pages") > 0, "text_match").otherwise("model").alias("source"), "outcome")
    return rows.unionByName(out)


def verify_identity(claimed: DataFrame, identity: DataFrame, pages: DataFrame | FoldedPages, documents: DataFrame) -> DataFrame:
    """P11 for the patient: (doc, name, age, gender, name_outcome); labelled fields (D9) decide.

    Else the model's name (doc, name, age, gender) must stand on a page (J8), its age as a number with or without "years", its gender as a
    word; without any text the claim stands. A name that is not found is unverified or dropped, as an item.
    """
    texts = pages if isinstance(pages, FoldedPages) else fold(pages)
    c = claimed.select("doc", trim(F.coalesce("name", F.lit(""))).alias("m_name"), F.when(F.col("age") > 0, F.round("age").cast("int")).alias("m_age"), trim(F.coalesce("gender", F.lit(""))).alias("m_gender"))
    names = verify_items(c.select("doc", F.lit(1).alias("item"), F.lit("name").alias("kind"), F.col("m_name").alias("name"), F.lit("").alias("value")), texts, documents).select("doc", "outcome")
    both = c.join(by_document(texts.pages.select("doc", "text")), "doc", "left")
    age = F.coalesce(F.rlike("text", F.concat(F.lit(r"(?i)\b"), F.col("m_age").cast("string"), F.lit(r"\s*(?:y|yr|yrs|years?)?\b"))), F.lit(False))
    gender = F.coalesce(F.rlike("text", F.concat(F.lit(r"(?i)\b"), F.regexp_replace("m_gender", "[^A-Za-z]", ""), F.lit(r"\b"))), F.lit(False))
    seen = both.groupBy("doc").agg(F.count("text").alias("n"), F.bool_or(age).alias("age_there"), F.bool_or(gender).alias("gender_there"))
    out = c.join(by_document(names), "doc", "left").join(by_document(seen), "doc", "left").join(by_document(identity.select("doc", "name", "age", "gender")), "doc", "left")
    blank = F.col("n") == 0
    return out.select(
        "doc", F.coalesce("name", F.when(F.col("outcome") == "kept", F.col("m_name")), F.lit("")).alias("name"), F.coalesce("age", F.when(blank | F.col("age_there"), F.col("m_age"))).alias("age"),
        F.coalesce("gender", F.when((F.col("m_gender") != "") & (blank | F.col("gender_there")), F.col("m_gender")), F.lit("")).alias("gender"), F.when(F.col("name").isNotNull(), "labelled").when(F.col("m_name") == "", "absent").otherwise(F.col("outcome")).alias("name_outcome"),
    )


LAB = "struct<name:string,value:string,unit:string,normal_range:string,is_abnormal:boolean>"
#: Columns of a model's outputs: those that are absent or null count as empty.
OUTPUTS = {
    "name": "string", "age": "double", "gender": "string", "labs": f"array<{LAB}>", "symptoms": "array<string>", "medicines": "array<string>", "diagnoses": "array<string>", "dates": "array<string>",
    "measurements": "array<struct<name:string,value:string,unit:string>>", "scores": "array<struct<name:string,result:string>>", "notes": "string", "imaging": "array<string>", "narrative": "string", "limitations": "array<string>",
}
#: What a kind of item is called where it is reported, in the order of the report.
LABELS = {"name": "Patient name", "lab": "Lab", "symptom": "Symptom", "medicine": "Medicine", "diagnosis": "Diagnosis", "date": "Date", "measurement": "Measurement", "score": "Risk score", "note": "Doctor notes"}
LISTS = {"symptom": "symptoms", "medicine": "medicines", "diagnosis": "diagnoses", "date": "dates"}
SHOWN_DROPPED = 5


def verify_extractions(outputs: DataFrame, pages: DataFrame, tables: DataFrame, documents: DataFrame) -> DataFrame:
    """P11 as one job: a verified result per document, nested, from one pass over its folded pages.

    ``outputs``: doc and the columns of OUTPUTS, one row a document. ``pages``: doc, page (null for a text without pages), filename, text. ``tables``: rows as
    for verify_labs. ``documents``: doc, model_only (part of it only a model can read), notes (array of limits known before), typed (the
    clinician's own text). Documents without an output give no row.

    The result: doc, patient (name, age, gender: labelled fields of the text decide), labs (table rows first, then the model's), symptoms, medicines,
    diagnoses, dates, measurements, scores (name and result on one page), notes, imaging, unverified (what only a model could have read),
    limitations, raw_text (typed text and pages as they are, then what the model read where part is model-only) and model_text. What stands
    nowhere in a readable document is dropped, and how much is said in the limitations.
    """
    none = F.array().cast("array<string>")
    given = outputs.select("doc", *(F.col(c).cast(t).alias(c) if c in outputs.columns else F.lit(None).cast(t).alias(c) for c, t in OUTPUTS.items()))
    given = saved(given, "outputs")
    documents = documents.select("doc", "model_only", *(F.col(c).cast(t).alias(c) if c in documents.columns else F.lit(None).cast(t).alias(c) for c, t in (("notes", "array<string>"), ("typed", "string"))))
    typed = documents.filter(F.trim(F.coalesce("typed", F.lit(""))) != "").select("doc", F.lit(None).cast("int").alias("page"), F.lit("typed input").alias("filename"), F.col("typed").alias("text"))
    own = pages.select("doc", F.col("page").cast("int").alias("page"), "filename", "text")
    # A page key that also tells texts without a page number apart.
    every = own.unionByName(typed).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    text = fold(every.select("doc", F.struct(F.coalesce("page", F.lit(0)).alias("page"), "filename").alias("page"), "text"))
    readable = text.folded.select("doc").distinct().withColumn("readable", F.lit(True))

    strings = [given.select("doc", F.lit(k).alias("kind"), F.posexplode(clean_strings(F.coalesce(c, none))).alias("no", "name")).withColumn("value", F.lit("")) for k, c in LISTS.items()]
    strings += [given.select("doc", F.lit("note").alias("kind"), F.lit(0).alias("no"), trim(F.coalesce("notes", F.lit(""))).alias("name"), F.lit("").alias("value")).filter("name <> ''")]
    pairs = given.select("doc", F.lit("measurement").alias("kind"), F.posexplode("measurements").alias("no", "m")).select("doc", "kind", "no", trim(F.col("m.name")).alias("name"), trim(F.col("m.value")).alias("value"), trim(F.coalesce("m.unit", F.lit(""))).alias("unit")).filter("name <> '' AND value <> ''")
    scores = given.select("doc", F.lit("score").alias("kind"), F.posexplode("scores").alias("no", "m")).select("doc", "kind", "no", trim(F.col("m.name")).alias("name"), trim(F.col("m.result")).alias("value")).filter("name <> '' AND value <> ''")
    items = strings[0]
    for more in (*strings[1:], scores):
        items = items.unionByName(more)
    items = items.withColumn("unit", F.lit("")).unionByName(pairs).withColumn("item", F.struct("kind", "no"))
    items = saved(items, "items")

    # One join for all texts (both parts of a score are a fact each), one for all pairs.
    facts = items.filter("kind <> 'measurement'").select("doc", F.col("item"), F.explode(F.when(F.col("kind") == "score", F.array("name", "value")).otherwise(F.array("name"))).alias("value"))
    facts = facts.select("doc", F.struct("item", "value").alias("fact"), "value")
    found = grounding.text_pages(facts, text.folded, "doc", "fact", "value", "page")
    parts = found.groupBy("doc", F.col("fact.item").alias("item")).agg(F.collect_list("pages").alias("p"))
    asked = facts.groupBy("doc", F.col("fact.item").alias("item")).agg(F.count_distinct("value").alias("n"))
    both = parts.join(by_document(asked), ["doc", "item"]).filter(F.size("p") == F.col("n"))
    both = both.select("doc", "item", F.aggregate(F.slice("p", 2, 1), F.get("p", F.lit(0)), lambda x, y: F.array_intersect(x, y)).alias("pages"))
    measured = grounding.lab_pages(items.filter("kind = 'measurement'"), text.folded, "doc", "item", "name", "value", "page")
    checked = items.join(by_document(both.unionByName(measured)), ["doc", "item"], "left").join(by_document(readable), "doc", "left").join(by_document(documents.select("doc", "model_only")), "doc", "left")
    checked = checked.withColumn("outcome", outcome(F.col("pages"), F.col("readable"), F.col("model_only")))
    shown = F.concat_ws(" ", "name", F.nullif("value", F.lit("")), F.nullif("unit", F.lit("")))
    shown = F.when(F.col("kind") == "score", F.concat_ws(": ", "name", "value")).when(F.col("kind") == "note", F.left("name", F.lit(80))).otherwise(shown)
    checked = checked.select("doc", "kind", "no", "name", "value", "unit", "outcome", shown.alias("shown"))

    labs = given.select("doc", F.posexplode("labs").alias("no", "l")).select("doc", F.format_string("%08d", "no").alias("item"), "l.*")
    keyed = text.pages.select("doc", "page", "text")
    rows = tables.withColumn("item", F.concat(F.lit("t"), F.col("item").cast("string"))).withColumn("page", F.struct(F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), (F.col("filename") if "filename" in tables.columns else F.lit(None).cast("string")).alias("filename")))
    verified = verify_labs(labs, FoldedPages(keyed, text.folded), rows, documents)
    files = lambda a: F.size(F.array_distinct(F.transform(a, lambda p: p["filename"])))
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter("pages", lambda p: p["page"] > 0), lambda p: p["page"])))
    one_file = files(F.col("pages")) == 1
    lab = F.struct(
        "name", "value", "unit", "normal_range", "is_abnormal", "flag", "flag_source", "source", F.get(F.col("pages"), F.lit(0))["filename"].alias("filename"),
        F.when(one_file & (F.size(numbers) == 1), F.get(numbers, F.lit(0))).alias("page"), F.when(one_file & (F.size(numbers) > 1), numbers).alias("pages"),
    )
    verified = saved(verified.select("doc", (F.col("source") != "table").cast("int").alias("k"), "item", "outcome", lab.alias("lab")), "verified-labs")
    of_labs = verified.filter("k = 1").select("doc", F.lit("lab").alias("kind"), F.col("item").cast("int").alias("no"), F.col("lab.name").alias("name"), F.col("lab.value").alias("value"), F.col("lab.unit").alias("unit"), "outcome", F.concat_ws(" ", "lab.name", "lab.value", F.nullif("lab.unit", F.lit(""))).alias("shown"))

    identity = structure.extract_identity(every, "doc", "page", "text")
    who = saved(verify_identity(given.select("doc", "name", "age", "gender"), identity, text, documents), "identity")
    names = who.filter(F.col("name_outcome").isin("unverified", "dropped")).join(by_document(given.select("doc", trim(F.col("name")).alias("claimed"))), "doc")
    names = names.select("doc", F.lit("name").alias("kind"), F.lit(0).alias("no"), F.col("claimed").alias("name"), F.lit("").alias("value"), F.lit("").alias("unit"), F.col("name_outcome").alias("outcome"), F.col("claimed").alias("shown"))

    everything = saved(checked.unionByName(of_labs).unionByName(names), "outcomes")
    order = F.create_map(*(x for n, k in enumerate(LABELS) for x in (F.lit(k), F.lit(n))))
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("kind")]
    said = F.when((F.col("kind") == "name") & (F.col("outcome") == "dropped"), label).otherwise(F.concat(label, F.lit(": "), F.col("shown")))
    row = F.struct(order[F.col("kind")].alias("k"), "no", "name", "value", "unit", said.alias("said"))
    listed = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, row))), what)
    kept = lambda kind: (F.col("outcome") == "kept") & (F.col("kind") == kind)
    lists = [listed(kept(k), lambda r: r["name"]).alias(c) for k, c in LISTS.items()]
    lists += [listed(kept("measurement"), lambda r: F.struct(r["name"].alias("name"), r["value"].alias("value"), r["unit"].alias("unit"))).alias("measurements")]
    lists += [listed(kept("score"), lambda r: F.struct(r["name"].alias("name"), r["value"].alias("result"))).alias("scores")]
    lists += [listed(F.col("outcome") == o, lambda r: r["said"]).alias(o) for o in ("unverified", "dropped")]
    nested = everything.groupBy("doc").agg(*lists, F.max(F.when(kept("note"), F.col("name"))).alias("notes"))
    nested_labs = verified.filter("outcome = 'kept'").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item", "lab"))), lambda r: r["lab"]).alias("labs"))

    head = F.concat(F.lit('Another name appears in the document ("'))
    other = F.transform(F.coalesce("other_names", F.array().cast(identity.schema["other_names"].dataType)), lambda o: F.concat(head, o["name"], F.lit('"'), F.when(o["page"] > 0, F.concat(F.lit(", page "), o["page"].cast("string"))).otherwise(""), F.lit('); the patient name was taken from the "Patient Name" field.')))
    gone = F.concat(F.size("dropped").cast("string"), F.lit(" item(s) proposed by the AI were not found in the document text and were discarded ("), F.array_join(F.slice("dropped", 1, SHOWN_DROPPED), "; "), F.when(F.size("dropped") > SHOWN_DROPPED, "; …").otherwise(""), F.lit(")."))
    verbatim = prompting.verbatim_text(own.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.trim("text")), "doc", "filename", "page", "text").withColumnRenamed("text", "verbatim")
    out = given.select("doc", "imaging", "narrative", "limitations").join(by_document(who), "doc")
    for more in (nested, nested_labs, identity.select("doc", "other_names"), verbatim, documents.withColumnRenamed("notes", "known"), readable):
        out = out.join(by_document(more), "doc", "left")
    narrative = trim(F.coalesce("narrative", F.lit("")))
    read = F.coalesce("model_only", F.lit(False))
    by_model = F.when(read & (narrative != ""), F.concat(F.lit("--- Read by AI from images/scans (not verified against the text layer) ---\n"), narrative))
    local = F.col("readable").isNotNull()
    empty = lambda c: F.coalesce(c, F.filter(c, lambda x: F.lit(False)), F.array().cast(out.schema[c].dataType))
    out = out.withColumn("dropped", F.coalesce("dropped", none))
    return out.select(
        "doc", F.struct("name", "age", "gender").alias("patient"), *(empty(c).alias(c) for c in ("labs", *LISTS.values(), "measurements", "scores")), F.coalesce("notes", F.lit("")).alias("notes"), clean_strings(F.coalesce("imaging", none)).alias("imaging"),
        F.coalesce("unverified", none).alias("unverified"), F.concat(F.coalesce("known", none), other, F.when(F.size("dropped") > 0, F.array(gone)).otherwise(none), clean_strings(F.coalesce("limitations", none))).alias("limitations"),
        F.when(local, F.array_join(F.array_compact(F.array(F.nullif(trim(F.coalesce("typed", F.lit(""))), F.lit("")), "verbatim", by_model)), "\n\n")).otherwise(narrative).alias("raw_text"),
        F.when(local & ~read, "").otherwise(narrative).alias("model_text"),
    )


def page_notes(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc, notes, needs_model) of pages (doc, name, page, status, images): what a reader of the text alone would miss, in page order.

    ``tables`` (doc, page, mapped: rows that fit the lab columns, rows) adds a note for tables that none fits. A document needs a model where a
    page is scanned or mixed, an empty one has images, or all pages are empty.
    """
    at = F.concat(F.col("name"), F.lit(" page "), F.col("page").cast("string"), F.lit(": "))
    note = F.when(F.col("status") == "scanned", F.concat(at, F.lit("no text layer (scanned)."))).when(F.col("status") == "mixed", F.concat(at, F.lit("contains "), F.col("images").cast("string"), F.lit(" embedded image(s)."))).when(F.col("status") == "empty", F.concat(at, F.lit("no extractable content.")))
    notes = pages.select("doc", "page", F.lit(1).alias("k"), note.alias("note"))
    if tables is not None:
        odd = tables.filter("mapped = 0 AND rows > 0").join(pages.select("doc", "page", "name"), ["doc", "page"])
        notes = notes.unionByName(odd.select("doc", "page", F.lit(0).alias("k"), F.concat(at, F.lit("a table was detected but its rows could not be mapped; kept as plain text.")).alias("note")))
    listed = notes.filter("note is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "k", "note"))).alias("l"))
    listed = listed.select("doc", F.transform("l", lambda s: s["note"]).alias("notes"))
    unread = F.col("status").isin("scanned", "mixed") | ((F.col("status") == "empty") & (F.col("images") > 0))
    needs = pages.groupBy("doc").agg((F.bool_or(unread) | F.bool_and(F.col("status") == "empty")).alias("needs_model"))
    return needs.join(listed, "doc", "left").select("doc", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), "needs_model")


def page_counts(segments: DataFrame, doc_col: str = "document_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(doc_col, pages, chars): distinct pages (null ones don't count) and characters of a document's segments."""
    return segments.groupBy(doc_col).agg(F.count_distinct(page_col).alias("pages"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"))
