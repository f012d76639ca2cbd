"""Requests for a model, and reading what it returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docevidence.functions.text import escape_markup


def attribute(name: str, value: Column) -> Column:
    """`` name="value"`` escaped, nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), F.replace(escape_markup(value.cast("string")), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))


def evidence_block(evidence: DataFrame, request: str, attributes: list[str], empty: str = "(no evidence)") -> DataFrame:
    """C4: (request, block) with one element per evidence row, in the order of its number; escaped."""
    shown = F.concat(F.lit("<evidence"), attribute("id", F.col("evidence_id")), *(attribute(a, F.col(a)) for a in attributes), F.lit(">\n"), escape_markup(F.col("content")), F.lit("\n</evidence>"))
    rows = evidence.select(request, F.substring("evidence_id", 1, 1).alias("d"), F.substring("evidence_id", 2, 9).cast("int").alias("n"), shown.alias("t"))
    return rows.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("d", "n", "t"))).alias("e")).select(request, F.coalesce(F.nullif(F.array_join(F.transform("e", lambda s: s["t"]), "\n"), F.lit("")), F.lit(empty)).alias("block"))


def chunk_to_evidence(chunks: DataFrame) -> DataFrame:
    """Retrieved chunks as evidence input: score becomes similarity, text becomes content."""
    return chunks.withColumnsRenamed({"score": "similarity", "text": "content"})


def prompt_table(requests: DataFrame, blocks: DataFrame, request: str, template: str, empty: str = "(no evidence)", most_chars: int = 60_000) -> DataFrame:
    """Requests with ``prompt`` from the user's template, whose {column} marks are filled (``{block}``: the evidence), and ``truncated``."""
    rows = requests.join(blocks, request, "left").withColumn("block", F.coalesce("block", F.lit(empty)))
    prompt = F.lit(template)
    for c in rows.columns:
        if "{" + c + "}" in template:
            prompt = F.replace(prompt, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(request, F.left(prompt, F.lit(most_chars)).alias("prompt"), (F.length(prompt) > most_chars).alias("truncated"))


def parse_output(outputs: DataFrame, raw: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """Adds ``parsed`` (struct by ``schema``), ``violations`` and ``failure``; what can't be read or breaks a rule (a condition on
    ``parsed``) is a schema failure, never a default."""
    out = outputs.withColumn("parsed", F.from_json(F.col(raw), schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    broken = F.col("parsed").isNull() | F.col("parsed.__bad").isNotNull()
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda v: v.isNotNull())
    out = out.withColumn("violations", F.when(broken, F.array(F.lit("malformed"))).otherwise(found))
    return out.withColumn("failure", F.when(F.size("violations") > 0, "schema_validation_failure")).withColumn("parsed", F.when(F.size("violations") == 0, F.col("parsed").dropFields("__bad")))


def verbatim_text(pages: DataFrame, request: str, name: str, page: str, text: str) -> DataFrame:
    """(request, text): the pages under a line with file and page, in order."""
    head = F.concat(F.lit("--- "), F.col(name), F.coalesce(F.concat(F.lit(" · page "), F.col(page).cast("string")), F.lit("")), F.lit(" ---\n"))
    rows = pages.select(request, F.struct(F.col(name).alias("f"), F.col(page).alias("p"), F.concat(head, F.coalesce(F.col(text), F.lit(""))).alias("t")).alias("s"))
    return rows.groupBy(request).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("text"))
