"""A cleaning pipeline over ``documents``: toxicity, line dedup, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docevidence.llm import bpe, line_dedup, mixing, near_dup, toxicity
from docevidence.llm.common import Scratch, free_name, read_table, with_row_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; none where the labels teach no term, as then all texts score alike.

    Null and empty texts score by the model's constant term, as texts without any hit do. Repeated rows are judged one by one, alike.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    if not model.terms:
        return docs
    score = free_name("score", docs.columns)
    return toxicity.score(docs, model, docs.columns, out_col=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents that were nothing else.

    Null and empty texts stay as they are, so do repeated rows with fewer than 50 words; of longer repeated rows the first stays.
    """
    lines, removed = free_name("n_lines", docs.columns), free_name("removed", docs.columns)
    out = line_dedup.dedup_lines(docs, lines_col=lines, removed_col=removed)
    cut = F.size(removed) > 0
    return out.filter(~cut | (F.size(removed) < F.col(lines))).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more) the document with the smallest id stays.

    Documents without words, null texts among them, are no copies of each other and stay. Of rows with one id in a group, one stays.
    """
    row = free_name("row_key", docs.columns)
    rows = Scratch(spark, "near-copies").save(with_row_key(docs, row), "rows")
    kept = near_dup.group(rows, least_percent=80, row_col=row).filter("kept")
    one = kept.groupBy(F.when(F.col("n_shingles") > 0, F.struct("component_id")), F.when(F.col("n_shingles") == 0, F.col(row))).agg(F.min(row).alias(row))
    return rows.join(one.select(row).hint("shuffle_merge"), row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Documents without words have no share and go; repeated rows count one by one."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, decoded again for control: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text has no tokens."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_column(docs, "text", ranks, public_tokenizers.PATTERN, ["doc_id"], decoded_col="decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: Learned scores and a tokenizer decide here, which SQL can't express; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order."""
    docs = read_table(spark, sf_dir, "documents")
    work = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.save(docs, f"{k}-{name}")
    return docs
