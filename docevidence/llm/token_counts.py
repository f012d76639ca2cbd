"""Token counts with a digest cache.

Stored counts are keyed by the digest of the content as the tokenizer's normaliser leaves it (a byte-level tokenizer has
none, so the UTF-8 bytes) and the digest of the tokenizer file. A run joins its digests to the store, encodes one text
for each digest that is missing, and appends those counts to the store.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docevidence.llm.common import Scratch, map_batches, with_row_key
from docevidence.llm.hf_counts import library_encoder, tokenizer_digest

STORE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def read_store(spark, store_path: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer version, one row per content digest; an absent store is empty."""
    try:
        store = spark.read.schema(STORE_SCHEMA).parquet(store_path)
    except AnalysisException:
        store = spark.createDataFrame([], STORE_SCHEMA)
    return store.filter(F.col("tokenizer_digest") == tokenizer).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, store_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, without added special tokens, truncation or padding.

    A null text counts as empty (0 tokens). Repeated rows and ids stay; an empty table gives no rows. A text goes to the tokenizer
    once, however many rows hold it: its first row is found on digests alone, with partial results before the shuffle, then joined back
    by row. A count is stored under the digest of the very text that was encoded, so even where another scan gives a row another key, the
    store holds right counts only; a row without a count is then an error, and the next run adds what is missing. Counts join
    their rows by digest; both sides are shuffled for that alone, so Spark can split the rows of a hot text.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_row_key(docs.select(F.col(id_col).alias("__id"), text.alias("__text")), "__row").withColumn("content_digest", F.unhex(F.sha2(F.col("__text"), 256)))

    known = read_store(spark, store_path, tokenizer)
    firsts = rows.groupBy("content_digest").agg(F.min("__row").alias("__row"))
    missing = firsts.join(known, "content_digest", "left_anti").select("__row")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = library_encoder(tokenizer_path)
        texts = b.column("__text").to_pylist()
        n = [len(enc(t)) // 4 for t in texts]
        digests = [hashlib.sha256(t.encode()).digest() for t in texts]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    texts = rows.select("__row", "__text").join(missing.hint("shuffle_merge"), "__row").select("__text")
    map_batches(texts, count, STORE_SCHEMA).write.mode("append").parquet(store_path)

    counts = Scratch(spark, "token-counts").save(read_store(spark, store_path, tokenizer), "counts").hint("shuffle_merge")
    out = rows.select("__id", "content_digest", F.octet_length("__text").cast("long").alias("n_bytes")).join(counts, "content_digest", "left")
    missing = F.raise_error(F.lit("a text has no count: the rows were read anew in another order; run again")).cast("bigint")
    return out.select(F.col("__id").alias(id_col), "n_bytes", F.coalesce("n_tokens", missing).alias("n_tokens"))
