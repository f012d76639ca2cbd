"""Embeddings that the jobs take as an argument (V1, V2): a hash of tokens, a user's model, and a store of vectors in front of either."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docevidence.operators import retrieval


def space_id(model: str, dims: int) -> str:
    return f"{model}@{dims}"


def model_embed(df: DataFrame, key: str, text: str, model: Callable[[], Callable[[list[str]], np.ndarray]], dims: int, keep: list[str] | None = None, out_col: str = "values", batch: int = 32, prefix: str = "") -> DataFrame:
    """V2: key, ``keep`` and vectors of unit length by the user's model: ``model()`` is called once a task and gives a function of a list of
    texts to an array of ``dims`` columns (any other number is an error). ``prefix`` comes before each text, as for queries. A null text
    counts as empty; a zero vector stays zero. The space's name is ``space_id``'s.
    """
    columns = [key, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = model()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                v = np.asarray(embed([prefix + (t or "") for t in b.column(len(columns)).to_pylist()]), dtype=np.float64)
                if v.shape != (b.num_rows, dims):
                    raise ValueError(f"the model gave {v.shape}, not {(b.num_rows, dims)}")
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(n == 0, 1.0, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dims, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(columns))), lists], [*columns, out_col])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, F.col(text).alias("text to embed")).mapInArrow(run, f"{kinds}, `{out_col}` array<double>")


class Embedder:
    """What jobs need: the space's name, the number of dimensions, and vectors for rows with a unique key. ``query``: the texts ask."""

    space: str
    dims: int

    def embed(self, df: DataFrame, key: str, text: str, keep: list[str] | None = None, out_col: str = "values", query: bool = False) -> DataFrame:
        """(key, *keep, out_col)"""
        raise NotImplementedError


class HashEmbedder(Embedder):
    """V1: signed token hashing."""

    def __init__(self, dims: int = 256):
        self.dims, self.space = dims, space_id("hash", dims)

    def embed(self, df, key, text, keep=None, out_col="values", query=False):
        return retrieval.embed_rows(df, key, text, self.dims, keep, out_col)


class ModelEmbedder(Embedder):
    """V2: a user's model (see model_embed); ``query_prefix`` comes before texts that ask."""

    def __init__(self, name: str, model: Callable[[], Callable[[list[str]], np.ndarray]], dims: int, query_prefix: str = "", batch: int = 32):
        self.dims, self.space, self.model, self.query_prefix, self.batch = dims, space_id(name, dims), model, query_prefix, batch

    def embed(self, df, key, text, keep=None, out_col="values", query=False):
        return model_embed(df, key, text, self.model, self.dims, keep, out_col, self.batch, self.query_prefix if query else "")


class StoredEmbedder(Embedder):
    """Vectors by digest of the text, space and kind, kept in Parquet at ``path``: equal texts reach the inner embedder once, in one run and over
    runs. Digests that are missing are embedded and appended before the rows get their vectors; a digest that two runs append at once
    counts once when read."""

    SCHEMA = "space string, query boolean, digest string, values array<double>"

    def __init__(self, inner: Embedder, path: str):
        self.inner, self.path, self.space, self.dims = inner, path, inner.space, inner.dims

    def stored(self, spark, query: bool) -> DataFrame:
        try:
            rows = spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            rows = spark.createDataFrame([], self.SCHEMA)
        return rows.filter((F.col("space") == self.space) & (F.col("query") == F.lit(query))).groupBy("digest").agg(F.min("values").alias("values"))

    def embed(self, df, key, text, keep=None, out_col="values", query=False):
        spark, keep = df.sparkSession, keep or []
        said = F.coalesce(F.col(text), F.lit(""))
        rows = df.select(key, *keep, said.alias("__text"), F.sha2(said, 256).alias("__digest"))
        missing = rows.groupBy(F.col("__digest").alias("digest")).agg(F.min("__text").alias("text")).join(self.stored(spark, query), "digest", "left_anti")
        new = self.inner.embed(missing, "digest", "text", query=query)
        new.select(F.lit(self.space).alias("space"), F.lit(query).alias("query"), "digest", "values").write.mode("append").parquet(self.path)
        vectors = self.stored(spark, query).select(F.col("digest").alias("__digest"), F.col("values").alias(out_col))
        return rows.drop("__text").join(vectors, "__digest").select(key, *keep, out_col)


def chosen(embedder: Embedder | None, space: str | None, dims: int) -> Embedder:
    """The embedder of a job: the one given, or the hash of ``dims``. A space or length that is not the given embedder's is an error, so
    vectors of one space never meet queries of another."""
    own = embedder or HashEmbedder(dims)
    if embedder is not None and space is not None and space != embedder.space:
        raise ValueError(f"the embedder's space is {embedder.space}, not {space}")
    return own
