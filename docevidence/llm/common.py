"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a new temporary folder is taken in local mode, once per application; on a cluster it is an error, as a
    folder of one machine would not hold the others' files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables in the shared folder: a lost executor cannot take them along, and lineage ends there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.schemas[name] = df.schema
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        """A saved table, read anew."""
        return self.spark.read.schema(self.schemas[name]).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def map_batches(df: DataFrame, fn: Callable, schema: str, most_rows: int = 1000, most_bytes: int = 4 << 20, state: Callable[[], Any] | None = None) -> DataFrame:
    """``fn`` maps one Arrow record batch to one record batch (or None); a batch has ``most_rows`` rows and about ``most_bytes`` at
    most, or one row. ``state`` makes what ``fn`` gets as a second argument for all batches of a task."""

    def run(batches: Iterable) -> Iterator:
        more = (state(),) if state else ()
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                part = whole.slice(at, most_rows)
                while part.num_rows > 1 and part.nbytes > most_bytes:
                    part = part.slice(0, max(1, min(part.num_rows - 1, part.num_rows * most_bytes // part.nbytes)))
                at += part.num_rows
                if (out := fn(part, *more)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it as long as a column has that name (Spark's names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fields(df: DataFrame, columns: list[str]) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


_held: dict[Hashable, Any] = {}


def worker_state(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept for the next batches and tasks of this Python worker. A worker serves one job after another, so it
    holds one such object only: another key's goes first, and its memory is free again."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # where the C library has it, freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
        _held[key] = build()
    return _held[key]


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A key for each row of a file scan, repeated ids and repeated rows included. Another scan may split the files otherwise and
    give other keys, so a key that a later job uses again is saved first."""
    return df.withColumn(name, F.monotonically_increasing_id())
