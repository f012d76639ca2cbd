"""Tables with upserts, deletions and several writers on plain Parquet.

A table's rows are dealt to buckets: first by the hash of the ``by`` columns (a tenant), within that by the hash of the key. A version is
a small file ``_versions/<number>.json`` that names the folder of each bucket that has rows. A write makes new folders for the
buckets that it touches only, then the next version file, which must not be there yet: of two writers one finds it taken. If the other
has touched other buckets, the writer puts its own over the newer version; else it fails with Conflict, and nothing of it is seen. Readers
see one whole version. ``vacuum`` deletes what no kept version names, so that deleted rows leave the disk.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUPS, PARTS, SPREAD = 16, 4, 8


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since this one read them."""


class Files:
    """The few calls to the table's file system, whatever it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[tuple[str, bool, float]]:
        """(name, is it a folder, time in seconds) of what is in a folder, none if it is absent."""
        if not self.fs.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), s.isDirectory(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False where it is there already. The text is written aside first and then renamed, so nobody reads half of it."""
        own = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            claim = self.fs.create(self.path(f"{name}.claim"), False)  # fails where another writer was first
            claim.close()
        except Py4JJavaError:
            self.fs.delete(own, False)
            return False
        return bool(self.fs.rename(own, self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Table:
    """A table at ``path``. ``keys`` identify a row, ``by`` are those of its tenant (all keys if it has none): rows are dealt to ``groups`` by
    ``by`` and to ``parts`` of a group by the key. Layout and keys belong to the table: every user gives the same ones."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str] | None = None, by: list[str] | None = None, groups: int = GROUPS, parts: int = PARTS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.columns = spark.createDataFrame([], schema).columns
        self.keys = keys or self.columns[:1]
        self.by, self.groups, self.parts = by or self.keys, groups, parts
        self.files = Files(spark, self.path)

    def bucket(self) -> Column:
        return (F.pmod(F.xxhash64(*self.by), F.lit(self.groups)) * self.parts + F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(self.parts))).cast("int")

    def version(self) -> int:
        """The newest version's number; 0 for a table without any."""
        return max((int(n[:-5]) for n, _, _ in self.files.names(f"{self.path}/_versions") if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict[str, Any]:
        """``buckets`` (number to folder), ``marks`` (stream to its last batch) and ``note`` (what writers have left under a name) of a version."""
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.path}/_versions/{version:012d}.json")) if version else {"buckets": {}, "marks": {}, "note": {}}

    def read(self, version: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """A version's rows. ``of``: rows with the ``by`` columns of the tenants that are wanted, a few; other groups' folders are not
        read then (rows of tenants that share a group are)."""
        buckets = self.state(version)["buckets"]
        if of is not None:
            there = {r[0] for r in of.select(F.pmod(F.xxhash64(*self.by), F.lit(self.groups)).cast("int")).distinct().collect()}
            buckets = {b: folder for b, folder in buckets.items() if int(b) // self.parts in there}
        return self._rows(buckets.values())

    def _rows(self, folders) -> DataFrame:
        paths = sorted(f"{self.path}/{f}" for f in folders)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, folder: str) -> set[str]:
        """Writes rows to a folder for each bucket; returns the buckets. Up to SPREAD tasks write a bucket, as one tenant may have most rows."""
        dealt = rows.select(*self.columns, self.bucket().alias("__bucket")).repartition("__bucket", F.pmod(F.xxhash64(F.lit(2), *self.keys), F.lit(SPREAD)))
        dealt.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        return {n.split("=")[1] for n, is_folder, _ in self.files.names(f"{self.path}/{folder}") if is_folder and n.startswith("__bucket=")}

    def _commit(self, seen: dict[str, Any], version: int, touched: set[str], folder: str, filled: set[str], mark: tuple[str, int] | None, note: dict | None) -> int:
        """The next version after ``version`` with the touched buckets in ``folder`` (those not in ``filled`` are empty now)."""
        read = {b: seen["buckets"].get(b) for b in touched}
        while True:
            now = self.state(version)
            if {b: now["buckets"].get(b) for b in touched} != read:
                raise Conflict(f"{self.path}: version {version} has changed the same buckets")
            if mark and now["marks"].get(mark[0], -1) >= mark[1]:
                raise Conflict(f"{self.path}: batch {mark[1]} of {mark[0]} is there already")
            buckets = {b: f for b, f in now["buckets"].items() if b not in touched} | {b: f"{folder}/__bucket={b}" for b in filled}
            marks = now["marks"] | ({mark[0]: mark[1]} if mark else {})
            if self.files.create(f"{self.path}/_versions/{version + 1:012d}.json", json.dumps({"buckets": buckets, "marks": marks, "note": now["note"] | (note or {})})):
                return version + 1
            for _ in range(50):  # the other writer's file follows its claim
                if self.version() > version:
                    break
                time.sleep(0.1)
            else:
                raise Conflict(f"{self.path}: version {version + 1} is claimed and was never written; release() frees it")
            version += 1

    def release(self) -> None:
        """Frees the next version's number where a writer claimed it and died."""
        self.files.delete(f"{self.path}/_versions/{self.version() + 1:012d}.json.claim")

    def applied(self, stream: str) -> int:
        """The last batch of a stream that is in the table; -1 for none."""
        return self.state()["marks"].get(stream, -1)

    def publish(self, rows: DataFrame, note: dict | None = None) -> int:
        """The rows take the place of all there are."""
        version = self.version()
        seen, folder = self.state(version), f"data/{uuid.uuid4().hex}"
        filled = self._write(rows, folder)
        return self._commit(seen, version, filled | set(seen["buckets"]), folder, filled, None, note)

    def upsert(self, rows: DataFrame, keys: list[str] | None = None, order: str | None = None, mark: tuple[str, int] | None = None, note: dict | None = None, gone: DataFrame | None = None) -> int:
        """Rows replace those with their keys, and rows with the keys of ``gone`` go, in one version. Of given rows with one key the last by
        ``order`` stays, else the greatest. Only touched buckets are rewritten. ``mark`` (stream, batch): done once; a batch that the
        table has already changes nothing."""
        if keys not in (None, self.keys):
            raise ValueError(f"the table's keys are {self.keys}")
        version = self.version()
        seen = self.state(version)
        if mark and seen["marks"].get(mark[0], -1) >= mark[1]:
            return version
        own, folder = f"data/{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        extra = [F.col(order).alias("__order")] if order else []
        best = Window.partitionBy(*self.keys).orderBy(*([F.desc_nulls_last("__order")] if order else []), *(F.desc_nulls_last(c) for c in self.columns if c not in self.keys))
        one = rows.select(*self.columns, *extra).withColumn("__n", F.row_number().over(best)).filter("__n = 1")
        arrived = self._write(one, own)  # kept aside: the rows are made once
        lost = gone.select(*self.keys).distinct() if gone is not None else None
        touched = arrived | ({str(r[0]) for r in lost.select(self.bucket()).distinct().collect()} if lost is not None else set())
        if not touched & set(seen["buckets"]):  # nothing to keep beside the new rows, so they stay where they are
            return self._commit(seen, version, arrived, own, arrived, mark, note)
        new = self._rows(f"{own}/__bucket={b}" for b in arrived)
        old = self._rows(seen["buckets"][b] for b in touched if b in seen["buckets"])
        kept = old.join(new.select(*self.keys), self.keys, "left_anti")
        kept = kept.join(lost, self.keys, "left_anti") if lost is not None else kept
        filled = self._write(kept.unionByName(new), folder)
        done = self._commit(seen, version, touched, folder, filled, mark, note)
        self.files.delete(f"{self.path}/{own}")
        return done

    def delete(self, ids: DataFrame, keys: list[str]) -> int:
        """Removes the rows that agree with ``ids`` in ``keys``; returns their number. Only their buckets are rewritten; where ``keys`` has the
        ``by`` columns, only those tenants' groups are read."""
        version = self.version()
        seen, ids = self.state(version), ids.select(*keys).distinct()
        now = self.read(version, ids if set(self.by) <= set(keys) else None)
        found = {str(r["b"]): r["count"] for r in now.join(ids, keys, "left_semi").groupBy(self.bucket().alias("b")).count().collect()}  # a row for each bucket
        if found:
            folder = f"data/{uuid.uuid4().hex}"
            filled = self._write(self._rows(seen["buckets"][b] for b in found).join(ids, keys, "left_anti"), folder)
            self._commit(seen, version, set(found), folder, filled, None, None)
        return sum(found.values())

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> int:
        """Deletes folders that none of the ``keep`` newest versions names, and older versions; returns how many folders went. Folders younger
        than ``older_than`` seconds stay, as a writer may be about to name them."""
        newest = self.version()
        kept = [v for v in range(max(1, newest - keep + 1), newest + 1)]
        named = {f for v in kept for f in self.state(v)["buckets"].values()}
        limit, n = time.time() - older_than, 0
        for name, _, at in self.files.names(f"{self.path}/_versions"):
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) < kept[0] if kept else False:
                self.files.delete(f"{self.path}/_versions/{name}")
        for folder, _, _ in self.files.names(f"{self.path}/data"):
            buckets = [(b, at) for b, is_folder, at in self.files.names(f"{self.path}/data/{folder}")]
            unused = [b for b, at in buckets if f"data/{folder}/{b}" not in named and at <= limit]
            for b in unused:
                self.files.delete(f"{self.path}/data/{folder}/{b}")
            n += sum(b.startswith("__bucket=") for b in unused)
            if len(unused) == len(buckets):
                self.files.delete(f"{self.path}/data/{folder}")
        return n
