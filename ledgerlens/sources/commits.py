"""Tables with a manifest: files are staged first, then one small file names all that belongs to the table.

    path/commit=<id>/          Parquet files of one commit, never changed
    path/_manifests/<version>  JSON: folders of the table, its schema, rows, the last batch of each writer, whether it is partitioned

A manifest is written beside and renamed to its version without overwriting, so a version has one winner: a writer that
loses reads the winner's version and tries again. Readers follow the latest manifest, so they never see what a
writer staged and didn't commit, nor half of a commit. A batch that runs again after its commit finds its number in the
manifest and does nothing; one that died before it stages anew, and what it left is removed by `vacuumed`. Nothing is
cached, and no plan reads the folder that it writes.

A plain Parquet reader of the path works too, with a column of its own for the commit, but sees what isn't committed.

The exclusive rename is the file system's: HDFS has it, and object stores by conditional writes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Manifest:
    version: int
    folders: tuple[str, ...] = ()
    rows: int = 0
    schema: str | None = None
    batches: dict[str, int] = field(default_factory=dict)
    partitioned: bool = False  # whether a commit's files may be in folders of their own by a column


class _Files:
    """What is needed of a path's file system; metadata only, on the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(root).getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.hadoop.Path(root)).toString().rstrip("/")

    def path(self, name: str) -> Any:
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def listed(self, name: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds) of what a folder holds."""
        at = self.path(name)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether a new file has the text; False if there is one already."""
        beside = self.path(f"_manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.hadoop, "Options$Rename")
        none = self.gateway.new_array(kind, 1)
        none[0] = kind.NONE
        try:
            self.hadoop.FileContext.getFileContext(beside.toUri(), self.conf).rename(beside, self.path(name), none)
        except Exception as e:  # noqa: BLE001  the only one that is expected
            self.fs.delete(beside, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The latest manifest, or that of a version; version -1 stands for a table without any."""
    files = _Files(spark, path)
    versions = [int(name) for name, _ in files.listed("_manifests") if name.isdigit()]
    if version is not None and version not in versions:
        raise ValueError(f"{path} has no version {version}")
    if not versions:
        return Manifest(-1)
    found = json.loads(files.read(f"_manifests/{max(versions) if version is None else version:020d}"))
    return Manifest(found["version"], tuple(found["folders"]), found["rows"], found["schema"], found["batches"], found["partitioned"])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as its manifest has it; None before the first commit."""
    return _read(spark, path, manifest(spark, path, version))


def _read(spark: SparkSession, path: str, found: Manifest) -> DataFrame | None:
    if found.schema is None:
        return None
    schema = StructType.fromJson(json.loads(found.schema))
    if not found.folders:
        return spark.createDataFrame([], schema)
    paths = [f"{path}/{f}" for f in found.folders]
    if not found.partitioned:
        return spark.read.schema(schema).parquet(*paths)
    whole = spark.read.schema(schema).parquet(paths[0])  # each has its own root of partitions
    for p in paths[1:]:
        whole = whole.union(spark.read.schema(schema).parquet(p))
    return whole


def _committed(files: _Files, found: Manifest) -> bool:
    said = {"version": found.version, "folders": list(found.folders), "rows": found.rows, "schema": found.schema, "batches": found.batches, "partitioned": found.partitioned}
    return files.create(f"_manifests/{found.version:020d}", json.dumps(said))


def _changed(
    spark: SparkSession, path: str, new_rows: Callable[[DataFrame | None], DataFrame], writer: str | None, batch: int | None,
    attempts: int, replaces: bool = False, partition_by: tuple[str, ...] = (),
) -> int:
    """Stages what `new_rows` makes of the table and commits it; rows committed, 0 for a batch that is committed already."""
    files = _Files(spark, path)
    for attempt in range(attempts):
        now = manifest(spark, path)
        if writer is not None and now.batches.get(writer, -1) >= batch:
            return 0
        rows, folder = new_rows(_read(spark, path, now)), f"commit={uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
        n = spark.read.schema(rows.schema).parquet(f"{path}/{folder}").count()
        if not n:
            files.remove(folder)
        kept = () if replaces else now.folders
        batches = now.batches | ({writer: batch} if writer is not None else {})
        partitioned = bool(partition_by) or now.partitioned and not replaces
        if _committed(files, Manifest(now.version + 1, (*kept, folder) if n else kept, n if replaces else now.rows + n, rows.schema.json(), batches, partitioned)):
            return n
        files.remove(folder)
        time.sleep(min(2.0, 0.05 * 2**attempt))
    raise RuntimeError(f"{path}: other writers were first {attempts} times")


def append_rows(rows: DataFrame, path: str, writer: str | None = None, batch: int | None = None, attempts: int = 10, partition_by: tuple[str, ...] = ()) -> int:
    """Appends all rows, once a (writer, batch)."""
    return _changed(rows.sparkSession, path, lambda _: rows, writer, batch, attempts, partition_by=partition_by)


def append_keyed(rows: DataFrame, path: str, key: list[str], writer: str | None = None, batch: int | None = None, attempts: int = 10) -> int:
    """Appends one row of each key that the table doesn't have (K3, K6), once a (writer, batch); how many it appended.

    Of several rows with a new key the least by the other columns is taken, so that a batch that runs again takes the same.
    A null in a key equals a null. A writer that lost looks again for the keys that the winner has brought.
    """
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct(*others)).alias("r")).select(*key, "r.*").select(*rows.columns) if others else rows.distinct()

    def fresh(there: DataFrame | None) -> DataFrame:
        if there is None:
            return first
        known = there.select(*[F.col(k).alias(f"there_{i}") for i, k in enumerate(key)])
        same = [first[k].eqNullSafe(known[f"there_{i}"]) for i, k in enumerate(key)]
        return first.join(known, same, "left_anti")

    return _changed(rows.sparkSession, path, fresh, writer, batch, attempts)


def compacted(spark: SparkSession, path: str, attempts: int = 10) -> int:
    """Writes the table as one folder, so that its manifest is short; rows, batches and later appends stay as they are."""
    if not manifest(spark, path).folders:
        return 0
    return _changed(spark, path, lambda there: there, None, None, attempts, replaces=True)


def vacuumed(spark: SparkSession, path: str, older_than_s: float = 7 * 86400) -> int:
    """Removes staged folders that the latest manifest doesn't name and that haven't changed for so long; how many.

    The time must be longer than any writer takes from its first file to its commit, and any reader on an older version.
    """
    files, named = _Files(spark, path), set(manifest(spark, path).folders)
    gone = [name for name, at in files.listed("") if name.startswith("commit=") and name not in named and at < (time.time() - older_than_s) * 1000]
    for name in gone:
        files.remove(name)
    return len(gone)
