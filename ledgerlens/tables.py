"""Tables that cut the lineage of iterative plans: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The least number of tasks that rows with much work are dealt to.
MIN_TASKS = 64

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a local session gets a temporary folder; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="ledgerlens-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def kept(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, removed when the driver exits or by `dropped`."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession, least: int = 0) -> int:
    """The number of tasks that `spread` deals to, no fewer than `least`."""
    return max(MIN_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def spread(df: DataFrame, *by: str, tasks: int = 0) -> DataFrame:
    """`df` dealt over a number of tasks of its own (`tasks` at least), by columns if given: for rows that are few bytes and
    much work, which a small file would leave to one task and adaptive execution would merge again."""
    return df.repartition(tasks_of(df.sparkSession, tasks), *by)


def descended(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `start` and of what `step` makes of them, level by level, until a level is empty.

    Each level is a table in the shared folder, so no level computes the ones before it again, and neither the rows nor
    the levels are bounded.
    """
    found = level = kept(start)
    while not level.isEmpty():
        level = kept(step(level))
        found = found.unionByName(level)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_folder(spark)}/ledgerlens-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def dropped(df: DataFrame) -> None:
    """Removes a table that `kept` made and that no later plan reads."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, root)
        _written[:] = [w for w in _written if w[1].rsplit("/", 1)[-1] != root.rsplit("/", 1)[-1]]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and with it the folder
            return
    _written.clear()


atexit.register(_remove_all)
