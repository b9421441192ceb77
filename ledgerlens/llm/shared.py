"""What several operators share: the shared folder, the word rule and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: What one Arrow batch may hold, so that long texts don't make batches of gigabytes.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2000

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def batched(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches are bounded in bytes and rows, always to what all operators here use."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder that goes when the driver ends; elsewhere that is an error,
    as executors don't share their local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="ledgerlens-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, lineage cut, safe when executors are lost.

    The table is removed when the driver exits, since the caller's plan may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlens-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table that `written` made and that no later plan reads."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, root)
        _written[:] = [w for w in _written if w[1].rsplit("/", 1)[-1] != root.rsplit("/", 1)[-1]]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and with it the folder
            return
    _written.clear()


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, GAP), lambda w: w != "")), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges`; root is the least node of its component.

    Alternating large-star and small-star rounds: each is one shuffle of the current links, the links shrink to one a
    node, and each round's links are a table in the shared folder. A node with many neighbours is never collected: the
    least neighbour is a partial aggregate. Raises if it has not settled in `rounds`.
    """
    spark = edges.sparkSession
    links = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        after = written(small)
        # Settled: every node has one link and no root is itself linked to something less.
        deep = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        multi = 0 if deep else after.groupBy("u").count().where("count > 1").limit(1).count()
        dropped(links)
        links = after
        if not deep and not multi:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def released(spark: SparkSession) -> None:
    """Lets the driver find finished shuffles, so that executors remove their files before the next large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


atexit.register(_remove_all)
