"""Points in intervals and values as of a time: joins by range without meeting all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.registry import REGISTRY, table

#: Places in a bin of the finest level, bins of one level in a bin of the next, and levels.
SPAN, FAN, LEVELS = 64, 16, 4


def _width(level: Column, span: int, fan: int) -> Column:
    return (F.lit(span) * F.pow(F.lit(fan), level)).cast("bigint")


def points_in(points: DataFrame, ranges: DataFrame, key: list[str], at: str, first: str, last: str, span: int = SPAN, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The columns of `points` and of `ranges` (the key once) for each point that lies in a range of its key, ends included.

    Both sides are dealt to bins. A range goes to the finest level on which it covers at most `fan` + 1 bins, and a point to its bin
    on every level, so a pair meets once, a key with many points or ranges is many join keys, and a long range is few rows; only
    on the coarsest level may a range cover more. Rows with a null, and ranges that end before they begin, meet nothing.
    """
    whole = F.col(last).cast("bigint") - F.col(first).cast("bigint")
    level = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        level = F.when(whole <= span * fan ** (k + 1), F.lit(k)).otherwise(level)
    bins = F.sequence(F.floor(F.col(first) / _width(F.col("level_"), span, fan)), F.floor(F.col(last) / _width(F.col("level_"), span, fan)))
    dealt = ranges.where(F.col(first) <= F.col(last)).withColumn("level_", level).withColumn("bin_", F.explode(bins))
    # Points go to the levels that some range has.
    used = sorted(r["level_"] for r in dealt.select("level_").distinct().collect())
    every = points.withColumn("level_", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"))).withColumn("bin_", F.floor(F.col(at) / _width(F.col("level_"), span, fan)))
    return every.join(dealt, [*key, "level_", "bin_"]).where(F.col(at).between(F.col(first), F.col(last))).drop("level_", "bin_")


def as_of(current: DataFrame, history: DataFrame, key: list[str], at: str, value: str, tie: str, bucket_s: int = 86400) -> DataFrame:
    """`current` with prior_<value> and prior_<at>: those of the last row of `history` with its key and an earlier time; null if none.

    Rows of history at one time come by `tie`, the largest last. Both sides are put in one order and the last value is carried
    on, so no row of a key meets another. A key is dealt over buckets of time: each is filled by itself, and what it starts with
    is the last row of the buckets before it, of which there is one row each; so a key with very many rows is many tasks' work.
    """
    names = [*key, at]
    old = history.select(*names, F.lit(1).alias("kind_"), F.col(tie).alias("tie_"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("held_"), F.lit(None).cast(current.schema.simpleString()).alias("row_"))
    new = current.select(*names, F.lit(0).alias("kind_"), F.lit(None).cast(history.schema[tie].dataType).alias("tie_"), F.lit(None).cast(old.schema["held_"].dataType).alias("held_"), F.struct(*current.columns).alias("row_"))
    both = old.unionByName(new).withColumn("bucket_", F.floor(F.unix_timestamp(at) / bucket_s))
    ends = both.groupBy(*key, "bucket_").agg(F.max_by("held_", F.when(F.col("kind_") == 1, F.struct(at, "tie_"))).alias("end_"))
    before = Window.partitionBy(*key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried_", F.last("end_", ignorenulls=True).over(before)).drop("end_")
    # A row of the same time isn't earlier: rows that ask come before those that answer.
    within = Window.partitionBy(*key, "bucket_").orderBy(at, "kind_", "tie_").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("last_", F.last("held_", ignorenulls=True).over(within)).where("kind_ = 0").select(*key, "bucket_", "last_", "row_")
    same = F.lit(True)
    there = carried.select(*[F.col(k).alias(f"{k}_k") for k in key], F.col("bucket_").alias("bucket_k"), "carried_")
    for k in key:
        same = same & filled[k].eqNullSafe(there[f"{k}_k"])
    joined = filled.join(there, same & filled["bucket_"].eqNullSafe(there["bucket_k"]), "left")
    held = F.coalesce("last_", "carried_")
    return joined.select("row_.*", held["v"].alias(f"prior_{value}"), held["at"].alias(f"prior_{at}"))


@REGISTRY.query(
    "prior_slices",
    """
    WITH e AS (SELECT event_id, user_id, event_type, ts, value FROM events),
    h AS (SELECT user_id, event_type, ts, arg_max(value, event_id) AS value FROM e WHERE event_id % 3 <> 0 GROUP BY ALL)
    SELECT c.event_id, c.user_id, c.event_type, c.ts, h.value AS prior_value, h.ts AS prior_ts
    FROM e c ASOF LEFT JOIN h ON c.user_id = h.user_id AND c.event_type = h.event_type AND c.ts > h.ts
    """,
)
def prior_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with the slice before it; two thirds of the runs left one."""
    e = table(spark, sf_dir, "events")
    history = e.where("event_id % 3 <> 0").select("user_id", "event_type", "ts", "value", "event_id")
    return as_of(e.select("event_id", "user_id", "event_type", "ts"), history, ["user_id", "event_type"], "ts", "value", "event_id", 3600)
