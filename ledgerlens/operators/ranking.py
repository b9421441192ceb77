"""Ranking, top-k, latest-per-key and first-seen order. Every pick is by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import PROVENANCE_ECOSYSTEMS, PROVENANCE_LAYERS
from ledgerlens.registry import REGISTRY, table

#: Severities from most to least severe (fixed values): the index has four, findings have five.
INDEX_SEVERITIES = ("critical", "high", "medium", "low")
FINDING_SEVERITIES = ("critical", "high", "medium", "low", "negligible")


def severity_rank(label: Column, levels: tuple[str, ...]) -> Column:
    named = F.lower(F.trim(label))
    rank = F.when(named == levels[0], 0)
    for i, level in enumerate(levels[1:], 1):
        rank = rank.when(named == level, i)
    return rank.otherwise(len(levels) - 1)


def normal_severity(label: Column) -> Column:
    """Trimmed and lower-cased; what isn't a level is negligible."""
    named = F.lower(F.trim(label))
    return F.when(named.isin(*FINDING_SEVERITIES), named).otherwise("negligible")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order (T2): a partial top-k in each task, so only k rows a task are sent."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows a group and task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def adapter_order(adapters: DataFrame) -> DataFrame:
    """Adapters (layer, ecosystem, ..) with `rank` from 0: layers in their order, within one ecosystems in theirs (T7). Adapters of an
    unknown layer or ecosystem have no rank."""
    layer = F.array_position(F.array(*map(F.lit, PROVENANCE_LAYERS)), F.col("layer"))
    ecosystem = F.array_position(F.array(*map(F.lit, PROVENANCE_ECOSYSTEMS)), F.col("ecosystem"))
    return adapters.withColumn("rank", F.when((layer > 0) & (ecosystem > 0), (layer - 1) * len(PROVENANCE_ECOSYSTEMS) + ecosystem - 1).cast("int"))


def latest_per_key(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The last row of each key as a partial aggregate; a hot key costs one row a task."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("last")).select(key, "last.*")


def best_candidate(df: DataFrame, group: str, score: str, ident: str) -> DataFrame:
    """Highest score of each group, ties to the smallest id."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(ident).alias("i"))).alias("b")
    return df.groupBy(group).agg(best).select(group, F.col("b.i").alias(ident), (-F.col("b.s")).alias(score))


def first_applicable(recipes: DataFrame, case: str) -> DataFrame:
    """First applicable recipe by precedence and name, and those that declined before it."""
    order = F.struct((-F.col("precedence")).alias("p"), F.col("name").alias("n"))
    picked = recipes.withColumn("o", order).groupBy(case).agg(
        F.min(F.when(F.col("applies"), F.col("o"))).alias("win"), F.collect_list(F.when(~F.col("applies"), F.col("o"))).alias("declined")
    )
    before = F.filter("declined", lambda d: F.col("win").isNull() | (d < F.col("win")))
    return picked.select(case, F.col("win.n").alias("winner"), F.transform(F.array_sort(before), lambda d: d["n"]).alias("declined"))


def dispatch_order(df: DataFrame, group: list[str]) -> DataFrame:
    """Those that run last after the others, heavy before light, then by registration, in each group."""
    heavy = F.when(F.col("heaviness") == "heavy", 0).when(F.col("heaviness") == "medium", 1).otherwise(2)
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("runs_last", heavy, "idx")))


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the place at which each was first seen."""
    return df.groupBy(key).agg(F.min(pos).alias("first_pos"))


def vulnerability_order(df: DataFrame) -> DataFrame:
    """Severity, newest first, id; then package, ecosystem and introduced to break ties."""
    return df.orderBy(severity_rank(F.col("severity"), INDEX_SEVERITIES), F.desc("published_at"), "cve_id", "package", "ecosystem", "introduced")


def by_precedence(df: DataFrame, group: str, name: str, rank: Column) -> DataFrame:
    """First hit by precedence, all hits in that order, and whether there was more than one."""
    pairs = F.array_sort(F.collect_set(F.struct(rank.alias("r"), F.col(name).alias("n"))))
    found = df.groupBy(group).agg(pairs.alias("p"))
    return found.select(group, F.col("p")[0]["n"].alias("primary"), F.transform("p", lambda x: x["n"]).alias("all"), (F.size("p") > 1).alias("ambiguous"))


@REGISTRY.query(
    "top20_ranked",
    """
    SELECT o_orderkey, c_name, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20
    """,
)
def top20_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select("o_orderkey", "c_name", "o_orderpriority", "o_totalprice")
    return top_k(rows, 20, F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey"))


@REGISTRY.query(
    "top20_per_group",
    """
    SELECT o_orderpriority, o_orderkey, o_totalprice,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders QUALIFY rank <= 20
    """,
)
def top20_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_k_per_group(rows, ["o_orderpriority"], 20, F.desc("o_totalprice"), F.asc("o_orderkey"))


@REGISTRY.query(
    "latest_per_key",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_per_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(table(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id"), ["event_id", "event_type", "value"])


@REGISTRY.query(
    "best_candidate",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) = 1",
)
def best_candidate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_candidate(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_partkey")


@REGISTRY.query(
    "first_applicable_recipe",
    """
    WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS name, floor(o_totalprice)::BIGINT % 7 AS precedence, o_orderstatus = 'F' AS applies FROM orders),
    w AS (SELECT case_id, min_by(name, (-precedence, name)) FILTER (applies) AS winner, min((-precedence, name)) FILTER (applies) AS o FROM r GROUP BY 1)
    SELECT w.case_id, winner, coalesce(list(r.name ORDER BY -precedence, name) FILTER (NOT applies AND (o IS NULL OR (-precedence, name) < o)), []) AS declined
    FROM w JOIN r USING (case_id) GROUP BY ALL
    """,
)
def first_applicable_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("name"),
        (F.floor("o_totalprice") % 7).alias("precedence"), (F.col("o_orderstatus") == "F").alias("applies"),
    )
    return first_applicable(recipes, "case_id")


@REGISTRY.query("first_seen_order", "SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY event_type")
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@REGISTRY.query(
    "precedence_selection",
    """
    WITH p AS (SELECT DISTINCT user_id, event_type AS n, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS r FROM events)
    SELECT user_id, (list(n ORDER BY r, n))[1] AS "primary", list(n ORDER BY r, n) AS "all", count(*) > 1 AS ambiguous FROM p GROUP BY user_id
    """,
)
def precedence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return by_precedence(table(spark, sf_dir, "events"), "user_id", "event_type", rank)


_PROBE = ("o_custkey AS run", "o_orderkey AS idx", "o_orderstatus = 'F' AS runs_last", "CASE o_orderkey % 3 WHEN 0 THEN 'heavy' WHEN 1 THEN 'medium' ELSE 'light' END AS heaviness")


@REGISTRY.query(
    "dispatch_order",
    f"""
    WITH p AS (SELECT {", ".join(_PROBE)} FROM orders)
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY runs_last, CASE heaviness WHEN 'heavy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, idx) AS position FROM p
    """,
)
def dispatch_order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch_order(table(spark, sf_dir, "orders").selectExpr(*_PROBE), ["run"])
