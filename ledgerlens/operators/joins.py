"""Joins: semi-join resolution, catalogue probes, scope lookup, tier shadowing, mutual references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import RECORD_STATES
from ledgerlens.registry import REGISTRY, table


def resolve(records: DataFrame, installed: DataFrame, on: list[str], group: str) -> DataFrame:
    """Per group: how many of its records are installed, as none, one or many.

    A left semi join keeps the record side's rows; groups without a match come from the aggregate over all records, so
    nothing is joined twice.
    """
    hits = records.join(installed.select(*on).distinct().withColumn("hit", F.lit(1)), on, "left")
    n = F.count("hit")
    return hits.groupBy(group).agg(n.alias("n")).withColumn(
        "outcome", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many")
    )


def catalogue_matches(names: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Exact-name matches with a catalogue (J2, J3). The planner broadcasts the catalogue if its size allows."""
    return names.join(catalogue, key)


def compose_layers(found: DataFrame, key: str) -> DataFrame:
    """First result other than unknown per layer by rank, composed to both, app, base_image or unknown.

    Results of a third layer are read but don't count, as in the reference's assembly.
    """
    known = F.col("kind") != "unknown"
    first = found.groupBy(key).agg(
        F.min(F.when(known & (F.col("layer") == "app"), F.struct("rank", "kind"))).alias("app"),
        F.min(F.when(known & (F.col("layer") == "base_image"), F.struct("rank", "kind"))).alias("base"),
    )
    app, base = F.col("app").isNotNull(), F.col("base").isNotNull()
    return first.select(
        key, F.when(app & base, "both").when(app, "app").when(base, "base_image").otherwise("unknown").alias("provenance"),
        F.col("app.kind").alias("app_kind"), F.col("base.kind").alias("base_kind"),
    )


def orphans(records: DataFrame, log: DataFrame, head: str, log_head: str) -> DataFrame:
    """Records whose chain head is empty or not in the log."""
    heads = log.select(F.col(log_head).alias(head)).where(F.col(head) != "")
    return records.join(heads, head, "left_anti")


def digest_mismatches(audit: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Audit rows whose cache side is missing or has another digest."""
    other = cache.select(key, F.col("digest").alias("cached"))
    return audit.join(other, key, "left").agg(F.count("*").alias("checked"), F.count_if(~F.col("digest").eqNullSafe(F.col("cached"))).alias("mismatched"))


def ranked_scopes(scopes: DataFrame, queries: DataFrame, dims: list[str]) -> DataFrame:
    """Matching scopes of each query: most specific, then highest precedence, then name (J8, T5, P12). An incoming `*` is a
    value like any other (D1).

    Scopes are equated on each dimension or on its wildcard: every query is exploded to its 2^d wildcard forms, so the
    theta join becomes an equi join.
    """
    q = queries
    for d in dims:
        q = q.withColumn(f"s_{d}", F.explode(F.array_distinct(F.array(F.col(d), F.lit("*")))))
    s = scopes.select("scope", "precedence", *[F.col(d).alias(f"s_{d}") for d in dims])
    specific = sum(((F.col(f"s_{d}") != "*").cast("int") for d in dims), F.lit(0))
    hit = q.join(s, [f"s_{d}" for d in dims]).withColumn("specificity", specific)
    order = Window.partitionBy(*queries.columns).orderBy(F.desc("specificity"), F.desc("precedence"), "scope")
    return hit.withColumn("rank", F.row_number().over(order)).select(*queries.columns, "scope", "specificity", "rank")


def first_tier(items: DataFrame, key: str, tier: str, path: str) -> DataFrame:
    """One winner a key, the first tier by order and path, and how many it shadows (J11). Two partial aggregates."""
    return items.groupBy(key).agg(F.min(F.struct(F.col(tier).alias("tier"), F.col(path).alias("path"))).alias("w"), (F.count("*") - 1).alias("shadowed")).select(
        key, F.col("w.tier").alias("tier"), F.col("w.path").alias("path"), "shadowed"
    )


def version_freshness(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Stale only where both versions are known and differ."""
    joined = expected.join(observed, key, "left")
    both = F.col("expected").isNotNull() & F.col("observed").isNotNull()
    return joined.withColumn("state", F.when(both & (F.col("expected") != F.col("observed")), "stale").otherwise("fresh"))


def supersession_issues(records: DataFrame) -> DataFrame:
    """(number, issue) for records (number, status, review_trigger, supersedes, superseded_by) (J14): two self-joins."""
    other = records.select(F.col("number").alias("t"), F.col("supersedes").alias("t_prior"), F.col("superseded_by").alias("t_next"), F.lit(True).alias("there"))
    own = records.select(
        "number",
        F.explode(F.array(
            F.when(~F.coalesce(F.col("status").isin(*RECORD_STATES), F.lit(False)), F.lit("invalid_status")),
            F.when((F.col("status") == "Provisional Accepted") & F.coalesce(F.col("review_trigger") == "", F.lit(True)), F.lit("missing_review_trigger")),
            F.when((F.col("status") == "Superseded") & F.col("superseded_by").isNull(), F.lit("missing_successor")),
        )).alias("issue"),
    )
    after = records.where("status = 'Superseded' and superseded_by is not null").join(other, F.col("superseded_by") == F.col("t"), "left").select(
        "number", F.when(F.col("there").isNull(), "successor_not_found").when(~F.col("t_prior").eqNullSafe(F.col("number")), "successor_without_back_link").alias("issue")
    )
    before = records.where("supersedes is not null").join(other, F.col("supersedes") == F.col("t"), "left").select(
        "number", F.when(F.col("there").isNull(), "prior_not_found").when(~F.col("t_next").eqNullSafe(F.col("number")), "prior_without_back_link").alias("issue")
    )
    return own.unionByName(after).unionByName(before).where("issue is not null")


@REGISTRY.query(
    "semi_join_resolution",
    """
    WITH h AS (SELECT l_orderkey, count(p_partkey) AS n
               FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 5) ON l_partkey = p_partkey GROUP BY 1)
    SELECT l_orderkey, n, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS outcome FROM h
    """,
)
def semi_join_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return resolve(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), small, ["l_partkey"], "l_orderkey")


@REGISTRY.query(
    "catalog_broadcast_join",
    """
    SELECT p_partkey, r AS catalogue_rank FROM part JOIN (VALUES ('Brand#11', 1), ('Brand#22', 2), ('Brand#33', 3)) c(b, r) ON p_brand = b
    """,
)
def catalog_broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.sql("SELECT * FROM VALUES ('Brand#11', 1), ('Brand#22', 2), ('Brand#33', 3) AS c(p_brand, catalogue_rank)")
    return catalogue_matches(table(spark, sf_dir, "part"), catalogue, "p_brand").select("p_partkey", "catalogue_rank")


@REGISTRY.query(
    "first_tier_wins",
    """
    SELECT p_type AS item, min(p_size) AS tier, min_by(p_partkey, (p_size, p_partkey)) AS path, count(*) - 1 AS shadowed
    FROM part GROUP BY p_type
    """,
)
def first_tier_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_tier(table(spark, sf_dir, "part").withColumnRenamed("p_type", "item"), "item", "p_size", "p_partkey")


_SCOPES = "('all', 0, '*', '*'), ('asia', 5, 'ASIA', '*'), ('china', 1, 'ASIA', 'CHINA'), ('eu', 5, 'EUROPE', '*'), ('zz', 5, 'EUROPE', '*'), ('fr', 9, '*', 'FRANCE')"


@REGISTRY.query(
    "wildcard_scope_rank",
    f"""
    WITH s(scope, precedence, r, n) AS (VALUES {_SCOPES}),
    q AS (SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey),
    m AS (SELECT *, (r <> '*')::INT + (n <> '*')::INT AS specificity FROM q JOIN s ON (r = '*' OR r = region) AND (n = '*' OR n = nation))
    SELECT region, nation, scope, specificity,
           row_number() OVER (PARTITION BY region, nation ORDER BY specificity DESC, precedence DESC, scope) AS rank FROM m
    """,
)
def wildcard_scope_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = spark.sql(f"SELECT * FROM VALUES {_SCOPES} AS s(scope, precedence, region, nation)")
    q = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ranked_scopes(scopes, q.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation")), ["region", "nation"])


@REGISTRY.query(
    "layer_provenance",
    """
    WITH f AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 'app' WHEN 'N' THEN 'base_image' ELSE 'runtime' END AS layer,
                      l_linenumber AS rank, CASE WHEN l_quantity < 10 THEN 'unknown' ELSE l_linestatus END AS kind FROM lineitem),
    a AS (SELECT k, min_by(kind, (rank, kind)) FILTER (layer = 'app' AND kind <> 'unknown') AS app_kind,
                 min_by(kind, (rank, kind)) FILTER (layer = 'base_image' AND kind <> 'unknown') AS base_kind FROM f GROUP BY k)
    SELECT k, CASE WHEN app_kind IS NOT NULL AND base_kind IS NOT NULL THEN 'both' WHEN app_kind IS NOT NULL THEN 'app'
                   WHEN base_kind IS NOT NULL THEN 'base_image' ELSE 'unknown' END AS provenance, app_kind, base_kind FROM a
    """,
)
def layer_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("l_returnflag") == "A", "app").when(F.col("l_returnflag") == "N", "base_image").otherwise("runtime")
    kind = F.when(F.col("l_quantity") < 10, "unknown").otherwise(F.col("l_linestatus"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), layer.alias("layer"), F.col("l_linenumber").alias("rank"), kind.alias("kind"))
    return compose_layers(found, "k")


@REGISTRY.query(
    "digest_mismatches",
    """
    SELECT count(*) AS checked, count(*) FILTER (o_orderstatus IS DISTINCT FROM s) AS mismatched
    FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON o_orderkey = l_orderkey
    """,
)
def digest_mismatch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("digest"))
    cache = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linestatus").alias("digest"))
    return digest_mismatches(audit, cache, "key")


@REGISTRY.query(
    "orphan_records",
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def orphan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("head"))
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("log_head"))
    return orphans(records, log, "head", "log_head").select("c_custkey")


@REGISTRY.query(
    "version_freshness",
    """
    SELECT s_suppkey, CASE WHEN c_nationkey IS NOT NULL AND s_nationkey <> c_nationkey THEN 'stale' ELSE 'fresh' END AS state
    FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey
    """,
)
def version_freshness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("expected"))
    observed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("observed"))
    return version_freshness(expected, observed, "s_suppkey").select("s_suppkey", "state")


_RECORDS = (
    "p_partkey AS number",
    "CASE p_partkey % 8 WHEN 0 THEN 'odd' WHEN 1 THEN 'Accepted' WHEN 3 THEN 'Provisional Accepted' WHEN 5 THEN 'Proposed' WHEN 7 THEN 'Deferred' ELSE 'Superseded' END AS status",
    "CASE WHEN p_partkey % 16 = 3 THEN 't' WHEN p_partkey % 32 = 11 THEN '' END AS review_trigger",
    "CASE WHEN p_partkey % 8 IN (3, 5) THEN p_partkey - 1 WHEN p_partkey % 8 = 7 THEN -p_partkey END AS supersedes",
    "CASE WHEN p_partkey % 8 IN (2, 4) THEN p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 7 = 0 THEN 100000000 ELSE 1 END END AS superseded_by",
)


@REGISTRY.query(
    "supersession_issues",
    f"""
    WITH r AS (SELECT {", ".join(_RECORDS)} FROM part)
    SELECT * FROM (
      SELECT a.number, CASE WHEN b.number IS NULL THEN 'successor_not_found' WHEN b.supersedes IS DISTINCT FROM a.number THEN 'successor_without_back_link' END AS issue
      FROM r a LEFT JOIN r b ON a.superseded_by = b.number WHERE a.status = 'Superseded' AND a.superseded_by IS NOT NULL
      UNION ALL SELECT a.number, CASE WHEN b.number IS NULL THEN 'prior_not_found' WHEN b.superseded_by IS DISTINCT FROM a.number THEN 'prior_without_back_link' END
      FROM r a LEFT JOIN r b ON a.supersedes = b.number WHERE a.supersedes IS NOT NULL
      UNION ALL SELECT number, 'missing_successor' FROM r WHERE status = 'Superseded' AND superseded_by IS NULL
      UNION ALL SELECT number, 'missing_review_trigger' FROM r WHERE status = 'Provisional Accepted' AND coalesce(review_trigger, '') = ''
      UNION ALL SELECT number, 'invalid_status' FROM r WHERE status NOT IN ('Proposed', 'Accepted', 'Provisional Accepted', 'Deferred', 'Superseded'))
    WHERE issue IS NOT NULL
    """,
)
def supersession_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supersession_issues(table(spark, sf_dir, "part").selectExpr(*_RECORDS))
