"""Composed plans: gather, vulnerability refresh and resolution, retrieval, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import feeds, joins, ledger, ranking
from ledgerlens.operators.cascades import freshness_confidence, index_freshness
from ledgerlens.operators.text_safety import nested_redacted
from ledgerlens.registry import REGISTRY, table
from ledgerlens.sources.sinks import envelope


def gather(slices: DataFrame) -> DataFrame:
    """Envelope of each repository from its probes' slices, secrets in their values redacted before anything is joined (3.1)."""
    return envelope(nested_redacted(slices, "slice"))


def refresh(raw: DataFrame, target: DataFrame | None, order: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inserted, rejects, feed digests) of raw feed rows (3.2, A15)."""
    state = feeds.ingested(feeds.normalised(raw), target, order)
    inserted = state.where("state = 'inserted'")
    digests = ledger.ordered_digest(raw, ["source"], ["payload"], F.col("payload"))
    return inserted, state.where("state = 'error'"), digests


def resolved(records: DataFrame, installed: DataFrame) -> DataFrame:
    """Per CVE: none, one or many installed packages."""
    return joins.resolve(records.select("cve_id", "ecosystem", "package"), installed, ["ecosystem", "package"], "cve_id")


def replayed(events: DataFrame, stored: DataFrame, key: str, order: str, payload) -> DataFrame:
    """Verdict and latest heads of each workflow (3.5)."""
    return ledger.first_divergence(ledger.chain_heads(events, key, order, payload), stored, key, order)


def index_report(slices: DataFrame, head: str) -> DataFrame:
    """Freshness and confidence of every registered index; a missing slice is an absent one."""
    state = index_freshness(
        F.col("present"), F.col("last_indexed_commit"), F.col("files_indexed"), F.col("files_in_repo"), F.col("indexer_errors"), F.col("last_indexed_at"), F.lit(head)
    )
    f = slices.withColumn("f", state)
    return f.select("name", "f.*", freshness_confidence(F.col("f.kind"), F.col("f.reason"), F.col("files_indexed"), F.col("files_in_repo")).alias("confidence"))


def dispatch_all(registry: DataFrame, slices: DataFrame, head: str) -> DataFrame:
    """(name, kind, reason, detail, confidence) of every registered index, in the order of registration.

    registry: (pos, name). An index without a slice is an absent one, and a slice that isn't what it should be is a stale
    one: nothing that one index holds stops another. `slices` has (name, slice as JSON).
    """
    v = F.try_parse_json("slice")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    there = registry.join(slices, "name", "left").select(
        "pos", "name", F.col("slice").isNotNull().alias("present"), at("$.last_indexed_commit", "string").alias("last_indexed_commit"), at("$.files_indexed", "bigint").alias("files_indexed"),
        at("$.files_in_repo", "bigint").alias("files_in_repo"), at("$.indexer_errors", "bigint").alias("indexer_errors"), at("$.last_indexed_at", "string").alias("last_indexed_at"),
    )
    return index_report(there, head).join(registry, "name").orderBy("pos").drop("pos")


@REGISTRY.query(
    "index_dispatch",
    """
    SELECT 'index-' || p_partkey AS name, CASE WHEN p_partkey % 7 = 6 THEN 'fresh' ELSE 'stale' END AS kind,
           ['indexer_error', 'indexer_error', 'commits_behind', 'coverage_gap', 'indexer_error', 'indexer_error', NULL][p_partkey % 7 + 1] AS reason,
           ['upstream_scip_unavailable', 'scip_slice_malformed', 'old' || p_size, '9/10', 'indexer_reported_2_errors', 'scip_slice_malformed', '2024-01-01T00:00:00Z'][p_partkey % 7 + 1] AS detail,
           ['low', 'low', 'medium', 'medium', 'low', 'low', 'high'][p_partkey % 7 + 1] AS confidence FROM part
    """,
)
def index_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No slice, a cut one, one of an older commit, a gap, errors, a time that isn't one, a good one."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("index-"), F.col("p_partkey").cast("string"))
    fields = """'"files_in_repo":10,"last_indexed_commit":"', CASE WHEN p_partkey % 7 = 2 THEN concat('old', p_size) ELSE 'head' END, '","files_indexed":', CASE WHEN p_partkey % 7 = 3 THEN 9 ELSE 10 END, ',"indexer_errors":',
      CASE WHEN p_partkey % 7 = 4 THEN 2 ELSE 0 END, ',"last_indexed_at":"', CASE WHEN p_partkey % 7 = 5 THEN 'yesterday' ELSE '2024-01-01T00:00:00Z' END, '"'"""
    text = F.expr(f"CASE WHEN p_partkey % 7 = 1 THEN '{{cut' ELSE concat('{{', {fields}, '}}') END")
    slices = part.where("p_partkey % 7 <> 0").select(name.alias("name"), text.alias("slice"))
    return dispatch_all(part.select(F.col("p_partkey").alias("pos"), name.alias("name")), slices, "head")


@REGISTRY.query(
    "customer_findings_report",
    """
    WITH f AS (SELECT c_mktsegment, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderpriority, o_orderkey) AS rank
               FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
    SELECT c_mktsegment, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rank) AS first_findings FROM f WHERE rank <= 5 GROUP BY 1
    """,
)
def customer_findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    top = ranking.top_k_per_group(rows.select("c_mktsegment", "o_orderpriority", "o_orderkey"), ["c_mktsegment"], 5, F.asc("o_orderpriority"), F.asc("o_orderkey"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return top.groupBy("c_mktsegment").agg(F.array_join(ordered, ",").alias("first_findings"))
