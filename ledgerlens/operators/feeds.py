"""Vulnerability feeds: three shapes to one record, typed rejects, idempotent ingest, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import ECOSYSTEMS
from ledgerlens.functions.scalars import aware_timestamp, full_match
from ledgerlens.operators.cascades import cascade
from ledgerlens.operators.ranking import vulnerability_order
from ledgerlens.registry import REGISTRY, table

OSV = (
    "id STRING, aliases ARRAY<STRING>, published STRING, database_specific STRUCT<severity: STRING>, affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>,"
    " ranges: ARRAY<STRUCT<events: ARRAY<STRUCT<introduced: STRING, fixed: STRING, last_affected: STRING>>>>>>"
)
NVD = (
    "cve STRUCT<id: STRING, published: STRING, metrics: STRUCT<cvssMetricV31: ARRAY<STRUCT<baseSeverity: STRING>>, cvssMetricV30: ARRAY<STRUCT<baseSeverity: STRING>>,"
    " cvssMetricV2: ARRAY<STRUCT<baseSeverity: STRING>>>>, affected STRUCT<ecosystem: STRING, package: STRING, ranges: ARRAY<STRUCT<introduced: STRING, fixed: STRING, last_affected: STRING>>>"
)
GHSA = "ghsa_id STRING, cve_id STRING, published_at STRING, severity STRING, package STRUCT<ecosystem: STRING, name: STRING>, introduced STRING, fixed_version STRING, last_affected STRING"
MAX_BYTES = 256 * 1024
KEY = ["cve_id", "ecosystem", "package", "introduced", "fixed", "last_affected"]
_CVE, _GHSA = r"CVE-\d{4}-\d{4,7}", r"GHSA(?:-[0-9a-z]{4}){3}"


def _severity(label: Column) -> Column:
    """Mapped level, null if unmapped; MODERATE is medium."""
    up = F.upper(label)
    return F.when(up.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.lower(up)).when(up == "MODERATE", "medium")


def collapsed_events(events: Column) -> Column:
    """First introduced, fixed and last_affected.

    Each event gives one key: the first of the three, in this order, that it has and that no earlier event gave.
    """
    start = F.struct(F.lit(None).cast("string").alias("i"), F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("l"))

    def step(s: Column, e: Column) -> Column:
        take_i = e["introduced"].isNotNull() & s["i"].isNull()
        take_f = ~take_i & e["fixed"].isNotNull() & s["f"].isNull()
        take_l = ~take_i & ~take_f & e["last_affected"].isNotNull() & s["l"].isNull()
        return F.struct(
            F.when(take_i, e["introduced"]).otherwise(s["i"]).alias("i"), F.when(take_f, e["fixed"]).otherwise(s["f"]).alias("f"),
            F.when(take_l, e["last_affected"]).otherwise(s["l"]).alias("l"),
        )

    return F.aggregate(F.coalesce(events, F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>")), start, step)


def _record(**c: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in c.items()])


def osv_record(payload: Column) -> Column:
    """First alias that is a CVE, else the id; first affected package and range."""
    j = F.from_json(payload, OSV)
    first = F.get(j["affected"], F.lit(0))
    e = collapsed_events(F.get(first["ranges"], F.lit(0))["events"])
    ident = F.coalesce(F.get(F.filter(j["aliases"], lambda a: a.startswith("CVE-")), F.lit(0)), j["id"])
    return _record(
        cve_id=ident, ecosystem=F.lower(first["package"]["ecosystem"]), package=first["package"]["name"], introduced=F.coalesce(e["i"], F.lit("0.0.0")),
        fixed=e["f"], last_affected=e["l"], severity=_severity(j["database_specific"]["severity"]), published=j["published"],
    )


def nvd_record(payload: Column) -> Column:
    """Severity of the first CVSS version that has one; an unmapped first one doesn't fall through."""
    j = F.from_json(payload, NVD)
    m, r = j["cve"]["metrics"], F.get(j["affected"]["ranges"], F.lit(0))
    label = F.coalesce(*[F.get(m[v], F.lit(0))["baseSeverity"] for v in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    return _record(
        cve_id=j["cve"]["id"], ecosystem=F.lower(j["affected"]["ecosystem"]), package=j["affected"]["package"], introduced=F.coalesce(r["introduced"], F.lit("0.0.0")),
        fixed=r["fixed"], last_affected=r["last_affected"], severity=_severity(label), published=j["cve"]["published"],
    )


def ghsa_record(payload: Column) -> Column:
    """CVE id else GHSA id (P5)."""
    j = F.from_json(payload, GHSA)
    return _record(
        cve_id=F.coalesce(j["cve_id"], j["ghsa_id"]), ecosystem=F.lower(j["package"]["ecosystem"]), package=j["package"]["name"], introduced=F.coalesce(j["introduced"], F.lit("0.0.0")),
        fixed=j["fixed_version"], last_affected=j["last_affected"], severity=_severity(j["severity"]), published=j["published_at"],
    )


SHAPES = {"osv": osv_record, "nvd": nvd_record, "ghsa": ghsa_record}


def normalised(raw: DataFrame) -> DataFrame:
    """Rows (source, payload, ...) with the record's fields, published_at and reject_reason, the first failing check."""
    picked = F.coalesce(*[F.when(F.col("source") == name, shape(F.col("payload"))) for name, shape in SHAPES.items()])
    df = raw.withColumn("r", picked).select(*raw.columns, "r.*")
    good_id = full_match(F.col("cve_id"), _CVE, 20) | full_match(F.col("cve_id"), _GHSA, 19)
    at = aware_timestamp(F.col("published"))
    reason = cascade(
        (F.octet_length("payload") > MAX_BYTES, "payload_too_large"), (F.try_parse_json("payload").isNull(), "malformed_json"), (F.col("cve_id").isNull(), "missing_id"),
        (~good_id, "bad_cve_id"), (F.coalesce(~F.col("ecosystem").isin(*ECOSYSTEMS), F.lit(True)), "unsupported_ecosystem"), (F.col("package").isNull(), "missing_package"),
        (F.col("severity").isNull(), "bad_severity"), (at.isNull(), "missing_tz"),
    )
    return df.withColumn("published_at", at).withColumn("reject_reason", reason).drop("published")


def ingested(records: DataFrame, target: DataFrame | None, order: str) -> DataFrame:
    """Rows with `state`: inserted, skipped or error (K3, D6): of each key the first row is inserted, unless the target
    has it; severity or source don't make a key."""
    # Each rejected row is a partition of its own: rejects may have no key at all, and none of them counts.
    nth = F.row_number().over(Window.partitionBy(*KEY, F.when(F.col("reject_reason").isNotNull(), F.col(order))).orderBy(order))
    df = records.withColumn("nth", nth)
    if target is not None:
        t = target.select(*[F.col(k).alias(f"t_{k}") for k in KEY]).distinct().withColumn("there", F.lit(True))
        same = F.lit(True)
        for k in KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"t_{k}"))
        df = df.join(t, same, "left").drop(*[f"t_{k}" for k in KEY])
    else:
        df = df.withColumn("there", F.lit(None).cast("boolean"))
    state = F.when(F.col("reject_reason").isNotNull(), "error").when((F.col("nth") == 1) & F.col("there").isNull(), "inserted").otherwise("skipped")
    return df.withColumn("state", state).drop("nth", "there")


def meta_upserted(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value table with the changes put in (K4): a rewrite, since Parquet has no update."""
    tagged = meta.withColumn("v", F.lit(0)).unionByName(changes.withColumn("v", F.lit(1)))
    return tagged.groupBy("key").agg(F.max_by("value", "v").alias("value"))


def lookup(records: DataFrame, package: str, ecosystem: str) -> DataFrame:
    """Records of a package, ordered."""
    return vulnerability_order(records.where((F.col("package") == package) & (F.col("ecosystem") == ecosystem)))


def find_by_cve(records: DataFrame, cve: str) -> DataFrame:
    return vulnerability_order(records.where(F.col("cve_id") == cve))


def affecting_range(records: DataFrame, cve: str) -> DataFrame:
    """First range by package, ecosystem and introduced as text; no row if there is none."""
    rows = records.where(F.col("cve_id") == cve).orderBy("package", "ecosystem", "introduced").limit(1)
    return rows.select("introduced", "fixed", "last_affected")


_FEED = [
    ("osv", 1, '{"id":"OSV-1","aliases":["GHSA-x","CVE-2024-0001"],"published":"2024-01-01T00:00:00Z","database_specific":{"severity":"MODERATE"},"affected":[{"package":{"ecosystem":"npm","name":"left-pad"},"ranges":[{"events":[{"introduced":"1.0.0"},{"fixed":"1.2.0"}]}]}]}'),
    ("osv", 2, '{"id":"CVE-2024-0002","published":"2024-01-02T00:00:00","database_specific":{"severity":"HIGH"},"affected":[{"package":{"ecosystem":"npm","name":"a"},"ranges":[]}]}'),
    ("nvd", 3, '{"cve":{"id":"CVE-2024-0003","published":"2024-02-01T00:00:00Z","metrics":{"cvssMetricV30":[{"baseSeverity":"HIGH"}]}},"affected":{"ecosystem":"pypi","package":"flask","ranges":[{"introduced":"1.0"}]}}'),
    ("ghsa", 4, '{"ghsa_id":"GHSA-aaaa-bbbb-cccc","published_at":"2024-03-01T00:00:00+02:00","severity":"LOW","package":{"ecosystem":"maven","name":"x:y"},"introduced":"2"}'),
    ("ghsa", 5, '{"ghsa_id":"GHSA-aaaa-bbbb-cccc","cve_id":"bad","published_at":"2024-03-01T00:00:00Z","severity":"LOW","package":{"ecosystem":"maven","name":"x:y"}}'),
    ("nvd", 6, '{"cve":{"id":"CVE-2024-0003","published":"2024-02-01T00:00:00Z","metrics":{"cvssMetricV31":[{"baseSeverity":"LOW"}]}},"affected":{"ecosystem":"pypi","package":"flask","ranges":[{"introduced":"1.0"}]}}'),
    ("osv", 7, "{not json"),
    ("ghsa", 8, '{"cve_id":"CVE-2024-0008","published_at":"2024-03-01T00:00:00Z","severity":"LOW","package":{"ecosystem":"cargo","name":"x"}}'),
]


# Feed rows made of parts: two parts share a key, and some rows fail one check or another.
_FROM_PARTS = {
    "seq": "p_partkey + 8",
    "id": "CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'bad' ELSE 'CVE-2023-' || lpad(CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)), 7, '0') END",
    "ecosystem": "CASE CAST(floor(p_partkey / 2) AS BIGINT) % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'Maven' WHEN 3 THEN 'npm' ELSE 'cargo' END",
    "name": "CASE WHEN p_partkey % 23 <> 0 THEN 'p' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) % 100 AS VARCHAR(20)) END",
    "severity": "CASE p_size % 6 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'critical' WHEN 4 THEN 'Medium' ELSE 'none' END",
    "introduced": "CASE WHEN p_partkey % 4 < 2 THEN '1.' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) % 10 AS VARCHAR(20)) END",
    "at": "CASE WHEN p_partkey % 11 = 0 THEN '2024-01-02T00:00:00' ELSE '2024-01-02T00:00:00Z' END",
    "source": "CASE p_partkey % 3 WHEN 0 THEN 'osv' WHEN 1 THEN 'nvd' ELSE 'ghsa' END",
    "broken": "p_partkey % 13 = 0",
}


def _part_feed(parts: DataFrame) -> DataFrame:
    """(source, seq, payload): each part as a record of one of the three shapes, or as text that isn't JSON."""
    rows = parts.select(*[F.expr(e).alias(n) for n, e in _FROM_PARTS.items()])
    package = F.struct("ecosystem", "name")
    osv = F.struct(
        "id", F.col("at").alias("published"), F.struct("severity").alias("database_specific"),
        F.array(F.struct(package.alias("package"), F.array(F.struct(F.array(F.struct("introduced")).alias("events"))).alias("ranges"))).alias("affected"),
    )
    nvd = F.struct(
        F.struct("id", F.col("at").alias("published"), F.struct(F.array(F.struct(F.col("severity").alias("baseSeverity"))).alias("cvssMetricV31")).alias("metrics")).alias("cve"),
        F.struct("ecosystem", F.col("name").alias("package"), F.array(F.struct("introduced")).alias("ranges")).alias("affected"),
    )
    ghsa = F.struct(F.col("id").alias("cve_id"), F.col("at").alias("published_at"), "severity", package.alias("package"), "introduced")
    shaped = F.when(F.col("source") == "osv", F.to_json(osv)).when(F.col("source") == "nvd", F.to_json(nvd)).otherwise(F.to_json(ghsa))
    return rows.select("source", F.col("seq").cast("bigint").alias("seq"), F.when(F.col("broken"), "{not json").otherwise(shaped).alias("payload"))


@REGISTRY.query(
    "feed_union_ingest",
    f"""
    WITH p AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _FROM_PARTS.items())} FROM part),
    r AS (SELECT source, seq, CASE WHEN NOT broken THEN id END AS cve_id, CASE WHEN NOT broken THEN lower(ecosystem) END AS ecosystem, CASE WHEN NOT broken THEN name END AS name,
                 CASE WHEN NOT broken AND severity <> 'none' THEN replace(lower(severity), 'moderate', 'medium') END AS severity,
                 CASE WHEN broken THEN '0.0.0' ELSE coalesce(introduced, '0.0.0') END AS introduced,
                 CASE WHEN broken THEN 'malformed_json' WHEN id IS NULL THEN 'missing_id' WHEN id = 'bad' THEN 'bad_cve_id' WHEN ecosystem = 'cargo' THEN 'unsupported_ecosystem'
                      WHEN name IS NULL THEN 'missing_package' WHEN severity = 'none' THEN 'bad_severity' WHEN right(p.at, 1) <> 'Z' THEN 'missing_tz' END AS reject_reason FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY cve_id, ecosystem, name, introduced, reject_reason IS NULL ORDER BY seq) AS nth FROM r)
    SELECT source, seq, cve_id, severity, introduced, reject_reason, CASE WHEN reject_reason IS NOT NULL THEN 'error' WHEN nth = 1 THEN 'inserted' ELSE 'skipped' END AS state FROM n
    UNION ALL SELECT * FROM (VALUES ('osv', 1, 'CVE-2024-0001', 'medium', '1.0.0', NULL, 'inserted'), ('osv', 2, 'CVE-2024-0002', 'high', '0.0.0', 'missing_tz', 'error'),
      ('nvd', 3, 'CVE-2024-0003', 'high', '1.0', NULL, 'inserted'), ('ghsa', 4, 'GHSA-aaaa-bbbb-cccc', 'low', '2', NULL, 'inserted'),
      ('ghsa', 5, 'bad', 'low', '0.0.0', 'bad_cve_id', 'error'), ('nvd', 6, 'CVE-2024-0003', 'low', '1.0', NULL, 'skipped'),
      ('osv', 7, NULL, NULL, '0.0.0', 'malformed_json', 'error'), ('ghsa', 8, 'CVE-2024-0008', 'low', '0.0.0', 'unsupported_ecosystem', 'error'))
      t(source, seq, cve_id, severity, introduced, reject_reason, state)
    """,
)
def feed_union_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame(_FEED, "source string, seq bigint, payload string").unionByName(_part_feed(table(spark, sf_dir, "part")))
    return ingested(normalised(raw), None, "seq").select("source", "seq", "cve_id", "severity", "introduced", "reject_reason", "state")


@REGISTRY.query(
    "ingest_stats",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth FROM documents)
    SELECT count(*) FILTER (nth = 1 AND n_chars >= 50) AS inserted, count(*) FILTER (nth > 1 AND n_chars >= 50) AS skipped,
           least(count(*) FILTER (n_chars < 50), 5) AS errors_kept, greatest(count(*) FILTER (n_chars < 50) - 5, 0) AS errors_truncated FROM r
    """,
)
def ingest_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.operators.aggregates import ingest_stats

    keyed = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("h"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    state = F.when(F.col("n_chars") < 50, "error").when(nth == 1, "inserted").otherwise("skipped")
    return ingest_stats(keyed.withColumn("state", state), "state", 5)


@REGISTRY.query(
    "meta_upsert",
    "SELECT key, value FROM (SELECT p_brand AS key, max(p_partkey) AS value FROM part WHERE p_size > 40 GROUP BY 1 UNION ALL SELECT p_brand, min(p_partkey) FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 40) GROUP BY 1)",
)
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.groupBy(F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("value"))
    new = part.where("p_size > 40").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_partkey").alias("value"))
    return meta_upserted(old, new)
