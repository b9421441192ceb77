"""Counts with fixed buckets and other grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import OS_PACKAGE_TYPES
from ledgerlens.registry import REGISTRY, table

#: Order priorities from most to least urgent.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def zero_filled_counts(df: DataFrame, key: Column, buckets: tuple[str, ...], other: str) -> DataFrame:
    """Rows per bucket, zero where a bucket is empty; keys outside the buckets count as `other`.

    One pass with one partial aggregate a bucket, so nothing is joined and the shuffle holds one row a task.
    """
    named = F.when(key.isin(*buckets), key).otherwise(F.lit(other))
    counts = df.agg(*[F.count_if(named == b).alias(b) for b in buckets])
    pairs = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"`{b}`").alias("n")) for b in buckets])
    return counts.select(F.inline(pairs))


@REGISTRY.query(
    "priority_counts_zero_filled",
    """
    WITH b(bucket) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')),
    o AS (SELECT CASE WHEN o_orderpriority IN (SELECT bucket FROM b) THEN o_orderpriority ELSE '5-LOW' END AS bucket
          FROM orders)
    SELECT b.bucket, count(o.bucket) AS n FROM b LEFT JOIN o ON o.bucket = b.bucket GROUP BY b.bucket
    """,
)
def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_filled_counts(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), PRIORITIES, PRIORITIES[-1])


def counts_by(df: DataFrame, key: Column, missing: str = "unknown") -> DataFrame:
    """Rows per key with null and '' as `missing`; keys without rows don't appear (A2)."""
    return df.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit(missing)).alias("key")).agg(F.count("*").alias("n"))


def argmax_label(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """The most frequent label of each group, ties to the first by name (A5).

    Counting first leaves one row a group and label, so the second aggregate is small whatever the skew.
    """
    counts = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    best = F.min(F.struct(-F.col("n"), F.col(label))).alias("best")
    return counts.groupBy(*group).agg(best).select(*group, F.col(f"best.{label}").alias("primary"), (-F.col("best.col1")).alias("n"))


def native_package_count(df: DataFrame) -> Column:
    """npm packages whose metadata type is native or with a location that ends in .node (A3)."""
    return F.count_if(
        (F.col("type") == "npm") & (F.coalesce(F.col("native"), F.lit(False)) | F.exists("locations", lambda p: p.endswith(".node")))
    )


def os_package_rollup(df: DataFrame) -> DataFrame:
    """Four fixed counts (A4): every operating system package counts as needed at run time."""
    zero = F.lit(0).cast("bigint")
    return df.agg(F.count_if(F.col("type").isin(*OS_PACKAGE_TYPES)).alias("runtime_required")).select(
        "runtime_required", zero.alias("build_only"), zero.alias("convenience"), zero.alias("unknown")
    )


#: Confidence labels from low to high (fixed values).
CONFIDENCE = ("low", "medium", "high")


def confidence_rank(label: Column) -> Column:
    return F.when(label == "low", 0).when(label == "medium", 1).when(label == "high", 2)


def confidence_label(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), (rank + 1).cast("int"))


def least_confidence(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """The lowest confidence of a group; null where there is none."""
    return df.groupBy(*group).agg(F.min(confidence_rank(F.col(label))).alias("r")).select(*group, confidence_label(F.col("r")).alias("confidence"))


def load_confidence(errors: Column, items: Column) -> Column:
    """No error: high; some items in spite of errors: medium; else low (A10)."""
    return F.when(errors == 0, "high").when(items > 0, "medium").otherwise("low")


def parse_confidence(refused: Column, parsed: Column, failed: Column) -> Column:
    """Refused or nothing parsed: low; no failure: high; as many parsed as failed: medium; else low."""
    return F.when(refused | (parsed == 0), "low").when(failed == 0, "high").when(parsed >= failed, "medium").otherwise("low")


def trace_confidence(scenarios: Column, all_of: int = 5) -> Column:
    """Coverage of runtime scenarios: all, the smoke test, the start alone, or none."""
    return (
        F.when(F.size(scenarios) >= all_of, "high").when(F.array_contains(scenarios, "smoke_test"), "medium")
        .when(F.array_contains(scenarios, "startup"), "low").otherwise("unavailable")
    )


def coverage_band(covered: Column, total: Column) -> Column:
    """At least nine tenths covered: medium; less, or nothing to cover: low."""
    return F.when((total > 0) & (F.try_divide(covered, total) >= 0.90), "medium").otherwise("low")


def strict_and(df: DataFrame, group: str, pos: str, kind: str, passed: Column, degrading: str | None = None) -> DataFrame:
    """All signals passed, the failing kinds in input order with repeats, and whether a degrading kind occurs."""
    failing = F.array_sort(F.collect_list(F.when(~passed, F.struct(F.col(pos).alias("p"), F.col(kind).alias("k")))))
    return df.groupBy(group).agg(
        F.bool_and(passed).alias("passed"),
        F.transform(failing, lambda x: x["k"]).alias("failing"),
        F.bool_or(F.col(kind) == degrading if degrading else F.lit(False)).alias("degraded"),
    )


def set_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count and sorted distinct values of each group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(value)).alias("vals"))


def shannon_entropy(text: Column) -> Column:
    """Bits per code point of one string; 0 for the empty one (A23). One pass over the distinct characters of the row."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.char_length(text)

    def share(c: Column) -> Column:
        p = (n - F.char_length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.coalesce(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + share(c)), F.lit(0.0))


def ingest_stats(df: DataFrame, state: str, cap: int = 100) -> DataFrame:
    """Inserted, skipped and failed rows; errors beyond `cap` are only counted."""
    errors = F.count_if(F.col(state) == "error")
    return df.agg(
        F.count_if(F.col(state) == "inserted").alias("inserted"), F.count_if(F.col(state) == "skipped").alias("skipped"),
        F.least(errors, F.lit(cap)).alias("errors_kept"), F.greatest(errors - cap, F.lit(0)).alias("errors_truncated"),
    )


def gc_rollup(entries: DataFrame, now: int, ttl_s: int) -> DataFrame:
    """Entries older than the time to live, strictly, and their bytes."""
    old = F.lit(now) - F.col("created_at") > ttl_s
    return entries.agg(F.count_if(old).alias("evicted"), F.coalesce(F.sum(F.when(old, F.col("size"))), F.lit(0)).alias("bytes"))


def budget_totals(ledger: DataFrame, max_tokens: int) -> DataFrame:
    """Per workflow: consumed and outstanding tokens and dollars, and what is left (A22). Money is decimal throughout."""
    open_ = F.col("op") == "precharge"
    settled = F.col("op") == "reconcile"
    per_token = ledger.groupBy("workflow_id", "token_id").agg(
        F.max(F.when(open_, F.col("tokens"))).alias("held"), F.max(F.when(settled, F.col("tokens"))).alias("used"),
        F.max(F.when(settled, F.col("dollars"))).alias("spent"),
    )
    consumed = F.coalesce(F.sum("used"), F.lit(0))
    outstanding = F.coalesce(F.sum(F.when(F.col("used").isNull(), F.col("held"))), F.lit(0))
    return per_token.groupBy("workflow_id").agg(
        consumed.alias("consumed"), outstanding.alias("outstanding"), (F.lit(max_tokens) - consumed - outstanding).alias("remaining"),
        F.coalesce(F.sum("spent"), F.lit(0).cast("decimal(38,18)")).alias("dollars"),
    )


@REGISTRY.query("counts_by_source", "SELECT coalesce(nullif(source, ''), 'unknown') AS key, count(*) AS n FROM documents GROUP BY 1")
def counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by(table(spark, sf_dir, "documents"), F.col("source"))


@REGISTRY.query(
    "argmax_language",
    """
    WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
    SELECT source, lang AS "primary", n FROM c
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1
    """,
)
def argmax_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return argmax_label(table(spark, sf_dir, "documents"), ["source"], "lang")


@REGISTRY.query(
    "package_type_rollup",
    """
    SELECT count(*) FILTER (p_type LIKE '%BRASS') AS brass, count(*) FILTER (p_type LIKE '%STEEL') AS steel,
           count(*) FILTER (NOT (p_type LIKE '%BRASS' OR p_type LIKE '%STEEL')) AS other FROM part
    """,
)
def package_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    brass, steel = kind.endswith("BRASS"), kind.endswith("STEEL")
    return table(spark, sf_dir, "part").agg(
        F.count_if(brass).alias("brass"), F.count_if(steel).alias("steel"), F.count_if(~(brass | steel)).alias("other")
    )


@REGISTRY.query(
    "min_confidence",
    """
    SELECT source, CASE min(CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END)
                   WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence
    FROM labels JOIN documents USING (doc_id) GROUP BY source
    """,
)
def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium").alias("label")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return least_confidence(table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", label), ["source"], "label")


@REGISTRY.query(
    "load_and_parse_confidence",
    """
    WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type <> 'error') AS i FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN e = 0 THEN 'high' WHEN i > 0 THEN 'medium' ELSE 'low' END AS load,
           CASE WHEN i = 0 THEN 'low' WHEN e = 0 THEN 'high' WHEN i >= e THEN 'medium' ELSE 'low' END AS parse,
           CASE WHEN i + e > 0 AND i / (i + e) >= 0.9 THEN 'medium' ELSE 'low' END AS coverage FROM c
    """,
)
def load_and_parse_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(error).alias("e"), F.count_if(~error).alias("i"))
    e, i = F.col("e"), F.col("i")
    return c.select(
        "user_id", load_confidence(e, i).alias("load"), parse_confidence(F.lit(False), i, e).alias("parse"),
        coverage_band(i, i + e).alias("coverage"),
    )


@REGISTRY.query(
    "strict_and_rollup",
    """
    SELECT user_id, bool_and(event_type <> 'error') AS passed,
           coalesce(list(event_type ORDER BY event_id) FILTER (event_type = 'error'), []) AS failing,
           bool_or(event_type = 'click') AS degraded
    FROM events GROUP BY user_id
    """,
)
def strict_and_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_and(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", F.col("event_type") != "error", "click")


@REGISTRY.query(
    "set_profile",
    "SELECT user_id, count(*) AS n, list_sort(list(DISTINCT event_type)) AS vals FROM events GROUP BY user_id",
)
def set_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_summary(table(spark, sf_dir, "events"), "user_id", "event_type")


@REGISTRY.query(
    "entropy_scores",
    """
    WITH c AS (SELECT p_partkey, ch, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY 1, 2),
    t AS (SELECT p_partkey, sum(n) AS t FROM c GROUP BY 1)
    SELECT p_partkey, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM c JOIN t USING (p_partkey) GROUP BY 1
    """,
)
def entropy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(shannon_entropy(F.col("p_name")), 6).alias("entropy"))


@REGISTRY.query(
    "gc_rollup",
    """
    SELECT count(*) FILTER (epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate) > 86400 * 365) AS evicted,
           coalesce(sum(o_custkey) FILTER (epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate) > 86400 * 365), 0)::BIGINT AS bytes
    FROM orders
    """,
)
def gc_rollup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").select(
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.col("o_custkey").alias("size")
    )
    return gc_rollup(entries, 902016000, 86400 * 365)
