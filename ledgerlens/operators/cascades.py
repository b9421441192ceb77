"""Ordered rule cascades: freshness, outcomes, rejects, thresholds. The first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import (
    DISK_FULL,
    ECOSYSTEMS,
    GENERATED_DIRS,
    GENERATOR_MARKERS,
    IDENTIFIERS,
    NETWORK_DENIED,
    REGENERATE_SCRIPTS,
)
from ledgerlens.functions.scalars import full_match, safe_relative_path
from ledgerlens.registry import REGISTRY, table


def cascade(*rules: tuple[Column, Column | str], otherwise: Column | str | None = None) -> Column:
    """First value whose condition is true; a null condition isn't."""
    out = None
    for when, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(when, value) if out is None else out.when(when, value)
    return out if otherwise is None else out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def index_freshness(present: Column, commit: Column, indexed: Column, total: Column, errors: Column, at: Column, head: Column) -> Column:
    """Struct (kind, reason, detail) of an index against the head commit (N1); typed columns are null where malformed."""
    malformed = commit.isNull() | indexed.isNull() | total.isNull() | errors.isNull() | at.isNull()

    def stale(reason: str, detail: Column) -> Column:
        return F.struct(F.lit("stale").alias("kind"), F.lit(reason).alias("reason"), detail.cast("string").alias("detail"))

    return cascade(
        (~present, stale("indexer_error", F.lit("upstream_scip_unavailable"))),
        (malformed, stale("indexer_error", F.lit("scip_slice_malformed"))),
        (commit != head, stale("commits_behind", commit)),
        (indexed < total, stale("coverage_gap", F.concat_ws("/", indexed, total))),
        (errors > 0, stale("indexer_error", F.concat(F.lit("indexer_reported_"), errors.cast("string"), F.lit("_errors")))),
        (F.try_to_timestamp(at).isNull(), stale("indexer_error", F.lit("scip_slice_malformed"))),
        otherwise=F.struct(F.lit("fresh").alias("kind"), F.lit(None).cast("string").alias("reason"), at.cast("string").alias("detail")),
    )


def freshness_confidence(kind: Column, reason: Column, indexed: Column, total: Column) -> Column:
    """fresh: high; a gap of at most a tenth, commits behind or another digest: medium; else low."""
    return cascade(
        (kind == "fresh", "high"),
        ((reason == "coverage_gap") & (total > 0) & (F.try_divide(indexed, total) >= 0.90), "medium"),
        (reason.isin("commits_behind", "digest_mismatch"), "medium"),
        otherwise="low",
    )


def stale_by_age(now: Column, seen: Column, most_s: int) -> Column:
    """Strictly older than allowed; a time in the future is fresh."""
    age = F.unix_timestamp(now) - F.unix_timestamp(seen)
    return (age > 0) & (age > most_s)


def due(now: Column, last: Column, interval_s: int) -> Column:
    """At least the interval since the last run, or a clock that went back, or no run yet."""
    gone = F.unix_timestamp(now) - F.unix_timestamp(last)
    return last.isNull() | (gone >= interval_s) | (gone < 0)


def exit_status(skipped: Column, errors: Column) -> Column:
    """skipped, ok, timeout or error, from the error strings' prefixes."""
    return cascade((skipped, "skipped"), (F.size(errors) == 0, "ok"), (F.exists(errors, lambda e: e.startswith("timeout:")), "timeout"), otherwise="error")


#: Lowest failing exit code of each scanner (fixed values); the others fail on any code but 0.
FAILS_FROM_TWO = ("semgrep", "gitleaks", "ripgrep")


def scanner_outcome(tool: Column, exit_code: Column, parsed: Column, rules: Column) -> Column:
    """failed, failed(invalid_json), skipped or ran."""
    failed = F.when(tool.isin(*FAILS_FROM_TWO), exit_code >= 2).otherwise(exit_code != 0)
    return cascade((failed, "failed"), (~parsed, "failed(invalid_json)"), ((tool == "semgrep") & (rules == 0), "skipped"), otherwise="ran")


def sandbox_outcome(c: dict[str, Column]) -> Column:
    """Outcome of a jailed command (P29): raised errors, kill by deadline or memory, denied host, full disk, completed."""
    killed = c["exit_code"] == -9
    denied = c["stderr"].rlike("|".join(NETWORK_DENIED))
    full = c["stderr"].rlike("|".join(DISK_FULL))
    return cascade(
        (c["raised"] == "timeout", "timed_out"),
        (c["raised"].isNotNull() | c["exit_code"].isNull(), "jail_setup_failed"),
        (killed & (c["elapsed_s"] >= c["budget_s"] - 0.1), "timed_out"),
        (killed & ((c["oom_kills"] > 0) | (c["peak_mib"] >= c["memory_mib"])), "oom_killed"),
        (killed, "completed"),
        ((c["exit_code"] != 0) & denied & c["denied_host"].isNotNull(), "network_denied"),
        ((c["exit_code"] != 0) & full & c["quota_bytes"].isNotNull() & c["written_bytes"].isNotNull(), "disk_quota_exceeded"),
        otherwise="completed",
    )


def certificate_source(paths: Column) -> Column:
    """Where certificates come from, by ordered path prefixes."""
    return cascade(
        (F.size(paths) == 0, "absent"), (F.exists(paths, lambda p: p.startswith("/etc/ssl/certs/")), "ca-certificates"),
        (F.exists(paths, lambda p: p.startswith("/app/vendor/certs/") | p.startswith("/vendor/certs/")), "vendored"), otherwise="unknown",
    )


def app_layer(kind: Column) -> Column:
    """Whether provenance allows a change in the application's layer."""
    return kind.isin("app_direct", "app_transitive", "app_vendored", "both")


def harvest_verdict(plan: Column, passed: Column, confidence: Column) -> Column:
    """Whether a plan's outcome is kept, or why not: failed trust comes before low confidence (P20)."""
    return cascade((plan != "applied_from_llm", "not_eligible"), (~passed, "trust_failed"), (confidence != "high", "low_confidence"), otherwise="harvested")


def generated_marker(head: Column, path: Column) -> Column:
    """Generator by a marker in the first 4096 bytes, in order, else `directory` under a known one, else null."""
    first = F.left(F.encode(head, "UTF-8"), F.lit(4096))
    marked = [(F.contains(first, F.encode(F.lit(text), "UTF-8")), name) for name, text in GENERATOR_MARKERS]
    under = F.lit(False)
    for d in GENERATED_DIRS:
        under = under | (path == d) | path.startswith(f"{d}/")
    return cascade(*marked, (under, "directory"))


def regenerate_command(generator: Column, scripts: Column) -> Column:
    """`pnpm run` with the first of a generator's script names that is there."""
    names = F.coalesce(*[F.when(generator == g, F.array(*map(F.lit, keys))) for g, keys in REGENERATE_SCRIPTS.items()])
    return F.concat(F.lit("pnpm run "), F.get(F.filter(names, lambda k: F.array_contains(scripts, k)), F.lit(0)))


def runtime_freshness(s: dict[str, Column]) -> Column:
    """Struct (kind, reason, detail) of a runtime trace against the built image.

    `kinds` say what the fields were in the report: a field of another type than text or null is malformed.
    """
    def stale(reason: str, detail: str) -> Column:
        return F.struct(F.lit("stale").alias("kind"), F.lit(reason).alias("reason"), F.lit(detail).alias("detail"))

    digest = F.struct(F.lit("stale").alias("kind"), F.lit("digest_mismatch").alias("reason"), F.concat_ws("<>", s["built"], s["traced"]).alias("detail"))
    return cascade(
        (~s["present"] | (s["coverage"] == "unavailable"), stale("indexer_error", "upstream_unavailable")), (~s["well_formed"] | s["at"].isNull(), stale("indexer_error", "slice_malformed")),
        (s["built"].isNull(), stale("indexer_error", "no_built_image")), (s["traced"].isNull(), stale("indexer_error", "no_trace_recorded")), (s["built"] != s["traced"], digest),
        (F.try_to_timestamp(s["at"]).isNull(), stale("indexer_error", "slice_malformed")),
        otherwise=F.struct(F.lit("fresh").alias("kind"), F.lit(None).cast("string").alias("reason"), s["at"].alias("detail")),
    )


def recipe_outcome(plan: Column, refusal: Column) -> Column:
    """Recipe outcome of a plan outcome, a closed mapping."""
    return cascade(
        (plan == "applied_from_llm", "applied:phase4.plan.applied_from_llm"), (plan == "applied_from_recipe", "applied:phase4.plan.applied_from_recipe"),
        (plan == "rag_only_applicable", "skipped:registry_skipped"), (plan == "refused", F.concat(F.lit("failed:fallback.refused."), F.lower(refusal))),
    )


def config_issues(c: dict[str, float | str]) -> list[str]:
    """Threshold configuration, checked on the driver before planning."""
    import math

    found = []
    for k in ("high", "degraded"):
        if not (math.isfinite(c[k]) and 0 <= c[k] <= 1):
            found.append(f"{k} isn't in 0 to 1")
    if not found and c["high"] <= c["degraded"]:
        found.append("high isn't above degraded")
    for k in ("per_call", "per_workflow"):
        if c[k] <= 0:
            found.append(f"{k} isn't positive")
    if c["per_call"] > c["per_workflow"]:
        found.append("per_call is above per_workflow")
    path = str(c["path"])
    if not path or path.startswith("/") or ".." in path.split("/"):
        found.append("path isn't relative")
    return found


def invariant_violations(reports: DataFrame) -> DataFrame:
    """(id, violation) of outcome reports whose fields contradict each other."""
    rules = {
        "completed_needs_patch": ~((F.col("outcome") == "completed").eqNullSafe(F.col("patch").isNotNull() & (F.size("failure_modes") == 0))),
        "validated_needs_branch": (F.col("outcome") == "validated") & (F.col("branch").isNull() | F.col("transform").isNull()),
        "failed_has_branch": (F.col("outcome") == "failed") & F.col("branch").isNotNull(),
        "passed_has_failing": F.col("passed") != (F.size("failing") == 0),
        "fewer_findings_than_fingerprints": F.col("findings") < F.col("fingerprints"),
    }
    checks = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    return reports.select("id", F.explode(F.filter(checks, lambda v: v.isNotNull())).alias("violation"))


def identifier_checks(text: Column) -> list[Column]:
    """One boolean a grammar (P25), the closed set of ecosystems and relative paths among them."""
    found = [full_match(text, pattern, cap).alias(name) for name, pattern, cap in IDENTIFIERS]
    return [*found, F.coalesce(text.isin(*ECOSYSTEMS), F.lit(False)).alias("ecosystem"), safe_relative_path(text).alias("relative_path")]


def rule_outcomes(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, rule, outcome, evidence) of file-pattern rules (P13), one row for each rule and repository: all matching files
    must match, the first failing one is the evidence; no matching file: not applicable, or a failure where one is asked for.

    A rule's regular expression that ends in a literal extension meets only files of that extension, others meet all; the
    expression decides after that equi-join.
    """
    tail = F.regexp_extract("glob_regex", r"\\\.([A-Za-z0-9]+)(?:\\z|\$)$", 1)
    keyed = rules.withColumn("kind", F.when(tail != "", tail).otherwise(F.lit("*")))
    own = F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1)
    dealt = files.withColumn("kind", F.explode(F.array_distinct(F.array(F.lit("*"), own))))
    good = F.rlike("content", F.col("content_regex")) != F.col("inverted")
    hits = dealt.join(keyed, "kind").where(F.rlike("path", F.col("glob_regex"))).groupBy("repo", "rule").agg(
        F.bool_and(good).alias("ok"), F.min(F.when(~good, F.col("path"))).alias("evidence")
    )
    # Every repository has a row for every rule: rules are dealt to a few blocks, and each repository meets all blocks.
    blocks = 16
    dealt_rules = rules.select("rule", "needs_file", F.pmod(F.hash("rule"), F.lit(blocks)).alias("block"))
    every = files.select("repo").distinct().withColumn("block", F.explode(F.array(*map(F.lit, range(blocks))))).join(dealt_rules, "block").drop("block")
    none = F.when(F.col("needs_file"), "fail").otherwise("not_applicable")
    return every.join(hits, ["repo", "rule"], "left").select(
        "repo", "rule", F.when(F.col("ok").isNull(), none).when(F.col("ok"), "pass").otherwise("fail").alias("outcome"), "evidence"
    )


def exception_partition(df: DataFrame, today: Column) -> DataFrame:
    """active up to and on the day of expiry."""
    return df.withColumn("state", F.when(F.col("expires") >= today, "active").otherwise("expired"))


def rejects(df: DataFrame, *rules: tuple[Column, str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with `reason`): the first failing check is the reason."""
    checked = df.withColumn("reason", cascade(*rules))
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


_NOW = "TIMESTAMP '1998-08-02 00:00:00'"


@REGISTRY.query(
    "freshness_cascade",
    """
    WITH s AS (SELECT o_orderkey, o_orderstatus <> 'P' AS present, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS commit,
                      (o_orderkey % 20) AS indexed, (o_custkey % 21) AS total, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS errors FROM orders),
    f AS (SELECT *, CASE WHEN NOT present THEN 'indexer_error' WHEN commit IS NULL THEN 'indexer_error' WHEN commit <> '1-URGENT' THEN 'commits_behind'
                         WHEN indexed < total THEN 'coverage_gap' WHEN errors > 0 THEN 'indexer_error' END AS reason FROM s)
    SELECT o_orderkey, CASE WHEN reason IS NULL THEN 'fresh' ELSE 'stale' END AS kind, reason,
           CASE WHEN reason IS NULL THEN 'high' WHEN reason = 'coverage_gap' AND total > 0 AND indexed / total >= 0.9 THEN 'medium'
                WHEN reason = 'commits_behind' THEN 'medium' ELSE 'low' END AS confidence FROM f
    """,
)
def freshness_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") != "P").alias("present"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("commit"),
        (F.col("o_orderkey") % 20).alias("indexed"), (F.col("o_custkey") % 21).alias("total"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("errors"),
    )
    state = index_freshness(F.col("present"), F.col("commit"), F.col("indexed"), F.col("total"), F.col("errors"), F.lit("2024-01-01T00:00:00Z"), F.lit("1-URGENT"))
    f = s.withColumn("f", state).select("o_orderkey", "f.kind", "f.reason", "indexed", "total")
    return f.select("o_orderkey", "kind", "reason", freshness_confidence(F.col("kind"), F.col("reason"), F.col("indexed"), F.col("total")).alias("confidence"))


@REGISTRY.query(
    "staleness_and_due",
    f"""
    SELECT o_orderkey, epoch({_NOW}) - epoch(o_orderdate) > 0 AND epoch({_NOW}) - epoch(o_orderdate) > 31536000 AS stale,
           epoch({_NOW}) - epoch(o_orderdate) >= 86400 OR epoch({_NOW}) - epoch(o_orderdate) < 0 AS due,
           CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'active' ELSE 'expired' END AS state FROM orders
    """,
)
def staleness_and_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, seen = F.expr(_NOW), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", stale_by_age(now, seen, 31536000).alias("stale"), due(now, seen, 86400).alias("due"), seen.alias("expires"))
    return exception_partition(rows, F.expr("TIMESTAMP '1997-01-01 00:00:00'")).drop("expires")


@REGISTRY.query(
    "identifier_grammars",
    "SELECT url, "
    + ", ".join(f"regexp_full_match(url, '{p}') AND length(url) <= {cap} AS {name}" for name, p, cap in IDENTIFIERS)
    + ", url IN ('npm', 'pypi', 'maven', 'rubygems', 'gomod') AS ecosystem, url <> '' AND NOT starts_with(url, '/') AND NOT contains(url, '\\')"
    + " AND NOT list_contains(string_split(url, '/'), '..') AS relative_path FROM (SELECT url FROM pages UNION ALL SELECT r_name FROM region"
    + " UNION ALL SELECT lower(c_name) FROM customer UNION ALL SELECT sha256(c_name) FROM customer UNION ALL SELECT 'npm')",
)
def identifier_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "customer").select("c_name")
    texts = (
        table(spark, sf_dir, "pages").select("url").union(table(spark, sf_dir, "region").select("r_name"))
        .union(name.select(F.lower("c_name"))).union(name.select(F.sha2("c_name", 256))).union(spark.sql("SELECT 'npm'"))
    )
    return texts.select("url", *identifier_checks(F.col("url")))


@REGISTRY.query(
    "scanner_outcomes",
    """
    SELECT l_orderkey, l_linenumber,
      CASE WHEN (l_shipmode IN ('semgrep', 'gitleaks', 'ripgrep') AND code >= 2) OR (l_shipmode NOT IN ('semgrep', 'gitleaks', 'ripgrep') AND code <> 0) THEN 'failed'
           WHEN NOT parsed THEN 'failed(invalid_json)' WHEN l_shipmode = 'semgrep' AND rules = 0 THEN 'skipped' ELSE 'ran' END AS outcome
    FROM (SELECT l_orderkey, l_linenumber, ['semgrep', 'gitleaks', 'ripgrep', 'grype', 'syft'][(l_partkey % 5 + 1)::INT] AS l_shipmode, l_linenumber % 4 AS code,
                 l_linestatus = 'O' AS parsed, l_suppkey % 2 AS rules FROM lineitem)
    """,
)
def scanner_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = F.array(*map(F.lit, ("semgrep", "gitleaks", "ripgrep", "grype", "syft")))
    outcome = scanner_outcome(F.element_at(tools, (F.col("l_partkey") % 5 + 1).cast("int")), F.col("l_linenumber") % 4, F.col("l_linestatus") == "O", F.col("l_suppkey") % 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", outcome.alias("outcome"))
