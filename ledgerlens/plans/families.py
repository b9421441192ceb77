"""Queries that apply families of column functions and small operators to whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import cascades, graph, retrieval, sets
from ledgerlens.registry import REGISTRY, table
from ledgerlens.sources import lines, sinks


def _pick(values: list[str | None], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


@REGISTRY.query(
    "text_digests",
    """
    SELECT c_custkey, sha256(c_name) AS content, left(sha256(c_name), 8) AS mark, sha256(chr(2) || c_name || chr(31) || c_mktsegment) AS identity,
           CASE WHEN c_custkey % 7 <> 0 THEN sha256(chr(2) || c_name || chr(31) || c_mktsegment) END AS checked FROM customer
    """,
)
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 to H5, H7, A16."""
    other = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_mktsegment", F.lit(chr(31)))).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.content_hash(F.col("c_name")).alias("content"), S.fingerprint(F.col("c_name")).alias("mark"),
        S.identity_hash(F.col("c_name"), F.col("c_mktsegment")).alias("identity"), S.checked_identity_hash(F.col("c_name"), other).alias("checked"),
    )


_PART_JSON = "'\"brand\":\"' || p_brand || '\",\"key\":' || p_partkey || ',\"name\":' || coalesce('\"' || n || '\"', 'null') || ',\"size\":' || p_size || ',\"type\":\"' || p_type || '\"'"


@REGISTRY.query(
    "record_ids",
    f"""
    SELECT p_partkey, sha256('{{' || {_PART_JSON} || '}}') AS id, 'sha256:' || sha256('{{"type":"' || p_type || '","size":' || p_size || '}}') AS digest,
           '{{"b":"' || p_brand || '","t":"' || p_type || '"}}' AS canonical
    FROM (SELECT *, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS n FROM part)
    """,
)
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H17, F15."""
    fields = {"key": F.col("p_partkey"), "name": F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")}
    pairs = F.create_map(F.lit("t"), "p_type", F.lit("b"), "p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.record_id(fields).alias("id"), S.case_digest({"type": fields["type"], "size": fields["size"]}).alias("digest"), S.canonical_json_map(pairs).alias("canonical")
    )


@REGISTRY.query(
    "ages_and_days",
    """
    SELECT o_orderkey, (epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate)) / 86400 AS age, epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate) >= 365 * 86400 AS old,
           strftime(o_orderdate, '%Y-%m-%d') AS day, 'order: ' || o_orderkey || chr(10) || 'status: ' || coalesce(nullif(o_orderstatus, 'P'), '') AS query FROM orders
    """,
)
def ages_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H13, H14, F14."""
    now, then = F.expr("TIMESTAMP '1998-08-02 00:00:00'"), F.col("o_orderdate").cast("timestamp")
    text = sinks.query_text({"order": F.col("o_orderkey").cast("string"), "status": F.nullif(F.col("o_orderstatus"), F.lit("P"))})
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.age_days(now, then).alias("age"), S.older_than(now, then, 365).alias("old"), S.utc_day(then).alias("day"), text.alias("query")
    )


@REGISTRY.query(
    "vector_checks",
    """
    SELECT vec_id, len(embedding) = 64 AS usable, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
           coalesce(embedding[1] BETWEEN 0 AND 1, false) AS in_range FROM embeddings
    """,
)
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8, H11, H15."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", S.vector_ok(v, 64).alias("usable"), F.round(S.l2_norm(v), 5).alias("norm"), S.in_unit_range(F.get(v, F.lit(0)).cast("double")).alias("in_range")
    )


@REGISTRY.query(
    "rebuilt_index",
    """
    WITH r AS (SELECT vec_id // 2 AS id, arg_max(vec_id, vec_id) AS last FROM embeddings GROUP BY 1),
    n AS (SELECT id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM r JOIN embeddings ON vec_id = last)
    SELECT id, round(embedding[1]::DOUBLE / CASE WHEN abs(norm - 1) <= 1e-6 THEN 1 ELSE norm END, 6) AS first FROM n WHERE norm > 0
    """,
)
def rebuilt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: two records of each id, the later one counts."""
    records = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("id"), F.col("vec_id").alias("seq"), "embedding")
    size = F.size("embedding")
    dim = F.coalesce(records.agg(F.max(size)).scalar(), F.lit(0))
    return retrieval.rebuilt(records, "seq", dim).select("id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@REGISTRY.query(
    "text_rules",
    r"""
    WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '/home/' || lower(c_mktsegment) || '/x/' || c_name ELSE '/repo/' || c_name END AS path,
                      CASE WHEN c_custkey % 2 = 0 THEN 'v1.' ELSE '1.' END || c_custkey AS version,
                      CASE WHEN c_custkey % 4 = 0 THEN 'chart.yaml' ELSE 'values-' || lower(c_mktsegment) || '.yml' END AS file FROM customer)
    SELECT c_custkey, regexp_replace(path, '(?:/repo/?)|(?:/Users/[^/]+/)|(?:/home/[^/]+/)|(?:/root/)', '', 'g') AS scrubbed, regexp_replace(version, '^[vV]', '') AS bare,
           CASE WHEN c_custkey % 4 = 0 THEN 'chart' ELSE lower(c_mktsegment) END AS env, c_custkey % 4 <> 0 AS recognised,
           CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS errors, c_nationkey >= 10 AS engine,
           CASE WHEN c_custkey % 3 <> 0 THEN sha256(c_name) END AS digest, (c_custkey % 30 + 1) NOT IN (9, 10, 13) AS forbidden,
           'node_modules/' || lower(c_mktsegment) AS lock_key, lower(c_mktsegment) AS package FROM c
    """,
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F16, F18, F22, F28, F29, F32, P21."""
    key, segment, name = F.col("c_custkey"), F.lower("c_mktsegment"), F.col("c_name")
    path = F.when(key % 3 == 0, F.concat(F.lit("/home/"), segment, F.lit("/x/"), name)).otherwise(F.concat(F.lit("/repo/"), name))
    version = F.concat(F.when(key % 2 == 0, "v1.").otherwise("1."), key.cast("string"))
    env = S.values_env(F.when(key % 4 == 0, "chart.yaml").otherwise(F.concat(F.lit("values-"), segment, F.lit(".yml"))))
    said = F.when(key % 5 != 0, F.concat(F.lit("Found "), F.col("c_nationkey").cast("string"), F.lit(" errors in 3 files."))).otherwise("done")
    line = F.when(key % 3 != 0, F.concat(F.sha2(name, 256), F.lit("  "), name)).otherwise(name)
    lock_key = F.concat(F.lit("node_modules/"), segment)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.path_scrubbed(path, "/repo").alias("scrubbed"), S.bare_version(version).alias("bare"), env["env"].alias("env"), env["recognised"].alias("recognised"),
        S.tsc_errors(said).alias("errors"), S.engine_at_least(F.concat(F.lit(">="), F.col("c_nationkey").cast("string")), 10).alias("engine"),
        S.lock_line(line)["digest"].alias("digest"), S.forbidden_characters(F.concat(name, F.char(key % 30 + 1))).alias("forbidden"),
        lock_key.alias("lock_key"), S.package_of_lock_key(lock_key).alias("package"),
    )


@REGISTRY.query(
    "page_markers",
    """
    SELECT page_id, url LIKE '%.org/%' AS org, CASE WHEN contains(html, '<table') OR contains(url, '<table') THEN '<table' WHEN contains(html, '<article') OR contains(url, '<article') THEN '<article' END AS marker,
           CASE WHEN contains(url, 'utm_') THEN 'utm_' WHEN contains(html, '<article') THEN '<article' END AS first_text FROM pages
    """,
)
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, P27 in both orders."""
    texts = F.array("url", "html")
    return table(spark, sf_dir, "pages").select(
        "page_id", S.glob_match(F.col("url"), "*.org/*").alias("org"), S.first_marker(texts, ["<table", "<article"]).alias("marker"), S.first_marked_text(texts, ["<article", "utm_"]).alias("first_text")
    )


@REGISTRY.query(
    "outcome_verdicts",
    """
    WITH v AS (SELECT *, ['app_direct', 'app_transitive', 'app_vendored', 'both', 'os'][(l_partkey % 5 + 1)::INT] AS kind,
                      ['applied_from_llm', 'applied_from_recipe', 'rag_only_applicable', 'refused'][(l_suppkey % 4 + 1)::INT] AS plan,
                      [NULL, 'timeout', 'setup'][(l_partkey % 3 + 1)::INT] AS raised, [0, -9, 1][(l_suppkey % 3 + 1)::INT] AS code FROM lineitem)
    SELECT l_orderkey, l_linenumber, kind <> 'os' AS app,
           CASE WHEN plan <> 'applied_from_llm' THEN 'not_eligible' WHEN l_linestatus <> 'O' THEN 'trust_failed' WHEN l_linenumber % 2 = 0 THEN 'low_confidence' ELSE 'harvested' END AS harvest,
           CASE plan WHEN 'applied_from_llm' THEN 'applied:phase4.plan.applied_from_llm' WHEN 'applied_from_recipe' THEN 'applied:phase4.plan.applied_from_recipe'
                     WHEN 'rag_only_applicable' THEN 'skipped:registry_skipped' ELSE 'failed:fallback.refused.' || lower(l_returnflag) END AS recipe,
           CASE WHEN l_returnflag = 'A' THEN 'skipped' WHEN l_partkey % 3 = 0 THEN 'ok' WHEN l_partkey % 3 = 1 THEN 'timeout' ELSE 'error' END AS status,
           CASE l_partkey % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'ca-certificates' WHEN 2 THEN 'vendored' ELSE 'unknown' END AS certificates,
           CASE WHEN raised = 'timeout' THEN 'timed_out' WHEN raised IS NOT NULL THEN 'jail_setup_failed' WHEN code = -9 AND l_quantity >= 29.9 THEN 'timed_out'
                WHEN code = -9 AND l_linenumber > 3 THEN 'oom_killed' ELSE 'completed' END AS sandbox
    FROM v
    """,
)
def outcome_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, P19, P20, P29, M11, N6."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    plan = _pick(["applied_from_llm", "applied_from_recipe", "rag_only_applicable", "refused"], supplier)
    none = F.array().cast("array<string>")
    errors = F.when(part % 3 == 0, none).when(part % 3 == 1, F.array(F.lit("boom"), F.lit("timeout: x"))).otherwise(F.array(F.lit("boom")))
    paths = F.when(part % 4 == 0, none).when(part % 4 == 1, F.array(F.lit("/vendor/certs/a"), F.lit("/etc/ssl/certs/b"))).when(part % 4 == 2, F.array(F.lit("/vendor/certs/a"))).otherwise(F.array(F.lit("/opt/x")))
    code = F.element_at(F.array(F.lit(0), F.lit(-9), F.lit(1)), (supplier % 3 + 1).cast("int"))
    sandbox = cascades.sandbox_outcome({
        "exit_code": code, "stderr": F.lit(""), "raised": _pick([None, "timeout", "setup"], part), "elapsed_s": F.col("l_quantity"), "budget_s": F.lit(30.0),
        "oom_kills": F.lit(0), "peak_mib": F.col("l_linenumber"), "memory_mib": F.lit(4), "denied_host": F.lit(None).cast("string"),
        "quota_bytes": F.lit(None).cast("long"), "written_bytes": F.lit(None).cast("long"),
    })
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", cascades.app_layer(_pick(["app_direct", "app_transitive", "app_vendored", "both", "os"], part)).alias("app"),
        cascades.harvest_verdict(plan, F.col("l_linestatus") == "O", F.when(F.col("l_linenumber") % 2 == 0, "low").otherwise("high")).alias("harvest"),
        cascades.recipe_outcome(plan, F.col("l_returnflag")).alias("recipe"), cascades.exit_status(F.col("l_returnflag") == "A", errors).alias("status"),
        cascades.certificate_source(paths).alias("certificates"), sandbox.alias("sandbox"),
    )


@REGISTRY.query(
    "typed_identifiers",
    r"""
    SELECT p_partkey, p_partkey % 3 <> 2 AS package, p_partkey % 4 IN (0, 1) AS registry, p_partkey % 4 IN (0, 3) AS image FROM part
    """,
)
def typed_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: package ids, registry URLs and image references."""
    key, name = F.col("p_partkey"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))
    size = F.col("p_size").cast("string")
    package = F.when(key % 3 == 0, F.concat(name, F.lit("@1."), size, F.lit(".0"))).when(key % 3 == 1, F.concat(F.lit("@a/"), name, F.lit("@1.0.0-rc."), size)).otherwise(F.concat(name, F.lit("@"), size))
    registry = F.when(key % 4 == 0, F.concat(F.lit("https://"), name, F.lit(".example.org/x"))).when(key % 4 == 1, "https://a.example:8080/").when(key % 4 == 2, "https://u@a.example/").otherwise("http://a.example/")
    image = F.when(key % 4 == 0, F.concat(name, F.lit(":"), size)).when(key % 4 == 1, F.concat(name, F.lit(":a:b"))).when(key % 4 == 2, F.concat(name, F.lit(" x"))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", S.package_id(package).alias("package"), S.registry_url(registry).alias("registry"), S.image_ref(image).alias("image"))


@REGISTRY.query(
    "skill_matches",
    """
    WITH s AS (SELECT p_partkey AS skill, CASE WHEN p_partkey % 10 = 0 THEN ['*'] ELSE ['t' || (p_partkey % 7), 't' || (p_partkey % 5)] END AS tasks,
                      CASE WHEN p_partkey % 6 = 0 THEN ['*'] ELSE ['l' || (p_partkey % 4)] END AS languages FROM part),
    q AS (SELECT s_suppkey AS query, CASE WHEN s_suppkey % 4 <> 0 THEN 't' || (s_suppkey % 7) END AS task, ['l' || (s_suppkey % 4), 'l9'] AS languages FROM supplier)
    SELECT query, skill FROM q, s WHERE (list_contains(tasks, '*') OR coalesce(list_contains(tasks, task), false)) AND (list_contains(s.languages, '*') OR list_has_any(s.languages, q.languages))
    """,
)
def skill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    part, supplier, l, t = F.col("p_partkey"), F.col("s_suppkey"), F.lit("l"), F.lit("t")
    any_of = F.array(F.lit("*"))
    skills = table(spark, sf_dir, "part").select(
        part.alias("skill"), F.when(part % 10 == 0, any_of).otherwise(F.array(F.concat(t, (part % 7).cast("string")), F.concat(t, (part % 5).cast("string")))).alias("tasks"),
        F.when(part % 6 == 0, any_of).otherwise(F.array(F.concat(l, (part % 4).cast("string")))).alias("languages"),
    )
    queries = table(spark, sf_dir, "supplier").select(
        supplier.alias("query"), F.when(supplier % 4 != 0, F.concat(t, (supplier % 7).cast("string"))).alias("task"), F.array(F.concat(l, (supplier % 4).cast("string")), F.lit("l9")).alias("languages")
    )
    return sets.skill_matches(skills, queries)


@REGISTRY.query(
    "lifted_scopes",
    """
    SELECT s_suppkey AS scope, unnest(['vuln', 't' || (s_suppkey % 3)]) AS task, language, build
    FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['node', 'python'] ELSE ['*'] END) AS language, build FROM (SELECT s_suppkey, unnest(['npm', 'pip']) AS build FROM supplier))
    """,
)
def lifted_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4."""
    key = F.col("s_suppkey")
    manifests = table(spark, sf_dir, "supplier").select(
        key.alias("scope"), F.array(F.lit("vuln"), F.concat(F.lit("t"), (key % 3).cast("string"))).alias("task"),
        F.when(key % 2 == 0, F.array(F.lit("node"), F.lit("python"))).otherwise(F.array(F.lit("*"))).alias("language"), F.array(F.lit("npm"), F.lit("pip")).alias("build"),
    )
    return sets.lifted_scopes(manifests, ["task", "language", "build"])


@REGISTRY.query(
    "npm_lock_files",
    """
    SELECT p_partkey::VARCHAR AS path, 2 + (p_partkey % 2)::INT AS lockfile_version, 'node_modules/' || replace(p_name, ' ', '-') AS key, replace(p_name, ' ', '-') AS name, '1.' || p_size || '.0' AS version FROM part
    UNION ALL SELECT p_partkey::VARCHAR, 2 + (p_partkey % 2)::INT, 'node_modules/a/node_modules/@s/b', '@s/b', '2.0.0' FROM part
    """,
)
def npm_lock_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, F16."""
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    text = F.concat(
        F.lit('{"lockfileVersion":'), (2 + F.col("p_partkey") % 2).cast("string"), F.lit(',"packages":{"":{"name":"root"},"node_modules/'), name, F.lit('":{"version":"1.'),
        F.col("p_size").cast("string"), F.lit('.0"},"node_modules/a/node_modules/@s/b":{"version":"2.0.0"}}}'),
    )
    return lines.npm_packages(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))


@REGISTRY.query(
    "coverage_files",
    """
    SELECT p_partkey::VARCHAR AS path, p_size::BIGINT AS lines_found, (p_size // 2)::BIGINT AS lines_hit, 0::BIGINT AS functions_found, 0::BIGINT AS functions_hit, 3::BIGINT AS branches_found, 0::BIGINT AS branches_hit,
           p_name AS source_file, CASE WHEN p_partkey % 2 = 0 THEN [1, 7] ELSE [1] END AS lines_covered FROM part
    """,
)
def coverage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, S16."""
    size = F.col("p_size")
    text = F.concat(
        F.lit("TN:\nSF:"), "p_name", F.lit("\nDA:1,4\nDA:5,0\nDA:7,"), (1 - F.col("p_partkey") % 2).cast("string"), F.lit("\nLF:"), size.cast("string"),
        F.lit("\nLH:"), F.floor(size / 2).cast("string"), F.lit("\nBRF:3\nBRH:x\nend_of_record\n"),
    )
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"))
    return lines.lcov_totals(files).join(lines.lcov_records(files)[0].drop("nth"), "path")


@REGISTRY.query(
    "owner_files",
    """
    SELECT c_custkey::VARCHAR AS path, 3 AS line_number, '/' || lower(c_mktsegment) || '/' AS pattern, ['@' || c_nationkey, '@all'] AS owners FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 4, '*.md', [] FROM customer
    """,
)
def owner_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19."""
    text = F.concat(F.lit("# owners\n\n/"), F.lower("c_mktsegment"), F.lit("/  @"), F.col("c_nationkey").cast("string"), F.lit(" @all # all\n*.md\n"))
    return lines.code_owners(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), text.alias("text")))[0]


@REGISTRY.query(
    "rule_outcomes",
    """
    WITH f AS (SELECT c_mktsegment AS repo, c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.json' ELSE '.md' END AS path, c_name AS content FROM customer),
    h AS (SELECT repo, 'json' AS rule, bool_and(contains(content, '#0')) AS ok, min(path) FILTER (NOT contains(content, '#0')) AS evidence FROM f WHERE ends_with(path, '.json') GROUP BY 1
          UNION ALL SELECT repo, 'no_nine', bool_and(NOT ends_with(content, '9')), min(path) FILTER (ends_with(content, '9')) FROM f GROUP BY 1)
    SELECT repo, rule, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS outcome, evidence FROM h
    UNION ALL SELECT DISTINCT repo, 'toml', 'fail', NULL FROM f UNION ALL SELECT DISTINCT repo, 'yaml', 'not_applicable', NULL FROM f
    """,
)
def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    key = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("repo"), F.concat(key.cast("string"), F.when(key % 2 == 0, ".json").otherwise(".md")).alias("path"), F.col("c_name").alias("content")
    )
    rules = spark.createDataFrame(
        [("json", r"\.json\z", "#0", False, True), ("no_nine", ".", r"9\z", True, False), ("toml", r"\.toml\z", "x", False, True), ("yaml", r"\.yaml\z", "x", False, False)],
        "rule string, glob_regex string, content_regex string, inverted boolean, needs_file boolean",
    )
    return cascades.rule_outcomes(rules, files)


@REGISTRY.query(
    "symbol_references",
    """
    SELECT DISTINCT p_brand AS symbol, l_suppkey AS test FROM lineitem JOIN part ON l_partkey = p_partkey AND l_linenumber BETWEEN 2 AND 4
    """,
)
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test covers a line of the symbol's definition."""
    coverage = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("test"))
    definitions = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("file"), F.lit(2).alias("first_line"), F.lit(4).alias("last_line"))
    return graph.tests_exercising(coverage, definitions)


@REGISTRY.query(
    "report_issues",
    """
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'validated_without_branch' WHEN o_orderstatus = 'O' AND o_custkey % 2 <> 0 THEN 'failed_with_branch' ELSE 'unknown_outcome' END AS issue
    FROM orders WHERE (o_orderstatus = 'F' AND o_custkey % 2 = 0) OR (o_orderstatus = 'O' AND o_custkey % 2 <> 0) OR o_orderstatus NOT IN ('F', 'O')
    """,
)
def report_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    status = F.col("o_orderstatus")
    reports = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(status == "F", "validated").when(status == "O", "failed").otherwise("other").alias("outcome"),
        F.when(F.col("o_custkey") % 2 != 0, "b").alias("branch"), F.lit("t").alias("transform"),
    )
    return sinks.report_issues(reports).select("id", "issue")
