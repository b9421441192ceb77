"""Repository facts on literal files."""

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates, cascades, joins, ranking, sets, text_safety
from ledgerlens.operators import repository as R


def files(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], "repo string, path string, content string")


def test_counts_and_tools(spark):
    df = files(spark, ("a.test.ts", ""), ("x/b.spec.js", ""), ("node_modules/c.test.js", ""), ("A.TS", ""), ("package.json", '{"workspaces":["a"]}'), ("nx.json", "{}"))
    assert R.test_file_count(df).first().test_files == 2
    assert {(r.language, r.n) for r in R.language_counts(df, {".ts": "ts", ".js": "js"}).collect()} == {("ts", 2), ("js", 1)}
    tool = R.monorepo_tool(df).first()
    assert (tool.tool, tool.markers) == ("nx", ["nx.json", "package.json"])
    assert R.monorepo_tool(files(spark, ("package.json", '{"workspaces":[]}'))).count() == 0


def test_reflection_digest_refs_and_edits(spark):
    df = files(spark, ("a.js", "eval(x); process.env.A; process.env.B; my.eval(y)"), ("b.js", "require(name); require('lit')"))
    deps = spark.createDataFrame([("r", "typeorm")], "repo string, package string")
    got = R.reflection(df, deps).first()
    assert (got.eval_usage, got.env_read, got.dynamic_require, got.uses_typeorm, got.uses_nestjs, got.confidence_impact) == (1, 2, 1, True, False, "high")
    same_size = files(spark, ("a.js", "eval(x); process.env.A; process.env.B; my.eval(z)"), ("b.js", "require(name); require('lit')"))
    assert R.tree_digest(df).first().digest == R.tree_digest(same_size).first().digest
    assert R.tree_digest(df, True).first().digest != R.tree_digest(same_size, True).first().digest
    refs = R.policy_refs(spark.createDataFrame([(1, '{"policies":["x",{"name":"n","path":"p"}]}')], "id int, text string")).first()
    assert (refs.pos, refs.name, refs.path) == (1, "n", "p")
    edited = R.edited_dependency(files(spark, ("package.json", '{"devDependencies":{"a":"1","b":"2"},"peerDependencies":{"a":"3"}}')), "a", "9").first()
    assert edited.section == "devDependencies" and edited.edited == {"a": "9", "b": "2"}


def test_rollups_and_cascades(spark):
    sbom = spark.createDataFrame([("npm", True, []), ("npm", False, ["x.node"]), ("deb", False, []), (None, False, [])], "type string, native boolean, locations array<string>")
    assert sbom.agg(aggregates.native_package_count(sbom).alias("n")).first().n == 2
    assert aggregates.os_package_rollup(sbom).first().asDict() == {"runtime_required": 1, "build_only": 0, "convenience": 0, "unknown": 0}
    certs = spark.createDataFrame([([],), (["/etc/ssl/certs/a"],), (["/vendor/certs/x"],), (["/x"],)], "p array<string>")
    assert [r[0] for r in certs.select(cascades.certificate_source(F.col("p"))).collect()] == ["absent", "ca-certificates", "vendored", "unknown"]
    gen = spark.createDataFrame([("// Code generated by protoc-gen-ts", "a.ts"), ("x", "gen/a.ts"), ("x", "regen/a.ts")], "h string, p string")
    assert [r[0] for r in gen.select(cascades.generated_marker(F.col("h"), F.col("p"))).collect()] == ["protoc-typescript", "directory", None]
    assert spark.range(1).select(cascades.regenerate_command(F.lit("prisma"), F.array(F.lit("generate")))).first()[0] == "pnpm run generate"
    plans = spark.createDataFrame([("refused", "BUDGET"), ("rag_only_applicable", None)], "k string, r string")
    assert [r[0] for r in plans.select(cascades.recipe_outcome(F.col("k"), F.col("r"))).collect()] == ["failed:fallback.refused.budget", "skipped:registry_skipped"]
    h = spark.createDataFrame([("refused", True, "high"), ("applied_from_llm", False, "low"), ("applied_from_llm", True, "low"), ("applied_from_llm", True, "high")], "k string, p boolean, c string")
    assert [r[0] for r in h.select(cascades.harvest_verdict(F.col("k"), F.col("p"), F.col("c"))).collect()] == ["not_eligible", "trust_failed", "low_confidence", "harvested"]
    assert spark.range(1).select(cascades.exit_status(F.lit(False), F.array(F.lit("x"), F.lit("timeout: 3")))).first()[0] == "timeout"


def test_runtime_freshness(spark):
    rows = [
        (False, True, "high", "a", "a", "2026-01-01T00:00:00+00:00"), (True, True, "unavailable", "a", "a", "2026-01-01T00:00:00+00:00"), (True, False, "high", "a", "a", "2026-01-01T00:00:00+00:00"),
        (True, True, "high", None, "a", "2026-01-01T00:00:00+00:00"), (True, True, "high", "a", None, "2026-01-01T00:00:00+00:00"), (True, True, "high", "b", "a", "2026-01-01T00:00:00+00:00"),
        (True, True, "high", "a", "a", "2026-01-01T00:00:00+00:00"), (True, True, "high", "a", "a", "nonsense"),
    ]
    df = spark.createDataFrame(rows, "present boolean, well_formed boolean, coverage string, built string, traced string, at string")
    got = [r.f for r in df.select(cascades.runtime_freshness({c: F.col(c) for c in df.columns}).alias("f")).collect()]
    assert [x.detail for x in got[:6]] == ["upstream_unavailable", "upstream_unavailable", "slice_malformed", "no_built_image", "no_trace_recorded", "b<>a"]
    assert got[6].kind == "fresh" and got[7].detail == "slice_malformed"


def test_dispatch_keys_and_scopes(spark):
    q = spark.createDataFrame([("refs", 1), ("odd", 2)], "primitive string, id int")
    found, missing = R.band_dispatch(q, spark.createDataFrame([("refs", "a")], "primitive string, adapter string"))
    assert found.first().adapter == "a" and missing.first().id == 2
    keys = text_safety.secret_shaped_keys(spark.createDataFrame([(1, '{"a":{"API-Key":1},"references_secrets":2,"b":[{"myToken":3}]}')], "id int, j string"), "id", "j")
    assert {r.key for r in keys.collect()} == {"API-Key", "myToken"}
    # An incoming wildcard is only a value: it matches wildcard dimensions alone.
    scopes = spark.createDataFrame([("w", 0, "*"), ("c", 9, "x")], "scope string, precedence int, d string")
    assert [r.scope for r in joins.ranked_scopes(scopes, spark.createDataFrame([("*",)], "d string"), ["d"]).collect()] == ["w"]
    ranks = spark.createDataFrame([(" HIGH ",), ("odd",), (None,)], "s string").select(ranking.normal_severity(F.col("s"))).collect()
    assert [r[0] for r in ranks] == ["high", "negligible", "negligible"]
    assert spark.range(1).select(sets.admitted(F.array(F.lit("a")), F.array(F.lit("*")))).first()[0] is True
