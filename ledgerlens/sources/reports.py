"""Scanner reports: NDJSON and JSON with explicit, tolerant schemas; and pipeline, chart and manifest documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIPGREP = "type STRING, data STRUCT<path: STRUCT<text: STRING>, lines: STRUCT<text: STRING>, line_number: INT, submatches: ARRAY<STRUCT<match: STRUCT<text: STRING>>>>"
AST_GREP = "file STRING, message STRING, ruleId STRING, rule_id STRING, range STRUCT<start: STRUCT<line: INT>>"
SEMGREP = "results ARRAY<STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT>, extra: STRUCT<severity: STRING, message: STRING>>>, paths STRUCT<scanned: ARRAY<STRING>>, time STRUCT<rules: ARRAY<STRING>>"
GITLEAKS = "ARRAY<STRUCT<RuleID: STRING, File: STRING, StartLine: INT, Description: STRING, Secret: STRING>>"
SYFT = "artifacts ARRAY<STRUCT<name: STRING, version: STRING, type: STRING, locations: ARRAY<STRUCT<path: STRING>>, metadata: MAP<STRING, STRING>>>, source STRUCT<target: STRUCT<imageSize: BIGINT>>"
GRYPE = "matches ARRAY<STRUCT<vulnerability: STRUCT<id: STRING, severity: STRING, fix: STRUCT<state: STRING>>, artifact: STRUCT<name: STRING, type: STRING>>>"


def ndjson(files: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(path, pos, r) of the lines of (path, text), and files with a line that isn't an object (S6, S7): such a file fails whole."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    parsed = lines.withColumn("ok", F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)))
    bad = parsed.groupBy("path").agg(F.bool_and("ok").alias("ok")).where("not ok").select("path")
    good = parsed.join(bad, "path", "left_anti").select("path", "pos", F.from_json("line", schema).alias("r"))
    return good, bad.withColumn("reason", F.lit("malformed_line"))


def ripgrep_matches(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, pos, pattern, file, line, snippet) of match events only."""
    good, bad = ndjson(files, RIPGREP)
    d = F.col("r.data")
    rows = good.where("r.type = 'match'").select(
        "path", "pos", F.get(d["submatches"], F.lit(0))["match"]["text"].alias("pattern"), d["path"]["text"].alias("file"), d["line_number"].alias("line"),
        F.regexp_replace(d["lines"]["text"], r"\s+\z", "").alias("snippet"),
    )
    return rows, bad


def ast_grep_findings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = ndjson(files, AST_GREP)
    return good.select("path", "pos", "r.file", F.coalesce("r.ruleId", "r.rule_id").alias("rule"), F.col("r.range.start.line").alias("line"), "r.message"), bad


def semgrep_findings(files: DataFrame) -> DataFrame:
    """(report, rule, file, line, severity, message): severity in lower case."""
    rows = files.select(F.col("path").alias("report"), F.inline(F.from_json("text", SEMGREP)["results"]))
    return rows.select("report", F.col("check_id").alias("rule"), F.col("path").alias("file"), F.col("start.line").alias("line"), F.lower("extra.severity").alias("severity"), "extra.message")


def semgrep_summary(files: DataFrame) -> DataFrame:
    j = F.from_json("text", SEMGREP)
    return files.select("path", F.size(j["paths"]["scanned"]).alias("files_scanned"), F.size(j["time"]["rules"]).alias("rules"))


def gitleaks_findings(files: DataFrame) -> DataFrame:
    """(path, rule, file, line, description, fingerprint) in (file, line, rule) order; the secret is never selected."""
    rows = files.select(F.col("path").alias("report"), F.inline(F.from_json("text", GITLEAKS)))
    return rows.select(
        "report", F.col("RuleID").alias("rule"), F.col("File").alias("file"), F.col("StartLine").alias("line"), F.col("Description").alias("description"),
        F.left(F.sha2("Secret", 256), F.lit(8)).alias("fingerprint"),
    ).orderBy("file", "line", "rule")


def packages(files: DataFrame) -> DataFrame:
    """(path, name, version, type, native, locations) of a bill of materials (S10); unknown fields are ignored."""
    rows = files.select("path", F.inline(F.from_json("text", SYFT)["artifacts"]))
    native = F.coalesce(F.try_element_at("metadata", F.lit("type")) == "native", F.lit(False))
    return rows.select("path", "name", "version", "type", native.alias("native"), F.transform("locations", lambda x: x["path"]).alias("locations"))


def vulnerability_matches(files: DataFrame) -> DataFrame:
    """(path, cve, severity, fix_state, package, package_type)."""
    rows = files.select("path", F.inline(F.from_json("text", GRYPE)["matches"]))
    return rows.select("path", F.col("vulnerability.id").alias("cve"), F.col("vulnerability.severity").alias("severity"), F.col("vulnerability.fix.state").alias("fix_state"), F.col("artifact.name").alias("package"), F.col("artifact.type").alias("package_type"))


def upstream_digest(text: Column) -> Column:
    """Digest that an earlier report names; no report, malformed, no field and an empty one are all null."""
    return F.nullif(F.try_variant_get(F.try_parse_json(text), "$.image.digest", "string"), F.lit(""))


def image_reference(values: Column) -> Column:
    """Image of chart values in its four shapes (F17): text, repository with tag, repository alone; a tag alone is none."""
    def at(path: str) -> Column:
        return F.try_variant_get(values, path, "string")

    repo, tag = at("$.image.repository"), at("$.image.tag")
    flat = F.when(F.schema_of_variant(F.try_variant_get(values, "$.image", "variant")) == "STRING", at("$.image"))
    return F.coalesce(flat, F.concat(repo, F.lit(":"), tag), repo)


def containers(manifests: DataFrame) -> DataFrame:
    """(id, kind, name, image) of the containers of pods and of templates (F19); manifests has (id, value)."""
    kind = F.try_variant_get("value", "$.kind", "string")
    spec = F.when(kind == "Pod", F.try_variant_get("value", "$.spec.containers", "array<variant>")).when(
        kind.isin("Deployment", "StatefulSet", "DaemonSet", "Job", "ReplicaSet"), F.try_variant_get("value", "$.spec.template.spec.containers", "array<variant>")
    )
    rows = manifests.select("id", kind.alias("kind"), F.explode(spec).alias("c"))
    return rows.select("id", "kind", F.try_variant_get("c", "$.name", "string").alias("name"), F.try_variant_get("c", "$.image", "string").alias("image"))


def workflow_steps(docs: DataFrame) -> DataFrame:
    """(id, job, pos, run, uses) of jobs.*.steps[]."""
    jobs = "jobs MAP<STRING, STRUCT<steps: ARRAY<STRUCT<run: STRING, uses: STRING>>>>"
    rows = docs.select("id", F.explode(F.from_json("text", jobs)["jobs"]).alias("job", "j"))
    return rows.select("id", "job", F.posexplode("j.steps").alias("pos", "s")).select("id", "job", "pos", "s.run", "s.uses")


def pipeline_scripts(docs: DataFrame) -> DataFrame:
    """(id, job, pos, line) of script and before_script, a text or a list."""
    rows = docs.select("id", F.explode(F.from_json("text", "map<string,string>")).alias("job", "body"))
    body = F.try_parse_json("body")
    parts = [
        F.coalesce(F.try_variant_get(body, f"$.{k}", "array<string>"), F.when(F.try_variant_get(body, f"$.{k}", "string").isNotNull(), F.array(F.try_variant_get(body, f"$.{k}", "string"))), F.array().cast("array<string>"))
        for k in ("before_script", "script")
    ]
    return rows.select("id", "job", F.posexplode(F.concat(*parts)).alias("pos", "line"))


def shell_steps(text: Column) -> Column:
    """Commands of `sh '...'` steps."""
    return F.regexp_extract_all(text, F.lit(r"""\bsh\s*\(?\s*(['"])(.*?)\1"""), F.lit(2))


def secret_names(text: Column) -> Column:
    """Sorted names of ${{ secrets.NAME }}."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{\{\s*secrets\.([A-Za-z_]\w*)\s*\}\}"), F.lit(1))))
