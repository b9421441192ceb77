"""Facts of repositories from a table of files (repo, path, content): counts, tools, digests, reflection, refs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import DECORATOR_PACKAGES, MONOREPO_MARKS, SKIPPED_DIRS, TEST_SUFFIXES
from ledgerlens.operators.ledger import digest_sql, ordered_digest
from ledgerlens.registry import REGISTRY, table


def skipped(path: Column) -> Column:
    """Whether a folder of the path is one that walks leave out."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*map(F.lit, SKIPPED_DIRS)))


def test_file_count(files: DataFrame) -> DataFrame:
    """Test files of each repository by suffix, those in skipped folders left out."""
    hit = F.lit(False)
    for s in TEST_SUFFIXES:
        hit = hit | F.col("path").endswith(s)
    return files.groupBy("repo").agg(F.count_if(hit & ~skipped(F.col("path"))).alias("test_files"))


def language_counts(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """(repo, language, n) by case-folded extension (A5); `languages` maps extensions to names."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    name = F.coalesce(*[F.when(ext == e, F.lit(n)) for e, n in languages.items()])
    return files.where(~skipped(F.col("path"))).select("repo", name.alias("language")).where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("n"))


def monorepo_tool(files: DataFrame) -> DataFrame:
    """(repo, tool, markers): first tool in order, all marks sorted (M10); package.json counts if it has workspaces."""
    rank, tool = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (mark, name) in enumerate(MONOREPO_MARKS):
        rank, tool = F.when(F.col("path") == mark, i).otherwise(rank), F.when(F.col("path") == mark, name).otherwise(tool)
    spaces = F.try_variant_get(F.try_parse_json("content"), "$.workspaces", "variant")
    filled = spaces.isNotNull() & ~F.to_json(spaces).isin("[]", "{}", "false", "null", '""', "0")
    hits = files.select("repo", "path", rank.alias("r"), tool.alias("t"), filled.alias("w")).where("r is not null and (path <> 'package.json' or w)")
    return hits.groupBy("repo").agg(F.min_by("t", "r").alias("tool"), F.array_sort(F.collect_set("path")).alias("markers"))


#: Patterns that come near the tree queries for reflection: calls are seen by text, also inside strings and comments.
REFLECTION = {
    "eval_usage": r"(?<![\w.$])eval\s*\(",
    "function_constructor_usage": r"\bnew\s+Function\s*\(",
    "dynamic_require": r"(?<![\w.$])require\s*\(\s*[A-Za-z_$][\w$]*\s*\)",
    "dynamic_import": r"(?<![\w.$])import\s*\(\s*[A-Za-z_$][\w$]*\s*\)",
    "prototype_manipulation": r"\.(?:prototype|__proto__)\b",
    "decorator": r"(?m)^\s*@[A-Za-z_$][\w$.]*",
    "env_read": r"\bprocess\.env\b",
}


def reflection(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Per repository the count of each pattern, decorator flags and their impact on confidence."""
    counts = files.groupBy("repo").agg(*[F.coalesce(F.sum(F.regexp_count("content", F.lit(p))), F.lit(0)).alias(n) for n, p in REFLECTION.items()])
    flags = dependencies.groupBy("repo").agg(*[F.bool_or(F.col("package") == p).alias(f"uses_{n}") for n, p in DECORATOR_PACKAGES])
    joined = counts.join(flags, "repo", "left").na.fill({f"uses_{n}": False for n, _ in DECORATOR_PACKAGES})
    any_count, any_flag = F.lit(False), F.lit(False)
    for n in REFLECTION:
        any_count = any_count | (F.col(n) > 0)
    for n, _ in DECORATOR_PACKAGES:
        any_flag = any_flag | F.col(f"uses_{n}")
    impact = F.when((F.col("eval_usage") > 0) | (F.col("function_constructor_usage") > 0), "high").when(~any_count & ~any_flag, "low").otherwise("medium")
    return joined.withColumn("confidence_impact", impact)


def tree_digest(files: DataFrame, content: bool = False) -> DataFrame:
    """(repo, digest) over sorted (path, size), or with contents (A17, D4: sizes alone miss an edit of equal size)."""
    size = F.octet_length("content").cast("string")
    line = F.concat_ws(chr(31), "path", size, *([F.sha2("content", 256)] if content else []))
    return ordered_digest(files, ["repo"], ["path"], line).select("repo", "digest")


def policy_refs(docs: DataFrame) -> DataFrame:
    """(id, pos, name, path) of a document's policy entries; entries that aren't objects are left out (M9)."""
    entries = F.try_variant_get(F.try_parse_json("text"), "$.policies", "array<variant>")
    rows = docs.select("id", F.posexplode(entries).alias("pos", "p")).where(F.schema_of_variant("p").startswith("OBJECT"))
    return rows.select("id", "pos", F.try_variant_get("p", "$.name", "string").alias("name"), F.try_variant_get("p", "$.path", "string").alias("path"))


def edited_dependency(manifests: DataFrame, package: str, version: str) -> DataFrame:
    """(repo, section, edited): the first section with the package, its version replaced."""
    sections = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
    doc = manifests
    for s in sections:
        doc = doc.withColumn(s, F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>"))
    has = [F.coalesce(F.map_contains_key(s, package), F.lit(False)) for s in sections]
    section = F.coalesce(*[F.when(h, F.lit(s)) for h, s in zip(has, sections)])
    chosen = F.coalesce(*[F.when(h, F.col(s)) for h, s in zip(has, sections)])
    edited = F.transform_values(chosen, lambda k, v: F.when(k == package, F.lit(version)).otherwise(v))
    return doc.select("repo", section.alias("section"), edited.alias("edited")).where("section is not null")


def band_dispatch(queries: DataFrame, adapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query with its adapter, queries whose primitive has none)."""
    return queries.join(adapters, "primitive"), queries.join(adapters, "primitive", "left_anti")


def snapshots(files: DataFrame) -> DataFrame:
    """(repo, git_commit) of every repository of a table of files (S29): what its HEAD stands for, null where that can't be told.

    HEAD is a commit itself, or names a ref: that ref's own file, else its line among the packed refs.
    """
    head = files.where("path = '.git/HEAD'").select("repo", F.trim(F.regexp_replace("content", r"\n", "")).alias("head"))
    named = head.withColumn("ref", F.nullif(F.regexp_extract("head", r"\Aref: (.+)\z", 1), F.lit("")))
    loose = files.where("path like '.git/refs/%'").select("repo", F.substring("path", F.lit(6), F.length("path")).alias("ref"), F.trim(F.regexp_replace("content", r"\n", "")).alias("loose"))
    lines = files.where("path = '.git/packed-refs'").select("repo", F.explode(F.split("content", "\n")).alias("line"))
    packed = lines.select("repo", F.regexp_extract("line", r"\A([0-9a-f]{40}) (.+)\z", 2).alias("ref"), F.regexp_extract("line", r"\A([0-9a-f]{40}) (.+)\z", 1).alias("packed")).where("ref <> ''").dropDuplicates(["repo", "ref"])
    found = named.join(loose, ["repo", "ref"], "left").join(packed, ["repo", "ref"], "left")
    commit = F.when(F.col("ref").isNull(), F.col("head")).otherwise(F.coalesce("loose", "packed"))
    known = found.select("repo", F.when(commit.rlike(r"\A[0-9a-f]{40}\z"), commit).alias("git_commit"))
    return files.select("repo").distinct().join(known, "repo", "left")


_FILES = "(SELECT source AS repo, lpad(doc_id::VARCHAR, 9, '0') AS path, strlen(text) AS size FROM documents)"


@REGISTRY.query("tree_digest", f"SELECT repo, digest FROM ({digest_sql(_FILES, 'repo', 'path', 'path || chr(31) || size')})")
def tree_digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    return tree_digest(files)
