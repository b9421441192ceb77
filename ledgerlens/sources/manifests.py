"""Manifests and rule catalogues in YAML: checked against their schema, walked to rows, bad files as rejects.

A file is good as a whole or rejected as a whole, with the first reason that holds: `parse` (what the YAML reader
refuses), `schema`, or the reader's own finer reasons named below. The walk is column functions over variants, so a file
is one row until its queries are exploded, and only the look for an id in several files is a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerlens.functions.fixed import CONFIDENCE_LEVELS, CONTEXT_BANDS, CONTEXT_PRIMITIVES, IMPORT_PATH, NAMESPACE, RULE_FIELDS, TASK_QUERIES
from ledgerlens.registry import REGISTRY, table
from ledgerlens.sources.files import capped_files, yaml_rows

MAX_BYTES = 64 * 1024
#: A query may fall back so many times.
MAX_FALLBACKS = 8


class NothingReadable(ValueError):
    """None of the search paths can be read: the one fatal case of a load."""


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is there and of a kind: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, or a longer prefix."""
    return v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _keys(v: Column) -> Column:
    return F.map_keys(_at(v, "$", "map<string,variant>"))


def _only(v: Column, *names: str) -> Column:
    """Whether an object has no other keys."""
    return F.size(F.array_except(_keys(v), F.array(*map(F.lit, names)))) == 0


def _list(v: Column, path: str) -> Column:
    """The list at a path; an empty one where there is none."""
    return F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _list_or_none(v: Column, path: str) -> Column:
    there = _at(v, path)
    return there.isNull() | _is(there, "ARRAY")


def _first(*cases: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for bad, reason in cases])


def _parsed(files: DataFrame, ident: list[str]) -> DataFrame:
    """A row for each document with it as variant `v`, and one with `refused` for what YAML refuses: one frame, so that no
    file is read once for its rows and once more for its rejects."""
    keyed = files.withColumn("file", F.to_json(F.struct(*ident)))
    read = yaml_rows(keyed.select(F.col("file").alias("path"), "text"), MAX_BYTES)
    from_key = F.from_json("path", ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in ident)).alias("k")
    return read.select(from_key, "pos", F.try_parse_json("json").alias("v"), F.concat(F.lit("parse:"), "reason").alias("refused")).select("k.*", "pos", "v", "refused")


def _checked(docs: DataFrame, keys: list[str], reason: Column) -> DataFrame:
    """Rows of `_parsed` with their reason, if any. A file of several documents is one bad file: its later documents are the reason."""
    n = F.count("*").over(Window.partitionBy(*keys, F.col("refused").isNull()))
    # The reasons are computed first: a window below the filter on `pos` carries one text a row and not the expression.
    rows = docs.withColumn("reason", reason).withColumn("n", n).where("refused is not null or pos = 0")
    return rows.withColumn("reason", F.coalesce("refused", F.when(F.col("n") > 1, "schema"), "reason")).drop("n", "refused")


def _split(checked: DataFrame, ident: list[str]) -> tuple[DataFrame, DataFrame]:
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null").select(*ident, "reason")


def _query_issue(q: Column) -> Column:
    """What is wrong with one context query, its fallback aside."""
    args = _at(q, "$.args", "map<string,variant>")
    plain = lambda x: _is(x, "STRING") | _is(x, "BIGINT") | _is(x, "BOOLEAN") | _is(x, "ARRAY<STRING>") | _is(x, "ARRAY<VOID>")
    most = _at(q, "$.max_files")
    fallback = _at(q, "$.fallback")
    return _first(
        (~_is(q, "OBJECT"), "schema"), (~_only(q, "primitive", "args", "fallback", "max_files"), "schema"), (~_is(_at(q, "$.primitive"), "STRING"), "schema"),
        (~_at(q, "$.primitive", "string").isin(*CONTEXT_PRIMITIVES), "unknown_primitive"), (~_is(_at(q, "$.args"), "OBJECT"), "schema"),
        (F.exists(F.map_values(args), lambda x: ~plain(x)), "schema"), (most.isNotNull() & ~F.is_variant_null(most) & ~_is(most, "BIGINT"), "schema"),
        (_at(q, "$.max_files", "bigint") <= 0, "negative_max_files"), (fallback.isNotNull() & ~F.is_variant_null(fallback) & ~_is(fallback, "OBJECT"), "schema"),
    )


def _names_issue(v: Column) -> Column:
    """What is wrong with provides, {namespace: {name: import path}}, and requires, {namespace: [name]}."""
    word, path = rf"\A{NAMESPACE}\z", rf"\A{IMPORT_PATH}\z"
    provides, requires = _at(v, "$.provides"), _at(v, "$.requires")
    inner = F.map_values(_at(v, "$.provides", "map<string,variant>"))
    lists = F.map_values(_at(v, "$.requires", "map<string,variant>"))
    some_key = lambda m: F.exists(_keys(m), lambda k: ~k.rlike(word))
    return _first(
        (provides.isNotNull() & (~_is(provides, "OBJECT") | some_key(provides)), "schema"), (requires.isNotNull() & (~_is(requires, "OBJECT") | some_key(requires)), "schema"),
        (F.exists(inner, lambda m: ~_is(m, "OBJECT") | some_key(m) | F.exists(F.map_values(_at(m, "$", "map<string,variant>")), lambda p: ~_is(p, "STRING") | ~_at(p, "$", "string").rlike(path))), "schema"),
        (F.exists(lists, lambda m: ~_is(m, "ARRAY") | F.exists(_at(m, "$", "array<variant>"), lambda n: ~_is(n, "STRING") | ~_at(n, "$", "string").rlike(word))), "schema"),
    )


def context_queries(files: DataFrame, ident: str = "plugin") -> tuple[DataFrame, DataFrame]:
    """(ident, path, band, pos, step, primitive, args, max_files) of context manifests, and rejects (ident, path, reason).

    files: (ident, path, text), one document a file. `step` is 0 for a query, 1 for its fallback, and so on; args is
    JSON with sorted keys. Finer reasons: `unknown_primitive`, `negative_max_files`, `too_many_fallbacks`, and `duplicate_id` for all but the
    first path of an ident whose file is good. must_read has to be there; other bands may be missing.
    """
    keys = [ident, "path"]
    docs = _parsed(files, keys)
    v = F.col("v")
    placed = lambda band: F.transform(_list(v, f"$.{band}"), lambda q, i: F.struct(F.lit(band).alias("band"), i.alias("pos"), q.alias("q")))
    bands = [placed(b) for b in CONTEXT_BANDS]
    chain = lambda e: F.filter(
        F.array(*[F.struct(e["band"].alias("band"), e["pos"].alias("pos"), F.lit(k).alias("step"), _at(e["q"], "$" + ".fallback" * k).alias("q")) for k in range(MAX_FALLBACKS + 1)]),
        lambda s: s["q"].isNotNull() & ((s["step"] == 0) | ~F.is_variant_null(s["q"])),
    )
    walked = docs.withColumn("steps", F.flatten(F.transform(F.concat(*bands), chain)))
    issue = F.get(F.filter(F.transform("steps", lambda s: _query_issue(s["q"])), lambda r: r.isNotNull()), F.lit(0))
    reason = F.coalesce(
        _first(
            (F.col("pos") > 0, "schema"), (~_is(v, "OBJECT"), "schema"), (~_only(v, *CONTEXT_BANDS, "provides", "requires"), "schema"), (~_is(_at(v, "$.must_read"), "ARRAY"), "schema"),
            (~_list_or_none(v, "$.should_read") | ~_list_or_none(v, "$.may_read"), "schema"),
        ),
        _names_issue(v), issue, _first((F.exists("steps", lambda s: s["step"] == MAX_FALLBACKS), "too_many_fallbacks")),
    )
    checked = _checked(walked, keys, reason)
    nth = F.row_number().over(Window.partitionBy(ident, F.col("reason").isNull()).orderBy("path"))
    unique = checked.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), "duplicate_id").otherwise(F.col("reason")))
    good, rejects = _split(unique.select(*keys, "steps", "reason"), keys)
    rows = good.select(*keys, F.explode("steps").alias("s"))
    return rows.select(
        *keys, "s.band", "s.pos", "s.step", _at(F.col("s.q"), "$.primitive", "string").alias("primitive"), F.to_json(_at(F.col("s.q"), "$.args")).alias("args"), _at(F.col("s.q"), "$.max_files", "bigint").alias("max_files"),
    ), rejects


def task_queries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, task_class, pos, compute, arg) of task manifests' derived queries, and rejects (path, reason).

    Finer reason: `unknown_query_primitive`. Lists may be empty and may repeat an item.
    """
    docs = _parsed(files, ["path"])
    v = F.col("v")
    queries = _list(v, "$.derived_queries")
    arg_of = lambda q: F.coalesce(*[F.when(_at(q, "$.compute", "string") == c, _at(q, f"$.{a}")) for c, a in TASK_QUERIES.items()])
    only = lambda q: F.coalesce(*[F.when(_at(q, "$.compute", "string") == c, _only(q, "compute", a)) for c, a in TASK_QUERIES.items()])
    known = lambda q: _is(_at(q, "$.compute"), "STRING") & _at(q, "$.compute", "string").isin(*TASK_QUERIES)
    strings = lambda path: ~_is(_at(v, path), "ARRAY") | F.exists(_list(v, path), lambda x: ~_is(x, "STRING"))
    floor = _at(v, "$.confidence_floor")
    level = _at(v, "$.confidence_floor.kind", "string")
    reason = _first(
        (F.col("pos") > 0, "schema"), (~_is(v, "OBJECT"), "schema"), (F.exists(queries, lambda q: _is(q, "OBJECT") & ~known(q)), "unknown_query_primitive"),
        (~_only(v, "schema_version", "task_class", "required_probes", "required_skills", "derived_queries", "confidence_floor"), "schema"),
        (~_is(_at(v, "$.schema_version"), "STRING") | (_at(v, "$.schema_version", "string") != "1"), "schema"), (~_is(_at(v, "$.task_class"), "STRING"), "schema"),
        (strings("$.required_probes") | strings("$.required_skills") | ~_is(_at(v, "$.derived_queries"), "ARRAY"), "schema"),
        (F.exists(queries, lambda q: ~_is(q, "OBJECT") | ~only(q) | ~_is(arg_of(q), "STRING")), "schema"),
        (~_is(floor, "OBJECT") | ~_only(floor, "kind", "reason") | level.isNull() | ~level.isin(*CONFIDENCE_LEVELS), "schema"),
        ((level != "trusted") & ~_is(_at(v, "$.confidence_floor.reason"), "STRING") | (level == "trusted") & _at(v, "$.confidence_floor.reason").isNotNull(), "schema"),
    )
    checked = _checked(docs, ["path"], reason)
    good, rejects = _split(checked.select("path", "v", "reason"), ["path"])
    rows = good.select("path", _at(v, "$.task_class", "string").alias("task_class"), F.posexplode(queries).alias("pos", "q"))
    return rows.select("path", "task_class", "pos", _at(F.col("q"), "$.compute", "string").alias("compute"), F.variant_get(arg_of(F.col("q")), "$", "string").alias("arg")), rejects


@F.pandas_udf(BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    def ok(p: str | None) -> bool:
        try:
            re.compile(p or "", re.MULTILINE)
        except re.error:
            return False
        return True

    return patterns.map(ok)


def convention_rules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, pos, id, kind, description, pattern, file_glob) of catalogues of rules, and rejects (path, reason).

    A file is `rules: [..]`, each rule of a known kind with exactly its fields. Finer reasons: `unknown_pattern_type`, and
    `bad_regex` for a pattern that doesn't compile. Rules of all good files together make the catalogue; an id may come twice.
    """
    docs = _parsed(files, ["path"])
    v = F.col("v")
    rules = _list(v, "$.rules")
    common = ("kind", "id", "description")
    kind = lambda r: _at(r, "$.kind", "string")
    unknown = lambda r: _is(r, "OBJECT") & (~_is(_at(r, "$.kind"), "STRING") | ~kind(r).isin(*RULE_FIELDS))

    def wrong(r: Column) -> Column:
        shape = F.coalesce(*[F.when(kind(r) == k, _only(r, *common, *more) & _all_strings(r, ("id", "description", *more))) for k, more in RULE_FIELDS.items()])
        return ~_is(r, "OBJECT") | ~shape

    reason = _first(
        (F.col("pos") > 0, "schema"), (~_is(v, "OBJECT"), "schema"), (F.exists(rules, unknown), "unknown_pattern_type"), (~_only(v, "rules") | ~_is(_at(v, "$.rules"), "ARRAY"), "schema"), (F.exists(rules, wrong), "schema"),
    )
    checked = _checked(docs, ["path"], reason)
    good, rejects = _split(checked.select("path", "v", "reason"), ["path"])
    fields = [_at(F.col("r"), f"$.{f}", "string").alias(f) for f in ("id", "kind", "description", "pattern", "file_glob")]
    rows = good.select("path", F.posexplode(rules).alias("pos", "r")).select("path", "pos", *fields).withColumn("ok", _compiles("pattern"))
    broken = rows.where("not ok").select("path").distinct()
    return rows.join(broken, "path", "left_anti").drop("ok"), rejects.unionByName(broken.withColumn("reason", F.lit("bad_regex")))


def _all_strings(r: Column, names: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for n in names:
        found = found & _is(_at(r, f"$.{n}"), "STRING")
    return found


def loaded(spark: SparkSession, paths: list[str], parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """What `parse` makes of the YAML files of all search paths, and its rejects with those of files over the cap.

    A path that can't be read is left out; where none can, NothingReadable is raised. No path at all is an empty load.
    """
    good, over = [], []
    for p in paths:
        try:
            small, large = capped_files(spark, p, max_bytes, "*.{yaml,yml}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        good.append(small)
        over.append(large)
    if paths and not good:
        raise NothingReadable(f"no search path is readable: {', '.join(paths)}")
    files = spark.createDataFrame([], "path string, text string")
    rejects = spark.createDataFrame([], "path string, reason string")
    for small, large in zip(good, over):
        files, rejects = files.unionByName(small), rejects.unionByName(large)
    rows, bad = parse(files)
    return rows, bad.unionByName(rejects)


# Manifests made of parts: every 13th names an unknown primitive, every 17th asks for no files, every 19th has a strange key,
# every 23rd is no YAML; of two parts in a row with one plugin the first good path counts.
_PLUGIN = "'plugin-' || CAST(floor(p_partkey / 2) AS BIGINT)"
_PATH = "lpad(CAST(p_partkey AS STRING), 9, '0')"
_TEXT = """concat('must_read:\\n- primitive: ', CASE WHEN p_partkey % 13 = 0 THEN 'scip.unknown' ELSE 'scip.refs' END, '\\n  args: {symbol: "', p_name, '", exact: true, size: ', p_size, '}\\n  max_files: ',
 CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size END, CASE WHEN p_partkey % 3 = 0 THEN '\\n  fallback: {primitive: dep_graph.consumers, args: {pkg: [a, b]}}' ELSE '' END,
 CASE WHEN p_partkey % 5 = 0 THEN '\\nmay_read:\\n- primitive: import_graph.reverse_lookup\\n  args: {}\\n- primitive: import_graph.reverse_lookup\\n  args: {module: m}' ELSE '' END,
 CASE WHEN p_partkey % 19 = 0 THEN '\\nextra: 1' ELSE '' END, CASE WHEN p_partkey % 23 = 0 THEN '\\n  - : [' ELSE '' END, '\\n')"""


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    return context_queries(part.select(F.expr(_PLUGIN).alias("plugin"), F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("text")))


_MADE = """
p AS (SELECT 'plugin-' || p_partkey // 2 AS plugin, lpad(p_partkey::VARCHAR, 9, '0') AS path, p_partkey AS k, p_name, p_size,
             CASE WHEN p_partkey % 23 = 0 THEN 'parse:malformed' WHEN p_partkey % 19 = 0 THEN 'schema' WHEN p_partkey % 13 = 0 THEN 'unknown_primitive' WHEN p_partkey % 17 = 0 THEN 'negative_max_files' END AS why FROM part),
r AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY plugin, why IS NULL ORDER BY path) > 1 THEN 'duplicate_id' ELSE why END AS reason FROM p)
"""


@REGISTRY.query(
    "context_manifests",
    f"""
    WITH {_MADE}
    SELECT plugin, path, 'must_read' AS band, 0 AS pos, 0 AS step, 'scip.refs' AS primitive, '{{"exact":true,"size":' || p_size || ',"symbol":"' || p_name || '"}}' AS args, p_size::BIGINT AS max_files FROM r WHERE reason IS NULL
    UNION ALL SELECT plugin, path, 'must_read', 0, 1, 'dep_graph.consumers', '{{"pkg":["a","b"]}}', NULL FROM r WHERE reason IS NULL AND k % 3 = 0
    UNION ALL SELECT plugin, path, 'may_read', i, 0, 'import_graph.reverse_lookup', ['{{}}', '{{"module":"m"}}'][i + 1], NULL FROM r, (VALUES (0), (1)) v(i) WHERE reason IS NULL AND k % 5 = 0
    """,
)
def context_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir)[0]


@REGISTRY.query("manifest_rejects", f"WITH {_MADE} SELECT plugin, path, reason FROM r WHERE reason IS NOT NULL")
def manifest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir)[1]
