"""File sources: size caps, JSON with comments, YAML, nesting depth, layered configuration.

Files are read by Spark only; what a parser refuses becomes a reject row with a reason, never an exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.tables import descended, spread


def capped_files(spark: SparkSession, path: str, max_bytes: int, glob: str = "*", excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(path, content) of files under the cap and (path, reason) of the others (S1, S23, S33). The length filter reaches the
    source, so a file that is too large isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    for name in excluded:
        files = files.where(~F.array_contains(F.split("path", "/"), name))
    good = files.where(F.col("length") <= max_bytes).select("path", F.col("content").cast("string").alias("text"))
    return good, files.where(F.col("length") > max_bytes).select("path", F.lit("size_cap_exceeded").alias("reason"))


def json_depth(text: Column, root: int = 0) -> Column:
    """Deepest nesting of JSON text; the root container has depth `root` (S5, F31, D17: 0, or 1 with scalars at 0)."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.greatest(F.aggregate(marks, start, step, lambda s: s["most"]) - 1 + root, F.lit(0))


def without_comments(text: Column) -> Column:
    """JSON text without // and /* */ comments; those inside strings stay (S3). Possessive, so no input backtracks."""
    return F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/', "$1")


def json_objects(files: DataFrame, max_depth: int = 64, comments: bool = False) -> tuple[DataFrame, DataFrame]:
    """(path, value variant) of files that are one JSON object, rejects by reason."""
    text = without_comments(F.col("text")) if comments else F.col("text")
    parsed = files.withColumn("clean", text).withColumn("value", F.try_parse_json("clean"))
    reason = (
        F.when(F.col("value").isNull(), "malformed").when(~F.schema_of_variant("value").startswith("OBJECT"), "not_an_object")
        .when(json_depth(F.col("clean")) > max_depth, "too_deep")
    )
    checked = parsed.withColumn("reason", reason)
    return checked.where("reason is null").select("path", "value"), checked.where("reason is not null").select("path", "reason")


def yaml_documents(files: DataFrame, max_bytes: int = 1 << 20, max_depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """(path, pos, json) of every YAML document of (path, text), rejects by reason (S4, S13). Aliases are counted for what
    they expand to before anything is expanded: a document deeper than `max_depth`, one of more than `2 * max_bytes`
    characters, and one that holds itself are rejects."""
    out = yaml_rows(files, max_bytes, max_depth)
    return out.where("reason is null").drop("reason"), out.where("reason is not null").select("path", "reason")


def yaml_rows(files: DataFrame, max_bytes: int = 1 << 20, max_depth: int = 64) -> DataFrame:
    """(path, pos, json, reason): documents and rejects of `yaml_documents` together. Small tables may hold many files, so they are dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or len(text.encode("utf-8", "replace")) > max_bytes:
                    rows.append((path, None, None, "size_cap_exceeded" if text else "empty"))
                    continue
                try:
                    for pos, doc in enumerate(yaml.load_all(text, loader)):
                        fault = _fault(doc, max_depth, 2 * max_bytes)
                        rows.append((path, pos, None if fault else json.dumps(doc, default=str), fault))
                except (yaml.YAMLError, ValueError, TypeError):
                    rows.append((path, None, None, "malformed"))
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "pos", "json", "reason"])

    return spread(files.select("path", "text"), "path").mapInArrow(run, "path string, pos int, json string, reason string")


def _fault(value: object, max_depth: int, max_size: int) -> str | None:
    """What is wrong with a value's depth or size with every alias expanded; each container is looked at once."""
    done: dict[int, tuple[int, int]] = {}  # height and size of a container
    going: set[int] = set()
    stack: list[tuple[object, bool]] = [(value, False)]
    while stack:
        v, after = stack.pop()
        if not isinstance(v, (dict, list, set, tuple)):
            continue
        inside = [*v, *v.values()] if isinstance(v, dict) else list(v)
        if after:
            going.discard(id(v))
            height, size = 0, 2
            for x in inside:
                h, n = done.get(id(x), (0, 0)) if isinstance(x, (dict, list, set, tuple)) else (0, len(str(x)))
                height, size = max(height, h), size + n + 1
            done[id(v)] = (height + 1, size)
            if height > max_depth:
                return "too_deep"
            if size > max_size:
                return "expands_too_far"
        elif id(v) in going:
            return "holds_itself"
        elif id(v) not in done:
            going.add(id(v))
            stack.append((v, True))
            stack += [(x, False) for x in inside]
    return None


def layered(df: DataFrame, known: list[str], layers: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scope, key, value) from the strongest layer that has it, and unknown keys (S28). df has (scope, layer, key, value)."""
    rank = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    good = df.where(F.col("key").isin(*known)).groupBy("scope", "key").agg(F.max_by("value", rank).alias("value"))
    return good, df.where(~F.col("key").isin(*known)).select("scope", "layer", "key")


def digest_map(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, name, digest) of `{name: hex64}` files and the bad entries."""
    rows = df.select("path", F.explode(F.from_json("text", "map<string,string>")).alias("name", "digest"))
    ok = F.col("digest").rlike(r"\A[0-9a-f]{64}\z") & (F.col("name") != "")
    return rows.where(ok), rows.where(~F.coalesce(ok, F.lit(False)))


def rule_catalogue(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, pos, rule) of all readable rule files and one error a bad file (S30, S31). Fatal is: both empty of rules."""
    parsed = files.withColumn("rules", F.from_json("text", "array<struct<id:string,kind:string,pattern:string>>"))
    bad = F.col("rules").isNull() | F.exists("rules", lambda r: r["id"].isNull())
    good = parsed.where(~bad).select("path", F.posexplode("rules").alias("pos", "rule")).select("path", "pos", "rule.*")
    return good, parsed.where(bad).select("path", F.lit("malformed_rules").alias("reason"))


def string_leaves(spark: SparkSession, docs: str) -> DataFrame:
    """(id, path, leaf) of every string leaf of a variant (F21); `docs` is a view or query with (id, value)."""

    def inside(level: DataFrame) -> DataFrame:
        opened = level.where("leaf is null").select("id", F.col("path").alias("above"), F.col("value").alias("node"))
        rows = opened.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        return _leaves(rows.select("id", F.concat("above", F.lit("."), F.coalesce("key", F.col("pos").cast("string"))).alias("path"), "value"))

    roots = spark.sql(f"SELECT id, CAST('$' AS STRING) AS path, value FROM {docs}")
    return descended(_leaves(roots), inside).where("leaf is not null").select("id", "path", "leaf")


def _leaves(values: DataFrame) -> DataFrame:
    """(id, path, leaf, value) of texts and containers: a text as leaf, a container as value; other values hold no text."""
    kind = F.schema_of_variant("value")
    text, container = kind == "STRING", kind.startswith("OBJECT") | kind.startswith("ARRAY")
    rows = values.where(text | container)
    return rows.select("id", "path", F.when(text, F.try_variant_get("value", F.lit("$"), "string")).alias("leaf"), F.when(container, F.col("value")).alias("value"))
