"""Sinks: partitioned tables, keyed appends, rendered sections. Spark's commit protocol makes a write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import MAX_RECORD_BYTES
from ledgerlens.sources.commits import append_keyed, append_rows


def cache_records(entries: DataFrame, cap: int = MAX_RECORD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Entries (key, payload, created_at_unix_s, probe_name, probe_version) with their digest and index record, and those whose
    record is too long (K2): the record is JSON with sorted keys and a line feed, and has at most `cap` bytes."""
    with_digest = entries.withColumn("blob_sha256", F.sha2("payload", 256))
    record = F.concat(F.to_json(F.struct("blob_sha256", "created_at_unix_s", "key", "probe_name", "probe_version")), F.lit("\n"))
    made = with_digest.withColumn("record", record)
    fits = F.octet_length("record") <= cap
    return made.where(fits), made.where(~fits).select("key", F.octet_length("record").alias("record_bytes"), F.lit("record_too_long").alias("reason"))


def put_cache(entries: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> int:
    """Appends blobs, each content once, and then index records, partitioned by two hex digits of the digest (K2); how many records.

    A record is only there when its blob is: a writer that dies in between leaves blobs that nothing names.
    """
    good, _ = cache_records(entries)
    append_keyed(good.select("blob_sha256", "payload").distinct(), f"{path}/blobs", ["blob_sha256"], writer, batch)
    return append_rows(good.select("key", "blob_sha256", "record", F.left("blob_sha256", F.lit(2)).alias("shard")), f"{path}/index", writer, batch, partition_by=("shard",))


def leaf_name_issue(name: Column) -> Column:
    """Why a name can't be that of a raw artifact, null if it can (K1): it names one file of a folder."""
    return (
        F.when(name.isNull() | (name == ""), "empty").when(name.isin(".", ".."), "dots").when(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), "separator")
        .when(name.startswith(".") & name.endswith(".tmp"), "temporary")
    )


def publish(slices: DataFrame, artifacts: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> DataFrame:
    """Writes raw artifacts (repo, name, payload) first and the envelopes of their repositories last (K1); rejects (repo, name, issue).

    `slices` are redacted rows of `envelope`. A repository with a bad name publishes nothing, so a run without an envelope failed.
    """
    checked = artifacts.withColumn("issue", leaf_name_issue(F.col("name")))
    bad = checked.where("issue is not null").select("repo", "name", "issue")
    refused = bad.select("repo").distinct()
    append_rows(checked.where("issue is null").drop("issue").join(refused, "repo", "left_anti"), f"{path}/raw", writer, batch)
    append_rows(envelope(slices).join(refused, "repo", "left_anti"), f"{path}/envelopes", writer, batch)
    return bad


def append_new(rows: DataFrame, path: str, key: list[str], writer: str | None = None, batch: int | None = None) -> int:
    """Appends one row of each key that the table doesn't have (K3, K6) and returns how many it appended; see `commits`."""
    return append_keyed(rows, path, key, writer, batch)


def write_by_day(rows: DataFrame, path: str, ts: str) -> None:
    """JSON lines partitioned by UTC day."""
    rows.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").json(path)


def write_run(run: DataFrame, probes: DataFrame, path: str) -> None:
    """A run's row and its probes' rows (K9)."""
    run.write.mode("append").parquet(f"{path}/runs")
    probes.write.mode("append").parquet(f"{path}/probes")


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, json) of node-link form with sorted nodes and links (K8); for graphs that fit a document."""
    n = nodes.groupBy("graph").agg(F.array_sort(F.collect_set(F.struct("id"))).alias("nodes"))
    e = edges.groupBy("graph").agg(F.array_sort(F.collect_set(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("links"))
    return n.join(e, "graph", "left").select("graph", F.to_json(F.struct(F.lit(True).alias("directed"), "links", "nodes")).alias("json"))


def envelope(slices: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, json): probes.<name> documents of long rows (repo, probe, slice), keys sorted (K1, N7); a later row of a probe wins."""
    last = slices.groupBy(repo, "probe").agg(F.max_by("slice", "pos").alias("slice"))
    pairs = F.array_sort(F.collect_list(F.concat(F.substr(F.to_json(F.array("probe")), F.lit(2)), F.lit("\0"), F.col("slice"))))
    fields = F.transform(pairs, lambda p: F.concat(F.regexp_replace(F.split(p, "\0", 2)[0], r"\]\z", ""), F.lit(":"), F.split(p, "\0", 2)[1]))
    return last.groupBy(repo).agg(F.concat(F.lit('{"probes":{'), F.array_join(fields, ","), F.lit("}}")).alias("json"))


def confidence_section(indexes: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, markdown): one line an index by name; malformed rows say so."""
    at = F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.when(F.col("confidence").isNull(), "malformed").otherwise(
        F.concat(F.col("confidence"), F.lit(" at "), F.coalesce(F.left("commit", F.lit(8)), F.lit("unknown")), F.coalesce(F.concat(F.lit(", "), at), F.lit("")))
    )
    rows = indexes.select(repo, F.struct("name", F.concat(F.lit("- "), F.col("name"), F.lit(": "), said).alias("l")).alias("r"))
    return rows.groupBy(repo).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["l"]), "\n").alias("markdown"))


def report_issues(reports: DataFrame) -> DataFrame:
    """Reports that the sink refuses, by outcome-conditional rules."""
    outcome = F.col("outcome")
    issue = (
        F.when((outcome == "validated") & (F.col("branch").isNull() | F.col("transform").isNull()), "validated_without_branch")
        .when((outcome == "failed") & F.col("branch").isNotNull(), "failed_with_branch").when(~outcome.isin("validated", "failed", "skipped"), "unknown_outcome")
    )
    return reports.withColumn("issue", issue).where("issue is not null")


def query_text(fields: dict[str, Column]) -> Column:
    """Fixed rendering of a retrieval query."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in fields.items()])
