"""Landed vulnerability feeds (S22): files of a raw zone to records and rejects, in batch and as a stream.

A feed's folder holds files of one source. `lines`: a record a line. `documents`: a file is one JSON document, which is a
record, a list of them, or an object with a list of them under one of the source's own keys. Files are read by Spark's text source,
compressed or not, so large line files are split by byte ranges, in batch and as a stream.

A record that isn't JSON, as the last line of a file that was cut off, becomes a reject row with its file and reason; so does a
document that isn't. Blank lines are no records. A record's place is (file, payload): it doesn't depend on splits or on
the order of arrival, so both forms give the same rows. An empty file has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.feeds import KEY, SHAPES, normalised
from ledgerlens.sources import commits

#: Where a source's documents hold their records.
LIST_KEYS = {"nvd": "vulnerabilities", "osv": "vulns", "ghsa": "advisories"}


def _records(text: Column, source: str) -> Column:
    """The records of a document as JSON texts; a text that isn't JSON stands for itself."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    inner = F.try_variant_get(v, f"$.{LIST_KEYS[source]}", "array<variant>")
    whole = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(kind.startswith("OBJECT") & inner.isNotNull(), inner)
    return F.coalesce(F.transform(whole, lambda r: F.to_json(r)), F.array(text))


def landed(spark: SparkSession, path: str, source: str, layout: str = "lines", stream: bool = False, files_per_batch: int = 100) -> DataFrame:
    """(source, file, payload) of every record that a feed's folder holds."""
    if source not in SHAPES:
        raise ValueError(f"no feed is named {source!r}")
    if layout not in ("lines", "documents"):
        raise ValueError(f"a feed is of lines or documents, not {layout!r}")
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    text = reader.format("text").schema("value string").option("wholetext", layout == "documents").option("recursiveFileLookup", "true").load(path)
    rows = text.select(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    if layout == "documents":
        rows = rows.select("source", "file", F.explode(_records(F.col("payload"), source)).alias("payload"))
    return rows.where(F.trim("payload") != "")


def records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parsed records of `landed` rows, and the rejects (source, file, payload, reason)."""
    parsed = normalised(raw)
    good = parsed.where("reject_reason is null").drop("reject_reason", "payload")
    return good, parsed.where("reject_reason is not null").select("source", "file", "payload", F.col("reject_reason").alias("reason"))


def file_report(raw: DataFrame) -> DataFrame:
    """(source, file, records, rejects, first_reason) of each file that holds something."""
    reason = F.col("reject_reason")
    return normalised(raw).groupBy("source", "file").agg(F.count_if(reason.isNull()).alias("records"), F.count_if(reason.isNotNull()).alias("rejects"), F.min(reason).alias("first_reason"))


def ingest(raw: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> tuple[int, int]:
    """Adds what a feed landed to the table of records and to that of rejects; how many rows of each are new.

    Of a key the first writer wins (D6); of several records of a batch with one key the least. The same reject of the same
    file is kept once, so files may be read again.
    """
    good, bad = records(raw)
    new = commits.append_keyed(good, f"{path}/records", KEY, writer, batch)
    return new, commits.append_keyed(bad, f"{path}/rejects", ["source", "file", "payload"], writer, batch)


def start_ingest(feeds: Iterable[DataFrame], path: str, checkpoint: str) -> list[StreamingQuery]:
    """A query a feed that ingests its files, each once, and ends when it has caught up."""
    started = []
    for n, raw in enumerate(feeds):
        at = f"{checkpoint}/{n}"
        sink = raw.writeStream.foreachBatch(_each_batch(path, at))
        started.append(sink.option("checkpointLocation", at).trigger(availableNow=True).start())
    return started


def _each_batch(path: str, writer: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, number: int) -> None:
        ingest(batch, path, writer, number)

    return run
