"""Structured Streaming forms of the ordered and idempotent operators; on the same rows they equal the batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerlens.operators.ledger import GENESIS, admission_step, next_head
from ledgerlens.sources.sinks import append_new


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def idempotent_ingest(stream: DataFrame, path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Appends a row of each key that the table doesn't have, the least of a batch (K3). A batch that is run again, after a
    failure before or after its commit, appends nothing twice: the manifest has the number of each checkpoint's last batch."""
    return (
        stream.writeStream.foreachBatch(lambda batch, n: append_new(batch, path, key, checkpoint, n)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _folded(stream: DataFrame, key: str, order: str, value: str, kind: type, start: Any, step: Callable[[Any, Any], tuple[Any, Any]], state: str, out: str) -> DataFrame:
    """(key, order, out): a batch form's step continued across batches. Rows of a key must arrive in order of batches;
    within a batch they are put in order, by `order` and the value, nulls first, as the batch form does."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else start
        rows = pd.concat(list(parts)).sort_values([order, value], na_position="first")
        found = []
        for v in rows[value]:
            now, x = step(now, None if pd.isna(v) else kind(v))
            found.append(x)
        held.update((now,))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), out: found})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {out} string", f"now {state}", "append", GroupStateTimeout.NoTimeout)


def chained(stream: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, order, head): hash chain continued across batches (W2); `checkpoints` has the whole append of K5."""
    return _folded(stream, key, order, payload, str, GENESIS, next_head, "string", "head")


def admitted(stream: DataFrame, key: str, order: str, tokens: str, per_call: int, max_tokens: int, dollars_per_token: str = "0", max_dollars: str = "0") -> DataFrame:
    """(key, order, verdict): budget continued across batches."""
    step = admission_step(per_call, max_tokens, dollars_per_token, max_dollars)
    return _folded(stream, key, order, tokens, int, 0, step, "bigint", "verdict")


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling counts with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
