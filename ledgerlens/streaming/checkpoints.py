"""Checkpoint append (K5): edge, boundary, size cap, scrub, chain; as a batch fold and as a stream with the same rows.

An event is refused, with the first reason that holds: `missing_transition` (no transition id), `illegal_transition` (prior and next aren't a legal
step; nulls aren't), `not_a_boundary` (the next state isn't one at which a checkpoint is taken), `payload_too_large` (its
canonical JSON is over the cap, before scrubbing), `duplicate_transition` (its id is in the workflow's log). Else its JSON
is scrubbed of named secrets, and the head protects what is stored: head = H(prior head, record separator, stored). A
refused event leaves head, state and sequence as they are. `continues` says whether the event's prior state is the one that the
log was left in; the append doesn't depend on it.

Rows of a workflow with the same order come by transition id, then by what is stored, nulls first. A null payload is stored as an empty
text. A null key is a workflow of its own. A stream holds one workflow's rows of a batch at a time; its state is a tail
and the ids seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlens.functions.fixed import BOUNDARY_STATES, LEGAL_STEPS, MAX_EVENT_BYTES, SECRET_PATTERNS
from ledgerlens.operators.ledger import _STEPS, GENESIS, _steps, next_head, ordered_fold
from ledgerlens.operators.text_safety import _MARK, named_redacted
from ledgerlens.registry import REGISTRY, table
from ledgerlens.sources import commits

START_STATE = "needs_plan"
_ENTRY = "struct<seq: bigint, prior_head: string, head: string, continues: boolean>"
_ARROW = pa.struct([("seq", pa.int64()), ("prior_head", pa.string()), ("head", pa.string()), ("continues", pa.bool_())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def judged(events: DataFrame, key: str, order: str, transition: Column, prior: Column, next_: Column, payload: Column, cap: int = MAX_EVENT_BYTES) -> DataFrame:
    """(key, order, transition, prior, next, reason, stored) without what depends on the log; stored is null if refused."""
    legal = F.coalesce(F.concat_ws("\0", prior, next_).isin(*["\0".join(s) for s in LEGAL_STEPS]) & prior.isNotNull() & next_.isNotNull(), F.lit(False))
    text = F.coalesce(payload, F.lit(""))
    reason = (
        F.when(transition.isNull(), "missing_transition").when(~legal, "illegal_transition").when(~next_.isin(*BOUNDARY_STATES), "not_a_boundary")
        .when(F.octet_length(text) > cap, "payload_too_large")
    )
    rows = events.select(key, order, transition.cast("string").alias("transition"), prior.alias("prior"), next_.alias("next"), reason.alias("reason"), text.alias("stored"))
    return named_redacted(rows.withColumn("stored", F.when(F.col("reason").isNull(), F.col("stored"))), "stored")


def _step(tail: tuple[int, str, str], event: dict[str, Any]) -> tuple[tuple[int, str, str], dict[str, Any] | None]:
    seq, head, left = tail
    if event["reason"] is not None:
        return tail, None
    new, _ = next_head(head, event["stored"])
    entry = {"seq": seq + 1, "prior_head": head, "head": new, "continues": event["prior"] == left}
    return (seq + 1, new, event["next"]), entry


def _columns(key: str, order: str) -> list[str]:
    return [key, order, "transition", "reason", "seq", "prior_head", "head", "continues", "stored"]


def checkpoint_log(events: DataFrame, key: str, order: str, transition: Column, prior: Column, next_: Column, payload: Column, cap: int = MAX_EVENT_BYTES) -> DataFrame:
    """(key, order, transition, reason, seq, prior_head, head, continues, stored) of every event; reason is null for those appended."""
    rows = judged(events, key, order, transition, prior, next_, payload, cap)
    nth = F.row_number().over(Window.partitionBy(key, "transition", F.when(F.col("reason").isNotNull(), F.col(order))).orderBy(order, "stored"))
    seen = rows.withColumn("nth", nth).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("nth") > 1), "duplicate_transition").otherwise(F.col("reason")))
    event = F.struct("reason", "prior", "next", "stored")
    shut = seen.select(key, order, "transition", "reason", "stored", event.alias("event"))
    folded = ordered_fold(shut, key, [order, "transition", "stored"], "event", (0, GENESIS, START_STATE), _step, "entry", _ENTRY, _ARROW)
    kept = F.when(F.col("reason").isNull(), F.col("stored"))
    return folded.select(key, order, "transition", "reason", "entry.seq", "entry.prior_head", "entry.head", "entry.continues", kept.alias("stored"))


class _Append(StatefulProcessor):
    """The append over one workflow's rows; typed state: the tail, and the ids in the log."""

    def __init__(self, key: str, order: str) -> None:
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "seq bigint, head string, left string")
        self.seen = handle.getMapState("seen", "transition string", "seq bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.order, "transition", "stored"], na_position="first")
        before = tail = tuple(self.tail.get()) if self.tail.exists() else (0, GENESIS, START_STATE)
        out = []
        for event in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            if event["reason"] is None and self.seen.containsKey((event["transition"],)):
                event["reason"] = "duplicate_transition"
            tail, entry = _step(tail, event)
            if entry is not None:
                self.seen.updateValue((event["transition"],), (entry["seq"],))
            kept = event["stored"] if event["reason"] is None else None
            out.append({self.key: event[self.key], self.order: event[self.order], "transition": event["transition"], "reason": event["reason"], **(entry or dict.fromkeys(("seq", "prior_head", "head", "continues"))), "stored": kept})
        if tail != before:
            self.tail.update(tail)
        found = pd.DataFrame(out, columns=_columns(self.key, self.order))
        yield found.astype({"seq": "Int64", "continues": "boolean"})

    def close(self) -> None:
        pass


def checkpoint_stream(events: DataFrame, key: str, order: str, transition: Column, prior: Column, next_: Column, payload: Column, cap: int = MAX_EVENT_BYTES) -> DataFrame:
    """As `checkpoint_log`, with the state kept across batches; the rows of a workflow must arrive in order of batches."""
    rows = judged(events, key, order, transition, prior, next_, payload, cap)
    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, transition string, reason string, seq bigint, prior_head string, head string, continues boolean, stored string"
    return rows.groupBy(key).transformWithStateInPandas(_Append(key, order), schema, "append", "none")


def start(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a `checkpoint_stream` to a table with a manifest, a batch once; `chain` and `refused` read the two outputs."""
    spark = log.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the settings that it is started with
    try:
        rows = log.withColumn("refused", F.col("reason").isNotNull())
        sink = rows.writeStream.foreachBatch(lambda batch, n: commits.append_rows(batch, path, checkpoint, n, partition_by=("refused",)))
        return sink.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def chain(spark: SparkSession, path: str) -> DataFrame:
    """The persisted chain."""
    return commits.read(spark, path).where("not refused").drop("refused", "reason")


def refused(spark: SparkSession, path: str) -> DataFrame:
    """What the append refused, with its reasons."""
    return commits.read(spark, path).where("refused").select(*commits.read(spark, path).columns[:4])


# Ids repeat every 5,000 events; some payloads hold secrets, a few are over the cap.
_NOTE = "event_type || CASE WHEN event_id % 53 = 0 THEN ' AKIA' || lpad(event_id::VARCHAR, 16, '0') ELSE '' END || CASE WHEN event_id % 31 = 0 THEN ' ghp_' || lpad(event_id::VARCHAR, 36, '0') ELSE '' END || CASE WHEN event_id % 997 = 0 THEN repeat('x', 70000) ELSE '' END"
_SCRUBBED = "doc"
for _n, _p in SECRET_PATTERNS[:2]:
    _SCRUBBED = f"list_reduce(list_prepend({_SCRUBBED}, list_distinct(regexp_extract_all({_SCRUBBED}, '{_p}'))), lambda t, m: replace(t, m, {_MARK.format('m')}))"


@REGISTRY.query(
    "checkpoint_append",
    f"""
    WITH RECURSIVE {_STEPS},
    e AS (SELECT user_id, event_id, 't' || event_id % 5000 AS transition, prior, next, (prior, next) IN (SELECT (prior, next) FROM edges) AS legal,
                 '{{"event_id":' || event_id || ',"next":"' || next || '","note":"' || {_NOTE} || '","prior":"' || prior || '"}}' AS doc FROM s JOIN events USING (user_id, event_id)),
    j AS (SELECT user_id, event_id, transition, prior, next, CASE WHEN NOT legal THEN 'illegal_transition' WHEN next = 'needs_plan' THEN 'not_a_boundary' WHEN strlen(doc) > 65536 THEN 'payload_too_large' END AS why, {_SCRUBBED} AS stored FROM e),
    r AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY user_id, transition, why IS NULL ORDER BY event_id) > 1 THEN 'duplicate_transition' ELSE why END AS reason FROM j),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, lag(next, 1, 'needs_plan') OVER (PARTITION BY user_id ORDER BY event_id) AS stand FROM r WHERE reason IS NULL),
    c(user_id, seq, event_id, prior_head, head) AS (
      SELECT user_id, seq, event_id, repeat('0', 64), sha256(repeat('0', 64) || chr(30) || stored) FROM a WHERE seq = 1
      UNION ALL SELECT a.user_id, a.seq, a.event_id, c.head, sha256(c.head || chr(30) || a.stored) FROM c JOIN a ON a.user_id = c.user_id AND a.seq = c.seq + 1)
    SELECT r.user_id, r.event_id, r.transition, r.reason, c.seq, c.prior_head, c.head, a.prior = a.stand AS continues, CASE WHEN r.reason IS NULL THEN r.stored END AS stored
    FROM r LEFT JOIN a USING (user_id, event_id) LEFT JOIN c USING (user_id, event_id)
    """,
)
def checkpoint_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir).join(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id", "event_id"])
    number = F.col("event_id").cast("string")
    some = lambda every, text: F.when(F.col("event_id") % every == 0, text).otherwise("")
    note = F.concat("event_type", some(53, F.concat(F.lit(" AKIA"), F.lpad(number, 16, "0"))), some(31, F.concat(F.lit(" ghp_"), F.lpad(number, 36, "0"))), some(997, F.repeat(F.lit("x"), 70_000)))
    doc = F.to_json(F.struct("event_id", "next", note.alias("note"), "prior"))
    transition = F.concat(F.lit("t"), (F.col("event_id") % 5000).cast("string"))
    return checkpoint_log(steps, "user_id", "event_id", transition, F.col("prior"), F.col("next"), doc)
