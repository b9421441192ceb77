"""Event logs: hash chains, divergence, legal steps, budgets, store digests.

Folds whose state is the previous output aren't windows. They stream over one key's rows, put in order by the partition's
sort, and hold one state; a long log spills in the sort and never becomes one row. streaming/ has the forms that keep
state across batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import LEGAL_STEPS
from ledgerlens.registry import REGISTRY, table

GENESIS = "0" * 64
_RS = chr(30)


def ordered_fold(
    rows: DataFrame, key: str, order: list[str], value: str, start: Any, step: Callable[[Any, Any], tuple[Any, Any]], out: str, kind: str, arrow: pa.DataType | None = None
) -> DataFrame:
    """`rows` with pos (from 0) and `out`: step(state, value) -> (state, out) over the rows of each key in order. `kind` and
    `arrow` are the type of `out` for either side; `value` may be a struct, and comes as a dict.

    One shuffle by the key and a sort that spills; a task keeps the state of one key at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos, state = object(), 0, start
        for batch in batches:
            places, found = [], []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist()):
                if k != last:
                    last, pos, state = k, 0, start
                state, x = step(state, v)
                places.append(pos)
                found.append(x)
                pos += 1
            columns = [*batch.columns, pa.array(places, pa.int64()), pa.array(found, arrow or pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pos", out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{fields}, pos bigint, {out} {kind}")


def next_head(head: str, event: str | None) -> tuple[str, str]:
    """Step of the hash chain; a null event counts as an empty one."""
    head = hashlib.sha256(f"{head}{_RS}{event or ''}".encode()).hexdigest()
    return head, head


def chain_heads(log: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """(key, pos, order, event, head): head = H(head before, record separator, payload), from a genesis of zeros.

    Rows that share key and order are put in the order of their payloads; a null payload counts as an empty one.
    """
    rows = log.select(key, order, payload.alias("event"))
    return ordered_fold(rows, key, [order, "event"], "event", GENESIS, next_head, "head", "string").select(key, "pos", order, "event", "head")


def chain_tail(log: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Length and last head of each key."""
    return chain_heads(log, key, order, payload).groupBy(key).agg(F.count("*").alias("n"), F.max_by("head", "pos").alias("head"))


def first_divergence(heads: DataFrame, stored: DataFrame, key: str, transition: str, keys: DataFrame | None = None) -> DataFrame:
    """Per key the first place where the stored log isn't the recomputed one: verdict, place, transition id, tails.

    `stored` has (key, pos, stored_head, parsable). An unparsable row is a torn write, a row that only one side has is
    missing or unexpected, where it comes first. A key of `keys` without any row is empty at genesis.
    """
    joined = heads.join(stored, [key, "pos"], "full")
    bad = (
        F.when(F.col("head").isNull(), "unexpected").when(F.col("parsable").isNull(), "missing")
        .when(~F.col("parsable"), "torn_write").when(~F.col("head").eqNullSafe(F.col("stored_head")), "tampered")
    )
    first = F.min(F.when(bad.isNotNull(), F.struct("pos", bad.alias("v"), F.col(transition).alias("t"))))
    found = joined.groupBy(key).agg(
        first.alias("f"), F.max_by("head", F.when(F.col("head").isNotNull(), F.col("pos"))).alias("tail"),
        F.max_by("stored_head", F.when(F.col("parsable").isNotNull(), F.col("pos"))).alias("stored_tail"), F.lit(True).alias("there"),
    )
    if keys is not None:
        found = keys.select(key).distinct().join(found, key, "left")
    verdict = F.when(F.col("there").isNull(), "empty").otherwise(F.coalesce("f.v", F.lit("intact")))
    return found.select(
        key, verdict.alias("verdict"), F.col("f.pos").alias("at"), F.col("f.t").alias("transition"),
        F.coalesce("tail", F.lit(GENESIS)).alias("tail"), F.coalesce("stored_tail", F.lit(GENESIS)).alias("stored_tail"),
    )


def legal_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEGAL_STEPS), "prior string, next string")


def illegal_steps(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Events whose (prior, next) isn't an edge (W4). The few edges are a literal table, broadcast by their size."""
    return events.join(edges, ["prior", "next"], "left_anti")


def broken_continuity(events: DataFrame, key: str, order: str) -> DataFrame:
    """Extension: events whose prior state isn't the state that the event before left."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("before", F.lag("next").over(w)).where("before is not null and before <> prior")


def latest_state(workflows: DataFrame, events: DataFrame, key: str, order: str, default: str = "needs_plan") -> DataFrame:
    """Next state of the last event, or the default for workflows without one."""
    last = events.groupBy(key).agg(F.max_by("next", order).alias("state"))
    return workflows.join(last, key, "left").select(key, F.coalesce("state", F.lit(default)).alias("state"))


def admission_step(per_call: int, max_tokens: int, dollars_per_token: str, max_dollars: str) -> Callable[[int, int | None], tuple[int, str]]:
    """Step of the budget: call cap, then workflow tokens, then workflow dollars. A refused call consumes nothing."""
    rate, cap = Decimal(dollars_per_token), Decimal(max_dollars)

    def step(used: int, asked: int | None) -> tuple[int, str]:
        total = used + (asked or 0)
        if (asked or 0) > per_call:
            return used, "per_call_max_exceeded"
        if total > max_tokens:
            return used, "workflow_max_tokens_exceeded"
        if total * rate > cap:
            return used, "workflow_max_dollars_exceeded"
        return total, "admitted"

    return step


def admissions(calls: DataFrame, key: str, order: str, tokens: str, per_call: int, max_tokens: int, dollars_per_token: str, max_dollars: str) -> DataFrame:
    """(key, order, verdict) of each call in order (W8): call cap, then workflow tokens, then workflow dollars.

    A refused call consumes nothing, so the running total depends on the verdicts: an ordered fold per key. Null tokens
    count as none.
    """
    step = admission_step(per_call, max_tokens, dollars_per_token, max_dollars)
    rows = calls.select(key, order, F.col(tokens).cast("bigint").alias("asked"))
    return ordered_fold(rows, key, [order, "asked"], "asked", 0, step, "verdict", "string").select(key, order, "verdict")


def reconciled(precharges: DataFrame, settlements: DataFrame, token: str, order: str) -> DataFrame:
    """Each settlement as applied, duplicate or unknown (W9): the first one of a token that was charged is applied."""
    ranked = settlements.withColumn("nth", F.row_number().over(Window.partitionBy(token).orderBy(order)))
    known = precharges.select(token).distinct().withColumn("known", F.lit(True))
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.col("nth") == 1, "applied").otherwise("duplicate")
    return ranked.join(known, token, "left").withColumn("verdict", verdict).drop("known", "nth")


def digest_bucket(order: list[str], digits: int = 3) -> Column:
    """A row's bucket in the tree of a digest: the first hex digits of the hash of its order columns."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order]), 256), 1, digits)


def digest_leaves(df: DataFrame, group: list[str], order: list[str], payload: Column, digits: int = 3) -> DataFrame:
    """(group, bucket, n, leaf): rows of a bucket and the digest of its payloads in order, line feeds between."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col("__p"))))
    leaf = F.sha2(F.array_join(F.transform(rows, lambda r: r["__p"]), "\n"), 256)
    return df.withColumns({"__p": payload, "bucket": digest_bucket(order, digits)}).groupBy(*group, "bucket").agg(F.count("*").alias("n"), leaf.alias("leaf"))


def digest_roots(leaves: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, digest) of the leaves' lines "bucket:leaf" in order."""
    line = F.concat("bucket", F.lit(":"), "leaf")
    return leaves.groupBy(*group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def ordered_digest(df: DataFrame, group: list[str], order: list[str], payload: Column, digits: int = 3) -> DataFrame:
    """(group, n, digest) whatever the order of the rows (W10, A15, A17): a tree of two levels.

    A row's bucket is the first `digits` hex digits of the hash of its order columns. A bucket's digest is that of its
    payloads in order, line feeds between; a group's is that of its lines "bucket:digest" in order. So no task holds a
    group: a bucket has a 4096th of it, and a group at most 4096 lines. Null payloads are counted and not hashed.
    """
    return digest_roots(digest_leaves(df, group, order, payload, digits), group)


def rolled(leaves: DataFrame, stored: DataFrame, removed: DataFrame, added: DataFrame, group: list[str], order: list[str], payload: Column, digits: int = 3) -> DataFrame:
    """The leaves of a store after a change, from its leaves before and the buckets that the change touches.

    `stored` is the store before the change with its `bucket`, by which it should be partitioned: only touched buckets are
    read, and `digest_roots` of the result is the digest of a full rebuild. Rows of `removed` (group, order columns) leave,
    rows of `added` come; a row that is in both is replaced. Nothing else of the store is hashed again. The touched buckets,
    16^digits at most, come to the driver to prune the read.
    """
    key, bucket = [*group, *order], digest_bucket(order, digits)
    gone, new = removed.select(*key).withColumn("bucket", bucket), added.withColumn("bucket", bucket)
    touched = [r["bucket"] for r in gone.select("bucket").union(new.select("bucket")).distinct().collect()]
    near = stored.where(F.col("bucket").isin(*touched)) if touched else stored.limit(0)
    other = gone.select(*[F.col(c).alias(f"gone_{c}") for c in key])
    same = F.lit(True)
    for c in key:
        same = same & near[c].eqNullSafe(other[f"gone_{c}"])
    now = near.join(other, same, "left_anti").drop("bucket").unionByName(new.drop("bucket"))
    kept = leaves.where(~F.col("bucket").isin(*touched)) if touched else leaves
    return kept.select(*group, "bucket", "n", "leaf").unionByName(digest_leaves(now, group, order, payload, digits))


def digest_sql(source: str, group: str, order: str, payload: str) -> str:
    """SQL of `ordered_digest` with one group and one order column."""
    return f"""
    WITH l AS (SELECT {group} AS g, left(sha256(({order})::VARCHAR), 3) AS b, count(*) AS n, sha256(coalesce(string_agg({payload}, chr(10) ORDER BY {order}), '')) AS d FROM {source} GROUP BY 1, 2)
    SELECT g AS {group}, sum(n)::BIGINT AS n, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS digest FROM l GROUP BY 1
    """


_PAYLOAD = "event_id || ':' || event_type"


def _payload() -> Column:
    return F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))


_CHAIN = f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, {_PAYLOAD} AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
c(user_id, pos, event_id, event, head) AS (
  SELECT user_id, pos, event_id, event, sha256(repeat('0', 64) || chr(30) || event) FROM e WHERE pos = 0
  UNION ALL SELECT e.user_id, e.pos, e.event_id, e.event, sha256(c.head || chr(30) || e.event) FROM c JOIN e ON e.user_id = c.user_id AND e.pos = c.pos + 1)
"""


@REGISTRY.query("hash_chain", _CHAIN + "SELECT user_id, pos, event_id, event, head FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_heads(table(spark, sf_dir, "events"), "user_id", "event_id", _payload())


@REGISTRY.query(
    "tamper_first_divergence",
    _CHAIN + """
    , w AS (SELECT user_id, pos, event_id, head, CASE WHEN event_id % 97 = 5 THEN sha256(head) ELSE head END AS stored, event_id % 89 <> 7 AS ok, event_id % 101 <> 9 AS there FROM c),
    b AS (SELECT *, CASE WHEN NOT there THEN 'missing' WHEN NOT ok THEN 'torn_write' WHEN head <> stored THEN 'tampered' END AS v FROM w),
    g AS (SELECT user_id, coalesce(min_by(v, pos) FILTER (v IS NOT NULL), 'intact') AS verdict, min(pos) FILTER (v IS NOT NULL) AS at,
                 min_by(event_id, pos) FILTER (v IS NOT NULL) AS transition, max_by(head, pos) AS tail,
                 coalesce(max_by(stored, pos) FILTER (there), repeat('0', 64)) AS stored_tail FROM b GROUP BY user_id)
    SELECT * FROM g UNION ALL SELECT -1, 'empty', NULL, NULL, repeat('0', 64), repeat('0', 64)
    """,
)
def tamper_first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = chain_heads(table(spark, sf_dir, "events"), "user_id", "event_id", _payload())
    stored = heads.where("event_id % 101 <> 9").select(
        "user_id", "pos", F.when(F.col("event_id") % 97 == 5, F.sha2("head", 256)).otherwise(F.col("head")).alias("stored_head"),
        (F.col("event_id") % 89 != 7).alias("parsable"),
    )
    keys = heads.select("user_id").union(spark.sql("SELECT -1L"))
    return first_divergence(heads, stored, "user_id", "event_id", keys)


_STATES = "['needs_plan', 'plan_ready', 'patch_applied', 'completed', 'gate_failed_retryable', 'awaiting_human_review', 'failed_unrecoverable']"
_STEPS = f"""
s AS (SELECT user_id, event_id, {_STATES}[(event_id % 7 + 1)::INT] AS prior, {_STATES}[(event_id * 3 % 7 + 1)::INT] AS next FROM events),
edges(prior, next) AS (VALUES {", ".join(map(str, LEGAL_STEPS))})
"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(x.strip(" '")) for x in _STATES.strip("[]").split(",")])
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.element_at(states, (F.col("event_id") % 7 + 1).cast("int")).alias("prior"),
        F.element_at(states, (F.col("event_id") * 3 % 7 + 1).cast("int")).alias("next"),
    )


@REGISTRY.query("illegal_transitions", f"WITH {_STEPS} SELECT prior, next, user_id, event_id FROM s ANTI JOIN edges USING (prior, next)")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return illegal_steps(_steps(spark, sf_dir), legal_steps(spark)).select("prior", "next", "user_id", "event_id")


@REGISTRY.query(
    "broken_continuity",
    f"WITH {_STEPS} SELECT user_id, event_id, prior, next, before FROM (SELECT *, lag(next) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s) WHERE before IS NOT NULL AND before <> prior",
)
def broken_continuity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_continuity(_steps(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "prior", "next", "before")


@REGISTRY.query(
    "latest_state",
    f"WITH {_STEPS} SELECT c_custkey AS user_id, coalesce(max_by(next, event_id), 'needs_plan') AS state FROM customer LEFT JOIN s ON user_id = c_custkey GROUP BY 1",
)
def latest_state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    workflows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return latest_state(workflows, _steps(spark, sf_dir), "user_id", "event_id")


@REGISTRY.query(
    "budget_admission",
    """
    WITH RECURSIVE o AS (
      SELECT o_custkey AS k, o_orderkey AS o, floor(o_totalprice / 10)::BIGINT AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    f(k, o, n, used, verdict) AS (
      SELECT k, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM o WHERE n = 1
      UNION ALL
      SELECT o.k, o.o, o.n,
             CASE WHEN o.t > 32000 OR f.used + o.t > 250000 OR (f.used + o.t) * 0.000006 > 1.5 THEN f.used ELSE f.used + o.t END,
             CASE WHEN o.t > 32000 THEN 'per_call_max_exceeded' WHEN f.used + o.t > 250000 THEN 'workflow_max_tokens_exceeded'
                  WHEN (f.used + o.t) * 0.000006 > 1.5 THEN 'workflow_max_dollars_exceeded' ELSE 'admitted' END
      FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
    SELECT k AS o_custkey, o AS o_orderkey, verdict FROM f WHERE n > 0
    """,
)
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 10).alias("tokens"))
    return admissions(calls, "o_custkey", "o_orderkey", "tokens", 32_000, 250_000, "0.000006", "1.5")


@REGISTRY.query(
    "reconcile_once",
    """
    WITH s AS (SELECT l_orderkey AS token, l_linenumber AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem)
    SELECT token, seq, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN nth = 1 THEN 'applied' ELSE 'duplicate' END AS verdict
    FROM s LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') ON token = o_orderkey
    """,
)
def reconcile_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    charged = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("token"))
    settled = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), F.col("l_linenumber").alias("seq"))
    return reconciled(charged, settled, "token", "seq").select("token", "seq", "verdict")


@REGISTRY.query("set_digest", digest_sql("nation", "n_regionkey", "n_nationkey", "n_nationkey || '|' || n_name"))
def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat(F.col("n_nationkey").cast("string"), F.lit("|"), F.col("n_name"))
    return ordered_digest(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], payload)


@REGISTRY.query(
    "chain_tails",
    _CHAIN + "SELECT user_id, count(*) AS n, max_by(head, pos) AS head FROM c GROUP BY user_id",
)
def chain_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_tail(table(spark, sf_dir, "events"), "user_id", "event_id", _payload())


@REGISTRY.query(
    "budget_totals",
    """
    WITH l AS (SELECT o_custkey AS w, o_orderkey AS t, floor(o_totalprice)::BIGINT AS tokens, o_orderstatus <> 'O' AS settled FROM orders)
    SELECT w AS workflow_id, coalesce(sum(tokens - 1) FILTER (settled), 0)::BIGINT AS consumed, coalesce(sum(tokens) FILTER (NOT settled), 0)::BIGINT AS outstanding,
           (10000000 - coalesce(sum(tokens - 1) FILTER (settled), 0) - coalesce(sum(tokens) FILTER (NOT settled), 0))::BIGINT AS remaining,
           coalesce(sum((tokens * 0.01)::DECIMAL(38, 2)) FILTER (settled), 0)::DOUBLE AS dollars
    FROM l GROUP BY w
    """,
)
def budget_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.operators.aggregates import budget_totals

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("workflow_id"), F.col("o_orderkey").alias("token_id"), F.floor("o_totalprice").cast("bigint").alias("tokens"), "o_orderstatus"
    )
    none = F.lit(None).cast("decimal(38,18)")
    held = orders.select("workflow_id", "token_id", F.lit("precharge").alias("op"), "tokens", none.alias("dollars"))
    money = (F.col("tokens").cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,18)")
    used = orders.where("o_orderstatus <> 'O'").select("workflow_id", "token_id", F.lit("reconcile").alias("op"), (F.col("tokens") - 1).alias("tokens"), money.alias("dollars"))
    return budget_totals(held.unionByName(used), 10_000_000).withColumn("dollars", F.col("dollars").cast("double"))


@REGISTRY.query(
    "rolling_digest",
    digest_sql("(SELECT o_orderstatus, o_orderkey, o_orderkey || '|' || o_custkey AS line FROM orders WHERE o_orderkey % 500 <> 3 UNION ALL SELECT o_orderstatus, -o_orderkey, -o_orderkey || '|' || o_custkey FROM orders WHERE o_orderkey % 700 = 5)", "o_orderstatus", "o_orderkey", "line"),
)
def rolling_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all orders, moved on by the orders that left and those that came."""
    columns = ["o_orderstatus", "o_orderkey", "o_custkey"]
    payload = F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select(*columns)
    leaves = digest_leaves(orders, columns[:1], columns[1:2], payload)
    added = orders.where("o_orderkey % 700 = 5").withColumn("o_orderkey", -F.col("o_orderkey"))
    stored = orders.withColumn("bucket", digest_bucket(columns[1:2]))
    return digest_roots(rolled(leaves, stored, orders.where("o_orderkey % 500 = 3"), added, columns[:1], columns[1:2], payload), columns[:1])
