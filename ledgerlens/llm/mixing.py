"""Mixing sources to target weights by a low-discrepancy source schedule. DataFrame functions only.

Each source's documents are shuffled by a digest of their id and laid end to end on a line of words, which is cut into
blocks of equal length. Slot k of the schedule gets the k-th van der Corput point. The points are mapped through the
cumulative numbers of blocks that the sources need, by their place among all the points, so that each source gets just
its number of slots, spread over the whole schedule; a slot's rank among its source's slots says which block of the
source it takes.

Nulls: a null text has size 0, a null source is a source of its own (last in order), a row without doc_id is shuffled by a
digest of its text. Empty texts take nothing. Equal rows each get a place of their own on the line. An empty table gives
no rows. Columns other than doc_id, source and text are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import n_words, written

WEIGHTS = (5, 2, 1)
#: Buckets of the digest by which a source's line is summed in parallel; three hex digits.
_HEX = 3
_CELLS = 1024
_CHUNK = 4096
#: Bits of a point: schedules of up to 2^40 slots.
_BITS = 40


def van_der_corput(k: Column, bits: int = _BITS) -> Column:
    """The base-2 radical inverse of k, as an integer of `bits` bits."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long")


def place_among(point: Column, slots: int, bits: int = _BITS) -> Column:
    """How many of the first `slots` points are less than a point.

    The first `slots` numbers are runs of 2^b for each bit b of `slots`, from the highest; the points of a run are evenly
    spaced, and its first lies less than one space from 0. So each run's share is one division.
    """
    total, start = F.lit(0).cast("long"), 0
    for b in range(slots.bit_length() - 1, -1, -1):
        if slots >> b & 1:
            first, space = int(f"{start:0{bits}b}"[::-1], 2), 1 << (bits - b)
            below = F.floor((point - F.lit(first) + F.lit(space - 1)) / F.lit(space)) if space > 1 else point - F.lit(first)
            total = total + F.greatest(F.lit(0), below).cast("long")
            start += 1 << b
    return total


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, sid, source_size, target, quota): `share` of all words by weight, at most `most` times a source's size.

    What a full source can't take goes to the others by weight. In order of cap / weight the full sources come first,
    so one pass of running sums finds the level at which no source is above its cap. One row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = by_source.withColumn("sid", (F.row_number().over(order) - 1).cast("int")).withColumn("w", cases)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything, fill = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
        # The first source that isn't full has the highest level of those; behind it the caps taken off are too large.
        .withColumn("flat", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("flat") * F.col("w"))
    return s.select("source", "sid", "source_size", target.alias("target")).withColumn(
        "quota", F.least(F.round("target"), F.col("source_size") * F.lit(float(most))).cast("long")
    )


def schedule(spark: SparkSession, goal: DataFrame, block: int) -> DataFrame:
    """(slot, sid, rank): each source's ranks 0 to ceil(quota / block) - 1 once, in low-discrepancy order."""
    need = goal.select("sid", F.ceil(F.col("quota") / F.lit(float(block))).cast("long").alias("need")).where("need > 0")
    slots = int(need.agg(F.sum("need")).first()[0] or 0)
    upto = Window.orderBy("sid")
    cell = F.lit(float(max(1, slots))) / _CELLS
    edges = need.withColumn("hi", F.sum("need").over(upto)).withColumn("lo", F.col("hi") - F.col("need")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell)))
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), place_among(van_der_corput(F.col("id")), slots).alias("place"))
    drawn = (
        points.withColumn("cell", F.floor(F.col("place") / cell)).join(edges.drop("need"), "cell").where("place >= lo and place < hi")
        .select("slot", "sid", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    )
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    past = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("n").over(past), F.lit(0)))
    within = Window.partitionBy("sid", "chunk").orderBy("slot")
    return (
        drawn.join(starts.select("sid", "chunk", "first"), ["sid", "chunk"])
        .select("slot", "sid", (F.col("first") + F.row_number().over(within) - 1).alias("rank"))
    )


def mix(docs: DataFrame, block: int = 8192, seed: str = "mix", share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """The mix as (slot, sid, copy, doc_id, place, from_word, n_words) and the documents with their place.

    The order of the mix is (slot, from_word of the line); `place` is (line start, number) and names a row uniquely.
    A document that straddles blocks has one row a block.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    digest = F.md5(F.concat(named, F.lit(f":{seed}")))
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("h")))
    goal = written(targets(sizes, share, most))
    cut = sizes.withColumn("bucket", F.substring("h", 1, _HEX))
    past = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        .withColumn("first", F.coalesce(F.sum("n").over(past), F.lit(0))).drop("n").alias("t")
        .join(goal.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source")))
        .select(F.col("t.source").alias("s_source"), F.col("t.bucket").alias("s_bucket"), "first", "sid", "source_size", "target", "quota")
    )
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size")
    line = (
        cut.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
        .withColumn("number", F.row_number().over(within))
        .withColumn("start", F.col("first") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .select("doc_id", "size", "sid", "bucket", "number", "start", "source_size", "target", "quota")
    )
    line = written(line)
    b = F.lit(block)
    pieces = (
        line.where("size > 0")
        .withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(int(most))])))
        .withColumn("lo", F.col("copy") * F.col("source_size") + F.col("start"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota")))
        .where("lo < hi")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / b), F.floor((F.col("hi") - 1) / b))))
        .withColumn("from_line", F.greatest("lo", F.col("rank") * b))
        .withColumn("n_words", F.least("hi", (F.col("rank") + 1) * b) - F.col("from_line"))
        .withColumn("from_word", F.col("from_line") - F.col("lo"))
    )
    mixed = pieces.join(schedule(spark, goal, block), ["sid", "rank"]).select(
        "slot", "sid", "copy", "doc_id", "bucket", "number", "from_line", "from_word", "n_words"
    )
    return mixed, line


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), first_slot
    and n_slots, the first and the number of the schedule's slots that take from it (null and 0 if none does)."""
    mixed, line = mix(docs, **options)
    per_row = mixed.groupBy("sid", "bucket", "number").agg(
        F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.size(F.collect_set("slot")).cast("long").alias("n_slots")
    )
    return line.join(per_row, ["sid", "bucket", "number"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_slot", F.coalesce("n_slots", F.lit(0).cast("long")).alias("n_slots"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':mix') AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid
  FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS goal FROM s),
t AS (
  SELECT a.sid, (any_value(a.goal) - coalesce(sum(b.cap) FILTER (b.ratio < a.ratio), 0)) / sum(b.w) FILTER (b.ratio >= a.ratio) AS level
  FROM c a, c b GROUP BY a.sid),
z AS (
  SELECT min(level) AS level FROM (
    SELECT t.sid, t.level, abs(sum(least(c.cap, t.level * c.w)) - any_value(c.goal)) <= 1e-9 * any_value(c.goal) AS fits
    FROM t, c GROUP BY t.sid, t.level) WHERE fits),
g AS (SELECT source, source_size, least(cap, level * w)::DOUBLE AS target FROM c, z),
p AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.size, d.source, g.source_size, g.target, least(round(g.target), 2 * g.source_size)::BIGINT AS quota,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS a
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (
  SELECT source, need, sum(need) OVER (ORDER BY source ASC NULLS LAST) - need AS lo
  FROM (SELECT source, ceil(least(round(target), 2 * source_size) / 8192)::BIGINT AS need FROM g)),
v AS (
  SELECT k, row_number() OVER (ORDER BY reverse(lpad(bin(k), 40, '0'))) - 1 AS place
  FROM (SELECT unnest(range((SELECT sum(need) FROM e)::BIGINT)) AS k)),
x AS (
  SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS rank FROM v JOIN e ON place >= lo AND place < lo + need),
b AS (
  SELECT r, source, unnest(range(lo // 8192, (hi - 1) // 8192 + 1)) AS rank
  FROM (SELECT r, source, c * source_size + a AS lo, least(c * source_size + a + size, quota) AS hi FROM p, (SELECT unnest([0, 1]) AS c) WHERE size > 0)
  WHERE lo < hi),
n AS (
  SELECT r, min(k) AS first_slot, count(DISTINCT k) AS n_slots FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source AND b.rank = x.rank GROUP BY r)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - a)) + greatest(0, least(size, quota - source_size - a)))::BIGINT AS taken,
       first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM p LEFT JOIN n USING (r)
"""
