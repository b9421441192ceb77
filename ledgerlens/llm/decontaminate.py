"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only.

An item is found in a document if at least `share` of the item's distinct word shingles (five lower-cased words) stand
in the document. An item of fewer words is one shingle, its whole sequence.

Items are partitioned by size. Partition p from 5 on holds the items of 2^(p-5) to 2^(p-4) - 1 distinct shingles, its
index has a bottom-k MinHash sketch of each, with the partition's own k = floor((1 - share) * largest size) + 1, and its
own threshold, ceil(share * least size): documents with fewer shingles don't probe it. Partitions 1 to 4 hold the items
of so many words, with k = 1. What each guarantees: a document that holds an item of size q lacks at most q - ceil(share
* q) of its shingles, which is less than k. So at least sketch length - (q - ceil(share * q)) of the sketched hashes, one
at least, are among the document's; documents with fewer hits are left out and nothing is lost. The document side, which
may be thousands of times longer than an item, isn't sketched (a sketch of fixed size would miss short items): each of its
shingle hashes probes the sketches. The candidates are verified by the exact share of the shingles' texts.

The sketches are broadcast only when their counted number is under `broadcast_rows`; else the probe is a shuffled join.

Nulls: a null or empty text, of document or item, has no shingle and matches nothing. A null doc_id or item_id is carried
as null. Repeated rows are found each for itself. Empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import GAP, written


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a lambda that reads it would else hold its whole expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shingles(array: str, width: int, joined) -> Column:
    """joined(words of it) of every shingle of `width` elements of an array column."""
    starts = F.slice(array, 1, F.greatest(F.size(array) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: joined(w, *[F.get(array, i + k) for k in range(1, width)]))


def _by_width(df: DataFrame, array: str, widths: list[int], joined) -> Column:
    """Shingles of the width that the row's `width` names."""
    found = F.when(F.lit(False), _shingles(array, 1, joined))
    for w in widths:
        found = found.when(F.col("width") == w, _shingles(array, w, joined))
    return found


def _hashes(df: DataFrame, widths: list[int]) -> DataFrame:
    """Adds `hashes`: a long for each shingle of the row's `width`, from the longs of its words."""
    df = _once(df, "word_hashes", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))
    return _once(df, "hashes", _by_width(df, "word_hashes", widths, F.xxhash64)).drop("word_hashes")


def _texts(df: DataFrame, name: str, widths: list[int]) -> DataFrame:
    """Replaces `text` by the distinct texts of its shingles of the row's `width`."""
    df = _once(df, "words", _words(F.col("text")))
    return df.withColumn(name, F.array_distinct(_by_width(df, "words", widths, lambda *w: F.concat_ws(" ", *w)))).drop("words", "text")


def _bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def index(items: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """(hash, width, part, threshold, item_id, q, need, length): the sketches of all partitions, one row a sketched hash."""
    part_of = F.lit(float(share))
    sized = (
        _hashes(_widths(items, width), list(range(1, width + 1))).withColumn("hashes", F.array_distinct("hashes"))
        .withColumn("q", F.size("hashes")).where("q > 0").withColumn("need", F.ceil(F.round(part_of * F.col("q"), 6)).cast("int"))
        .withColumn("level", F.floor(F.log2(F.col("q") + 0.5)))
        .withColumn("part", F.when(F.col("width") < width, F.col("width")).otherwise(F.lit(width) + F.col("level")).cast("int"))
        .withColumn("least_q", F.when(F.col("width") < width, 1).otherwise(F.pow(F.lit(2.0), F.col("level"))))
        .withColumn("k", F.floor(F.round((1 - part_of) * F.when(F.col("width") < width, 1).otherwise(2 * F.col("least_q") - 1), 6)) + 1)
        .withColumn("threshold", F.ceil(F.round(part_of * F.col("least_q"), 6)).cast("int"))
        .withColumn("sketch", F.slice(F.array_sort("hashes"), 1, F.col("k").cast("int")))
    )
    return sized.select(F.explode("sketch").alias("hash"), "width", "part", "threshold", "item_id", "q", "need", F.size("sketch").alias("length"))


def _widths(items: DataFrame, width: int) -> DataFrame:
    n = F.size(_words(F.col("text")))
    return items.select("item_id", "text", F.least(n, F.lit(width)).alias("width")).where("width > 0")


def contained(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): the items that each document holds."""
    items = items.select("item_id", "text")
    # Partitions are of hashes, the verdict of texts; equal hashes of different texts only make a sketch longer.
    sketches = written(index(items, width, share))
    n = sketches.count()
    widths = sorted(r["width"] for r in sketches.select("width").distinct().collect())  # `width` of them at most
    keyed = docs.select("doc_id", "text").withColumn("row_hash", F.xxhash64("doc_id", "text"))
    # One pass: words are hashed once, each width has its distinct hashes, and all of them are exploded together.
    hashed = _once(keyed, "word_hashes", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    each = [F.struct(F.lit(w).alias("width"), F.array_distinct(_shingles("word_hashes", w, F.xxhash64)).alias("hashes")) for w in widths or [width]]
    by_width = hashed.select("doc_id", "row_hash", F.explode(F.array(*each)).alias("x")).select("doc_id", "row_hash", "x.width", F.size("x.hashes").alias("n"), "x.hashes")
    probes = by_width.where("n > 0").select("doc_id", "row_hash", "width", "n", F.explode("hashes").alias("hash"))
    hits = probes.join(_bounded(sketches, n, broadcast_rows), ["width", "hash"]).where("n >= threshold and n >= need")
    # Repeated rows are counted together, which only lets more through to the check.
    counted = hits.groupBy("doc_id", "row_hash", "item_id", "width", "q", "need", "length").agg(F.count("*").alias("hits"))
    pairs = written(counted.where("hits >= length - (q - need)").select("doc_id", "row_hash", "item_id", "width").distinct())
    n_pairs = pairs.count()
    found = pairs.withColumnsRenamed({"doc_id": "c_doc", "row_hash": "c_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("row_hash") == F.col("c_hash"))
    held = keyed.join(_bounded(found, n_pairs, broadcast_rows), same).select("doc_id", "item_id", "width", "text")
    item_texts = _texts(_widths(items, width), "item_shingles", widths or [width]).withColumnsRenamed({"item_id": "i_item", "width": "i_width"})
    checked = _texts(held, "doc_shingles", widths or [width]).join(
        _bounded(item_texts, n, broadcast_rows), F.col("item_id").eqNullSafe(F.col("i_item")) & (F.col("width") == F.col("i_width"))
    )
    counted = checked.select(
        "doc_id", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long").alias("n_shared"),
    )
    enough = F.col("n_shared") >= F.round(F.lit(float(share)) * F.col("n_shingles"), 6)
    return counted.where(enough & (F.col("n_shingles") > 0)).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The documents that hold no item, as they are.

    An item of one word is held by every document that has the word, so a benchmark with such an item may empty a corpus:
    `per_item` of `contained` says how many documents each item costs.
    """
    found = contained(docs, items, broadcast_rows=broadcast_rows, **options)
    leaked = written(found.select(F.col("doc_id").alias("leaked_id")).distinct())
    few = _bounded(leaked, leaked.count(), broadcast_rows)
    return docs.join(few, docs["doc_id"].eqNullSafe(few["leaked_id"]), "left_anti")


def per_item(found: DataFrame) -> DataFrame:
    """(item_id, documents, n_shingles): how many documents hold each item, of what `contained` found."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("n_shingles").alias("n_shingles"))


ORACLE = r"""
WITH i AS (
  SELECT item_id, w, least(5, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
s AS (
  SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS shingle
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM i)),
q AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT DISTINCT r, doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS shingle
  FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM i))),
m AS (SELECT r, doc_id, item_id, count(*) AS n_shared FROM t JOIN s USING (k, shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN q USING (item_id) WHERE n_shared >= round(0.8 * n_shingles, 6)
"""
