"""Line dedup by a segment-partition edit join.

Distinct lines (trimmed) are compared. Two lines are near-equal within `edits` edits, or fewer for short lines: at most
1 - `similarity` of the shorter one's characters, so lines of under five characters are compared for equality only. A
line of length l is split into t + 1 segments of even length, t being what it allows; if another line, not shorter, is
within t edits, at least one segment stands in it unchanged, at a place that the lengths and the segment's number narrow
down to a few. So each line indexes its segments under (length, number, text), and probes the substrings that a line of
its own or a smaller length could have left it. Lines that meet are verified by banded bit-parallel edit distance.

A segment that more than `frequent` lines index would be compared pair by pair. Its lines are split again: without the
segment, what is left of two near-equal lines is within t edits too, so it is cut in t + 1 segments of its own and probed
in the same way. The frequent key is replaced by keys of the segment with one of these; no pair is lost.

Linked lines form classes (connected components). The first line of a class, by doc_id and line number, stays everywhere
else the line is removed. The links of a line, the other distinct lines near-equal to it, are counted exactly: lines that
share a segment are compared block by block.

Nulls: a null text is an empty one; blank lines are neither compared nor removed. A null doc_id comes before all others.
Repeated rows count as documents of their own: rows that agree in doc_id and text get the same result, the first
occurrence included. An empty table gives no rows. Only doc_id and text are read.

A line is named by two XXH64 of different seeds, 128 bits, where equality decides. Keys and links name it by the first of
them: of two lines that share it by chance (once in 2^64 pairs) one is compared for equality only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched, components, dropped, released, written

EDITS, SIMILARITY = 2, 0.8
#: Lines of a segment beyond which it is split again.
FREQUENT = 2000
#: Characters, and lines, of a segment's lines that are compared with others at once; more are split.
BLOCK, BLOCK_LINES = 65_536, 2048
_TRIM = " \t\r\x0b\x0c"
_MASK = 2**64 - 1


def allowed(length: int, edits: int = EDITS, similarity: float = SIMILARITY) -> int:
    """Edits within which a line of `length` is near-equal to lines that aren't shorter."""
    return min(edits, int(length * (1 - similarity) + 1e-9))


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 even segments of a line."""
    n = edits + 1
    short, longer = divmod(length, n)
    found, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        found.append((at, size))
        at += size
    return found


def places(other: int, length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(segment number, from, to, size): where the segments of a line of length `other` may stand in one of `length`.

    With d = length - other, segment i (from 0) of a line within `edits` stands unchanged at most i places from its own
    start, and at most edits - i places from it counted from the right end, for some i.
    """
    d, found = length - other, []
    for i, (start, size) in enumerate(segments(other, edits)):
        lo, hi = max(start - i, start + d - (edits - i), 0), min(start + i, start + d + (edits - i), length - size)
        if lo <= hi:
            found.append((i, lo, hi, size))
    return found


def probes(length: int, edits: int = EDITS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, size) of the substrings that a line of `length` must look up."""
    found = []
    for other in range(max(1, length - edits), length + 1):
        t = allowed(other, edits, similarity)
        if t and length - other <= t:
            found += [(other, i, at, size) for i, lo, hi, size in places(other, length, t) for at in range(lo, hi + 1)]
    return found


#: Rows of the line that are held as masks at once.
_ROWS = 1024


def within(a: str, b: str, edits: int) -> int:
    """Edit distance of a and b if it is at most `edits`, else edits + 1; a band of 2 edits + 1 bits moves along."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return edits + 1
    n, k = len(a), 0
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, n = 0, len(a)
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    if k:
        a, b = a[:-k], b[:-k]
    if not a:
        return len(b) if len(b) <= edits else edits + 1
    m, n, t = len(a), len(b), edits
    width = 2 * t + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    base = -_ROWS - t  # the masks hold so many rows from here on, so that a step costs the same in lines of any length
    # Bit k of column j stands for row j - t + k: whether the value grows (vp) or shrinks (vn) from the row above.
    vp, vn, score = full & ~((1 << (t + 1)) - 1), 0, t
    most = t + (n + t - m)
    for j in range(1, n + 1):
        # The band moves down one row a column, so the column before is seen one row lower.
        shift = j - t - 1
        if shift >= base + _ROWS:
            base = max(shift, 0)
            places = {}
            for i, c in enumerate(a[base : base + _ROWS + width]):
                places[c] = places.get(c, 0) | 1 << i
        x = places.get(b[j - 1], 0)
        shift -= base
        x = (x >> shift if shift >= 0 else x << -shift) & full
        vp, vn = (vp >> 1) | top, vn >> 1
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        score += not d0 & top
        if score > most:
            return edits + 1
        # Horizontal steps of the row above, of which the topmost is unknown and taken as growing.
        hp1, hn1 = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn = hn1 | ~(d0 | hp1) & full, d0 & hp1
    below = full & ~((1 << (m - n + t + 1)) - 1)
    score += (vn & below).bit_count() - (vp & below).bit_count()
    return min(score, edits + 1)


def _hashed(docs: DataFrame, plan: Callable[[int], list[tuple[int, int, int]]]) -> DataFrame:
    """(key, id, own) of the substrings that `plan` names for a line's length as (from, to, seed).

    The seed tells the indexed length and the segment's number; own says that the length is the line's. A line that a
    task meets often gives its rows once or, in a task of very many lines, a few times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple] = {}
        seen: set[int] = set()
        h = xxhash.xxh64_intdigest
        for batch in batches:
            keys: list[int] = []
            own: list[bool] = []
            ids: list[int] = []
            sizes: list[int] = []
            for t in batch.column(0):
                for raw in (t.as_py() or "").split("\n"):
                    line = raw.strip(_TRIM)
                    if not line or (ident := h(line, 42)) in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(ident)
                    found = plans.get(len(line))
                    if found is None:
                        if len(plans) > 20_000:
                            plans.clear()
                        steps = plan(len(line))
                        found = plans[len(line)] = (steps, [seed >> 3 == len(line) for _, _, seed in steps])
                    keys += [h(line[a:b], seed) for a, b, seed in found[0]]
                    own += found[1]
                    ids.append(ident)
                    sizes.append(len(found[1]))
            yield _keys(keys, np.repeat(np.array(ids, np.uint64).view(np.int64), sizes), own)

    return batched(docs).select("text").mapInArrow(run, "key bigint, id bigint, own boolean")


def _keys(keys: list[int], ids: np.ndarray | list[int], own: list[bool]) -> pa.RecordBatch:
    signed = pa.array(np.array(keys, np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([signed, pa.array(ids, pa.int64()), pa.array(own, pa.bool_())], ["key", "id", "own"])


def _indexed(length: int, edits: int, similarity: float) -> list[tuple[int, int, int]]:
    """(from, to, seed) of the segments that a line of `length` indexes; none if it allows no edit."""
    t = allowed(length, edits, similarity)
    return [(a, a + size, length << 3 | i) for i, (a, size) in enumerate(segments(length, t))] if t else []


def index_keys(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, id) of every segment of every line."""
    return _hashed(docs, lambda n: _indexed(n, edits, similarity)).drop("own")


def probe_keys(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, id, own) of every substring that a line looks up."""
    return _hashed(docs, lambda n: [(a, a + size, other << 3 | i) for other, i, a, size in probes(n, edits, similarity)])


def _second(key: int, rest: str, a: int, b: int, length: int, i: int) -> int:
    """The key of a segment with a segment of what is left without it."""
    return (key * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(rest[a:b], length << 3 | i)) & _MASK


def split_index(line: str, key: int, edits: int, similarity: float) -> list[int]:
    """The keys that replace a frequent key of a line that indexes it."""
    found = []
    for a, b, seed in _indexed(len(line), edits, similarity):
        if xxhash.xxh64_intdigest(line[a:b], seed) == key:
            rest = line[:a] + line[b:]
            t = allowed(len(line), edits, similarity)
            found += [_second(key, rest, c, c + size, len(rest), i) for i, (c, size) in enumerate(segments(len(rest), t))]
    return found


def split_probe(line: str, key: int, edits: int, similarity: float) -> set[int]:
    """The keys that replace a frequent key of a line that looks it up."""
    found = set()
    for other, i, at, size in probes(len(line), edits, similarity):
        if xxhash.xxh64_intdigest(line[at : at + size], other << 3 | i) == key:
            rest = line[:at] + line[at + size :]
            for j, lo, hi, n in places(other - size, len(rest), allowed(other, edits, similarity)):
                found |= {_second(key, rest, c, c + n, other - size, j) for c in range(lo, hi + 1)}
    return found


def _split(rows: DataFrame, how: Callable[[str, int], list[int] | set[int]]) -> DataFrame:
    """Rows (key, id, line, ...) of frequent keys with the keys that replace each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [how(line, key & _MASK) for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            keys = pa.array(np.array([k for f in found for k in f], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, *[c.take(at) for c in batch.columns[2:]]], ["key", *batch.schema.names[2:]])

    rows = rows.select("key", "line", *[c for c in rows.columns if c not in ("key", "line")])
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns if c != "line")
    return rows.mapInArrow(run, kinds).distinct()


def near_equal(x: str, y: str, edits: int, similarity: float) -> bool:
    t = allowed(min(len(x), len(y)), edits, similarity)
    return t > 0 and within(x, y, t) <= t


def verified(pairs: DataFrame, edits: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose lines line_a and line_b are near-equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [near_equal(x.as_py(), y.as_py(), edits, similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "line_a", "line_b").mapInArrow(run, "a bigint, b bigint")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, row, no, line, id, check) of every line that isn't blank, trimmed; id and check name it."""
    split = _keyed(docs).select("doc", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "raw"))
    lines = split.select("doc", "row", "no", F.trim(F.col("raw"), F.lit(_TRIM)).alias("line")).where("line <> ''")
    return lines.select("*", F.xxhash64("line").alias("id"), _check(F.col("line")).alias("check"))


def _check(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def sketch(line: str) -> int:
    """64 bits: the parity of the number of character pairs that hash to each. An edit turns at most four of them."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    slots = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(58)
    return int.from_bytes(np.packbits(np.bincount(slots.astype(np.int64), minlength=64) & 1 == 1).tobytes(), "big", signed=True)


def _sketched(texts: DataFrame) -> DataFrame:
    """Adds `sketch` to (id, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([sketch(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], ["id", "line", "sketch"])

    return texts.select("id", "line").mapInArrow(run, "id bigint, line string, sketch bigint")


def _checked(pairs: DataFrame, texts: DataFrame, edits: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are near-equal, as a table."""
    lines = texts.select("id", "line")
    full = pairs.distinct().join(lines.withColumnsRenamed({"id": "a", "line": "line_a"}), "a").join(
        lines.withColumnsRenamed({"id": "b", "line": "line_b"}), "b"
    )
    return written(verified(full, edits, similarity))


def first_shared(x: str, y: str, edits: int, similarity: float, hot: set[int] | frozenset[int] = frozenset()) -> int:
    """The first key that x indexes and y, which isn't shorter, looks up; -1 if there is none. Keys in `hot` are split."""
    t = allowed(len(x), edits, similarity)
    if not t or len(y) - len(x) > t:
        return -1
    cut = segments(len(x), t)
    for i, lo, hi, size in places(len(x), len(y), t):
        start = cut[i][0]
        at = y.find(x[start : start + size], lo, hi + size)
        if at < 0:
            continue
        key = xxhash.xxh64_intdigest(x[start : start + size], len(x) << 3 | i)
        if key not in hot:
            return key
        left = x[:start] + x[start + size :]
        inner = segments(len(left), t)
        while at >= 0:
            right = y[:at] + y[at + size :]
            for j, low, high, n in places(len(left), len(right), t):
                a = inner[j][0]
                if right.find(left[a : a + n], low, high + n) >= 0:
                    return _second(key, left, a, a + n, len(left), j)
            at = y.find(x[start : start + size], at + 1, hi + size)
    return -1


def _blocks(rows: DataFrame, side: str) -> DataFrame:
    """(key, side_block, side): the lines of each key in lists of about `BLOCK` characters, `BLOCK_LINES` lines at most."""
    size = F.greatest(F.sum(F.length("line")) / BLOCK, F.count("*") / BLOCK_LINES)
    sizes = rows.groupBy("key").agg(F.ceil(size).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)).cast("long")).alias(f"{side}_block")
    dealt = rows.join(sizes, "key", "left").select("key", part, F.struct("id", "line", "sketch", "own", "hot").alias("row"))
    return dealt.groupBy("key", f"{side}_block").agg(F.collect_list("row").alias(side))


def link_counts(shared: DataFrame, met: DataFrame, texts: DataFrame, edits: int, similarity: float) -> DataFrame:
    """(id, n_links) of every line with a link, as a table; n_links counts the other distinct lines near-equal to it.

    Every indexed line of a key is compared with every line that looks the key up, block by block, and only counts leave a
    task. A pair may meet under several keys; it counts under the first that they share. `hot` of a text has its split keys.
    """
    left = _blocks(shared.join(texts, "id").select("key", "id", "line", "sketch", F.lit(False).alias("own"), "hot"), "x")
    none = F.lit(None).cast("array<bigint>").alias("hot")
    right = _blocks(met.select("key", "id", "own").join(texts, "id").select("key", "id", "line", "sketch", "own", none), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py() & _MASK
                (xs, x_lines, x_ids, x_sketch, _, x_hot), (ys, y_lines, y_ids, y_sketch, y_own, _) = map(_columns, (batch.column(1)[row], batch.column(2)[row]))
                near = np.bitwise_count(x_sketch[:, None] ^ y_sketch[None, :]) <= 4 * edits
                near &= (x_ids[:, None] < y_ids[None, :]) | ~y_own[None, :] & (x_ids[:, None] != y_ids[None, :])
                for i, j in zip(*(a.tolist() for a in np.nonzero(near))):
                    x, y = x_lines[i], y_lines[j]
                    if first_shared(x, y, edits, similarity, x_hot[i]) == key and near_equal(x, y, edits, similarity):
                        counts[xs[i]] += 1
                        counts[ys[j]] += 1
            if len(counts) > 200_000:
                yield _counts(counts)
                counts.clear()
        yield _counts(counts)

    pairs = left.join(right, "key").repartition("key", "x_block", "y_block").select("key", "x", "y")
    return written(pairs.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n_links")))


def _columns(rows: pa.ListScalar) -> tuple:
    """Ids and lines as lists, ids, sketches and own as arrays, split keys as sets."""
    v = rows.values
    ids, line, sketches, own, hot = (v.field(k) for k in ("id", "line", "sketch", "own", "hot"))
    split = [frozenset(k & _MASK for k in found or ()) for found in hot.to_pylist()]
    return ids.to_pylist(), line.to_pylist(), ids.to_numpy(), sketches.to_numpy().view(np.uint64), own.to_numpy(zero_copy_only=False), split


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["id", "n"])


def linked(
    docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY, broadcast_rows: int = 1_000_000, counted: bool = False, frequent: int = FREQUENT
) -> DataFrame:
    """(id, check, root, n_links) of every line that is linked to another, as a table: its component of the near-equal
    pairs and, if `counted`, the number of its links.

    A group of n lines that are all near-equal to each other has n^2 / 2 links, which need not be made to know that it
    is one class. First, every line is checked with one line of each segment it meets, the one with the least id. Then all
    other pairs that meet are checked, but for those that the first links have put in one class already; so no link
    between different classes is lost. Of these, pairs whose sketches differ in more than 4 bits an edit can't be links
    and are never made: lines that share most of their text but differ in a word.
    """
    spark = docs.sparkSession
    index = written(index_keys(docs, edits, similarity))
    heads = index.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"))
    met = written(probe_keys(docs, edits, similarity).join(heads, "key").where("head <> id or last <> id").distinct())
    released(spark)
    shared = written(index.join(met.select("key").distinct(), "key", "left_semi").distinct())
    dropped(index)
    asked = written(met.select("id").unionByName(shared.select("id")).distinct())
    few = F.broadcast(asked) if asked.count() <= broadcast_rows else asked
    texts = written(_sketched(occurrences(docs).join(few, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))))
    first = _checked(met.where("head <> id").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")), texts, edits, similarity)
    roots = components(first)

    hot = written(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > frequent).select("key"))
    tables, split_texts = [met, shared, asked, texts, hot, first], texts.withColumn("hot", F.lit(None).cast("array<bigint>"))
    if hot.limit(1).count():
        line = texts.select("id", "line")
        frequent_index = written(shared.join(hot, "key", "left_semi"))
        by_index = _split(frequent_index.join(line, "id"), lambda x, key: split_index(x, key, edits, similarity))
        by_probe = _split(met.join(hot, "key", "left_semi").join(line, "id"), lambda x, key: split_probe(x, key, edits, similarity))
        of_line = frequent_index.groupBy("id").agg(F.collect_set("key").alias("hot"))
        split_texts = texts.join(of_line, "id", "left")
        shared = written(shared.join(hot, "key", "left_anti").unionByName(by_index.select("key", "id")))
        met = written(met.join(hot, "key", "left_anti").unionByName(by_probe.select(*met.columns)).distinct())
        tables += [frequent_index, shared, met]

    of = texts.select("id", "sketch").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "sketch", F.coalesce("root", "id").alias("root"))
    left = shared.join(of, "id").select("key", F.col("id").alias("x"), F.col("root").alias("x_root"), F.col("sketch").alias("x_sketch"))
    right = met.where("head <> last").join(of, "id").select("key", F.col("id").alias("y"), F.col("root").alias("y_root"), F.col("sketch").alias("y_sketch"), "own", "head")
    near = F.bit_count(F.col("x_sketch").bitwiseXOR(F.col("y_sketch"))) <= 4 * edits
    rest = left.join(right, (left["key"] == right["key"]) & (F.col("x_root") != F.col("y_root")) & (F.col("x") != F.col("head")) & near & ((F.col("x") < F.col("y")) | ~F.col("own")))
    second = _checked(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), texts, edits, similarity)
    tables.append(second)
    if second.limit(1).count():
        roots = components(first.unionByName(second))
    found = roots.withColumnRenamed("node", "id").join(texts.select("id", _check(F.col("line")).alias("check")), "id")
    if counted:
        counts = link_counts(shared, met, split_texts, edits, similarity)
        tables.append(counts)
        found = written(found.join(counts, "id", "left"))
    else:
        found = written(found.withColumn("n_links", F.lit(None).cast("long")))
    for t in tables:
        dropped(t)
    released(spark)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")


def decisions(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """(doc, row, gone, told) of every document row with a line that stands more than once, or nearly so.

    gone has the numbers of its lines to be removed, told (number, class, links) of those that repeat; both are
    bounded by the document's length. Links are null unless `counted`.
    """
    spark = docs.sparkSession
    narrow = written(occurrences(docs).drop("line"))
    where = F.struct("doc", "no", "row")
    roots = linked(docs, edits, similarity, counted=counted)
    named = narrow.groupBy("id", "check").agg(F.min(where).alias("first"), F.count("*").alias("n")).join(roots, ["id", "check"], "left")
    # A line that only equals others is a class of its own: named by its id, told apart by its check.
    named = written(named.select("id", "check", "first", "n", F.coalesce("root", "id").alias("root"), F.when(F.col("root").isNull(), F.col("check")).alias("own"), "n_links"))
    heads = named.groupBy("root", "own").agg(F.min("first").alias("head"), F.sum("n").alias("n")).where("n > 1").withColumnsRenamed({"root": "h_root", "own": "h_own"})
    same = (F.col("root") == F.col("h_root")) & F.col("own").eqNullSafe(F.col("h_own"))
    classes = written(named.select("id", "check", "root", "own", "n_links").join(heads, same).select("id", "check", "root", "n_links", "head"))
    dropped(named)
    dropped(roots)
    released(spark)
    return (
        narrow.join(classes, ["id", "check"]).groupBy("doc", "row")
        .agg(
            F.collect_set(F.when(~where.eqNullSafe(F.col("head")), F.col("no"))).alias("gone"),
            F.collect_set(F.struct("no", "root", "n_links")).alias("told"),
        )
    )


def _kept(text: str | None, gone: list[int] | None) -> str:
    away = set(gone or ())
    return "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in away)


OUT = "n_lines bigint, n_removed bigint, kept_sha256 string, kept string, n_links bigint, links array<bigint>, classes array<bigint>"


def deduplicated(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, kept, n_links, links, classes) of every row.

    kept is the text without its removed lines. For each line that isn't blank, in line order, classes has its class id and
    links the number of other distinct lines near-equal to it; n_links is their sum.
    """
    told = decisions(batched(docs), edits, similarity, counted=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = F.col("k.doc").eqNullSafe(F.col("t.doc")) & (F.col("k.row") == F.col("t.row"))
    asked = _keyed(docs).alias("k").join(told.alias("t"), same, "left").select(
        F.col("k.doc").alias("doc_id"), "text", "gone",
        "told.no", "told.root", "told.n_links",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for t, *rest in zip(*batch.columns[1:]):
                text = t.as_py() or ""
                away, nos, roots, n_links = (x.as_py() or [] for x in rest)
                at = dict(zip(nos, zip(roots, n_links)))
                kept = _kept(text, away)
                links, classes = [], []
                for no, raw in enumerate(text.split("\n")):
                    if line := raw.strip(_TRIM):
                        # A line that nothing repeats or nears is a class of its own, named by its id.
                        root, n = at.get(no) or ((h(line, 42) + 2**63) % 2**64 - 2**63, 0)
                        classes.append(root)
                        links.append(n or 0)
                out.append((text.count("\n") + 1, len(away), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept, sum(links), links, classes))
            cols = list(zip(*out)) if out else [()] * 7
            many = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), many, many]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", *[x.split()[0] for x in OUT.split(", ")]]
            )

    return asked.mapInArrow(run, f"doc_id {kind}, {OUT}")


def cleaned(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their removed lines, n_chars counted anew; all rows and columns stay."""
    told = decisions(batched(docs), edits, similarity).select(F.col("doc").alias("t_doc"), F.col("row").alias("t_row"), "gone").where("size(gone) > 0")
    told = told.select(*[told[c].alias(f"__{c}") for c in told.columns])
    row = F.xxhash64(docs["doc_id"], docs["text"])
    joined = docs.join(told, docs["doc_id"].eqNullSafe(told["__t_doc"]) & (row == told["__t_row"]), "left").select(
        *[docs[c] for c in docs.columns], told["__gone"]
    )
    text = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            gone = batch.columns[-1]
            kept = [t.as_py() if not g.is_valid else _kept(t.as_py(), g.as_py()) for t, g in zip(columns[text], gone)]
            columns[text] = pa.array(kept, pa.string())
            if chars >= 0:
                columns[chars] = pa.array([None if k is None else len(k) for k in kept], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
