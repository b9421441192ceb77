"""Spelling variants: words that differ by exactly one inserted, deleted or replaced code point, and the form each is a variant of.

Method: a positional q-gram inverted index with a count filter. The index is dealt over tasks by what a pair must share. A
pair of a word x of length l and a word of length l or l + 1 has its first difference at one place p of x; for each
segment [s, e) of the places of x, all words that agree outside it (the longer word without one more code point inside)
are one part of the index, and the pair is reported in the part whose segment holds p alone: it meets there, and is
counted once. A word is in four parts, as there are two segments for each of the two lengths that it may stand for. In a
part, postings are lists of words by gram, place and length, only of grams that touch the segment, as the others agree
anyway. For each word the lists of its grams at its own place (equal length) or its own and the next (the longer word)
are merged by a heap, and words met in at least m - 2 (equal length) or m - 1 (longer) of its m lists are verified: one
edit destroys at most two bigrams. Parts of more than `most` words are dealt again by halves of their segment, as often as
needed; a segment of one place holds no more words than there are letters.

A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least `ratio` times
its own. Roots are found by pointer doubling: n grows tenfold a step, so a chain has 18 steps at most.

Nulls: a null text has no words; a null doc_id takes part, and its runs keep all their letters. Repeated rows count again.
An empty table gives no rows. Words of any length are whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched, dropped, written

LEAST, RATIO, MOST = 7, 10, 2000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: So many different words are added up before they go to Spark.
_HELD = 200_000

Change = Callable[[str, int], str]


def misspelt(run: str, digest: int, every: int = 31) -> str:
    """The run, or where `every` divides the digest the run without its code point digest % length."""
    if digest % every:
        return run
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST, twice: int = 2, change: Change = misspelt) -> DataFrame:
    """(word, n): the runs of letters, A-Z in lower case and after `change`, of `least` or more code points and `twice` or more occurrences."""
    letters = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (t.as_py() or "").encode("utf-8", "replace").translate(_LOWER).decode()
                found = Counter(letters.findall(text))
                if i is None:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{i}:".encode())
                for word, n in found.items():
                    held[change(word, zlib.crc32(word.encode(), start))] += n
            if len(held) > _HELD:
                yield _counted(held, least)
                held = Counter()
        yield _counted(held, least)

    counts = batched(docs).select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def _counted(held: Counter, least: int) -> pa.RecordBatch:
    words = [w for w in held if len(w) >= least]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])


def _part(l: Column, s: Column, e: Column) -> Column:
    """The part of a word that stands for length `l`: what it has outside [s, e)."""
    word = F.col("word")
    after = F.substring(word, e + (F.length(word) - l) + 1, F.length(word))
    return F.xxhash64(l, s, e, F.substring(word, F.lit(1), s), after)


def _parts(words: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(part, l, s, e, word, n), and the tables behind it."""
    size, half = F.length("word"), (F.col("l") / 2).cast("int")
    placed = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).where("l > 0")
    spans = F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("l").alias("e")))
    dealt = placed.select("*", F.explode(spans).alias("x")).select("word", "n", "l", "x.s", "x.e")
    key, done, tables = ["part", "l", "s", "e"], None, []
    while True:
        dealt = dealt.withColumn("part", _part(F.col("l"), F.col("s"), F.col("e")))
        large = written(dealt.where("e - s > 1").groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > most))
        tables.append(large)
        if large.isEmpty():
            return (dealt if done is None else done.unionByName(dealt)), tables
        small = dealt.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = ((F.col("s") + F.col("e")) / 2).cast("int")
        halves = F.array(F.struct("s", middle.alias("e")), F.struct(middle.alias("s"), "e"))
        dealt = dealt.join(large, key, "left_semi").select("word", "n", "l", F.explode(halves).alias("x")).select("word", "n", "l", "x.s", "x.e")


def _differs(x: str, y: str, s: int, e: int) -> bool:
    """Whether y is x with one code point replaced or added, the first difference lying in [s, e)."""
    l, p = len(x), s
    while p < l and x[p] == y[p]:
        p += 1
    if not (p < e or p == e == l and len(y) > l) or x[:s] != y[:s]:
        return False
    return x[p + 1 :] == y[p + 1 :] and p < l if len(y) == l else x[p:] == y[p + 1 :]


def near_in_part(words: list[str], l: int, s: int, e: int) -> Iterator[tuple[int, int]]:
    """Places of the pairs of a part: a word of length `l`, and one of the same length and later or one longer by one."""
    first, last = max(0, s - 1), min(l - 2, e - 1)
    m = last - first + 1
    short = [i for i, w in enumerate(words) if len(w) == l]
    longer = [i for i, w in enumerate(words) if len(w) == l + 1]
    postings: defaultdict[tuple[int, int, str], list[int]] = defaultdict(list)
    for i in short:
        w = words[i]
        for p in range(first, last + 1):
            postings[l, p, w[p : p + 2]].append(i)
    for i in longer:
        w = words[i]
        for p in range(first, last + 2):
            postings[l + 1, p, w[p : p + 2]].append(i)
    for i in short:
        x = words[i]
        grams = [(p, x[p : p + 2]) for p in range(first, last + 1)]
        same = [postings[l, p, g] for p, g in grams]
        for j in _met(same, m - 2, short, i):
            if _differs(x, words[j], s, e):
                yield i, j
        if longer:
            # A gram is at its own place before the edit and at the next one after it; twice in a row it has both.
            shifted = [b for p, g in grams for b in (postings.get((l + 1, p, g)), postings.get((l + 1, p + 1, g))) if b]
            for j in _met(shifted, m - 1, longer, -1):
                if _differs(x, words[j], s, e):
                    yield i, j


def _met(lists: list[list[int]], bound: int, everyone: list[int], after: int) -> Iterator[int]:
    """Words after `after` that are in `bound` of the sorted lists or more; with no bound left, all."""
    if bound <= 0:
        yield from (j for j in everyone if j > after)
        return
    last, n = -1, 0
    for j in heapq.merge(*(b[bisect.bisect(b, after) :] for b in lists if b[-1] > after)):
        if j != last:
            last, n = j, 0
        n += 1
        if n == bound:
            yield j


def _linked(parts: DataFrame) -> DataFrame:
    """(word, k, best): near words of a word in one part, and the first of them by falling n, then by name."""

    def results(rows: list[tuple]) -> Iterator[tuple]:
        words, ns = [r[0] for r in rows], [r[1] for r in rows]
        count: Counter[int] = Counter()
        best: dict[int, tuple[int, str]] = {}
        for i, j in near_in_part(words, *rows[0][2:]):
            for a, b in ((i, j), (j, i)):
                count[a] += 1
                best[a] = min(best.get(a, (1, "")), (-ns[b], words[b]))
        return ((words[a], k, *best[a]) for a, k in count.items())

    def out(found: list[tuple]) -> pa.RecordBatch:
        word, k, n, near = zip(*found) if found else ((), (), (), ())
        best = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(near, pa.string())], ["minus_n", "near"])
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(k, pa.int64()), best], ["word", "k", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the part that the batch before ended in
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4, 5)], 1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            found: list[tuple] = []
            rows = None
            for n, (a, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
                own, last = tuple(keys[a].tolist()), n == len(starts) - 1
                if size == 1 and not last and not (n == 0 and own == key):
                    if n == 0 and len(held) > 1:
                        found.extend(results(held))
                    continue
                rows = rows or list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *keys[:, 1:].T.tolist()))
                if n == 0 and own == key:
                    held.extend(rows[a : a + size])
                    if not last:
                        found.extend(results(held))
                    continue
                if n == 0 and len(held) > 1:
                    found.extend(results(held))
                if last:
                    key, held = own, rows[a : a + size]
                else:
                    found.extend(results(rows[a : a + size]))
            yield out(found)
        yield out(list(results(held)) if len(held) > 1 else [])

    key = ["part", "l", "s", "e"]
    spread = parts.select("word", "n", *key).repartition("part").sortWithinPartitions(*key, "word")
    return batched(spread).mapInArrow(run, "word string, k bigint, best struct<minus_n: bigint, near: string>")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, n_near, near, near_n) for each row of `words` (word, n), whose words are distinct: how many words are near it, and the first of them."""
    kept = written(words)
    parts, tables = _parts(kept, most)
    found = written(_linked(parts))
    for t in tables:
        dropped(t)
    by = found.groupBy("word").agg(F.sum("k").alias("k"), F.min("best").alias("best"))
    return kept.join(by, "word", "left").select("word", "n", F.coalesce("k", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus_n")).alias("near_n"))


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root)."""
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = written(near_words(words, most).select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    up = written(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        dropped(up)
        up = after
        if up.where("moved").isEmpty():
            break
    return found.join(up.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: CRC32 bit by bit, near words by the words that are left when a letter is taken out, roots by recursion.
ORACLE = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS x FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, run, k, encode(coalesce(doc_id::VARCHAR || ':', '') || run) AS b FROM runs),
sums AS (
    SELECT doc_id, run, k, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || hex(b[i + 1:i + 1]))::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) AS h
    FROM bytes),
changed AS (
    SELECT CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM sums),
words AS (SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.further)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, up.root FROM f JOIN up ON up.word = f.word AND up.further IS NULL
"""
