"""Runs of periodic words in a text, and the text with one period of each run kept.

A run is a stretch of consecutive words with smallest period q and at least max(`least`, `times` * q) words that no
neighbouring word extends keeping period q.

Method: block matching. For each scale L = 8, 16, 32 .. the blocks of L words that begin at multiples of L are the keys of
an Aho-Corasick automaton over integer sequences, which is searched across the document. A run whose period lies in
[L, 2L), or is under 8 at the first scale, holds an aligned block that occurs again one period later, since it has at
least 3q, and 24, words; so occurrences of a block at a distance in the scale's range are seeds, and each is extended word
by word to both sides. Seeds inside a run known already, whose period divides their distance, are left out: the run is
theirs. A stretch whose period isn't its smallest is left to the scale of the smallest one. Only blocks whose first eight
words have equal digests within two block lengths become keys, which is necessary for an occurrence in range; so a text
without repeats costs its digests alone. Keys of more than `_KEY` integers are spelt in exact names of words of
a power of two, looked for at each remainder, as the automaton's depth is its longest key. The work is n log n; in a text of one word
over and over every seed but the first is inside the run.

Nulls: a null text has no words and no run; a null doc_id stays null. Repeated rows are rows of their own. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import GAP, batched

LEAST, TIMES = 24, 3
_KEY, _FIRST = 1024, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _gaps(ids: np.ndarray) -> np.ndarray | None:
    """Distance from each place to the next with the same digest of eight words; None if there is none."""
    n = len(ids) - _FIRST + 1
    plain, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(_FIRST):
        h = h * _ODD + plain[k : k + n]
    h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not same.size:
        return None
    gaps = np.full(n, len(ids) + 1, np.int64)
    gaps[order[same]] = order[same + 1] - order[same]
    return gaps


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of stretches of 2 * width words from those of width words; equal names, equal words."""
    pairs = names[:-width] * np.int64(len(names) + width + 1) + names[width:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _occurrences(names: np.ndarray, step: int, size: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a block's words occur up to two sizes after it: (place, key) pairs, and the key of each block.

    names: of `step` words each, at every place.
    """
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple[int, ...], int] = {}
    own = np.empty(len(blocks), np.int64)
    for i, b in enumerate(blocks.tolist()):
        key = tuple(names[b : b + size - step + 1 : step].tolist())
        if key not in keys:
            keys[key] = len(keys)
            found.add_word(key, keys[key])
        own[i] = keys[key]
    found.make_automaton()
    # Blocks lie in stretches; between them nothing has to be searched.
    cut = np.flatnonzero(np.diff(blocks) > 3 * size) + 1
    firsts, lasts = blocks[np.concatenate(([0], cut))], blocks[np.concatenate((cut - 1, [-1]))]
    places: list[int] = []
    which: list[int] = []
    length = size // step
    for a, b in zip(firsts.tolist(), (lasts + 3 * size).tolist()):
        for r in range(step):
            part = tuple(names[a + r : b : step].tolist())
            if len(part) >= length:
                for end, key in found.iter(part):
                    places.append(a + r + step * (end - length + 1))
                    which.append(key)
    return np.array(places, np.int64), np.array(which, np.int64), own


def _seeds(size: int, n: int, blocks: np.ndarray, places: np.ndarray, which: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of the occurrences whose distance belongs to the scale, by distance and block."""
    key_at = np.full(n // size + 1, -1, np.int64)
    key_at[blocks // size] = own
    starts, ds = [], []
    # At the first scale distances are 1 to 15, two blocks for an occurrence; later they lie in [size, 2 size), one block.
    for back in (0, 1) if size == _FIRST else (1,):
        at = (places - 1 if size == _FIRST else places) // size - back
        ok = at >= 0
        ok[ok] = key_at[at[ok]] == which[ok]
        d = places - at * size
        ok &= (d > 0) & (d < 2 * size)
        starts.append(at[ok] * size)
        ds.append(d[ok])
    b, d = np.concatenate(starts), np.concatenate(ds)
    order = np.lexsort((b, d))
    return b[order], d[order]


def _end(ids: np.ndarray, i: int, d: int) -> int:
    """The first place from i on that differs from the one d before it."""
    n, width = len(ids), 64
    while i < n:
        j = min(n, i + width)
        differ = np.flatnonzero(ids[i:j] != ids[i - d : j - d])
        if differ.size:
            return i + int(differ[0])
        i, width = j, 2 * width
    return n


def _begin(ids: np.ndarray, i: int, d: int) -> int:
    """The first place of the stretch to i over which each place equals the one d after it."""
    width = 64
    while i > 0:
        j = max(0, i - width)
        differ = np.flatnonzero(ids[j:i] != ids[j + d : i + d])
        if differ.size:
            return j + int(differ[-1]) + 1
        i, width = j, 2 * width
    return 0


def _is_smallest(stretch: np.ndarray, d: int) -> bool:
    """Whether no divisor of the period d is a period; two periods decide."""
    window, rest, f = stretch[: 2 * d], d, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            q = d // f
            if np.array_equal(window[q:], window[:-q]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def runs_in(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run, by start and period. `least` is 24 or more and `times` 3 or more."""
    if least < 24 or times < 3:
        raise ValueError("blocks find runs of at least 24 words and three periods")
    n = len(ids)
    gaps = _gaps(ids) if n >= least else None
    if gaps is None:
        return []
    runs: list[Run] = []
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # the furthest end of a run over a place, and that run's period
    names, step, size = ids, 1, _FIRST
    while times * (size if size > _FIRST else 1) <= n and size <= n:
        while size // step > _KEY:
            names, step = _doubled(names, step), 2 * step
        blocks = np.arange(0, n - size + 1, size)
        blocks = blocks[gaps[blocks] < 2 * size]
        if blocks.size:
            starts, ds = _seeds(size, n, blocks, *_occurrences(names, step, size, blocks))
            open_ = ~((reach[starts] >= starts + ds + size) & (ds % period[starts] == 0))
            last = (0, 0, 0)
            for b, d in zip(starts[open_].tolist(), ds[open_].tolist()):
                if last[0] == d and last[1] <= b and b + d + size <= last[2] or reach[b] >= b + d + size and d % period[b] == 0:
                    continue
                s, e = _begin(ids, b, d), _end(ids, b + d + size, d)
                last = (d, s, e)
                if e - s >= max(least, times * d) and _is_smallest(ids[s:e], d):
                    runs.append((s, e - s, d))
                    nearer = reach[s:e] < e
                    reach[s:e][nearer] = e
                    period[s:e][nearer] = d
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, one space apart, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed): runs by start and period; collapsed is the text with one period of each run kept."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode("utf-8", "replace").split()
                runs = runs_in(_numbers(words), least, times)
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(collapsed(words, runs).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return batched(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what `periodic` gives."""
    # Ratios are compared exactly; of equal ones the earlier stays, and runs come by start and period.
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    first = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, by a digest of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    cut = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    at = cut.withColumn("a", F.expr("int(pmod(g, greatest(n, 1)))")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p))))), 1, n), ' ')")
    return at.select("doc_id", F.when(F.col("words").isNotNull() & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def _crc32(text: Column | str) -> str:
    """The SQL of a CRC32, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text})[i + 1:i + 1]))::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""


#: Equal stretches of eight words at all distances, joined to islands; a stretch inside one of a divisor of its period isn't a run.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
a AS (SELECT r, doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN p IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM p),
g AS (SELECT r, n, i, array_to_string(ws[i + 1:i + 8], ' ') AS gram FROM (SELECT r, n, ws, unnest(range(n - 7)) AS i FROM t WHERE n >= 24)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
stretch AS (SELECT r, q, min(i) AS s, max(i) + 8 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
long AS (SELECT * FROM stretch WHERE e - s >= greatest(24, 3 * q)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.e >= x.e)),
said AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY 1),
best AS (SELECT * FROM runs x QUALIFY row_number() OVER (PARTITION BY r ORDER BY (e - s) / q DESC, s, q) = 1),
gone AS (SELECT r, list(DISTINCT i) AS out FROM (SELECT r, unnest(range(s + q, e)) AS i FROM runs) GROUP BY 1),
kept AS (SELECT t.r, array_to_string(CASE WHEN out IS NULL THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(out, i - 1)) END, ' ') AS words FROM t LEFT JOIN gone USING (r))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", e - s AS length, q AS period, (1000 * (e - s)) // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(words) AS collapsed_sha256
FROM t LEFT JOIN said USING (r) LEFT JOIN best USING (r) JOIN kept USING (r)
"""
