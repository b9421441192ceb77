"""Substring dedup by recompression: equal word sequences get equal interior symbols wherever they stand.

Rounds. Every word is a symbol, named by a hash of its bytes. In each round every symbol falls left or right by a hash
of its name, and each left symbol followed by a right one becomes one symbol, named by a hash of the pair. Names are
hashes, so all executors agree on them without a dictionary. Whether two neighbours merge depends on these two alone;
so after two rounds a border between symbols depends on two words to each side, and symbols have at most four words.

Anchors. A border inside a repeat, with the symbols that the next round would join across it (three words to each
side), is named by those six words: a higher symbol of the repeat's interior. A window of 13 words has at least two
such borders 3 to 10 words from its start; it picks the one with the least name. Equal windows pick equal anchors.
Consecutive windows that pick the same border are a run and make one row, with the name of all its words.

Revealing. Spark groups the rows by name. The document with the least id that has an anchor can't be removed there:
any smaller document with one of the windows would have the anchor too. A later document's run that equals one of the
least document's is removed there. What is left (the same anchor in other surroundings) is decided window by window: names of
13 words of these runs and of the least documents' runs are grouped again, by their anchor's name and their own.

Verifying. A name has 64 bits, and nothing is removed by one name alone: two runs, or two windows, are equal if the name of
their anchor (six of the words) and the name of all their words are equal, 128 bits that hash different stretches. Windows
that share an anchor by chance are told apart by their own names. With 10^13 windows in question, of which each shares its
anchor with ten others, a false removal is to be expected once in 10^5 runs of the operator.

Nulls: a null or empty text has no words; a null doc_id is never removed from nor compared with. Rows that share a
doc_id aren't compared with each other, as neither id is smaller; each gets its own result. Periodic text gives equal
names at several places, all of them kept. Documents shorter than a window stay whole. An empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched, dropped, released, written

WINDOW = 13
#: Words to each side of a border that name it, and rounds before it is taken. For a window of w words, w - 2 SIDE + 1
#: places must hold a border: at most 2 ** ROUNDS words lie between borders.
SIDE, ROUNDS = 3, 2
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_A_INVERSE = np.uint64(pow(int(_A), -1, 2**64))
_33 = np.uint64(33)
_NONE = np.uint64(2**64 - 1)
#: A span is start << 36 | windows << 32 | the row's hash.
_START, _COUNT = 36, 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _33)) * _C
    x = (x ^ (x >> _33)) * _A
    return x ^ (x >> _33)


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a + _B) * _A + b)


def borders(words: np.ndarray, heads: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Starts of the symbols after the rounds. `heads` marks the first word of each text; nothing merges across it."""
    starts, names = np.arange(len(words)), words
    for r in range(rounds):
        right = mixed(names + np.uint64((r + 1) * int(_B) % 2**64)) & np.uint64(1) == 1
        at = np.flatnonzero(~right[:-1] & right[1:] & ~heads[1:])
        merged = pair_name(names[at], names[at + 1])
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names = names.copy()
        names[at] = merged
        names, starts, heads = names[keep], starts[keep], heads[keep]
    return starts


class Names:
    """Names of any stretch of a sequence of words, from sums over powers of an odd number."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _A))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n])))
        self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _A_INVERSE))))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * _C)


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for words in texts for w in words], np.uint64)


def runs(words: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, whole) of each run of windows that pick one border; start counts within the text."""
    if window - 2 * SIDE + 1 < 2**ROUNDS:
        raise ValueError(f"a window of {window} words may hold no border")
    ends = np.cumsum(lengths)
    heads = np.zeros(len(words), bool)
    heads[(ends - lengths)[lengths > 0]] = True
    n = len(words) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    text = np.repeat(np.arange(len(lengths)), lengths)
    names = Names(words)
    at = borders(words, heads)
    at = at[(at >= SIDE) & (at <= len(words) - SIDE)]
    value = np.full(len(words) + 1, _NONE)
    value[at] = names.of(at - SIDE, at + SIDE)
    places = window - 2 * SIDE + 1
    picked = np.lib.stride_tricks.sliding_window_view(value[SIDE : SIDE + n + places - 1], places).argmin(1) + np.arange(n) + SIDE
    own = np.flatnonzero(text[:n] == text[window - 1 :])
    if not len(own):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    new = np.ones(len(own), bool)
    new[1:] = (picked[own[1:]] != picked[own[:-1]]) | (text[own[1:]] != text[own[:-1]])
    first = own[new]
    count = np.diff(np.append(np.flatnonzero(new), len(own)))
    border = picked[first]
    whole = mixed(names.of(first, first + count + window - 1) + (border - first).astype(np.uint64))
    return text[first], first - (ends - lengths)[text[first]], count, value[border], whole


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _texts(column: pa.Array) -> list[list[bytes]]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in column]


def anchors(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, whole, doc, span) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2))
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            text, start, count, key, whole = runs(word_hashes(texts), lengths, window)
            row = batch.column(1).to_numpy()[text]
            span = start << _START | count << _COUNT | row
            yield pa.RecordBatch.from_arrays(
                [_long(key), _long(whole), batch.column(0).take(pa.array(text)), pa.array(span)], ["key", "whole", "doc", "span"]
            )

    return keyed.where("doc is not null").mapInArrow(run, f"key bigint, whole bigint, doc {_kind(keyed)}, span bigint")


def _kind(df: DataFrame) -> str:
    return df.schema["doc"].dataType.simpleString()


def _parts(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return span >> _START, span >> _COUNT & 15


def window_names(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, name, doc, span, open) of every window of the given spans; rows have doc, row, text, spans, opens, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2))
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            names, offset = Names(word_hashes(texts)), np.cumsum(lengths) - lengths
            out: list[list[np.ndarray]] = [[], [], [], []]
            docs = []
            for k in range(batch.num_rows):
                spans = np.array(batch.column(3)[k].values)
                opens = batch.column(4)[k].values.to_numpy(zero_copy_only=False)
                start, count = _parts(spans)
                which = np.repeat(np.arange(len(spans)), count)
                at = start[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]
                lo = at + offset[k]
                out[0].append(names.of(lo, lo + window))
                out[1].append(at << _START | 1 << _COUNT | spans[which] & 0xFFFFFFFF)
                out[2].append(opens[which])
                out[3].append(np.array(batch.column(5)[k].values)[which])
                docs.append(np.full(len(at), k))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(out[3])), _long(np.concatenate(out[0])), batch.column(0).take(pa.array(np.concatenate(docs))),
                        pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])),
                    ],
                    ["key", "name", "doc", "span", "open"],
                )

    return rows.select("doc", "row", "text", "spans", "opens", "keys").mapInArrow(run, f"key bigint, name bigint, doc {_kind(rows)}, span bigint, `open` boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    row = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(0xFFFFFFFF))
    return docs.select(F.col("doc_id").alias("doc"), row.alias("row"), "text")


def _by_row(spans: DataFrame, what: Column) -> DataFrame:
    """One row a document row, with its spans; bounded by the document's length."""
    return spans.groupBy("doc", F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).alias("row")).agg(F.collect_list(what).alias("spans"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, row, spans): the windows of each document row that a document with a smaller id has too."""
    spark = docs.sparkSession
    keyed = _keyed(batched(docs))
    found = written(anchors(keyed, window))
    least = written(
        found.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").drop("last")
    )
    released(spark)
    met = written(found.join(least, "key").select("key", "whole", "doc", "span", "least"))
    dropped(found)
    dropped(least)
    released(spark)
    heads = met.where("doc = least")
    names = written(heads.groupBy("key").agg(F.min("whole").alias("least_whole")))
    later = written(
        met.where("doc > least").join(names, "key").select("key", "doc", "span", (F.col("whole") == F.col("least_whole")).alias("sure"))
    )
    released(spark)
    unsure = later.where("not sure")
    sources = heads.join(unsure.select("key").distinct(), "key", "left_semi")
    asked = unsure.select("doc", "span", "key", F.lit(True).alias("open")).unionByName(sources.select("doc", "span", "key", F.lit(False).alias("open")))
    pairs = _by_row(asked, F.struct("span", "open", "key")).withColumnRenamed("spans", "s")
    windows = written(
        window_names(keyed.join(pairs, ["doc", "row"]).select("doc", "row", "text", F.col("s.span").alias("spans"), F.col("s.open").alias("opens"), F.col("s.key").alias("keys")), window)
    )
    released(spark)
    # A table of its own, so that the join below can split the rows of a frequent name.
    dropped(met)
    first = written(
        windows.groupBy("key", "name").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").drop("last")
    )
    late = windows.where("`open`").join(first, ["key", "name"]).where("doc > least").select("doc", "span")
    return _by_row(later.where("sure").select("doc", "span").unionByName(late), F.col("span"))


OUT = "n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def deduplicated(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; kept is the kept words joined by one space."""
    spans = repeated_spans(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, found in zip(batch.column(1), batch.column(2)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if found.is_valid and len(found.values):
                    start, count = _parts(np.array(found.values))
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + count + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:n]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            cols = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", *[x.split()[0] for x in OUT.split(", ")]]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _keyed(docs).withColumnsRenamed({"doc": "k_doc", "row": "k_row"})
    joined = rows.join(spans, (F.col("k_doc") == F.col("doc")) & (F.col("k_row") == F.col("row")), "left")
    return joined.select(F.col("k_doc").alias("doc_id"), "text", "spans").mapInArrow(run, f"doc_id {kind}, {OUT}")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
c AS (SELECT DISTINCT r, unnest(range(k, k + 13)) AS p FROM g JOIN m USING (g) WHERE least < doc_id),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""
