"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering.

Pigeonring. The 64 bits are a ring of 8 segments. If two fingerprints differ in at most 3 bits, some segment starts a
chain whose first l segments differ in at most floor(3 l / 8) bits for every l from 1 to 8: 0, 0, 1, 1, 1, 2, 2, 3.
So two consecutive segments are equal, and of the next three at most one differs, hence two of those three are equal:
each of the 8 starts gives 3 keys of 32 bits. Two fingerprints meet only where such a key is equal, the chain of
budgets is checked next, and the full Hamming distance last. Nothing is lost: the filter is necessary for a link.

Only distinct fingerprints are joined, so copies, however many, cost one row.

Nulls: a null or empty text has no word and fingerprint zero, linked like any other; a null doc_id gets a component
but is never its least id. Repeated rows come out as often as they went in. An empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched, components, written

SEED = 42
#: The chain budgets floor(3 l / 8), l from 1 to 8.
BUDGETS = (0, 0, 1, 1, 1, 2, 2, 3)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: At most so many shingles are held as bits at once.
_CHUNK = 65536


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    total, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, _CHUNK):
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])], np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, row, fp): row is a hash of the text, fp the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "row", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batched(docs).select("doc_id", _row(docs).alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row bigint, fp bigint")


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * (i % 8)).bitwiseAND(F.lit(255).cast("long"))


def _keys(fp: Column) -> Column:
    """24 keys: the start, which two of the three next segments, and 4 segments of 8 bits."""
    found = []
    for start in range(8):
        for which, (x, y) in enumerate(((2, 3), (2, 4), (3, 4))):
            parts = [_segment(fp, start), _segment(fp, start + 1), _segment(fp, start + x), _segment(fp, start + y)]
            key = F.lit((start * 3 + which) << 32)
            for k, part in enumerate(parts):
                key = key.bitwiseOR(F.shiftleft(part, 24 - 8 * k))
            found.append(key.cast("long"))
    return F.array(*found)


def _chain(diff: Column, start: Column, limit: int) -> Column:
    """Whether the ring of differing bits, read from segment `start`, keeps within every budget."""
    turned = F.when(start == 0, diff)
    for s in range(1, 8):
        turned = turned.when(start == s, F.shiftleft(diff, 8 * s).bitwiseOR(F.shiftrightunsigned(diff, 64 - 8 * s)))
    ok = F.lit(True)
    for n, most in enumerate(BUDGETS, 1):
        first = F.shiftrightunsigned(turned, 64 - 8 * n) if n < 8 else turned
        ok = ok & (F.bit_count(first) <= min(most, limit))
    return ok


def links(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b), a < b as signed longs: pairs of the distinct fingerprints `fp` at `limit` (3 at most) or fewer bits."""
    if not 0 <= limit <= 3:
        raise ValueError("the chain budgets hold for at most 3 differing bits")
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    start = F.floor(F.shiftright(F.col("key"), 32) / 3)
    met = left.join(right, "key").where((F.col("a") < F.col("b")) & _chain(diff, start, limit))
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, limit: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links, the document's own included."""
    prints = written(fingerprints(docs, width)).select("doc_id", "fp")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(by_print.select("fp"), limit))
    named = by_print.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def firsts(docs: DataFrame, limit: int = 3, width: int = 3) -> DataFrame:
    """Of each component one row, as it is: the least by doc_id, then by a hash of its text, then by one of its other columns.

    Rows that share a doc_id but belong to different components all have theirs. Rows without an id can't be named as
    copies and stay.
    """
    prints = written(fingerprints(docs, width))
    # Copies are added up before they meet their component: a fingerprint is one row, however many share it.
    by_print = prints.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("p"))
    roots = components(links(prints.select("fp").distinct(), limit))
    of_print = by_print.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "p")
    picked = of_print.groupBy("root").agg(F.min("p").alias("p")).select(F.col("p.doc_id").alias("p_id"), F.col("p.row").alias("p_row"))
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    row, tie = _row(docs), F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    keyed = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("whole"), docs["doc_id"].alias("k_id"), row.alias("k_row"), tie.alias("tie"))
    met = keyed.join(picked, (F.col("k_id") == F.col("p_id")) & (F.col("k_row") == F.col("p_row")), "left_semi")
    first = F.row_number().over(Window.partitionBy("k_id", "k_row").orderBy("tie"))
    return met.withColumn("first", first).where("first = 1").select("whole.*").unionByName(docs.where("doc_id is null"))
