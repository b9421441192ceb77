"""Brown class-based n-grams: exchange clustering of words, class transitions and word emissions.

Tokens are lower-cased (A-Z) words and one end a text. Texts are tokenised once, into blocks: a row of a block has the
numbers of its words and a dictionary of them, so that what is known of a word meets it once a block, not once a token.

Classes. Exchange clustering moves symbols between classes while the class-bigram likelihood of the whole training corpus
grows; it runs on the driver over a bounded table of symbol bigrams that Spark counts over all training texts. Its symbols
are the `top_words` most frequent words, the `endings` most frequent last characters of all others, and one for the rest.
Then every other training word, however many there are, is moved to the class that is best for it: Spark counts the
classes before and after each word over all training texts, and a word goes to the class of the largest likelihood given
these, with a head start for that of its ending. A word that training hasn't seen has the class of its ending.

log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class), both smoothed:
P(d | c) = (n(c, d) + a p(d)) / (n(c) + a), P(w | c) = (c(w) + 0.1) / (n(c) + 0.1 (V(c) + 1)), where n counts all
training tokens under the final classes, and the last V + 1 is for words not seen.

Counts and classes of a bounded lexicon travel with the tasks, those of all other words are joined to the blocks by
shuffle; nothing sent to tasks or to the driver grows with the corpus.

Nulls: a null text is an empty one (one token, the end). A null doc_id is never held out. Repeated rows are scored
each. With no training text N and V are 0: base_score is then the sum of log10(0.1 / 0.1) = 0 a token. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched, dropped, released, written

#: What exchange clustering starts from on the driver; all other words join its classes by their own counts.
TOP_WORDS, TOP_ENDINGS, CLASSES = 1000, 300, 48
SUFFIX = 3
ADD = 0.1
#: Weight of the class unigram in a transition; head start of an ending's class, in nats.
BACKOFF, PRIOR = 5.0, 3.0
#: Words in a block; a longer text is a block of its own.
BLOCK_WORDS = 300_000
#: Words whose counts and classes travel with the tasks, a bound: those of all others are joined.
LEXICON = 262_144
_MOST = 2**24 - 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class _Numbers(dict):
    """Numbers of words, in order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks_of(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, words, trained, docs, held, lengths, ids): the documents of a stretch of a task's input.

    ids has the place in `words` of each word of each document, as 32-bit integers; trained counts the word in documents
    that aren't held out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        numbers, ids, size, doc_ids, held = _Numbers(), [], 0, [], []

        def flushed() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            every = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
            away = pa.concat_arrays(held)
            learned = np.repeat(~away.to_numpy(zero_copy_only=False), lengths)
            trained = np.bincount(every[learned], minlength=len(numbers))
            words = pa.array(list(numbers), pa.binary()).cast(pa.string())

            def row(values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + n]), row(words), row(pa.array(trained, pa.int64())), row(pa.concat_arrays(doc_ids)), row(away),
                    row(pa.array(lengths)), pa.array([every.tobytes()], pa.binary()),
                ],
                ["block", "words", "trained", "docs", "held", "lengths", "ids"],
            )

        for batch in batches:
            at = 0
            for k, t in enumerate(batch.column(1)):
                found = words_of(t.as_py())
                ids.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                size += 1 + len(found)
                if size > block_words:
                    doc_ids.append(batch.column(0).slice(at, k + 1 - at))
                    held.append(batch.column(2).slice(at, k + 1 - at))
                    yield flushed()
                    numbers, ids, size, doc_ids, held, n, at = _Numbers(), [], 0, [], [], n + 1, k + 1
            if at < batch.num_rows:
                doc_ids.append(batch.column(0).slice(at))
                held.append(batch.column(2).slice(at))
        if ids:
            yield flushed()

    return batched(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(
        run, f"block bigint, words array<string>, trained array<bigint>, docs array<{kind}>, held array<boolean>, lengths array<int>, ids binary"
    )


class Symbols:
    """Symbol of a word: a frequent word's own, else its ending's, else the last one. 0 is the text's end."""

    def __init__(self, words: list[str], signatures: list[str]) -> None:
        self.words, self.ends = pa.array(words, pa.string()), pa.array(signatures, pa.string())
        self.size = 2 + len(words) + len(signatures)

    def of(self, words: pa.Array) -> np.ndarray:
        own = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False)
        end = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -SUFFIX), self.ends), -1).to_numpy(zero_copy_only=False)
        found = np.where(end >= 0, 1 + len(self.words) + end, self.size - 1)
        return np.where(own >= 0, 1 + own, found).astype(np.int64)


def _sequence(ids: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The documents' values one after the other, an END before, between and after them."""
    out = np.full(len(ids) + len(lengths) + 1, END, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = values[ids]
    return out


def _learned(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a block, and numbers and lengths of its documents that aren't held out."""
    held = batch.column("held")[k].values.to_numpy(zero_copy_only=False)
    lengths = batch.column("lengths")[k].values.to_numpy()
    ids = np.frombuffer(batch.column("ids")[k].as_py(), np.int32)
    return batch.column("words")[k].values, ids[np.repeat(~held, lengths)], lengths[~held]


def symbol_bigrams(blocks: DataFrame, words: list[str], signatures: list[str]) -> DataFrame:
    """(code, n): code is left * size + right, over all training texts, each between two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(words, signatures)
        total = np.zeros(symbols.size**2, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own, ids, lengths = _learned(batch, k)
                found = _sequence(ids, lengths, symbols.of(own))
                codes, n = np.unique(found[:-1] * symbols.size + found[1:], return_counts=True)
                total[codes] += n
        codes = np.flatnonzero(total)
        for i in range(0, len(codes), 100_000):
            part = codes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["code", "n"])

    return blocks.select("words", "held", "lengths", "ids").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def exchange(table: np.ndarray, classes: int = CLASSES, rounds: int = 8) -> np.ndarray:
    """Class of each symbol. Class 0 holds the end alone; others start by rank and move while the likelihood grows."""
    n = len(table)
    table = table.astype(np.float64)
    classes = max(2, min(classes, n))
    cls = np.zeros(n, np.int64)
    order = np.argsort(-(table.sum(1) + table.sum(0)), kind="stable")
    order = order[order != END]
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    grid = member.T @ table @ member
    right, left = table @ member, table.T @ member  # of a symbol: counts of the classes after and before it

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(rounds):
        moved = 0
        for w in order:
            old, s = cls[w], table[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[old] -= s
            l[old] -= s
            nr, nl = r.sum() + s, l.sum() + s
            if nr + nl == 0:
                continue
            grid[old] -= r
            grid[:, old] -= l
            grid[old, old] -= s
            rows, cols, diag = grid.sum(1), grid.sum(0), np.diagonal(grid)
            up = f(grid + r) - f(grid)
            down = f(grid + l[:, None]) - f(grid)
            gain = up.sum(1) - np.diagonal(up) + down.sum(0) - np.diagonal(down)
            gain += f(diag + r + l + s) - f(diag) - f(rows + nr) + f(rows) - f(cols + nl) + f(cols)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            grid[new] += r
            grid[:, new] += l
            grid[new, new] += s
            if new != old:
                moved += 1
                cls[w] = new
                right[:, old] -= table[:, w]
                right[:, new] += table[:, w]
                left[:, old] -= table[w]
                left[:, new] += table[w]
        if not moved:
            break
    return cls


def contexts(blocks: DataFrame, words: list[str], signatures: list[str], cls: np.ndarray) -> DataFrame:
    """(word, told) of every training word that isn't one of `words`, a row a block. told has 32-bit integers: a code (the
    class before it, or the number of classes and the class after it) in the upper 8 bits, how often in the others.
    Neighbours have the class of their symbol."""
    c = int(cls.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(words, signatures)
        for batch in batches:
            for k in range(batch.num_rows):
                own, ids, lengths = _learned(batch, k)
                symbol = symbols.of(own)
                around = _sequence(ids, lengths, cls[symbol])
                at = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths) + 1
                rest = symbol[ids] > len(words)
                base = ids[rest].astype(np.int64) * (2 * c)
                codes, n = np.unique(np.concatenate((base + around[at[rest] - 1], base + c + around[at[rest] + 1])), return_counts=True)
                times = -(-n // _MOST)  # a count that doesn't fit comes in parts
                left = np.repeat(n, times) - _MOST * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                codes = np.repeat(codes, times)
                word = codes // (2 * c)
                told = (codes % (2 * c)).astype(np.uint32) << np.uint32(24) | np.minimum(left, _MOST).astype(np.uint32)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                offsets = (np.append(first, len(word)) * 4).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(told)])
                yield pa.RecordBatch.from_arrays([own.take(pa.array(word[first])), packed], ["word", "told"])

    return blocks.select("words", "held", "lengths", "ids").mapInArrow(run, "word string, told binary")


def gains(grid: np.ndarray) -> np.ndarray:
    """Log likelihood that one neighbour adds to each class: rows are codes as in `contexts`, columns classes."""
    c = len(grid)
    soft = grid + 0.5 / c
    rows, cols = soft.sum(1), soft.sum(0)
    before = np.log(soft) - np.log(rows)[:, None] - np.log(cols)[None, :]  # P(class | before) P(word | class)
    after = (np.log(soft) - np.log(rows)[:, None]).T
    out = np.concatenate((before, after))
    out[:, END] = -np.inf  # the end's class is its own
    return out


def assigned(around: DataFrame, signatures: list[str], words: list[str], cls: np.ndarray, grid: np.ndarray, prior: float = PRIOR) -> DataFrame:
    """(word, n, cls): each word's training count and its best class; ties go to the first class."""
    added = gains(grid)
    c = len(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(words, signatures)

        def told(own: pa.Array, score: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            score = score.copy()
            score[np.arange(len(own)), cls[symbols.of(own)]] += prior
            return pa.RecordBatch.from_arrays([own, pa.array(n), pa.array(score.argmax(1).astype(np.int32))], ["word", "n", "cls"])

        last: tuple | None = None  # rows of one word follow each other, over batches too
        for batch in batches:
            if not batch.num_rows:
                continue
            told_in = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32)
            code, n = told_in >> np.uint32(24), (told_in & np.uint32(_MOST)).astype(np.int64)
            sizes = pc.binary_length(batch.column(1)).to_numpy() // 4
            starts = np.cumsum(sizes) - sizes
            own = batch.column(0).dictionary_encode()
            first = np.flatnonzero(np.diff(own.indices.to_numpy(), prepend=-1))
            score = np.add.reduceat(np.add.reduceat(n[:, None] * added[code], starts), first)
            total = np.add.reduceat(np.add.reduceat(np.where(code < c, n, 0), starts), first)
            if last is not None:
                if last[0][0] == own.dictionary[0]:
                    score[0] += last[1][0]
                    total[0] += last[2][0]
                else:
                    yield told(*last)
            yield told(own.dictionary[:-1], score[:-1], total[:-1])
            last = (own.dictionary[-1:], score[-1:], total[-1:])
        if last is not None:
            yield told(*last)

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, n bigint, cls int")


def coded(blocks: DataFrame, words: DataFrame, top: list[str], signatures: list[str], cls: np.ndarray, ends: int, lexicon: int = LEXICON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, classes): each document's sum of log10(c + 0.1) and its classes, a byte
    each. Counts and classes of the most frequent words travel with the tasks; all others meet theirs by a join, once a
    block."""
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    known = words.orderBy(F.desc("n"), "word").limit(lexicon).toArrow().combine_chunks()
    sent = blocks.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy(zero_copy_only=False) if c != "word" else known[c].to_pylist() for c in ("word", "n", "cls")))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(sent.value[0], pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(1)[k].values
                at = np.flatnonzero(pc.is_null(pc.index_in(own, values)).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(at), np.int64))), pa.array(at.astype(np.int32)), own.take(pa.array(at))], ["block", "at", "word"]
                )

    def known_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, (values, lex_n, lex_cls) = Symbols(top, signatures), sent.value
        values, packed = pa.array(values, pa.string()), lex_n.astype(np.int64) << 8 | lex_cls
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                own = batch.column(0)[k].values
                place = pc.fill_null(pc.index_in(own, values), -1).to_numpy(zero_copy_only=False)
                code = cls[symbols.of(own)]
                code[place >= 0] = packed[place[place >= 0]]
                found.append(code.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], ["block", "docs", "held", "lengths", "ids", "known"])

    rare = blocks.select("block", "words").mapInArrow(outside, "block bigint, at int, word string")
    code = F.shiftleft(F.col("n"), 8).bitwiseOR(F.col("cls").cast("long")).alias("code")
    told = rare.join(words, "word").select("block", "at", code).groupBy("block").agg(F.collect_list(F.struct("at", "code")).alias("told"))
    # What is known without a join goes on instead of the words: 8 bytes a word, of which most are 0.
    lean = blocks.select("words", "block", "docs", "held", "lengths", "ids").mapInArrow(
        known_of, f"block bigint, docs array<{kind}>, held array<boolean>, lengths array<int>, ids binary, known binary"
    )
    joined = lean.join(told.withColumnRenamed("block", "t_block"), F.col("block") == F.col("t_block"), "left").drop("block", "t_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = batch.column("lengths")[k].values.to_numpy()
                ids = np.frombuffer(batch.column("ids")[k].as_py(), np.int32)
                code = np.frombuffer(batch.column("known")[k].as_py(), np.int64).copy()
                if batch.column("told")[k].is_valid:
                    found = batch.column("told")[k].values
                    code[found.field("at").to_numpy()] = found.field("code").to_numpy()
                count, of = code >> 8, code & 255
                doc = np.repeat(np.arange(len(lengths)), lengths)
                logs = np.bincount(doc, np.log10(count + ADD)[ids], len(lengths)) + np.log10(ends + ADD)
                known = np.bincount(doc, (count > 0)[ids], len(lengths)).astype(np.int64) + (ends > 0)
                data = of.astype(np.uint8)[ids].tobytes()
                cut = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                classes = pa.array([data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("docs")[k].values, batch.column("held")[k].values, pa.array(lengths.astype(np.int64) + 1), pa.array(known), pa.array(logs), classes],
                    ["doc_id", "held_out", "n_tokens", "n_known", "logs", "classes"],
                )

    return joined.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, classes binary")


def _moves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes before and after each step of a batch's documents, and the documents' numbers of steps."""
    texts = [np.frombuffer(b, np.uint8) for b in batch.column("classes").to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    found = _sequence(np.arange(lengths.sum()), lengths, np.concatenate([np.empty(0, np.uint8), *texts]))
    return found[:-1], found[1:], lengths + 1


def class_bigrams(texts: DataFrame, classes: int) -> DataFrame:
    """(code, n) of the class bigrams of all documents that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes**2, np.int64)
        for batch in batches:
            left, right, _ = _moves(batch)
            total += np.bincount(left * classes + right, minlength=classes**2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes**2)), pa.array(total)], ["code", "n"])

    return texts.where("not held_out").select("classes").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _grid(found: pa.Table, size: int) -> np.ndarray:
    grid = np.zeros(size**2, np.int64)
    grid[found["code"].to_numpy()] = found["n"].to_numpy()
    return grid.reshape(size, size)


@dataclass
class Model:
    """Class transitions and emissions: log10 P(d | c) is log_move[c, d], log10 P(w | c) is log10(c(w) + 0.1) - log_full[c]."""

    words: DataFrame
    texts: DataFrame
    log_move: np.ndarray
    log_full: np.ndarray
    train_tokens: int
    distinct: int


def fit(
    docs: DataFrame, top_words: int = TOP_WORDS, endings: int = TOP_ENDINGS, classes: int = CLASSES, block_words: int = BLOCK_WORDS, lexicon: int = LEXICON
) -> Model:
    """The model of all documents that aren't held out, and all documents' classes under it."""
    if not 2 <= classes <= 128:
        raise ValueError("a class before or after a word is one byte, and the end has a class of its own")
    spark = docs.sparkSession
    blocks = written(blocks_of(docs, block_words))
    ends = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    listed = blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("w")).select("w.words", "w.trained").where("trained > 0")
    counts = written(listed.groupBy(F.col("words").alias("word")).agg(F.sum("trained").alias("n")))
    found = counts.orderBy(F.desc("n"), "word").limit(top_words).toArrow()
    top, top_n = found["word"].to_pylist(), found["n"].to_numpy()
    least = (int(top_n[-1]), top[-1]) if top else (0, "")
    rest = counts.where((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("word") > least[1])))
    by_end = rest.groupBy(F.substring("word", -SUFFIX, SUFFIX).alias("s")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(endings)
    signatures = by_end.toArrow()["s"].to_pylist()
    dropped(counts)
    released(spark)

    symbols = Symbols(top, signatures)
    table = _grid(symbol_bigrams(blocks, top, signatures).toArrow(), symbols.size)
    cls = exchange(table, classes)
    c = int(cls.max()) + 1
    member = np.zeros((symbols.size, c))
    member[np.arange(symbols.size), cls] = 1
    others = assigned(contexts(blocks, top, signatures, cls), signatures, top, cls, member.T @ table @ member)
    own = spark.createDataFrame(list(zip(top, top_n.tolist(), cls[1 : 1 + len(top)].tolist())), "word string, n bigint, cls int")
    words = written(others.unionByName(own))
    released(spark)
    by_class = words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row a class
    size, distinct = np.zeros(c), np.zeros(c)
    for r in by_class:
        size[r["cls"]], distinct[r["cls"]] = r["n"], r["v"]
    size[END], distinct[END] = ends, ends > 0

    texts = written(coded(blocks, words, top, signatures, cls, ends, lexicon))
    dropped(blocks)
    grid = _grid(class_bigrams(texts, c).toArrow(), c).astype(np.float64)
    unigram = (size + ADD) / (size.sum() + ADD * c)
    log_move = np.log10((grid + BACKOFF * unigram) / (grid.sum(1, keepdims=True) + BACKOFF))
    log_full = np.log10(size + ADD * (distinct + 1))
    return Model(words, texts, log_move, log_full, int(size.sum()), int(distinct.sum()))


def scored(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    m = fit(docs, **options)
    log_move, log_full = m.log_move, m.log_full
    log_all = float(np.log10(m.train_tokens + ADD * (m.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, steps = _moves(batch)
            logs = batch.column("logs").to_numpy()
            of = np.repeat(np.arange(len(steps)), steps)
            score = logs + np.bincount(of, log_move[left, right] - log_full[right], len(steps))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.full(n, m_tokens)), pa.array(logs - steps * log_all), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    m_tokens, kind = m.train_tokens, docs.schema["doc_id"].dataType.simpleString()
    return m.texts.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
