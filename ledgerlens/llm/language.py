"""Language of texts by a linear-chain conditional random field over their words.

A word's features are hashed: all character n-grams of one to three characters with its ends marked, affixes of three
characters, and the word itself as a lexicon entry. Each feature has a weight a language; transitions between the
languages of neighbouring words are learned with them. Training maximises the likelihood of labelled sequences by
forward-backward gradients. The labels are per document, so sequences are spliced from stretches of differently
labelled documents, which is what code-switched text looks like. A word's label is its marginal by forward-backward
over the whole text; the language of a document is the one with the largest mean marginal over its words that have a
letter, and that mean is the score.

The training sample is bounded: at most `per_language` different rows of a language, those with the least digest of their id
and text, of each the first `chars` characters, and `sequences` sequences of them. Rows that share id and text are one row of
the sample; an id that is null or that many rows have makes no difference. Everything else covers all texts, whole. The labels
themselves, a count each, are collected: there are as many as languages.

Nulls: a null text, or one without a letter, is `und` with score 0; a null lang isn't learned from; a null doc_id is
never held out, and learned from like any other. Documents without a letter aren't learned from, so a label that has no others is left out. With one
label left, every text with a letter gets it with score 1; with none, everything is `und`, and `accepted` keeps every
document with a letter, as there is nothing to judge it by. Repeated rows are predicted each. An empty table gives no rows.
Ties go to the first language by name. Of the table only doc_id, text and, to train, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched

PER_LANGUAGE, CHARS, SEQUENCES, LENGTH = 200, 100_000, 3000, 48
SIZE = 1 << 16
UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15)
_MAX_CACHE = 150_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _P
    return ((h ^ (h >> np.uint64(29))) * _P >> np.uint64(48)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of every feature of the words."""
    padded = [f"\x02{w}\x03" for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    slots, owners = [], []
    h = c.copy()
    for n in range(1, 5):
        if n > 1:
            h = h[:-1] * _P + c[n - 1 :]
        ok = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            ok &= c > 3
        if n == 4:  # affixes of three characters
            ok &= (c[: len(h)] == 2) | (c[3:] == 3)
        at = np.flatnonzero(ok)
        slots.append(_slot(h[at], n))
        owners.append(owner[at])
    ends = np.cumsum(sizes)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(c), _P))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * power[: len(c)])))
    inverse = np.uint64(pow(int(_P), -1, 2**64))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(c), inverse))))
    whole = (sums[ends] - sums[ends - sizes]) * back[ends - sizes]
    slots.append(_slot(whole, 9))
    owners.append(np.arange(len(words)))
    return np.concatenate(slots), np.concatenate(owners)


def emissions(words: list[str], weights: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Summed feature weights of each word, one column a language; the features of few words are held at once."""
    out = np.zeros((len(words), weights.shape[1]))
    for i in range(0, len(words), at_once):
        part = words[i : i + at_once]
        slot, owner = features(part)
        for k in range(weights.shape[1]):
            out[i : i + at_once, k] = np.bincount(owner, weights[slot, k], len(part))
    return out


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward marginals of sequences that lie one after the other in `scores`, all stepped together."""
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    offset = np.concatenate(([0], np.cumsum(active)))
    # Time-major places: all first words, all second words, ...
    step = np.repeat(np.arange(longest), active)
    rank = np.arange(len(step)) - offset[:-1][step]
    place = starts[rank] + step
    x = np.exp(scores - scores.max(1, keepdims=True))[place]
    t = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(x), np.ones_like(x)
    for i in range(longest):
        a, b = offset[i], offset[i + 1]
        now = x[a:b]
        if i:
            now = (alpha[offset[i - 1] : offset[i - 1] + b - a] @ t) * now
        alpha[a:b] = now / now.sum(1, keepdims=True)
    back = np.ascontiguousarray(t.T)
    for i in range(longest - 2, -1, -1):
        a, b = offset[i + 1], offset[i + 2]
        after = (x[a:b] * beta[a:b]) @ back
        beta[offset[i] : offset[i] + b - a] = after / after.sum(1, keepdims=True)
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    out = np.empty_like(both)
    out[place] = both
    return out


class Model:
    """Languages, feature weights and transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray) -> None:
        self.languages, self.weights, self.moves = languages, weights, moves

    @classmethod
    def fitted(cls, texts: list[list[str]], labels: list[str], sequences: int = SEQUENCES, length: int = LENGTH, epochs: int = 4, seed: int = 7) -> Model:
        """Fits by stochastic gradient steps (AdaGrad) on spliced sequences.

        Labels without a usable word are left out. One language alone needs no weights: its score is 1.
        """
        languages = sorted({l for w, l in zip(texts, labels) if w})
        n = len(languages)
        by = [[w for w, l in zip(texts, labels) if l == lang and w] for lang in languages]
        weights, moves = np.zeros((SIZE, n)), np.zeros((n, n))
        if n < 2:
            return cls(languages, weights, moves)
        rng = np.random.default_rng(seed)
        words: list[str] = []
        truth: list[int] = []
        for _ in range(sequences):
            left = length
            while left:
                k = int(rng.integers(n))
                doc = by[k][int(rng.integers(len(by[k])))]
                size = min(left, int(rng.integers(6, 25)), len(doc))
                at = int(rng.integers(len(doc) - size + 1))
                words += doc[at : at + size]
                truth += [k] * size
                left -= size
        kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
        kind = np.array([kinds[w] for w in words])
        slot, owner = features(list(kinds))
        first = np.searchsorted(sorted_owner := np.sort(owner, kind="stable"), np.arange(len(kinds) + 1))
        slot = slot[np.argsort(owner, kind="stable")]
        del sorted_owner
        y = np.eye(n)[truth]
        past_w, past_m = np.full((SIZE, n), 1e-6), np.full((n, n), 1e-6)
        batch = 100
        for epoch in range(epochs):
            for s in rng.permutation(sequences // batch):
                rows = slice(s * batch * length, (s + 1) * batch * length)
                ids, which = np.unique(kind[rows], return_inverse=True)
                sizes = first[ids + 1] - first[ids]
                own = np.repeat(np.arange(len(ids)), sizes)
                slots = slot[np.repeat(first[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                scores = np.stack([np.bincount(own, weights[slots, k], len(ids)) for k in range(n)], 1)[which]
                p = marginals(scores, np.full(batch, length), moves)
                miss = y[rows] - p
                by_kind = np.stack([np.bincount(which, miss[:, k], len(ids)) for k in range(n)], 1)
                grad = np.stack([np.bincount(slots, by_kind[own, k], SIZE) for k in range(n)], 1) / batch - 1e-5 * weights
                past_w += grad * grad
                weights += 0.3 * grad / np.sqrt(past_w)
                truth_pair, model_pair = _pairs(y[rows], p, moves, scores, length)
                grad = (truth_pair - model_pair) / batch - 1e-3 * moves
                past_m += grad * grad
                moves += 0.1 * grad / np.sqrt(past_m)
        return cls(languages, weights, moves)


def _pairs(y: np.ndarray, p: np.ndarray, moves: np.ndarray, scores: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbouring labels, in truth and expected under the model."""
    n = y.shape[1]
    y3, s3 = y.reshape(-1, length, n), scores.reshape(-1, length, n)
    truth = np.einsum("bti,btj->ij", y3[:, :-1], y3[:, 1:])
    x = np.exp(s3 - s3.max(2, keepdims=True))
    t = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(x), np.ones_like(x)
    for i in range(length):
        now = x[:, i] if not i else (alpha[:, i - 1] @ t) * x[:, i]
        alpha[:, i] = now / now.sum(1, keepdims=True)
    for i in range(length - 2, -1, -1):
        after = (x[:, i + 1] * beta[:, i + 1]) @ t.T
        beta[:, i] = after / after.sum(1, keepdims=True)
    joint = alpha[:, :-1, :, None] * t[None, None] * (x * beta)[:, 1:, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return truth, joint.sum((0, 1))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sequences: int = SEQUENCES, chars: int = CHARS) -> Model:
    """Learns from documents that aren't held out and have a lang; see the bounds above."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = usable.select("lang", "doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((SIZE, 0)), np.zeros((0, 0)))
    # Digests of different rows are even, so a language's least ones lie below a limit that their number gives.
    limit = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, 2.0 * per_language / max(n, 1))
        limit = limit | ((F.col("lang") == lang) & (F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)))
    near = rows.where(limit).groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= per_language).toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    texts = [[w.decode("utf-8") for w in words_of(t)] for t in sample["text"].to_pylist()]
    texts = [[w for w in words if any(map(str.isalpha, w))] for words in texts]
    return Model.fitted(texts, sample["lang"].to_pylist(), sequences)


class _Cache(dict):
    """Row of a word in a growing table of emissions."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.table = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, bool)

    def rows(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(new) > _MAX_CACHE:
            self.clear()
            self.table, self.letters = self.table[:0], self.letters[:0]
            new = list(dict.fromkeys(words))
        if new:
            plain = [w.decode("utf-8") for w in new]
            has = np.array([any(map(str.isalpha, w)) for w in plain])
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.table = np.concatenate((self.table, emissions(plain, self.model.weights) * has[:, None]))
            self.letters = np.concatenate((self.letters, has))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _cache(sent: tuple) -> _Cache:
    languages, weights, moves = sent
    return _Cache(Model(languages, weights.astype(np.float64), moves))


def _labelled(column: pa.Array, cache: _Cache) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, words and switches of each text."""
    languages = cache.model.languages
    texts = [words_of(t.as_py()) for t in column]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    labels, shares, switches = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if languages and lengths.sum():
        ids = cache.rows([w for words in texts for w in words])
        starts = np.cumsum(lengths) - lengths
        for part in _parts(lengths):
            sizes = lengths[part]
            owner = np.repeat(np.arange(len(part)), sizes)
            own = ids[np.repeat(starts[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            p = marginals(cache.table[own], sizes, cache.model.moves)
            letters = cache.letters[own]
            n = np.bincount(owner, letters, len(part))
            mean = np.stack([np.bincount(owner, p[:, k] * letters, len(part)) for k in range(len(languages))], 1)
            mean /= np.maximum(n, 1)[:, None]
            best = mean.argmax(1)
            label = p.argmax(1)
            changed = (label[1:] != label[:-1]) & (owner[1:] == owner[:-1])
            switches[part] = np.bincount(owner[1:], changed, len(part)).astype(np.int64)
            shares[part] = np.where(n > 0, np.clip(mean[np.arange(len(part)), best], 0, 1), 0.0)
            for i in np.flatnonzero(n):
                labels[part[i]] = languages[best[i]]
    return labels, shares, lengths, switches


def _parts(lengths: np.ndarray, words: int = 50_000) -> Iterator[np.ndarray]:
    """Texts by falling length in parts of about so many words: steps are shared by texts alike in length, and what is
    held at once doesn't depend on the batch."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    cut = np.cumsum(lengths[order]) // words
    yield from np.split(order, np.flatnonzero(np.diff(cut)) + 1)


def accepted(docs: DataFrame, model: Model, least: float = 0.35) -> DataFrame:
    """The documents, as they are, whose language is known with a score of `least` or more; a null lang is filled in."""
    spark = batched(docs).sparkSession
    sent = spark.sparkContext.broadcast((model.languages, model.weights.astype(np.float32), model.moves))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(sent.value)
        for batch in batches:
            labels, shares, _, _ = _labelled(batch.column(text), cache)
            filled = pc.coalesce(batch.column(lang), pa.array(labels, batch.schema.field(lang).type))
            columns = [filled if i == lang else c for i, c in enumerate(batch.columns)]
            if cache.model.languages:
                keep = pa.array([label != UNKNOWN and share >= least for label, share in zip(labels, shares.tolist())], pa.bool_())
            else:
                keep = pa.array([any(map(str.isalpha, t.as_py() or "")) for t in batch.column(text)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switches): n_switches counts neighbours labelled differently."""
    spark = batched(docs).sparkSession
    sent = spark.sparkContext.broadcast((model.languages, model.weights.astype(np.float32), model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(sent.value)
        for batch in batches:
            labels, shares, lengths, switches = _labelled(batch.column(2), cache)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(shares), pa.array(lengths), pa.array(switches)],
                ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_words bigint, n_switches bigint"
    )
