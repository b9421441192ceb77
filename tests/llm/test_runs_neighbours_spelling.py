"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import neighbours, periodic, spelling

SCHEMA = "doc_id bigint, text string, words string, n bigint, runs string, word string, l int, part bigint"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2, 3) for i, t in rows], SCHEMA)


# 11 --------------------------------------------------------------------------------------------------------------------


def plain_runs(words, least=24, times=3):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(least, times * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    words = []
    for _ in range(rng.randrange(1, 5)):
        few = rng.choice([1, 2, 3, 50])
        block = [f"w{rng.randrange(few)}" for _ in range(rng.randrange(1, rng.choice([3, 10, 60])))]
        stretch = block * rng.randrange(1, 9)
        stretch = stretch[: rng.randrange(1, len(stretch) + 1)]
        if rng.random() < 0.4:
            stretch[rng.randrange(len(stretch))] = "typo"
        words += stretch
    return words


@pytest.mark.parametrize("key", [1024, 8])
def test_runs_equal_brute_force(monkeypatch, key):
    monkeypatch.setattr(periodic, "_KEY", key)  # with short keys, large blocks are spelt in names
    rng, found = random.Random(7), 0
    for _ in range(400):
        words = periodic_text(rng)
        runs = periodic.runs_in(periodic._numbers([w.encode() for w in words]))
        assert runs == plain_runs(words)
        found += len(runs)
    assert found > 150


def test_runs_of_very_long_texts():
    rng = np.random.default_rng(3)
    for q in (1, 7, 3000, 30_000):
        ids = np.concatenate((rng.integers(10**6, 2 * 10**6, 500), np.resize(rng.permutation(q) + 1, 100_000), rng.integers(10**6, 2 * 10**6, 500)))
        assert periodic.runs_in(ids.astype(np.int64)) == [(500, 100_000, q)]
    assert periodic.runs_in(rng.integers(0, 50, 100_000)) == []
    with pytest.raises(ValueError):
        periodic.runs_in(np.zeros(30, np.int64), least=10)


def test_periodic_query_equals_brute_force(spark):
    rng = random.Random(11)
    planted = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    rows = list(zip(planted, ["", " ", None, "one", "one two", "a b c", "x " * 30, " é " * 9]))  # nothing, or little, to plant in
    rows += [(i, "  ".join(periodic_text(rng))) for i in range(300)] + [(None, "a b " * 30), (7, None), (8, ""), (9, " \n"), (3, "é ü " * 40 + "ß"), (3, "é ü " * 40 + "ß")]
    got = periodic.digests(periodic.periodic(periodic.planted(frame(spark, rows)))).collect()
    want = []
    for i, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        said = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(said), sha(kept)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 100
    assert periodic.digests(periodic.periodic(periodic.planted(frame(spark, [])))).count() == 0


# 12 --------------------------------------------------------------------------------------------------------------------


def nearest_rows(spark, rows, k=5, **more):
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id bigint, embedding array<float>, dim int, score double, shard int")
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=k, **more)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(found[r.query_id]) == r["rank"]
    return found


def brute(rows, k=5):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = {}
    for q, a in ok:
        if q % 50 == 0:
            scored = [(-float(neighbours.cosines(a, b)), i) for i, b in ok if i != q and len(a) == len(b)]
            found[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: f for q, f in found.items() if f}


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("kind", ["even", "groups", "near copies"])
def test_recall_over_shards(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24))
    if kind == "groups":
        v = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] * 4 + v
    if kind == "near copies":
        v[1000:] = v[0] + 0.05 * v[1000:]
    rows = list(enumerate(v.astype(np.float32).tolist()))
    got, want = nearest_rows(spark, rows, shard_rows=800), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    for q, found in got.items():
        assert len(found) == 5 and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in found]
        for i, s in found:
            assert s == float(neighbours.cosines(np.array(rows[q][1]), np.array(rows[i][1])))


def test_every_node_is_reached():
    rng = np.random.default_rng(2)
    points = np.concatenate((rng.normal(size=(300, 8)), 1e-3 * rng.normal(size=(700, 8)) + 1))
    graph = neighbours.Graph(neighbours._unit(points), degree=4, beam=8)
    reached, wave = set(graph.entries.tolist()), set(graph.entries.tolist())
    while wave:
        wave = {int(t) for s in wave for t in graph.edges[s] if t >= 0} - reached
        reached |= wave
    assert len(reached) == 1000 and graph.edges.shape == (1000, 4)


def test_copies_ties_and_odd_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 0.0]
    rows = [(i, a) for i in range(0, 400)] + [(1000 + i, b) for i in range(3)] + [(2000, c), (2000, c), (3000, [2.0, 2.0, 0.0])]
    rows += [(50_000, None), (50_050, [0.0, 0.0, 0.0]), (50_100, [1.0, None, 0.0]), (50_150, [float("nan"), 1.0, 0.0]), (50_200, []), (50_250, [1.0, float("inf"), 0.0]), (None, a), (None, b)]
    rows += [(60_000, [1.0, 2.0]), (60_001, [2.0, 1.0]), (70_000, [1.0])]
    got = nearest_rows(spark, rows)
    want = brute([r for n, r in enumerate(rows) if r not in rows[:n]])
    assert got == want
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[350]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[60_000]] == [60_001] and 70_000 not in got and 50_000 not in got
    assert nearest_rows(spark, []) == {} and nearest_rows(spark, [(50, None)]) == {} and nearest_rows(spark, [(1, a), (2, b)]) == {}


def test_recall_of_the_query(spark):
    from ledgerlens.llm.queries import op12_nearest_neighbours

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in op12_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, brute(rows)) >= 0.9


# 13 --------------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


@pytest.mark.parametrize("most", [2000, 4])
def test_variants_equal_brute_force(spark, most):
    rng = random.Random(9)
    counts = {}
    for letters, size, n in (("ab", 9, 150), ("aé", 12, 60), ("abcdef", 7, 200), ("x", 40, 20), ("ÿz", 1, 1)):
        for _ in range(n):
            w = "".join(rng.choice(letters) for _ in range(rng.randrange(max(1, size - 2), size + 3)))
            counts[w] = rng.choice([2, 3, 20, 30, 400, 500, 6000])
    words = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n bigint, l int").select("word", "n")
    got = spelling.variants(words, most=most).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(counts)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r[3] is not None for r in want) > 30 and any(r[3] != r[5] for r in want if r[3])


def test_parts_report_each_pair_once():
    rng = random.Random(4)
    for _ in range(200):
        l = rng.randrange(1, 9)
        words = sorted({"".join(rng.choice("ab") for _ in range(l + rng.randrange(2))) for _ in range(12)})
        cuts = sorted({0, l, *(rng.randrange(0, l + 1) for _ in range(2))})
        found = Counter()
        for s, e in zip(cuts, cuts[1:]):
            by = {}
            for w in words:
                by.setdefault((w[:s], w[e + len(w) - l :]), []).append(w)
            for group in by.values():
                found.update(frozenset((group[i], group[j])) for i, j in spelling.near_in_part(group, l, s, e))
        want = [frozenset((a, b)) for a in words for b in words if a < b and min(len(a), len(b)) == l and one_edit(a, b)]
        assert found == Counter(want)


def test_counts_of_words(spark):
    text = "Internet internet ÄPFEL-äpfel Straßenbahn straßenbahn_STRASSENBAHN 12internet34 ×÷×÷×÷×÷ kurz"
    rows = [(i, text) for i in range(40)] + [(None, text), (5, None), (6, ""), (7, "x" * 50_000 + " " + "x" * 50_000), (40, text), (40, text)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None:
                run = spelling.misspelt(run, zlib.crc32(f"{i}:{run}".encode()))
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.word_counts(frame(spark, rows)).collect()} == want
    assert spelling.misspelt("abcdefg", 93) == "abdefg" and spelling.misspelt("abcdefg", 92) == "abcdefg"
    assert spelling.variants(spelling.word_counts(frame(spark, []))).count() == 0
    assert len(spelling.variants(spelling.word_counts(frame(spark, rows))).collect()) == len(want)
