"""Texts of some 300,000 words: nothing is cut, and what stands at their end counts like what stands at their start."""

import binascii
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language, lines, mixing, mpegts, periodic, simhash, spelling

WORDS = "the of and to in that with house river stone green walks under slowly".split()


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(6)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(3000)) for _ in range(300_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text, "en", "s", 0), (2, long_text + " an item that stands at the very end of it", "en", "s", 0), (3, "short " * 5 + "der die das", "de", "s", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_media_columns(docs, long_text):
    got = mpegts.features(mpegts.packed(docs.where("doc_id = 1"))).first()
    raw = long_text.encode()
    payload = raw + b"\xff" * (-len(raw) % 576)
    assert (got.n_bytes, got.payload_bytes, got.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert got.tail_crc32 == binascii.crc32(payload[-32:])


def test_fingerprints_do_not_depend_on_pieces(monkeypatch, long_text):
    whole = simhash.fingerprint(long_text)
    monkeypatch.setattr(simhash, "_CHUNK", 1000)
    assert simhash.fingerprint(long_text) == whole != simhash.fingerprint(long_text[: len(long_text) // 2])


def test_an_item_at_the_end_is_found(spark, docs):
    items = spark.createDataFrame([(7, "an item that stands at the very end of it"), (8, "an item that stands nowhere in any of them")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()] == [(2, 7)]


def test_sizes_and_languages(docs):
    assert {r.doc_id: r["size"] for r in mixing.taken(docs).collect()} == {1: 300_000, 2: 300_010, 3: 8}
    got = {r.doc_id: (r.lang_pred, r.n_words) for r in language.predicted(docs, language.fit(docs, sequences=200)).collect()}
    assert got[1] == ("en", 300_000) and got[2] == ("en", 300_010)


def test_long_lines(spark, long_text):
    df = spark.createDataFrame([(1, long_text + "\nother"), (2, "first\n" + long_text + "!"), (3, long_text[1:] + "\n" + long_text[:-40] + "x" * 40)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.deduplicated(df).collect()}
    assert got == {1: (2, 0), 2: (2, 1), 3: (2, 1)}


def test_runs_and_spellings_at_the_end(spark, long_text):
    df = spark.createDataFrame([(None, long_text + " x y z" * 20 + " misspelling misspeling" + " misspelling" * 30)], "doc_id bigint, text string")
    runs = periodic.periodic(df).first().runs
    assert {(300_000, 60, 3), (300_061 + 1, 30, 1)} <= {(r.start, r.length, r.period) for r in runs}
    found = {r.word: r.form for r in spelling.variants(spelling.word_counts(df, twice=1)).where(F.col("word").startswith("missp")).collect()}
    assert found == {"misspelling": None, "misspeling": "misspelling"}


@pytest.mark.parametrize("rows", [1, 4, 1024])
def test_masks_in_pieces_give_the_edit_distance(monkeypatch, rows):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    monkeypatch.setattr(lines, "_ROWS", rows)
    rng = random.Random(rows)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(25)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "c"])
        for edits in (1, 2, 3):
            assert lines.within(a, "".join(b), edits) == min(plain(a, b), edits + 1)
