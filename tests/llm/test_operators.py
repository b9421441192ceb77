"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import binascii
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import brown, chat, decontaminate, html, language, lines, mixing, mpegts, recompress, simhash
from ledgerlens.llm.queries import LLM
from ledgerlens.llm.shared import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names clash with those that operators use inside.
CLASH = ", hash bigint, row bigint, doc bigint, fp bigint, size bigint, n bigint, key bigint, id bigint, leaked_id bigint, least_id bigint"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def frame(spark, rows, clash=False):
    full = [(i, t, lang, src, None if t is None else len(t)) + ((7,) * 10 if clash else ()) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA + (CLASH if clash else ""))


ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, "the same words here and there again for all", "en", "s"), (3, "the same words here and there again for all", "en", "s"),
    (4, "the same words here and there again for all", "de", None), (None, "the same words here and there again for all", "en", "s"),
    (5, " \n\t ", "en", "s"), (6, "word " * 3000, "fr", "t"), (7, "é" * 50 + "\n" + "ü" * 3, "fr", "t"), (8, "1 2 3 !", "en", "t"),
]


def test_the_shared_folder_is_local_in_local_sessions_alone():
    import os
    from types import SimpleNamespace as N

    from ledgerlens.llm.shared import shared_dir

    def session(master, found=None):
        return N(conf=N(get=lambda key, default: found), sparkContext=N(master=master, getConf=lambda: N(get=lambda key: None)))

    assert shared_dir(session("spark://h:7077", "s3a://bucket/tmp")) == "s3a://bucket/tmp"
    assert os.path.isdir(shared_dir(session("local[4]"))) and shared_dir(session("local[4]")) == shared_dir(session("local"))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


# 7 ---------------------------------------------------------------------------------------------------------------------


def words_in(text):
    return (text or "").encode().split()


def test_mixing_meets_targets(spark, sample):
    rows = mixing.taken(spark.read.parquet(f"{SF}/documents.parquet"), block=512).toPandas()
    sizes = {d: len(words_in(t)) for d, t in zip(sample.doc_id, sample.text)}
    assert dict(zip(rows.doc_id, rows["size"])) == sizes
    assert (rows.taken <= 2 * rows["size"]).all()
    by = rows.merge(sample[["doc_id", "source"]], on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 1).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    # Targets: what full sources can't take goes to the others by weight.
    order = sorted(by.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * by["size"].sum()
    while True:
        total = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] / total > 2 * by["size"][s]}
        if not over:
            target |= {s: left * weight[s] / total for s in order if s not in full}
            break
        for s in over:
            target[s] = 2 * by["size"][s]
        full |= over
        left = 1.5 * by["size"].sum() - sum(target[s] for s in full)
    assert all(by.target[s] == pytest.approx(target[s]) for s in order)


def test_schedule_is_spread_and_whole(spark):
    goal = spark.createDataFrame([(0, 8000.0, 8000), (1, 1000.0, 1000), (2, 1.0, 1), (3, 0.0, 0)], "sid int, target double, quota bigint")
    slots = mixing.schedule(spark, goal, 10).toPandas().sort_values("slot")
    assert slots.slot.is_unique and {s: sorted(g["rank"]) for s, g in slots.groupby("sid")} == {0: list(range(800)), 1: list(range(100)), 2: [0]}
    assert slots.slot.tolist() == list(range(901))
    # Discrepancy: after any number of slots, each source has had its share but for a few (the points' own bound is a logarithm).
    for sid, need in ((0, 800), (1, 100), (2, 1)):
        had = np.cumsum(slots.sid.to_numpy() == sid)
        assert np.abs(had - np.arange(1, 902) * need / 901).max() <= 1 + math.log2(901) / 2
    for sid, g in slots.groupby("sid"):
        assert g["rank"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 901])
def test_places_of_points(spark, n):
    at = spark.range(n).select("id", mixing.place_among(mixing.van_der_corput(F.col("id")), n).alias("p")).collect()
    points = sorted(range(n), key=lambda k: f"{k:040b}"[::-1])
    assert {r.id: r.p for r in at} == {k: i for i, k in enumerate(points)}


def test_mixing_odd_rows(spark):
    got = mixing.taken(frame(spark, ODD, clash=True), block=4).toPandas()
    assert len(got) == len(ODD) and mixing.taken(frame(spark, [])).count() == 0
    again = mixing.taken(frame(spark, list(reversed(ODD))), block=4).toPandas()
    key = ["doc_id", "size", "target", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.taken(frame(spark, [(1, None, None, None)])).first().taken == 0


# 9 ---------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in low.encode().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(sample):
    for t in [*sample.text[:60], None, "", "one", "one two", "É A b c d e f g"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values):
        for k in range(1, 6):
            w = v
            for b in rng.sample(range(64), k):
                w ^= 1 << b
            values.add(w)
    values |= {0, 2**64 - 1, 2**63, 7}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()}
    nums = sorted(x for (x,) in signed)
    want = {(a, b) for i, a in enumerate(nums) for b in nums[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, ODD, clash=True)).collect()
    assert len(got) == len(ODD)
    at = {(r.doc_id, r.fp): r.component_id for r in got}
    assert {c for (d, f), c in at.items() if f == 0} == {1}
    same = [r.component_id for r in got if r.fp == simhash_signed("the same words here and there again for all")]
    assert same == [3] * 4
    kept = simhash.firsts(frame(spark, ODD, clash=True))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "6", "7", "8", "None"])
    # Rows that share an id but not a text are each judged for themselves.
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(2)]
    shared = simhash.firsts(frame(spark, [(1, texts[0], "en", "s"), (1, texts[1], "en", "t"), (2, texts[0], "en", "s"), (1, texts[1], "en", "a")])).collect()
    assert sorted((r.doc_id, r.text) for r in shared) == sorted((1, t) for t in texts)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def simhash_signed(text):
    return int(np.uint64(plain_fingerprint(text)).astype(np.int64))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 160, 162, 163, 175, 176, 177, 345, 346, 347, 575, 576, 577, 4608, 4609, 70_000])
def test_transport_stream_round_trip(size):
    payload = bytes(i * 7 % 256 for i in range(size)) or b"x"
    media = mpegts.pack(payload)
    found = mpegts.unpack(media)
    assert found.payload == payload and found.gaps == 0 and found.crc_errors == 0 and found.programs == 1
    assert len(found.random_access) == len(found.stamps) == -(-len(payload) // mpegts.ACCESS_UNIT)
    assert found.stamps == [k * mpegts.TICKS for k in range(len(found.stamps))]


def test_transport_stream_faults():
    whole = mpegts.pack(b"a" * 2000)
    media = bytearray(whole)
    del media[3 * 188 : 4 * 188]
    assert mpegts.unpack(bytes(media)).gaps == 1
    # A packet sent twice, one without payload and a flagged step aren't gaps.
    twice = whole[: 4 * 188] + whole[3 * 188 :]
    found = mpegts.unpack(twice)
    assert found.gaps == 0 and found.payload == b"a" * 2000
    empty = whole[3 * 188 : 3 * 188 + 3] + bytes((0x20 | whole[3 * 188 + 3] & 15, 183)) + b"\0" + b"\xff" * 182
    found = mpegts.unpack(whole[: 4 * 188] + empty + whole[4 * 188 :])
    assert found.gaps == 0 and found.payload == b"a" * 2000
    many = bytearray(mpegts.pack(b"b" * 10_000))
    firsts = [i for i in range(2 * 188, len(many), 188) if many[i + 1] & 0x40]
    del many[firsts[1] - 188 : firsts[1]]
    assert mpegts.unpack(bytes(many)).gaps == 1
    many[firsts[1] - 188 + 5] |= 0x80
    assert mpegts.unpack(bytes(many)).gaps == 0


def test_sections_span_packets():
    body = b"".join(bytes((n >> 8, n & 255, 0xE1, 0x00)) for n in range(1, 90))
    section = mpegts._section(0, 1, body)
    head = bytes((0x47, 0x40, 0, 0x10, 0)) + section[:183]
    tail = (bytes((0x47, 0, 0, 0x11)) + section[183:]).ljust(376, b"\xff")
    tail = tail[:188] + (bytes((0x47, 0, 0, 0x12)) + tail[188 : 188 + 184]).ljust(188, b"\xff")
    found = mpegts.unpack(head + tail + mpegts.pack(b"x" * 576)[188:])
    assert found.programs == 89 and found.crc_errors == 0 and found.payload == b"x" * 576


def test_corrupt_streams_give_rows(spark):
    good = mpegts.pack(b"x" * 576)
    rows = [(1, 576, good), (2, 0, b"\0" * 188), (3, 0, None), (4, 0, good[:188]), (5, 0, b"\x47" + bytes(187))]
    got = {r.doc_id: r for r in mpegts.features(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert got[1].payload_bytes == 576 and got[1].pts == [0] and got[1].access_points == [2 * 188]
    for k in (2, 3, 4, 5):
        assert got[k].feature.startswith("error=") and got[k].payload_sha256 is None


def test_transport_stream_faults_raise():
    with pytest.raises(ValueError):
        mpegts.unpack(b"\0" * 188)
    with pytest.raises(ValueError):
        mpegts.unpack(b"\x47" * 100)


def test_media_features(spark):
    got = mpegts.features(mpegts.packed(frame(spark, ODD, clash=True))).collect()
    assert len(got) == len(ODD) and mpegts.features(mpegts.packed(frame(spark, []))).count() == 0
    texts = {(i, len((t or "").encode())): t for i, t, _, _ in ODD}
    for r in got:
        raw = (texts[r.doc_id, r.n_bytes] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-32:]))


# 4 ---------------------------------------------------------------------------------------------------------------------


def plain_substring_dedup(rows, window=13):
    least = {}
    split = [(i, words_in(t)) for i, t, *_ in rows]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = b" ".join(w[s : s + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if least[b" ".join(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def check_substrings(spark, rows, clash=False):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompress.deduplicated(frame(spark, rows, clash)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_substring_dedup(rows)))
    return got


def test_substrings_of_the_sample(spark, sample):
    check_substrings(spark, [(int(d), t, "en", "s") for d, t in zip(sample.doc_id, sample.text)])


def test_substrings_of_small_alphabets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "abcdefg") for _ in range(rng.randrange(5, 60))), "en", "s") for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100 + i, f"{rng.random()} {passage if i % 2 else passage[:60]} {rng.random()}", "en", "s") for i in range(10)]
    rows += [(200, "a " * 50, "en", "s"), (201, "a " * 30, "en", "s"), (202, "a b " * 20, "en", "s"), (203, "a b " * 10, "en", "s"), (204, "a " * 13, "en", "s"), (205, "a " * 12, "en", "s")]
    assert sum(r[2] for r in check_substrings(spark, rows)) > 400


def test_substrings_odd_rows(spark):
    check_substrings(spark, ODD, clash=True)
    assert recompress.deduplicated(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        recompress.runs(np.zeros(20, np.uint64), np.array([20]), 8)


# 5 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|", "a<|b<|", "<<||", "\\<|", "plain\n"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.read_back(chat.piece("user", text)[0]) == [("user", text)]
    assert chat.read_back(chat.piece("r\n\\n" + text, text)[0]) == [("r\n\\n" + text, text)]


def test_layouts_by_fingerprint():
    layouts = chat.Layouts()
    cases = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "more": 1}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"value": "b", "from": "gpt"}]}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]), ({"output": "o", "instruction": "i"}, [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]), ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]),
        ({"unknown": 1}, None), ([1], None),
    ]
    for record, turns in cases:
        assert layouts.turns(record)[1] == turns
    assert layouts.fingerprint({"a": 1, "role": "x", "text": "y"}) == layouts.fingerprint({"text": "", "role": ""})


def test_conversations_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "tie"), (1, None, None, "first"), (2, 0, "assistant", "<|im_end|>é"), (None, 0, "user", "x"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df, "conv_id", record, ["turn", "role", "text"]), "conv_id").collect()}
    said = "".join(f"{a}\n{b}\n" for a, b in [("", "first"), ("user", ""), ("user", "tie"), ("assistant", "a"), ("assistant", "a")])
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == 2
    assert got[2].loss_sha256 == hashlib.sha256("<|im_end|>é".encode()).hexdigest() and got[None].n_turns == 1
    bad = spark.createDataFrame([(1, 0, "{", None), (1, 1, None, None)], "conv_id bigint, turn bigint, r string, text string")
    assert [r.piece for r in chat.formatted(bad, "conv_id", F.col("r"), ["turn"]).collect()] == [None, None]
    assert chat.digests(chat.formatted(df.limit(0), "conv_id", record, ["turn"]), "conv_id").count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one  two\n<b>three</b></p><p>x</p></article><footer>f</footer></body></html>", "A & B\none two three\nx"),
    ("<article><p>a<p>b<br>c</article><aside>side</aside><form>form</form>", "a\nb c"),
    ("<body><header><h1>Site</h1></header><main><div class='ad-box'>buy</div><p>text of the page</p><section id=comments><p>nice</p></section></main></body>", "text of the page"),
    ("<article><script>var a='<p>no</p>'</script><style>p{}</style><!-- no --><p>yes</p><div role=navigation>no</div><p hidden>no</p></article>", "yes"),
    ("<div><div class=cookie-notice>we use cookies</div><p>Just a page with some words in it.</p><p>And a second block.</p></div>", "Just a page with some words in it.\nAnd a second block."),
    ("<div class='page has-sidebar'><div class='entry-header'><h1>Title here</h1></div><p>Some text that is long enough to be content.</p></div>", "Title here\nSome text that is long enough to be content."),
    ("<article><h1>T</h1><p>Some words of a first paragraph that go on.</p><h2 id=related-work>Related work</h2><section id=search-algorithms><p>Searching a list of words takes time.</p></section><p class='lead ad-free'>The last paragraph of this page is here.</p><div class='ad box'>Buy this now and save a lot of money today.</div></article>", "T\nSome words of a first paragraph that go on.\nRelated work\nSearching a list of words takes time.\nThe last paragraph of this page is here."),
    ("<article><p>Some words of a first paragraph that go on and on.</p><ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a><li><a href=d>four</a><li><a href=e>five</a></ul><p>Some words of the second paragraph, also long.</p></article>", "Some words of a first paragraph that go on and on.\nSome words of the second paragraph, also long."),
    ("<nav><a href=x>menu</a> <a href=y>more</a><article><p>The text behind an open menu.</p></article><footer>end</footer>", "The text behind an open menu."),
    ("<nav><ul><li><a href=x>menu</a><li><a href=y>more</a></ul><div><p>The text behind an open menu, which is long enough.</p><p>And more of it here.</p></div>", "The text behind an open menu, which is long enough.\nAnd more of it here."),
    ("<body><form id=aspnet><div class=content><p>A page that stands in a form as a whole.</p></div></form></body>", "A page that stands in a form as a whole."),
    ("<p>Text with a <button>press</button>button and a <b>bold <i>word</b></i> in it.</p>", "Text with a button and a bold word in it."),
    ("<main><p>Main words of the page, quite a few of them.</p><section class=comments><article class=comment><p>Very nice and a long comment about all of it!</p></article></section></main>", "Main words of the page, quite a few of them."),
    ("<article><h1>T</h1><p>The only paragraph.</p></article><div id=c><p>A remark of a reader, longer than the article it is about, by far.</p><p>And another long one, about the remark before it this time.</p></div>", "T\nThe only paragraph."),
    ("<body><article><h1>T</h1><p>The only paragraph.</p></article><article><p>A remark of a reader, longer than the article it is about, by far.</p></article></body>", "T\nThe only paragraph."),
    ("<main><article><h1>T</h1><p>The only paragraph.</p></article><div id=c><p>A remark of a reader, longer than the article it is about.</p></div></main>", "T\nThe only paragraph."),
    ("<article><header><h1>T</h1><p>Standfirst</p><div>By someone</div></header><p>Text of the article.</p></article>", "T\nStandfirst\nText of the article."),
    ("<article><p>a <select><option>x</select> rest of the paragraph</p></article>", "a rest of the paragraph"),
    ("<body><div><div class=lead>A short lead</div><p>" + "many long words here " * 9 + "</p><p>" + "other long words here " * 9 + "</p><h2>Last</h2><p>The end.</p></div></body>", "A short lead\n" + ("many long words here " * 9).strip() + "\n" + ("other long words here " * 9).strip() + "\nLast\nThe end."),
    ("<article><p>Some words of a first paragraph that go on.</p><ul><li><a href=a>one book</a><li><a href=b>two books</a></ul><p>Words of the second paragraph.</p><p><a href=x>More</a></p></article>", "Some words of a first paragraph that go on.\none book\ntwo books\nWords of the second paragraph."),
    ("<p>text<a href='no end", "text"), ("<p>1 < 2 and <", "1 < 2 and <"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<<<>&lt;", "<<<><"), ("<article><p>unclosed <b>bold", "unclosed bold"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_of_the_sample():
    """Precision and recall by words, against what stands in each page's article element."""
    import html as markup
    import re

    import duckdb

    right = found = wanted = 0
    for (page,) in duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet') WHERE html IS NOT NULL").fetchall():
        inside = re.search(r"<article>(.*)</article>", page, re.S)
        want = Counter(markup.unescape(re.sub(r"<[^>]+>", " ", inside[1] if inside else "")).split())
        got = Counter(html.main_text(page).split())
        right, found, wanted = right + (want & got).total(), found + got.total(), wanted + want.total()
    assert right >= 0.95 * found and right >= 0.95 * wanted > 1000


def plain_main_text(page):
    """The same choice of lines, written without running flags: every question walks up the page's containers."""
    parser = html._parsed(page)
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""

    def up(i, parent):
        while i >= 0:
            yield i
            i = parent[i]

    def plain(x):
        return max(0, len(x[0]) - x[1])

    whole = sum(map(plain, lines))
    marks = [[m for m in up(x[5], parser.outer)] if x[5] >= 0 else [] for x in lines]
    big = {m for m in range(len(parser.by)) if parser.by[m] in ("words", "form") and sum(plain(x) for x, ms in zip(lines, marks) if m in ms) > 0.8 * whole}
    away = [any(parser.closed[m] and m not in big for m in ms) for ms in marks]
    ratio = [0 if gone else plain(x) / max(1, x[2]) for x, gone in zip(lines, away)]
    kernel = {k: math.exp(-k * k / 2) for k in range(-2, 3)}
    soft = [sum(w * ratio[i + k] for k, w in kernel.items() if 0 <= i + k < len(ratio)) / sum(w for k, w in kernel.items() if 0 <= i + k < len(ratio)) for i in range(len(ratio))]
    border = html.threshold(soft)
    high = [v >= border and v > 0 and not gone for v, gone in zip(soft, away)]
    mass = [sum(max(1, plain(x)) for x, h in zip(lines, high) if h and c in up(x[3], parents)) for c in range(len(parents))]
    mains = [c for c in range(len(parents)) if parser.main[c] and mass[c]]
    inner = [c for c in mains if not any(c in up(parents[d], parents) and mass[d] > 0.8 * mass[c] for d in mains)]
    best = max(inner, key=lambda c: mass[c], default=0)
    best = best if mass[best] >= 0.2 * mass[0] else 0
    # The only article, or the only one that has a first-level heading and no article around that heading inside it.
    nearest = [next((c for c in up(x[3], parents) if parser.main[c]), 0) for x in lines]
    there = {c for c, x, gone in zip(nearest, lines, away) if c and not gone and plain(x)}
    titled = {c for c, x, gone in zip(nearest, lines, away) if c and not gone and plain(x) and x[4]}
    if len(titled) == 1 or not titled and len(there) == 1:
        best = min(titled or there)
    region = best
    while not best and (deep := [c for c in range(len(parents)) if parents[c] == region and mass[c] >= max(1, 0.9 * mass[0])]):
        region = deep[0]
    own = [i for i, x in enumerate(lines) if region in up(x[3], parents) and not away[i]]
    links = "".join("l" if 2 * lines[i][1] > len(lines[i][0]) else "t" for i in own)
    text = []
    for k, i in enumerate(own):
        if links[k] == "l":
            before, after = re.search(r"(.?)(l*)$", links[: k + 1]), re.match(r"(l*)(.?)", links[k:])
            run = len(before[2]) + len(after[1]) - 1
            if not (best and run <= 2 and before[1] and after[2]) and (run > 1 or not high[i]):
                continue
        text.append(i)
    if not best:
        seeds = [i for i in text if high[i] or lines[i][4]]
        alone = parser.kinds[region] not in ("", "html", "body")
        text = [i for i in text if seeds and (alone or min(seeds) <= i <= max(seeds) and any(lines[j][3] == lines[i][3] for j in seeds))]
    return "\n".join(lines[i][0] for i in text)


def test_main_text_against_a_plain_version():
    rng = random.Random(12)
    tags = "div p article main section nav aside footer header ul li h1 h2 a b form table tr td span".split()
    for _ in range(400):
        page = "".join(
            rng.choice((f"<{rng.choice(tags)}{rng.choice(('', '', ' class=ad-box', ' id=related-work', ' class=comments'))}>", f"</{rng.choice(tags)}>", "word " * rng.randrange(1, 30), "x", "<br>"))
            for _ in range(rng.randrange(60))
        )
        assert html.main_text(page) == plain_main_text(page)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<p><b>" * 50_000 + "x", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<article><p>a" * 30_000, "<table><td>" * 30_000 + "<h1>" * 30_000, "<nav>" * 50_000 + "<p>text</p>", *(x * 50_000 for x in ("<a ", "</a ", '<a href="', "<!--", "<!", "<?", "<![CDATA[", "&#", "<script>", "<a <")), "<a " * 50_000 + ">"])
def test_time_is_linear_in_the_page(page):
    import time

    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 5


def test_smoothing_and_threshold():
    assert html.smoothed([4.0] * 7) == pytest.approx([4.0] * 7)
    assert html.smoothed([0, 0, 1, 0, 0])[2] == max(html.smoothed([0, 0, 1, 0, 0]))
    assert 2 < html.threshold([1, 1, 2, 50, 60]) <= 50


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", PAGES[0][0], 2), (1, None, None, 1)], "page_id bigint, url string, html string, text int")
    got = html.extracted(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(PAGES[0][1])] and html.extracted(df.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_scores(spark, sample):
    got = {r.doc_id: r for r in LLM.queries()["op8_lm_scores"](spark, SF).collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = {int(d): (t or "").encode().translate(low).split() + [None] for d, t in zip(sample.doc_id, sample.text)}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in words.items():
        r = got[d]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_are_class_probabilities(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    m = brown.fit(docs, top_words=20, endings=10, classes=6, block_words=500, lexicon=200)
    words = {r.word: (r.n, r.cls) for r in m.words.collect()}
    move, full = 10**m.log_move, 10**m.log_full
    assert move.sum(1) == pytest.approx(np.ones(len(move)))
    for c in range(1, len(move)):  # the words of a class and one for those not seen
        assert (sum(n + 0.1 for n, k in words.values() if k == c) + 0.1) / full[c] == pytest.approx(1)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    texts = {r.doc_id: [w.decode() for w in (r.text or "").encode().translate(low).split()] for r in rows}
    counts = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    assert {w: n for w, (n, _) in words.items()} == counts
    got = {r.doc_id: r for r in brown.scored(docs, top_words=20, endings=10, classes=6, block_words=500, lexicon=200).collect()}
    classes = {r.doc_id: list(r.classes) for r in m.texts.collect()}
    ends = sum(not h for h in held.values())
    grid = np.zeros(move.shape)
    for d, ws in texts.items():
        assert all(classes[d][i] == words[w][1] for i, w in enumerate(ws) if w in words)
        seq = [0, *classes[d], 0]
        if not held[d]:
            np.add.at(grid, (seq[:-1], seq[1:]), 1)
        want = sum(math.log10(move[a, b]) for a, b in zip(seq, seq[1:]))
        want += sum(math.log10((counts.get(w, 0) + 0.1) / full[words[w][1] if w in words else classes[d][i]]) for i, w in enumerate(ws)) + math.log10((ends + 0.1) / full[0])
        assert got[d].score == pytest.approx(want)
    size = grid.sum(0)
    want = (grid + 5 * ((size + 0.1) / (size.sum() + 0.1 * len(size)))) / (grid.sum(1, keepdims=True) + 5)
    assert move == pytest.approx(want)


def test_words_join_the_class_of_their_contexts(spark):
    rng = random.Random(6)
    subjects, verbs = [f"sub{i}x" for i in range(12)], [f"ver{i}x" for i in range(12)]
    texts = [" ".join(f"{rng.choice(subjects)} {rng.choice(verbs)}" for _ in range(40)) for _ in range(60)]
    m = brown.fit(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), top_words=8, endings=2, classes=3)
    cls = {r.word: r.cls for r in m.words.collect()}
    assert len({cls[w] for w in subjects}) == 1 and len({cls[w] for w in verbs}) == 1 and cls["sub0x"] != cls["ver0x"]


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    table = np.zeros((21, 21))
    for a in range(1, 21):
        for b in range(1, 21):
            if (a <= 10) == (b <= 10):
                table[a, b] = rng.integers(20, 40)
    cls = brown.exchange(table, 3)
    assert len(set(cls[1:11])) == 1 and len(set(cls[11:])) == 1 and cls[1] != cls[20] and cls[0] == 0


def test_scores_odd_rows(spark):
    got = brown.scored(frame(spark, ODD, clash=True)).collect()
    assert len(got) == len(ODD)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 5)] == [1, 1, 1] and all(math.isfinite(r.score) for r in got)
    assert brown.scored(frame(spark, [])).count() == 0


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_containment(spark):
    item = " ".join(f"w{i}" for i in range(24))
    broken = " ".join("zz" if i == 0 else f"w{i}" for i in range(24))
    half = " ".join(f"w{i}" for i in range(14))
    docs = [(1, f"before {item.upper()} after", "en", "s"), (2, broken, "en", "s"), (3, half, "en", "s"), (4, "x " * 5000 + item, "en", "s"), (4, "x " * 5000 + item, "en", "s"), (None, item, "en", "s"), (9, "it is too short. Or too short here", "en", "s")] + ODD
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too Short"), (None, item), (5, "x x x x x x x x"), (6, "W3 w4 w5 w6"), (7, "w4 w3")], "item_id bigint, text string")
    df = frame(spark, docs, clash=True)
    for rows in (500_000, 0):
        got = sorted((str(r.doc_id), str(r.item_id), r.n_shared) for r in decontaminate.contained(df, items, broadcast_rows=rows).collect())
        want = [(d, i, n) for d, n in (("1", 20), ("2", 19), ("4", 20), ("4", 20), ("None", 20)) for i in ("1", "None")] + [("4", "5", 1)] * 2
        want += [(d, "6", 1) for d in ("1", "2", "3", "4", "4", "None")] + [("9", "4", 1)]  # of fewer words than a shingle, whole
        assert got == sorted(want)
    assert {r.doc_id for r in decontaminate.clean(df, items.where("item_id is null or item_id not in (4, 6)")).collect()} == {3, 5, 6, 7, 8, 9}
    assert decontaminate.contained(df, items.limit(0)).count() == 0 and decontaminate.contained(df.limit(0), items).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.random()
        if k < 0.33 and out:
            out.pop(rng.randrange(len(out)))
        elif k < 0.66:
            out.insert(rng.randint(0, len(out)), rng.choice("abc"))
        elif out:
            out[rng.randrange(len(out))] = rng.choice("abc")
    return "".join(out)


def test_banded_distance_and_segments():
    rng = random.Random(1)
    for _ in range(4000):
        t = rng.randrange(5)
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(15)))
        b = near(rng, a, rng.randrange(7))
        d = distance(a, b)
        assert lines.within(a, b, t) == min(d, t + 1)
        if t and min(len(a), len(b)) > t and d <= t:
            x, y = sorted((a, b), key=len)
            index = {(len(x), i, x[s : s + n]) for i, (s, n) in enumerate(lines.segments(len(x), t))}
            assert index & {(o, i, y[s : s + n]) for o, i, s, n in lines.probes(len(y), t, 0.0)}


def test_short_lines_allow_fewer_edits():
    assert [lines.allowed(n) for n in (0, 4, 5, 9, 10, 500)] == [0, 0, 1, 1, 2, 2]


def test_split_keys_lose_nothing():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 24)))
        x, y = sorted((a, near(rng, a, rng.randrange(4))), key=len)
        if not lines.near_equal(x, y, 2, 0.8):
            continue
        every = {h for a, b, seed in lines._indexed(len(x), 2, 0.8) for h in [xxhash.xxh64_intdigest(x[a:b], seed)]}
        asked = {xxhash.xxh64_intdigest(y[s : s + n], o << 3 | i) for o, i, s, n in lines.probes(len(y))}
        for hot in (set(), every, {min(every)}):
            met = (every & asked) - hot
            for key in every & asked & hot:
                met |= set(lines.split_index(x, key, 2, 0.8)) & lines.split_probe(y, key, 2, 0.8)
            assert lines.first_shared(x, y, 2, 0.8, hot) in met


def linked_lines(a, b):
    t = min(2, int(min(len(a), len(b)) * 0.2 + 1e-9))
    return a != b and t > 0 and abs(len(a) - len(b)) <= t and distance(a, b) <= t


def plain_line_dedup(rows):
    first = {}
    for i, t, *_ in rows:
        for no, raw in enumerate((t or "").split("\n")):
            if line := raw.strip(" \t\r\x0b\x0c"):
                at = (i is not None, i, no)
                first[line] = min(first.get(line, at), at)
    parent = {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(first)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if linked_lines(a, b):
                parent[find(a)] = find(b)
    head = {}
    for x, at in first.items():
        head[find(x)] = min(head.get(find(x), at), at)
    out = []
    for i, t, *_ in rows:
        kept = [raw for no, raw in enumerate((t or "").split("\n")) if not (line := raw.strip(" \t\r\x0b\x0c")) or head[find(line)] == (i is not None, i, no)]
        out.append((i, (t or "").count("\n") + 1, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_classes(spark):
    rng = random.Random(4)
    pool = ["the quick brown fox jumps", "over the lazy dog and on", "ab" * 12, "Page 1", "Page 2", "no", "yes", "on", "ten chars!"]
    for _ in range(120):
        pool.append(near(rng, rng.choice(pool), rng.randrange(1, 4)))
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 6))), "en", "s") for i in range(60)] + [(None, pool[5], "en", "s"), (70, "short\n\nshort", "en", "s"), (71, None, "en", "s")]
    got = [(r.doc_id, r.n_lines, r.kept_sha256) for r in lines.deduplicated(frame(spark, rows, clash=True)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_line_dedup(rows)))


def test_lines_odd_rows(spark):
    got = lines.deduplicated(frame(spark, ODD, clash=True)).collect()
    assert len(got) == len(ODD) and lines.deduplicated(frame(spark, [])).count() == 0
    clean = lines.cleaned(frame(spark, ODD, clash=True))
    assert clean.columns == frame(spark, ODD, clash=True).columns and clean.count() == len(ODD)


@pytest.mark.parametrize(("block", "frequent"), [(65_536, 2000), (150, 3)])
def test_line_links_are_counted(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(9)
    pool = ["the quick brown fox jumps", "ab" * 12, "Page 1"]
    for _ in range(80):  # large groups of near-equal lines, nearly all of whose links lie inside a class
        pool.append(near(rng, rng.choice(pool[:3]), rng.randrange(1, 3)))
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(4)), "en", "s") for i in range(60)] + [(70, "short\n\na line of its own", "en", "s")]
    every = {x for _, t, *_ in rows for x in t.split("\n") if x}
    want = {x: n for x in every if (n := sum(linked_lines(a, x) for a in every))}
    found = {r.id: (r.root, r.n_links) for r in lines.linked(frame(spark, rows), counted=True, frequent=frequent, broadcast_rows=0 if frequent == 3 else 10**6).collect()}
    named = {xxhash.xxh64_intdigest(x, 42): x for x in every}
    assert {named[i % 2**64]: n for i, (_, n) in found.items()} == want
    for a in want:
        for b in want:
            if linked_lines(a, b):
                ra, rb = (found[int(np.uint64(xxhash.xxh64_intdigest(x, 42)).astype(np.int64))][0] for x in (a, b))
                assert ra == rb
    if frequent != 3:
        got = {r.doc_id: r for r in lines.deduplicated(frame(spark, rows)).collect()}
        for i, t, *_ in rows:
            told = [x for x in t.split("\n") if x]
            assert got[i].links == [want.get(x, 0) for x in told] and got[i].n_links == sum(got[i].links)
            assert len(got[i].classes) == len(told)
        assert len(set(got[70].classes)) == 2


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    got = language.marginals(scores, np.array([4, 0, 1, 4]), moves)
    at = 0
    for n in (4, 0, 1, 4):
        part, want, total = scores[at : at + n], np.zeros((n, 3)), 0.0
        for path in np.ndindex(*(3,) * n) if n else ():
            p = np.exp(sum(part[i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, s in enumerate(path):
                want[i, s] += p
        if n:
            assert got[at : at + n] == pytest.approx(want / total)
        at += n


def test_language_held_out(spark, sample):
    got = LLM.queries()["op6_language_id"](spark, SF).toPandas().merge(sample[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_code_switching():
    rng = random.Random(3)
    a, b = [["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "cuatro"]]
    texts = [[rng.choice(p) for _ in range(30)] for p in (a, b) for _ in range(10)]
    model = language.Model.fitted(texts, ["x"] * 10 + ["y"] * 10, sequences=300, epochs=2)
    words = ["alpha", "beta", "gamma"] * 3 + ["uno", "dos", "tres"] * 3
    p = language.marginals(language.emissions(words, model.weights), np.array([18]), model.moves)
    assert (p[:9, 0] > 0.5).all() and (p[9:, 1] > 0.5).all()


def test_language_odd_rows(spark):
    df = frame(spark, ODD, clash=True)
    model = language.fit(df)
    got = language.predicted(df, model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 5, 8)} == {"und"}
    none = language.fit(df.where("lang is null"))
    assert {r.lang_pred for r in language.predicted(df, none).collect()} == {"und"}
    assert language.predicted(df.limit(0), model).count() == 0
    assert language.accepted(df, model).columns == df.columns


def test_a_label_without_words_does_not_stop_training(spark):
    rng = random.Random(5)
    pools = {"en": ["alpha", "beta", "gamma", "delta"], "es": ["uno", "dos", "tres", "cuatro"], "fr": ["rouge", "vert", "bleu", "gris"]}
    rows = [(i, " ".join(rng.choice(pools[lang]) for _ in range(30)), lang, "s") for i, lang in enumerate(list(pools) * 12)]
    rows += [(i, "12 34 56", "aa", "s") for i in range(100, 104)]
    df = frame(spark, rows)
    model = language.fit(df, sequences=300)
    got = {r.doc_id: r.lang_pred for r in language.predicted(df, model).collect()}
    assert model.languages == ["en", "es", "fr"]
    assert all(got[i] == (lang if i < 100 else "und") for i, _, lang, _ in rows)
    assert language.accepted(df, model).count() == 36
    for label in ("en", None):  # one language alone, and none
        some = frame(spark, [(i, t, label if i < 100 else "aa", s) for i, t, _, s in rows])
        assert language.accepted(some, language.fit(some)).count() == 36


@pytest.mark.parametrize("ids", ["null", "equal", "half null", "two"])
def test_language_sample_whatever_the_ids(spark, ids):
    """Each language is learned, however ids repeat; ids that are held out teach nothing."""
    rng = random.Random(4)
    words = {"en": "the of and house river stone green walks".split(), "de": "der die und nicht haus fluss stein geht".split()}
    of = {"null": lambda i: None, "equal": lambda i: 9, "half null": lambda i: None if i % 2 else i, "two": lambda i: 1 + i % 2}[ids]
    rows = [(of(i), " ".join(rng.choice(words[lang]) for _ in range(8)), lang, "s") for i in range(3000) for lang in words]
    model = language.fit(frame(spark, rows), per_language=50, sequences=200)
    assert model.languages == ["de", "en"]
    got = language.predicted(frame(spark, [(1, "the river walks", None, "s"), (2, "der fluss geht", None, "s")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "en", 2: "de"}
    same = language.fit(frame(spark, [(1, "the green house", "en", "s")] * 3000 + [(9, "das haus", "de", "s")] * 3000), sequences=200)
    assert same.languages == ["de", "en"]


def plain_language(text, model):
    """Prediction of one text word by word, with the features spelt out and no words shared."""
    words = (text or "").lower().split()
    usable = [any(map(str.isalpha, w)) for w in words]
    if not any(usable):
        return "und", 0.0
    n = len(model.languages)
    scores = []
    for w, ok in zip(words, usable):
        total = [0.0] * n
        if ok:
            slots, _ = language.features([w])
            for s in slots:
                total = [t + float(np.float32(x)) for t, x in zip(total, model.weights[s])]
        scores.append(total)
    ahead = []
    for i, s in enumerate(scores):
        row = [math.exp(s[k]) * (sum(ahead[-1][j] * math.exp(model.moves[j, k]) for j in range(n)) if i else 1.0) for k in range(n)]
        ahead.append([x / sum(row) for x in row])
    behind = [[1.0] * n]
    for s in reversed(scores[1:]):
        row = [sum(math.exp(model.moves[j, k]) * math.exp(s[k]) * behind[0][k] for k in range(n)) for j in range(n)]
        behind.insert(0, [x / sum(row) for x in row])
    mean = [0.0] * n
    for a, b, ok in zip(ahead, behind, usable):
        both = [x * y for x, y in zip(a, b)]
        mean = [m + ok * x / sum(both) for m, x in zip(mean, both)]
    best = max(range(n), key=lambda k: mean[k])
    return model.languages[best], mean[best] / sum(usable)


def test_predictions_against_a_plain_version(spark, sample):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, sequences=600)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(docs, model).collect()}
    short = [(d, t) for d, t in zip(sample.doc_id, sample.text) if t is None or len(t) < 2500][:50]
    assert len(short) == 50
    for d, text in short:
        lang, score = plain_language(text, model)
        assert got[d][0] == lang and got[d][1] == pytest.approx(score, abs=1e-5)
