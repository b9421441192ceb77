"""Pointer doubling, interval and as-of joins, and the import scan, each against a plain version."""

import random
import time
from datetime import datetime, timedelta

import pytest

from ledgerlens.operators import graph, imports, intervals


def plain_chain(parents, start, most):
    rows, path, name = [(start, start, 0, (start,), None)], [start], start
    for depth in range(1, most + 1):
        name = parents.get(name)
        if name is None:
            break
        issue = "cycle" if name in path else "too_deep" if depth >= most else None
        path.append(name)
        rows.append((start, name, depth, tuple(path), issue))
        if issue:
            break
    return rows


@pytest.mark.parametrize("most", [1, 8, 64])
def test_extends_chains(spark, most):
    rng = random.Random(most)
    parents = {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 60)} | {f"l{i}": f"l{i + 1}" for i in range(80)}
    for size in range(1, 10):  # cycles, each with a tail of four
        for i in range(size):
            parents[f"c{size}.{i}"] = f"c{size}.{(i + 1) % size}"
        for i in range(4):
            parents[f"t{size}.{i}"] = f"t{size}.{i + 1}" if i < 3 else f"c{size}.0"
    parents |= {"lost": "nowhere"}
    nodes = spark.createDataFrame([*parents.items(), ("n0", None), ("l80", None)], "name string, parent string")
    got = {(r.start, r.name, r.depth, tuple(r.path), r.issue) for r in graph.extends_chain(nodes, most).collect()}
    want = {row for start in [*parents, "n0", "l80"] for row in plain_chain(parents, start, most)}
    assert got == want
    assert any(r[4] == "cycle" for r in want) and any(r[4] == "too_deep" for r in want)
    assert graph.extends_chain(nodes.limit(0), most).count() == 0


def test_points_in_ranges(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), rng.choice([rng.randrange(300), rng.randrange(-5000, 2_000_000)]), i) for i in range(400)] + [("a", None, -1), (None, 3, -2)]
    ranges = []
    for i in range(300):
        first = rng.choice([rng.randrange(300), rng.randrange(-5000, 2_000_000)])
        ranges.append((rng.choice("ab"), first, first + rng.choice([-1, 0, 1, 63, 64, 65, 1024, 1025, 17_000, 300_000, 1_500_000]), i))
    ranges += [("a", None, 5, -1), ("a", 5, None, -2), (None, 0, 9, -3)]
    left = spark.createDataFrame(points, "f string, line long, p int")
    right = spark.createDataFrame(ranges, "f string, lo long, hi long, r int")
    want = sorted((p[2], r[3]) for p in points for r in ranges if p[0] is not None and p[0] == r[0] and None not in (p[1], r[1], r[2]) and r[1] <= p[1] <= r[2])
    for span, fan, levels in ((64, 16, 4), (1, 2, 3), (8, 4, 1)):
        if levels == 1:
            right = right.where("hi - lo < 2000")
            want = [(p, r) for p, r in want if ranges[r][2] - ranges[r][1] < 2000]
        got = intervals.points_in(left, right, ["f"], "line", "lo", "hi", span, fan, levels)
        assert sorted((r.p, r.r) for r in got.collect()) == want
    assert len(want) > 50


def test_as_of_values(spark):
    rng, zero = random.Random(6), datetime(2024, 1, 1)
    when = lambda: zero + timedelta(minutes=rng.randrange(4000))
    history = [(rng.choice(["hot"] * 5 + ["b", None]), when(), rng.choice([None, rng.random()]), i) for i in range(300)]
    current = [(rng.choice(["hot"] * 5 + ["b", "new", None]), when(), i) for i in range(300)] + [("hot", zero - timedelta(days=400), 999)]
    h = spark.createDataFrame(history, "repo string, ts timestamp, slice double, n int")
    c = spark.createDataFrame(current, "repo string, ts timestamp, id int")
    want = {}
    for repo, ts, i in current:
        before = [(t, n, v) for r, t, v, n in history if r == repo and t < ts]
        want[i] = max(before)[2::-2] if before else (None, None)
    for bucket in (3600, 86400, 10**9):
        got = {r.id: (r.prior_slice, r.prior_ts) for r in intervals.as_of(c, h, ["repo"], "ts", "slice", "n", bucket).collect()}
        assert got == want
    assert intervals.as_of(c, h.limit(0), ["repo"], "ts", "slice", "n").where("prior_ts is null").count() == len(current)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("import a from 'm'", ["m"]), ('import "m"', ["m"]), ("import {a as b, from} from 'm'\nimport from from 'n'", ["m", "n"]), ("import * as x from'm';import y,{z}from\"n\"", ["m", "n"]), ("export * from 'm'; export {a} from 'n'; export const s = 'no'", ["m", "n"]),
        ("export default function f() { return 'no' }", []), ("const x = require('m'), y = require( \"n\" )", ["m", "n"]), ("import('m').then(x); import(`n`); import(`no${1}`); import(name); import('m' + 'no')", ["m", "n"]),
        ("// import 'no'\n/* import 'no' */ import 'm' /* unterminated import 'no'", ["m"]), ("s = \"import 'no'\"; t = 'require(\"no\")'; u = 'it\\'s import \"no\"'", []), ("`import 'no' ${require('m')} ${`${ {a: {}} } import 'no' ${require('n')}`} require('no')`", ["m", "n"]),
        ("x = /import 'no'/; y = a / require('m') / 2; z = (a) / b / require('n')", ["m", "n"]), ("return /['\"`]/.test(s) && require('m')", ["m"]), ("x = /[/'\"]/g; import 'm'", ["m"]), ("a.require('no'); a.import('no'); b?.require('no')", []),
        ("import x = require('m')\nimport type {T} from 'n'", ["m", "n"]), ("import.meta.url; import 'm'", ["m"]), ("import ''; import \"\\u006d\"; require('a\\/b')", ["m", "a/b"]), ("#!/usr/bin/env node import 'no'\nimport 'm'", ["m"]), ("", []), ("'unterminated import \"no\"\nimport 'm'", ["m"]),
        ("import a from 'm'\nimport a from 'm'", ["m"]), ("({ import: 'no', require: 'no', from: 'no' })", []), ("import d, * as n from 'm' with { type: 'json' }", ["m"]), ("`unterminated import 'no'", []),
    ],
)
def test_import_scan(text, found):
    assert imports.imports(text) == found


def test_import_scan_of_made_files():
    """Files put together from pieces whose imports are known."""
    rng = random.Random(2)
    for _ in range(300):
        text, want = "", []
        for i in range(rng.randrange(1, 30)):
            m = f"m{rng.randrange(50)}"
            piece, has = rng.choice([
                (f"import x{i} from '{m}';", True), (f"import \"{m}\"\n", True), (f"export * from '{m}'\n", True), (f"const y{i} = require('{m}');", True), (f"import('{m}');", True), (f"`a ${{require('{m}')}} b`;", True),
                (f"// import '{m}'\n", False), (f"/* require('{m}') \n */", False), (f"s = \"import '{m}'\";", False), (f"s = 'require(\"{m}\")';", False), (f"`import '{m}'`;", False), (f"x = /require\\('{m}'\\)/;", False),
                ("f = (a) / 2; g = b[0] / 3;", False), ("{ if (x) { y = {a: 1}; } }", False), (f"o.require('{m}');", False),
            ])
            text += piece
            if has and m not in want:
                want.append(m)
        assert imports.imports(text) == want, text


def test_import_scan_is_linear():
    for text in ("import 'm';" * 90_000, "'" + "a" * 1_000_000, "`" + "${" * 300_000, "/" * 1_000_000, "/*" * 500_000, "a/b/" * 250_000, "{" * 1_000_000, "\\" * 1_000_000, "x = /[" * 150_000, "import {" * 120_000, "`${`" * 200_000):
        began = time.perf_counter()
        imports.imports(text)
        assert time.perf_counter() - began < 5, text[:20]


def test_import_edges_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "import 'm'", 2), (1, "import 'm'; import 'm'", 2), (1, "import 'm'", 2)], "path bigint, content string, specifier int")
    assert sorted((r.path or 0, r.specifier) for r in graph.import_edges(df).collect()) == [(0, "m"), (1, "m")]
