"""Manifests, rule catalogues and landed feeds: good files, each reason of a reject, the fatal case, streams."""

import gzip
import json
import time

import pytest
import yaml
from pyspark.sql import functions as F

from ledgerlens.operators import feeds
from ledgerlens.sources import commits, files, landed, manifests


def yaml_files(spark, *texts):
    return spark.createDataFrame([("p", f"f{i}", t) for i, t in enumerate(texts)], "plugin string, path string, text string")


BANDS = """
must_read:
- primitive: scip.refs
  args: {symbol: S, flag: true, n: 3, many: [a, b], none: []}
  max_files: 5
  fallback:
    primitive: dep_graph.consumers
    args: {}
    fallback: {primitive: import_graph.transitive_callers, args: {m: x}, fallback: null}
should_read: []
may_read:
- {primitive: test_inventory.tests_exercising, args: {symbol: T}, max_files: null}
provides: {vuln_caps: {index: "a.b.c:Index"}}
requires: {scip: [refs]}
"""
QUERY = "{primitive: scip.refs, args: {}}"


def test_the_three_bands(spark):
    rows, bad = manifests.context_queries(yaml_files(spark, BANDS))
    got = sorted((r.band, r.pos, r.step, r.primitive, json.loads(r.args), r.max_files) for r in rows.collect())
    assert got == [
        ("may_read", 0, 0, "test_inventory.tests_exercising", {"symbol": "T"}, None),
        ("must_read", 0, 0, "scip.refs", {"symbol": "S", "flag": True, "n": 3, "many": ["a", "b"], "none": []}, 5),
        ("must_read", 0, 1, "dep_graph.consumers", {}, None),
        ("must_read", 0, 2, "import_graph.transitive_callers", {"m": "x"}, None),
    ]
    assert bad.count() == 0 and manifests.context_queries(yaml_files(spark).limit(0))[0].count() == 0


BAD = [
    ("must_read: [", "parse:malformed"), (None, "parse:empty"), ("must_read: " + "[" * 80 + "]" * 80, "parse:too_deep"), ("x" * 70_000, "parse:size_cap_exceeded"), ("[]", "schema"), ("just text", "schema"),
    ("should_read: []", "schema"), ("must_read: []\nother: 1", "schema"), ("must_read: {}", "schema"), ("must_read: []\nmay_read: 3", "schema"), ("must_read: [1]", "schema"),
    (f"must_read: [{QUERY}]\n---\nmust_read: []", "schema"), ("must_read: [{primitive: scip.refs}]", "schema"), ("must_read: [{primitive: scip.refs, args: {}, x: 1}]", "schema"),
    ("must_read: [{primitive: 3, args: {}}]", "schema"), ("must_read: [{primitive: scip.unknown, args: {}}]", "unknown_primitive"), ("must_read: [{primitive: scip.refs, args: {}, max_files: 0}]", "negative_max_files"),
    ("must_read: [{primitive: scip.refs, args: {}, max_files: many}]", "schema"), ("must_read: [{primitive: scip.refs, args: {a: {b: c}}}]", "schema"), ("must_read: [{primitive: scip.refs, args: {a: [1]}}]", "schema"),
    ("must_read: [{primitive: scip.refs, args: {}, fallback: x}]", "schema"), ("must_read: [{primitive: scip.refs, args: {}, fallback: {primitive: no.such, args: {}}}]", "unknown_primitive"),
    ("must_read: [" + "{primitive: scip.refs, args: {}, fallback: " * 9 + QUERY + "}" * 9 + "]", "too_many_fallbacks"), ("must_read: []\nprovides: {Bad: {}}", "schema"), ("must_read: []\nprovides: {a: {b: 'no path'}}", "schema"),
    ("must_read: []\nprovides: {a: {B: 'm:C'}}", "schema"), ("must_read: []\nrequires: {a: [Bad]}", "schema"), ("must_read: []\nrequires: {a: b}", "schema"), ("must_read: &a [*a]", "parse:holds_itself"),
]


def test_reasons_of_rejects(spark):
    made = spark.createDataFrame([(f"p{i}", f"f{i}", text) for i, (text, _) in enumerate(BAD)], "plugin string, path string, text string")
    rows, bad = manifests.context_queries(made)
    assert {r.path: r.reason for r in bad.collect()} == {f"f{i}": reason for i, (_, reason) in enumerate(BAD)}
    assert bad.count() == len(BAD) and rows.count() == 0


def test_an_id_in_several_files(spark):
    made = spark.createDataFrame([("p", "b", f"must_read: [{QUERY}]"), ("p", "a", "must_read: ["), ("p", "c", f"must_read: [{QUERY}]"), ("q", "c", f"must_read: [{QUERY}]"), ("p", "d", "must_read: []")], "plugin string, path string, text string")
    rows, bad = manifests.context_queries(made)
    assert sorted((r.plugin, r.path) for r in rows.collect()) == [("p", "b"), ("q", "c")]
    assert {(r.plugin, r.path, r.reason) for r in bad.collect()} == {("p", "a", "parse:malformed"), ("p", "c", "duplicate_id"), ("p", "d", "duplicate_id")}


TASK = "schema_version: '1'\ntask_class: t\nrequired_probes: [a, a]\nrequired_skills: []\nderived_queries:\n- {compute: consumers_of, pkg: left-pad}\n- {compute: refs_to, symbol: s}\nconfidence_floor: {kind: degraded, reason: stale}\n"


def test_task_manifests(spark):
    broken = [
        TASK.replace("'1'", "1"), TASK.replace("refs_to", "refs_of"), TASK.replace("symbol: s", "module: s"), TASK.replace("kind: degraded, reason: stale", "kind: degraded"),
        TASK.replace("kind: degraded, reason: stale", "kind: trusted, reason: x"), TASK.replace("[a, a]", "[1]"), TASK + "more: 1\n", TASK.replace("task_class: t\n", ""),
    ]
    rows, bad = manifests.task_queries(yaml_files(spark, TASK, TASK.replace("kind: degraded, reason: stale", "kind: trusted"), *broken).drop("plugin"))
    assert sorted((r.path, r.task_class, r.pos, r.compute, r.arg) for r in rows.collect()) == [(p, "t", i, c, a) for p in ("f0", "f1") for i, c, a in ((0, "consumers_of", "left-pad"), (1, "refs_to", "s"))]
    assert {(r.path, r.reason) for r in bad.collect()} == {(f"f{i + 2}", "unknown_query_primitive" if i == 1 else "schema") for i in range(len(broken))}


RULES = "rules:\n- {kind: file_pattern, id: a, description: d, file_glob: '*.ts', pattern: '^x'}\n- {kind: missing_file, id: b, description: d, file_glob: '*.lock'}\n"


def test_rule_catalogues_and_the_fatal_case(spark, tmp_path):
    (tmp_path / "user").mkdir()
    (tmp_path / "repo").mkdir()
    for name, text in {
        "user/a.yaml": RULES, "repo/b.yml": "rules:\n- {kind: dockerfile_pattern, id: a, description: d, pattern: FROM}\n", "repo/no.txt": "rules: [", "repo/kind.yaml": "rules: [{kind: other, id: a}]",
        "repo/field.yaml": "rules: [{kind: missing_file, id: a, description: d}]", "repo/regex.yaml": "rules: [{kind: dockerfile_pattern, id: a, description: d, pattern: '('}]", "repo/list.yaml": "- 1", "repo/big.yaml": "#" * 70_000,
    }.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / "user"), str(tmp_path / "gone"), str(tmp_path / "repo")]
    rows, bad = manifests.loaded(spark, paths, manifests.convention_rules)
    assert sorted((r.path.split("/")[-1], r.pos, r.id, r.kind, r.pattern, r.file_glob) for r in rows.collect()) == [
        ("a.yaml", 0, "a", "file_pattern", "^x", "*.ts"), ("a.yaml", 1, "b", "missing_file", None, "*.lock"), ("b.yml", 0, "a", "dockerfile_pattern", "FROM", None),
    ]
    assert {r.path.split("/")[-1]: r.reason for r in bad.collect()} == {"kind.yaml": "unknown_pattern_type", "field.yaml": "schema", "regex.yaml": "bad_regex", "list.yaml": "schema", "big.yaml": "size_cap_exceeded"}
    with pytest.raises(manifests.NothingReadable):
        manifests.loaded(spark, [str(tmp_path / "gone"), str(tmp_path / "away")], manifests.convention_rules)
    assert manifests.loaded(spark, [], manifests.convention_rules)[0].count() == 0


def test_alias_bombs_are_rejects(spark):
    bomb = "a: &a [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"{b}: &{b} [{', '.join(['*' + a] * 10)}]\n" for a, b in zip("abcdefgh", "bcdefghi"))
    wide = "a: &a " + "x" * 100_000 + "\nb: [" + ", ".join(["*a"] * 100) + "]\n"
    shared = "a: &a {k: v}\nb: *a\nc: *a\n"
    began = time.perf_counter()
    assert files._fault(yaml.safe_load(bomb), 64, 2 << 20) == "expands_too_far"
    assert time.perf_counter() - began < 1
    good, bad = files.yaml_documents(spark.createDataFrame([("bomb", bomb), ("wide", wide), ("shared", shared), ("set", "!!set {a, b}")], "path string, text string"))
    assert {r.path: r.reason for r in bad.collect()} == {"bomb": "expands_too_far", "wide": "expands_too_far"}
    assert {r.path for r in good.collect()} == {"shared", "set"}
    deep = "a: &a [[[[[[[[[[1]]]]]]]]]]\nb: [[[[[*a]]]]]\n"  # deeper where the alias stands than where it was made
    assert [r.reason for r in files.yaml_documents(spark.createDataFrame([("d", deep)], "path string, text string"), max_depth=12)[1].collect()] == ["too_deep"]


def payloads(spark):
    """Three feeds' records of parts."""
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey").orderBy("p_partkey").collect()
    made = {"osv": [], "nvd": [], "ghsa": []}
    for (k,) in rows:
        cve, at = f"CVE-2024-{k:04d}", "2024-01-01T00:00:00Z"
        made["osv"].append({"id": f"OSV-{k}", "aliases": [cve], "published": at, "database_specific": {"severity": "HIGH"}, "affected": [{"package": {"ecosystem": "npm", "name": f"p{k}"}, "ranges": [{"events": [{"introduced": "1"}, {"fixed": "2"}]}]}]})
        made["nvd"].append({"cve": {"id": cve, "published": at, "metrics": {"cvssMetricV31": [{"baseSeverity": "LOW"}]}}, "affected": {"ecosystem": "npm", "package": f"p{k}", "ranges": [{"introduced": "1", "fixed": "2" if k % 2 else "3"}]}})
        made["ghsa"].append({"ghsa_id": "GHSA-aaaa-bbbb-cccc", "cve_id": cve, "published_at": at, "severity": "critical" if k % 7 else "odd", "package": {"ecosystem": "npm", "name": f"q{k}"}})
    return made


@pytest.fixture
def zone(spark, tmp_path):
    made = payloads(spark)
    for source in made:
        (tmp_path / source).mkdir()
    lines = [json.dumps(r) for r in made["osv"]]
    (tmp_path / "osv" / "1.jsonl").write_text("\n".join(lines[:120]) + "\n\n")
    with gzip.open(tmp_path / "osv" / "2.jsonl.gz", "wt") as f:
        f.write("\n".join(lines[120:]))
    (tmp_path / "osv" / "cut.jsonl").write_text("\n".join(lines[:3]) + "\n" + lines[3][:40])
    (tmp_path / "osv" / "empty.jsonl").write_text("")
    (tmp_path / "nvd" / "all.json").write_text(json.dumps({"resultsPerPage": 3, "vulnerabilities": made["nvd"]}, indent=1))
    (tmp_path / "nvd" / "cut.json").write_text(json.dumps({"vulnerabilities": made["nvd"]})[:5000])
    (tmp_path / "ghsa" / "list.json").write_text(json.dumps(made["ghsa"][1:]))
    (tmp_path / "ghsa" / "one.json").write_text(json.dumps(made["ghsa"][0]))
    return tmp_path, made


LAYOUTS = {"osv": "lines", "nvd": "documents", "ghsa": "documents"}


def test_landed_files(spark, zone):
    root, made = zone
    read = {s: landed.landed(spark, str(root / s), s, layout) for s, layout in LAYOUTS.items()}
    good, bad = landed.records(read["osv"])
    assert good.count() == len(made["osv"]) + 3 and good.select("cve_id").distinct().count() == len(made["osv"])
    assert [(r.file.rsplit("/", 1)[-1], r.reason) for r in bad.collect()] == [("cut.jsonl", "malformed_json")]
    report = {r.file.rsplit("/", 1)[-1]: (r.records, r.rejects, r.first_reason) for r in landed.file_report(read["osv"]).collect()}
    assert report == {"1.jsonl": (120, 0, None), "2.jsonl.gz": (len(made["osv"]) - 120, 0, None), "cut.jsonl": (3, 1, "malformed_json")}
    good, bad = landed.records(read["nvd"])
    assert good.count() == len(made["nvd"]) and [r.reason for r in bad.collect()] == ["malformed_json"]
    good, bad = landed.records(read["ghsa"])
    odd = sum(r["severity"] == "odd" for r in made["ghsa"])
    assert good.count() == len(made["ghsa"]) - odd and [r.reason for r in bad.collect()] == ["bad_severity"] * odd
    with pytest.raises(ValueError):
        landed.landed(spark, str(root), "other")
    with pytest.raises(ValueError):
        landed.landed(spark, str(root), "osv", "pages")


def test_landed_stream_equals_batch(spark, zone):
    root, made = zone
    for s, layout in LAYOUTS.items():
        landed.ingest(landed.landed(spark, str(root / s), s, layout), str(root / "batch"))
    streams = lambda: [landed.landed(spark, str(root / s), s, layout, stream=True, files_per_batch=1) for s, layout in LAYOUTS.items()]

    for n, s in enumerate(streams()):
        landed.start_ingest([s], str(root / "stream"), str(root / f"cp{n}"))[0].awaitTermination(120)
    same = lambda t: [sorted(map(repr, commits.read(spark, str(root / x / t)).drop("source", "file", "severity").collect())) for x in ("batch", "stream")]
    for t in ("records", "rejects"):
        a, b = same(t)
        assert a == b and len(a) > 0
    # Nothing new on a second run; a new file brings only what is new.
    before = commits.read(spark, str(root / "stream" / "records")).count()
    extra = dict(made["osv"][0], aliases=["CVE-2030-0001"])
    (root / "osv" / "later.jsonl").write_text("\n".join(map(json.dumps, [made["osv"][1], extra])) + "\n")
    for n, s in enumerate(streams()):
        landed.start_ingest([s], str(root / "stream"), str(root / f"cp{n}"))[0].awaitTermination(120)
    after = commits.read(spark, str(root / "stream" / "records"))
    assert after.count() == before + 1 and after.where(F.col("cve_id") == "CVE-2030-0001").count() == 1
    assert landed.ingest(landed.landed(spark, str(root / "osv"), "osv"), str(root / "stream")) == (0, 0)
    assert feeds.lookup(after, "p1", "npm").count() >= 1
