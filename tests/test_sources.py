"""Sources, sinks and streams on literal files."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import feeds, graph, ledger
from ledgerlens.operators.cascades import invariant_violations, rule_outcomes
from ledgerlens.sources import files as S
from ledgerlens.sources import lines as L
from ledgerlens.sources import reports as R
from ledgerlens.sources import sinks as K


def texts(spark, *rows):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(rows)], "path string, text string")


def test_lcov(spark):
    text = "TN:\nSF:a.js\nDA:1,2\nDA:2,0\nDA:3,1\nLF:3\nLH:x\nLH:2\nend_of_record\nDA:9,9\nSF:b.js\nDA:7,1\n"
    good, bad = L.lcov_records(texts(spark, text, "SF:c\nDA:x,1\n"))
    assert [(r.source_file, r.lines_covered) for r in good.orderBy("nth").collect()] == [("a.js", [1, 3]), ("b.js", [7])]
    assert [r.path for r in bad.collect()] == ["f1"]
    total = L.lcov_totals(texts(spark, text)).first()
    assert (total.lines_found, total.lines_hit, total.branches_hit) == (3, 2, 0)


def test_istanbul(spark):
    doc = {"x.js": {"statementMap": {"0": {"start": {"line": 5}}, "10": {"start": {"line": 7}}, "2": {"start": {"line": 5}}}, "s": {"0": 1, "10": 3, "2": 0}}}
    assert L.istanbul_lines(texts(spark, json.dumps(doc))).first().lines == [5, 7]


def test_yarn(spark):
    text = '# yarn lockfile v1\n\n"a@^1", "a@^2":\n  version "1.2.3"\n  dependencies:\n    b "^1"\n  resolved "u"\n\nb@^1:\n  version "1.0.0"\n'
    good, bad = L.yarn_entries(texts(spark, text, "", "junk\n"))
    got = {(r.spec, r.section, r.name, r.value) for r in good.collect()}
    assert got == {("a@^1, a@^2", None, "version", "1.2.3"), ("a@^1, a@^2", "dependencies", "b", "^1"), ("a@^1, a@^2", None, "resolved", "u"), ("b@^1", None, "version", "1.0.0")}
    assert [r.path for r in bad.collect()] == ["f2"]


DOCKERFILE = """# syntax=docker/dockerfile:1
ARG V=1
FROM node:18 AS build
ENV A=1 B="x y"
RUN npm ci && \\
    npm test
COPY . /app
FROM build AS second
COPY --from=build /app /app
COPY --from=later /x /y
COPY --from=0 /x /y
ENTRYPOINT ["node", "x.js"]
ENTRYPOINT run it
USER app
"""


def test_dockerfile(spark):
    d = L.dockerfile_directives(texts(spark, DOCKERFILE)).cache()
    run = d.where("directive = 'RUN'").first()
    assert run.payload == "npm ci && \n    npm test" and run.stage == 0
    stages = {r.stage: r for r in L.dockerfile_stages(d).collect()}
    assert stages[0].env == {"A": "1", "B": "x y"} and stages[0].name == "build" and not stages[0].final
    assert stages[1].inherits_from == "build" and stages[1].entrypoint.command == "run it" and stages[1].user == "app" and stages[1].final
    copies = [(r.from_stage, r.resolved) for r in L.dockerfile_copies(d).orderBy("pos").collect()]
    assert copies == [(None, True), ("build", True), ("later", False), ("0", True)]
    health = texts(spark, "--interval=5s CMD curl x", "NONE").select(L.healthcheck(F.col("text")).alias("h")).collect()
    assert health[0].h.options == {"interval": "5s"} and health[0].h.cmd == "curl x" and health[1].h.kind == "none"


def test_owners_records_and_traces(spark):
    rows, bad = L.code_owners(texts(spark, "# top\n\n*.py @a @b # why\ndocs/\n"))
    assert [(r.line_number, r.pattern, r.owners) for r in rows.orderBy("line_number").collect()] == [(3, "*.py", ["@a", "@b"]), (4, "docs/", [])]
    assert bad.first().reason == "empty_owners_at_line_4"
    adr = "x\n# ADR-7: Title\nStatus: Proposed\nstatus: Accepted\nStatus: odd\n# Other\n" + "\n" * 60 + "Status: superseded\n"
    got = L.decision_records(texts(spark, adr)).first()
    assert (got.id, got.title, got.status) == ("f0", "Title", "accepted")
    trace = (
        'execve("/bin/sh", ["sh"], 0x7) = 0\nopenat(AT_FDCWD, "/lib/libc.so.6", O_RDONLY) = 3\nopenat(AT_FDCWD, "/etc/ssl/certs/ca-certificates.crt", O_RDONLY) = 3\n'
        'connect(5, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("1.2.3.4")}, 16) = 0\nnoise\n'
    )
    s = L.strace_facts(texts(spark, trace)).first()
    assert (s.binaries, s.libraries, s.certificates, s.files, s.endpoints, s.shells) == (["sh"], ["/lib/libc.so.6"], ["/etc/ssl/certs/ca-certificates.crt"], [], ["1.2.3.4:443"], 1)
    fm = L.front_matter(texts(spark, "---\nname: é\n---\nbody\n", "none")).collect()
    assert len(fm) == 1 and fm[0].header == "name: é" and fm[0].body_offset == len("---\nname: é\n---\n".encode()) and fm[0].body_bytes == 5


def test_json_yaml_and_layers(spark):
    good, bad = S.json_objects(texts(spark, '{"a": 1} // c', "[1]", "{", '{"a":{"b":{"c":1}}}'), max_depth=1, comments=True)
    assert [r.path for r in good.collect()] == ["f0"]
    assert {r.path: r.reason for r in bad.collect()} == {"f1": "not_an_object", "f2": "malformed", "f3": "too_deep"}
    pytest.importorskip("yaml")
    bomb = "a: &a [x, x]\nb: &b [*a, *a]\nc: [*b, *b]\n"
    docs, rejects = S.yaml_documents(texts(spark, "a: 1\n---\nb: [1, 2]\n", "a: [\n", bomb))
    assert [(r.path, r.pos) for r in docs.orderBy("path", "pos").collect()] == [("f0", 0), ("f0", 1), ("f2", 0)]
    assert [(r.path, r.reason) for r in rejects.collect()] == [("f1", "malformed")]
    df = spark.createDataFrame([("s", "default", "k", "1"), ("s", "cli", "k", "2"), ("s", "repo", "k", "3"), ("s", "repo", "odd", "3")], "scope string, layer string, key string, value string")
    merged, unknown = S.layered(df, ["k"], ["default", "user", "repo", "cli"])
    assert merged.first().value == "2" and unknown.first().key == "odd"
    good, bad = S.digest_map(texts(spark, json.dumps({"p": "a" * 64, "q": "no"})))
    assert good.first().name == "p" and bad.first().name == "q"
    good, bad = S.rule_catalogue(texts(spark, '[{"id":"r","kind":"k","pattern":"p"}]', "[{}]"))
    assert good.first().id == "r" and bad.first().path == "f1"
    spark.sql("SELECT 1 AS id, parse_json('{\"a\": [\"x\", {\"b\": \"y\"}], \"c\": 1}') AS value").createOrReplaceTempView("leaf_docs")
    assert sorted(r.leaf for r in S.string_leaves(spark, "leaf_docs").collect()) == ["x", "y"]


def test_capped_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ok")
    (tmp_path / "b.txt").write_text("x" * 100)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.txt").write_text("ok")
    good, bad = S.capped_files(spark, str(tmp_path), 10, "*.txt", ("node_modules",))
    assert [r.text for r in good.collect()] == ["ok"] and bad.first().reason == "size_cap_exceeded"


def test_reports(spark):
    line = {"type": "match", "data": {"path": {"text": "a"}, "lines": {"text": "s \n"}, "line_number": 3, "submatches": [{"match": {"text": "p"}}]}}
    good, bad = R.ripgrep_matches(texts(spark, json.dumps(line) + '\n{"type":"end"}\n', "{}\nbroken\n"))
    assert [(r.pattern, r.file, r.line, r.snippet) for r in good.collect()] == [("p", "a", 3, "s")] and bad.first().path == "f1"
    good, _ = R.ast_grep_findings(texts(spark, '{"file":"a","rule_id":"r"}', ""))
    assert good.first().rule == "r" and good.count() == 1
    leaks = R.gitleaks_findings(texts(spark, json.dumps([{"RuleID": "r", "File": "b", "StartLine": 2, "Secret": "s"}, {"RuleID": "r", "File": "a", "StartLine": 2, "Secret": "s"}])))
    assert [r.file for r in leaks.collect()] == ["a", "b"] and "Secret" not in leaks.columns
    found = R.semgrep_findings(texts(spark, '{"results":[{"check_id":"c","path":"p","start":{"line":1},"extra":{"severity":"ERROR","message":"m"}}]}')).first()
    assert (found.rule, found.file, found.severity) == ("c", "p", "error")
    sbom = R.packages(texts(spark, '{"artifacts":[{"name":"n","version":"1","type":"npm","locations":[{"path":"x.node"}],"other":1}]}')).first()
    assert sbom.locations == ["x.node"] and sbom.native is False
    steps = R.workflow_steps(spark.createDataFrame([(1, '{"jobs":{"b":{"steps":[{"uses":"u"},{"run":"r"}]}}}')], "id int, text string"))
    assert [(r.pos, r.run, r.uses) for r in steps.orderBy("pos").collect()] == [(0, None, "u"), (1, "r", None)]
    scripts = R.pipeline_scripts(spark.createDataFrame([(1, '{"j":{"before_script":"a","script":["b","c"]}}')], "id int, text string"))
    assert [r.line for r in scripts.orderBy("pos").collect()] == ["a", "b", "c"]
    shapes = ['{"image":"r:1"}', '{"image":{"repository":"r","tag":2}}', '{"image":{"repository":"r"}}', '{"image":{"tag":"2"}}']
    got = [r[0] for r in texts(spark, *shapes).orderBy("path").select(R.image_reference(F.parse_json("text"))).collect()]
    assert got == ["r:1", "r:2", "r", None]
    pods = spark.createDataFrame([(1, '{"kind":"Pod","spec":{"containers":[{"name":"a","image":"i"}]}}'), (2, '{"kind":"Deployment","spec":{"template":{"spec":{"containers":[{"name":"b","image":"j"}]}}}}')], "id int, t string")
    assert [r.image for r in R.containers(pods.select("id", F.parse_json("t").alias("value"))).orderBy("id").collect()] == ["i", "j"]


def test_event_collapse(spark):
    both = [{"introduced": "1", "fixed": "2"}, {"introduced": "3"}, {"fixed": "4"}]
    df = spark.createDataFrame([(both,)], "e array<struct<introduced:string,fixed:string,last_affected:string>>")
    got = df.select(feeds.collapsed_events(F.col("e")).alias("x")).first().x
    assert (got.i, got.f, got.l) == ("1", "4", None)


def test_ingest_twice_and_lookup(spark):
    raw = spark.createDataFrame(feeds._FEED, "source string, seq int, payload string")
    records = feeds.normalised(raw)
    first = feeds.ingested(records, None, "seq").where("state = 'inserted'").drop("state")
    again = feeds.ingested(records, first, "seq")
    assert again.where("state = 'inserted'").count() == 0
    assert [r.cve_id for r in feeds.lookup(first, "flask", "pypi").collect()] == ["CVE-2024-0003"]
    assert feeds.affecting_range(first, "CVE-2024-0001").first().fixed == "1.2.0"
    assert feeds.affecting_range(first, "none").count() == 0


def test_graphs(spark):
    imports = graph.import_edges(spark.createDataFrame([("a.ts", "import x from 'm'\nconst y = require(\"n\");\nimport '';\nimport 'm'\n")], "path string, content string"))
    assert sorted(r.specifier for r in imports.collect()) == ["m", "n"]
    locks = spark.sql("""SELECT 1 AS id, '{"dependencies":{"a":{"version":"1","dependencies":{"b":{"version":"2"}}}}}' AS tree""")
    locks.createOrReplaceTempView("nested_locks")
    assert {(r.path, r.version) for r in graph.nested_dependencies(spark, "nested_locks").collect()} == {("/a", "1"), ("/a/b", "2")}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert [r.consumer for r in graph.consumers(edges, "c").collect()] == ["b"] and graph.producers(edges, "b").count() == 2
    assert graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 5, 2).count() == 2


def test_rules_and_invariants(spark):
    rules = spark.createDataFrame([("r", "^a", "x", False, False), ("s", "^z", "x", False, True), ("t", "^z", "x", False, False)], "rule string, glob_regex string, content_regex string, inverted boolean, needs_file boolean")
    files = spark.createDataFrame([("g", "a1", "x"), ("g", "a2", "y"), ("g", "a0", "y"), ("h", "a1", "x"), ("h", "z.js", "x")], "repo string, path string, content string")
    rules = rules.union(spark.createDataFrame([("u", r"^z\.js\z", "y", True, False)], rules.schema))
    got = {(r.repo, r.rule): (r.outcome, r.evidence) for r in rule_outcomes(rules, files).collect()}
    first = {("g", "r"): ("fail", "a0"), ("g", "s"): ("fail", None), ("g", "t"): ("not_applicable", None), ("g", "u"): ("not_applicable", None)}
    assert got == first | {("h", "r"): ("pass", None), ("h", "s"): ("pass", None), ("h", "t"): ("pass", None), ("h", "u"): ("pass", None)}
    reports = spark.createDataFrame([(1, "completed", None, [], None, None, True, [], 1, 1), (2, "validated", "p", ["x"], "b", "t", True, ["k"], 0, 1)], "id int, outcome string, patch string, failure_modes array<string>, branch string, transform string, passed boolean, failing array<string>, findings int, fingerprints int")
    assert {(r.id, r.violation) for r in invariant_violations(reports).collect()} == {(1, "completed_needs_patch"), (2, "passed_has_failing"), (2, "fewer_findings_than_fingerprints")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    path = str(tmp_path / "t")
    assert K.append_new(rows, path, ["k"]) == 2
    assert K.append_new(rows.union(spark.createDataFrame([("c", 1)], rows.schema)), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3
    slices = spark.createDataFrame([("r", 'b"q', 1, '{"x":1}'), ("r", "a", 1, "1"), ("r", "a", 2, "2")], "repo string, probe string, pos int, slice string")
    assert json.loads(K.envelope(slices).first().json) == {"probes": {"a": 2, 'b"q': {"x": 1}}}
    idx = spark.createDataFrame([("r", "b", "high", "0123456789", None), ("r", "a", None, None, None)], "repo string, name string, confidence string, commit string, indexed_at timestamp")
    assert K.confidence_section(idx).first().markdown == "- a: malformed\n- b: high at 01234567"


def test_streams_equal_batches(spark, tmp_path):
    from ledgerlens.streaming import ledger_stream as T

    rows = [(u, i, f"e{i}", 10 * i) for u in (1, 2) for i in range(6)]
    schema = "user_id bigint, event_id bigint, payload string, tokens bigint"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 2 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.file_stream(spark, str(tmp_path / "in"), schema)
    for name, made in (("chain", T.chained(stream, "user_id", "event_id", "payload")), ("budget", T.admitted(stream, "user_id", "event_id", "tokens", 45, 70))):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    batch = spark.createDataFrame(rows, schema)
    heads = {(r.user_id, r.event_id): r.head for r in ledger.chain_heads(batch, "user_id", "event_id", F.col("payload")).collect()}
    assert {(r.user_id, r.event_id): r.head for r in spark.table("chain").collect()} == heads
    verdicts = {(r.user_id, r.event_id): r.verdict for r in ledger.admissions(batch, "user_id", "event_id", "tokens", 45, 70, "0.000001", "1").collect()}
    assert {(r.user_id, r.event_id): r.verdict for r in spark.table("budget").collect()} == verdicts
    q = T.idempotent_ingest(stream, str(tmp_path / "out"), ["user_id"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_gather_redacts_values_only(spark):
    from ledgerlens.plans.flows import gather

    key, other = "ghp_" + "a" * 36, "".join(chr(48 + i) for i in range(40))
    plain = {"files": [f"src/module_{i}.py" for i in range(12)], "n": 1, "deep": {"a\"b": [None, True, 1.50, "é \\"]}}
    secret = {key: [{"x": f"t {key}"}, other], "y": {other: "short"}}
    pem = "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"
    rows = [("r", "plain", 1, json.dumps(plain)), ("r", "secret", 1, json.dumps(secret)), ("r", "pem", 1, json.dumps({"k": pem})), ("r", "broken", 1, f"{{oops {key}"), ("r", "nan", 1, "NaN"), ("r", "none", 1, None)]
    slices = spark.createDataFrame(rows, "repo string, probe string, pos int, slice string")
    got = gather(slices).first().json
    probes = json.loads(got)["probes"]
    mark = "<REDACTED:fingerprint="
    assert probes["plain"] == plain
    assert list(probes["secret"]) == [key, "y"] and probes["secret"]["y"] == {other: "short"}
    named, entropy = probes["secret"][key]
    assert named["x"].startswith("t " + mark) and entropy.startswith(mark)
    assert probes["pem"]["k"].startswith(mark) and probes["broken"].startswith("{oops " + mark) and probes["nan"] == "NaN"
