"""Faults found in the third round, each with a case that failed before."""

from oracle import SF, connection, oracle_rows, rows_of
from pyspark.sql import functions as F

from ledgerlens.catalog import REGISTRY
from ledgerlens.operators import aggregates, graph, sets, text_safety
from ledgerlens.sources import files, lines, manifests

QUERIES, ORACLES = REGISTRY.queries(), REGISTRY.oracle_sql()


def test_a_held_text_of_low_entropy_is_marked(spark):
    """Customer 1009's text has 4.46 bits a character: the first of sf0.01 below the threshold."""
    sf = "/root/testdata/sf0.01"
    for name in ("marked_once", "envelope_entropy"):
        assert rows_of(QUERIES[name](spark, sf)) == oracle_rows(connection(sf), ORACLES[name])
    df = spark.createDataFrame([("aaaa",), ("<REDACTED:fingerprint=0123abcd> a",)], "t string")
    got = [r.t for r in df.select(text_safety.marked_once(F.col("t"), F.lit(True)).alias("t")).collect()]
    assert got[0].startswith("<REDACTED") and got[1] == "<REDACTED:fingerprint=0123abcd> a"


def _chain(depth, inner, end):
    for _ in range(depth):
        end = inner % end
    return end


def test_nested_trees_of_any_number_of_rows_and_levels(spark):
    """More rows than a recursive query may have here."""
    name = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(name, "5")
    try:
        deep = _chain(12, '{"dependencies":{"n":%s}}', '{"version":"1"}')
        spark.createDataFrame([(1, deep), (2, '{"dependencies":{"a":{"version":"2"},"b":{}}}'), (3, "{"), (4, None)], "id int, tree string").createOrReplaceTempView("deep_trees")
        got = graph.nested_dependencies(spark, "deep_trees").collect()
        assert len(got) == 14 and [r.version for r in got if r.path == "/n" * 12] == ["1"]
        assert {(r.path, r.version) for r in got if r.id == 2} == {("/a", "2"), ("/b", None)}
    finally:
        spark.conf.unset(name)


def test_string_leaves_of_any_number_of_rows_and_levels(spark):
    name = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(name, "5")
    try:
        texts = [_chain(12, '{"a":%s}', '["x","y"]'), '{"a":[1,null,true,"z",[],{}],"b":""}', '"whole"', "7"]
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        df.select("id", F.parse_json("t").alias("value")).createOrReplaceTempView("deep_docs")
        got = {(r.id, r.path, r.leaf) for r in files.string_leaves(spark, "deep_docs").collect()}
        assert got == {(0, "$" + ".a" * 12 + ".0", "x"), (0, "$" + ".a" * 12 + ".1", "y"), (1, "$.a.3", "z"), (1, "$.b", ""), (2, "$", "whole")}
    finally:
        spark.conf.unset(name)


def test_the_feed_holds_the_rows_of_all_shapes(spark):
    """The eight rows of the three shapes are ingested with those made of parts."""
    got = QUERIES["feed_union_ingest"](spark, SF)
    assert {r.seq: r.state for r in got.where("seq <= 8").collect()} == {1: "inserted", 2: "error", 3: "inserted", 4: "inserted", 5: "error", 6: "skipped", 7: "error", 8: "error"}
    assert got.count() == 8 + spark.read.parquet(f"{SF}/part.parquet").count()


def _top(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def test_skill_matches_of_repeated_ids_and_nulls(spark, monkeypatch):
    """Pairs come from blocks of ids, without an aggregate over them; an id of several rows has each pair once."""
    monkeypatch.setattr(sets, "BLOCK", 2)
    skills = [(i % 5 if i < 7 else i, tasks, langs) for i, (tasks, langs) in enumerate([(["a"], ["x"]), (["*"], ["x", "y"]), (["a", "b", "a"], ["*"]), ([], ["x"]), (None, ["x"]), (["b"], None)] * 3)]
    queries = [(i % 6, task, langs) for i, (task, langs) in enumerate([("a", ["x"]), (None, ["y", "z"]), ("b", []), ("a", ["x", "x"])] * 3)]
    want = {(q, s) for s, tasks, offered in skills for q, task, langs in queries if tasks and ("*" in tasks or task in tasks) and offered and ("*" in offered or set(offered) & set(langs))}
    got = sets.skill_matches(spark.createDataFrame(skills, "skill int, tasks array<string>, languages array<string>"), spark.createDataFrame(queries, "query int, task string, languages array<string>"))
    assert sorted((r.query, r.skill) for r in got.collect()) == sorted(want) and not _top(got).startswith("Aggregate")


def test_covering_tests_of_repeated_symbols_and_lines(spark):
    """A test meets a definition once, whatever its lines, without an aggregate over the pairs; one of several ranges too."""
    rows = [(f, line * 7 % 90, t) for f in range(3) for line in range(40) for t in (line % 3, (line * f) % 5)] * 2 + [(1, None, 9), (None, 3, 9)]
    defs = [(0, s, s * 11 % 80, s * 11 % 80 + s % 7 * 5) for s in range(20)] + [(2, 30, 5, 5), (2, 31, 9, 8), (1, 32, 0, 2000), (None, 33, 1, 9)]
    more = [(1, 3, 10, 50), (0, 3, 10, 50), (1, 3, 10, 50)]
    for d, repeated in ((defs, False), (defs + more, True)):
        want = {(s, t) for f, s, a, b in d for g, line, t in rows if f is not None and f == g and line is not None and a <= line <= b}
        got = graph.tests_exercising(spark.createDataFrame(rows, "file int, line int, test int"), spark.createDataFrame(d, "file int, symbol int, first_line int, last_line int"))
        assert sorted((r.symbol, r.test) for r in got.collect()) == sorted(want)
        assert repeated or not _top(got).startswith("Aggregate")


def _steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decision_records_are_read_without_a_shuffle(spark):
    texts = ["", "\n", "# 1. A\r\nStatus: accepted\r\n", "x\n" * 49 + "# B\nStatus: accepted\n", "x\n" * 50 + "# C\n", "# 7:\n#  D \nstatus: Odd\nstatus: Rejected\nStatus: proposed", None]
    got = lines.decision_records(spark.createDataFrame(list(enumerate(texts)), "path string, text string"))
    found = {r.path: (r.title, r.status) for r in got.collect()}
    assert found == {"1": (None, "unknown"), "2": ("A", "accepted"), "3": ("B", "unknown"), "4": (None, "unknown"), "5": ("D", "proposed")}
    assert "Exchange" not in _steps(got) and "Sort" not in _steps(got)


def test_dockerfile_stages_of_files_and_of_directives_agree(spark):
    """Lines aren't sorted by file; both ways to the stages give the same."""
    texts = [
        "ARG V\nFROM a AS x\nENV A=1 B=2\nENV A=3\nFROM x AS x\nFROM x\nUSER u\nUSER v\nENTRYPOINT a b\n", "# only\n\n", "", None, "from  b as Y \\\r\n  \nRUN a \\\n\\\n b \\", "FROM q AS q\nfrom Q\nFOO x\n  COPY a b\\\nUSER c",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    whole = lines.dockerfile_file_stages(df)
    assert rows_of(whole) == rows_of(lines.dockerfile_stages(lines.dockerfile_directives(df))) and "Sort" not in _steps(whole) and "Window" not in _steps(whole)
    got = {(r.path, r.stage): (r.base_image, r.name, r.inherits_from, r.env, r.user, r.final) for r in whole.collect()}
    assert got[0, 0] == ("a", "x", None, {"A": "3", "B": "2"}, None, False) and got[0, 1][:3] == ("x", "x", "x") and got[0, 2][2:] == ("x", {}, "v", True)
    assert [(r.pos, r.directive, r.stage) for r in lines.dockerfile_directives(df).where("path = 5").orderBy("pos").collect()] == [(0, "FROM", 0), (1, "FROM", 1), (3, "COPY", 1)]
    assert [r.payload for r in lines.dockerfile_directives(df).where("path = 4 and directive = 'RUN'").collect()] == ["a \n\n b"]


def test_manifests_are_read_once_for_their_rejects(spark):
    """The YAML reader ran once for what it refuses and once for what the schema does."""
    got = QUERIES["manifest_rejects"](spark, SF)
    assert _steps(got).count("MapInArrow") == 1
    texts = ["must_read: []\n", "must_read: []\n---\nmust_read: []\n", "must_read: [\n", "x: 1\n", "must_read: []\n---\na: [\n"]
    df = spark.createDataFrame([("p%d" % i, "f", t) for i, t in enumerate(texts)], "plugin string, path string, text string")
    assert sorted((r.plugin, r.reason) for r in manifests.context_queries(df)[1].collect()) == [("p1", "schema"), ("p2", "parse:malformed"), ("p3", "schema"), ("p4", "parse:malformed")]


def test_entropy_takes_one_pass_over_a_text(spark):
    """The rule counts a text's characters once, in batches, and agrees with the column function on any characters."""
    texts = ["", "a", "ab" * 20, "".join(chr(33 + i) for i in range(64)), "é漢😀" * 30 + "x", None, "".join(chr(0x1F600 + i % 40) for i in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", text_safety._bits(F.col("t")).alias("a"), aggregates.shannon_entropy(F.col("t")).alias("b")).collect()
    assert all(r.t is None and r.a is None or abs(r.a - r.b) < 1e-9 for r in rows)
    assert "ArrowEvalPython" in _steps(QUERIES["redact_secrets"](spark, SF))
