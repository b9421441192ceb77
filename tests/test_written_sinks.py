"""Sinks that write: cache blobs and records, raw artifacts and envelopes, daily lines, runs, snapshots of repositories."""

import hashlib
import json

from ledgerlens.operators import repository
from ledgerlens.sources import commits, lines, sinks


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, payload string, created_at_unix_s bigint, probe_name string, probe_version string")


def test_cache_blobs_come_before_their_records(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    rows = entries(spark, ("a", "same", 1, "p", "1"), ("b", "same", 2, "p", "1"), ("c", "other", 3, "p" * 4000, "1"), ("d", "é\n", 4, "p", None))
    good, bad = sinks.cache_records(rows)
    assert [(r.key, r.reason) for r in bad.collect()] == [("c", "record_too_long")] and bad.first().record_bytes > 4096
    record = {r.key: r.record for r in good.collect()}["a"]
    assert record == json.dumps({"blob_sha256": hashlib.sha256(b"same").hexdigest(), "created_at_unix_s": 1, "key": "a", "probe_name": "p", "probe_version": "1"}, sort_keys=True, separators=(",", ":")) + "\n"
    real, calls = commits._committed, []

    def dies_before_the_index(files, found):
        calls.append(files.root)
        if files.root.endswith("index") and len(calls) == 2:
            raise RuntimeError("died")
        return real(files, found)

    monkeypatch.setattr(commits, "_committed", dies_before_the_index)
    for _ in range(2):
        try:
            n = sinks.put_cache(rows, path, "w", 0)
        except RuntimeError:
            assert commits.read(spark, f"{path}/blobs").count() == 2 and commits.read(spark, f"{path}/index") is None
    assert n == 3 and sinks.put_cache(rows, path, "w", 0) == 0
    index, blobs = commits.read(spark, f"{path}/index"), commits.read(spark, f"{path}/blobs")
    assert index.join(blobs, "blob_sha256").count() == 3 and blobs.count() == 2
    assert all(r.shard == r.blob_sha256[:2] for r in index.collect())


def test_envelopes_come_after_raw_artifacts(spark, tmp_path):
    path = str(tmp_path / "out")
    slices = spark.createDataFrame([("good", "a", 1, "1"), ("bad", "a", 1, "2"), ("plain", "a", 1, "3")], "repo string, probe string, pos int, slice string")
    artifacts = spark.createDataFrame([("good", "x.json", b"1"), ("bad", "y.json", b"2"), ("bad", "../z", b"3"), ("bad", None, b"4"), ("good", ".hidden", b"5")], "repo string, name string, payload binary")
    rejects = sinks.publish(slices, artifacts, path)
    assert sorted((r.repo, r.name or "", r.issue) for r in rejects.collect()) == [("bad", "", "empty"), ("bad", "../z", "separator")]
    assert {r.repo for r in commits.read(spark, f"{path}/envelopes").collect()} == {"good", "plain"}
    assert {(r.repo, r.name) for r in commits.read(spark, f"{path}/raw").collect()} == {("good", "x.json"), ("good", ".hidden")}


def test_days_and_runs(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 23:59:59' AS ts, 1 AS v UNION ALL SELECT timestamp'2024-01-02 00:00:00', 2")
    sinks.write_by_day(rows, str(tmp_path / "days"), "ts")
    assert {p.name for p in (tmp_path / "days").iterdir() if p.name.startswith("dt")} == {"dt=2024-01-01", "dt=2024-01-02"}
    assert sorted((str(r.dt), r.v) for r in spark.read.json(str(tmp_path / "days")).collect()) == [("2024-01-01", 1), ("2024-01-02", 2)]
    run, probes = spark.sql("SELECT 'r1' AS run, 0 AS exit"), spark.sql("SELECT 'r1' AS run, 'p' AS probe, 'ran' AS state")
    for _ in range(2):
        sinks.write_run(run, probes, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit" / "runs")).count() == 2 and spark.read.parquet(str(tmp_path / "audit" / "probes")).columns == ["run", "probe", "state"]


def test_snapshots(spark):
    sha, other = "a" * 40, "b" * 40
    files = [
        ("detached", ".git/HEAD", sha + "\n"), ("loose", ".git/HEAD", "ref: refs/heads/x\n"), ("loose", ".git/refs/heads/x", sha + "\n"), ("loose", ".git/packed-refs", f"{other} refs/heads/x\n"),
        ("packed", ".git/HEAD", "ref: refs/heads/x/y\n"), ("packed", ".git/packed-refs", f"# c\n{other} refs/heads/x\n{sha} refs/heads/x/y\n^{other}\n"), ("unborn", ".git/HEAD", "ref: refs/heads/x\n"),
        ("broken", ".git/HEAD", "nonsense"), ("none", "README", ""), ("empty", ".git/HEAD", None), ("other", ".git/HEAD", "ref: refs/heads/x"), ("other", ".git/refs/heads/y", sha),
    ]
    got = {r.repo: r.git_commit for r in repository.snapshots(spark.createDataFrame(files, "repo string, path string, content string")).collect()}
    assert got == {"detached": sha, "loose": sha, "packed": sha} | dict.fromkeys(["unborn", "broken", "none", "empty", "other"])


def test_lock_files_of_three_versions(spark):
    texts = {
        "v1": {"lockfileVersion": 1, "dependencies": {"@s/a": {"version": "1", "dependencies": {"b": {"version": "2"}}}}}, "v3": {"lockfileVersion": 3, "packages": {"": {}, "node_modules/@s/a": {"version": "1"}}},
        "v2": {"lockfileVersion": 2, "packages": {"": {}, "node_modules/a": {"version": "1"}}, "dependencies": {"a": {"version": "1"}}}, "root": {"lockfileVersion": 3, "packages": {"": {"name": "r"}}}, "bare": {"lockfileVersion": 1},
        "four": {"lockfileVersion": 4, "packages": {}}, "none": {"packages": {}}, "text": {"lockfileVersion": "x"}, "list": [], "no packages": {"lockfileVersion": 2},
    }
    df = spark.createDataFrame([*((k, json.dumps(v)) for k, v in texts.items()), ("cut", "{"), ("null", None)], "path string, text string")
    good, bad = lines.npm_entries(df)
    assert sorted((r.path, r.lockfile_version, r.key, r.name, r.version) for r in good.collect()) == [
        ("v1", 1, "node_modules/@s/a", "@s/a", "1"), ("v1", 1, "node_modules/@s/a/node_modules/b", "b", "2"), ("v2", 2, "node_modules/a", "a", "1"), ("v3", 3, "node_modules/@s/a", "@s/a", "1"),
    ]
    assert {r.path: r.reason for r in bad.collect()} == {"four": "unknown_version", "none": "unknown_version", "text": "unknown_version", "list": "malformed", "cut": "malformed", "null": "malformed", "no packages": "no_packages"}
