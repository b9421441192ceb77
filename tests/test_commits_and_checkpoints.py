"""Tables with a manifest under crashes and races; the checkpoint append as a batch, as a stream, and by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.fixed import BOUNDARY_STATES, LEGAL_STEPS
from ledgerlens.operators import ledger
from ledgerlens.sources import commits
from ledgerlens.streaming import checkpoints, ledger_stream

KV = "k string, v int"


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), KV)


def content(spark, path):
    return sorted((r.k or "", r.v) for r in commits.read(spark, path).collect())


def test_keyed_appends(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.read(spark, path) is None and commits.manifest(spark, path).version == -1
    assert commits.append_keyed(kv(spark, ("a", 2), ("a", 1), ("b", 3), (None, 7), (None, 6)), path, ["k"]) == 3
    assert commits.append_keyed(kv(spark, ("a", 0), ("c", 4), (None, 1)), path, ["k"]) == 1
    assert content(spark, path) == [("", 6), ("a", 1), ("b", 3), ("c", 4)]
    assert commits.append_keyed(kv(spark), path, ["k"]) == 0
    assert commits.read(spark, path, 0).count() == 3 and commits.manifest(spark, path).rows == 4
    with pytest.raises(ValueError):
        commits.read(spark, path, 99)
    # Only keys: distinct rows.
    assert commits.append_keyed(kv(spark, ("x", 1), ("x", 1)), str(tmp_path / "u"), ["k", "v"]) == 1


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.append_rows(kv(spark, ("a", 1), ("a", 1)), path, "w", 0) == 2
    assert commits.append_rows(kv(spark, ("a", 1), ("a", 1)), path, "w", 0) == 0
    assert commits.append_rows(kv(spark, ("a", 1)), path, "other", 0) == 1
    assert commits.append_rows(kv(spark), path, "w", 1) == 0 and commits.append_rows(kv(spark, ("z", 1)), path, "w", 1) == 0
    assert len(content(spark, path)) == 3


def test_death_between_data_and_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.append_keyed(kv(spark, ("a", 1)), path, ["k"], "w", 0)
    with monkeypatch.context() as m:
        m.setattr(commits, "_committed", lambda files, found: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            commits.append_keyed(kv(spark, ("b", 2)), path, ["k"], "w", 1)
    staged = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("commit=")}
    assert len(staged) == 2 and content(spark, path) == [("a", 1)]
    assert commits.append_keyed(kv(spark, ("b", 2)), path, ["k"], "w", 1) == 1
    assert content(spark, path) == [("a", 1), ("b", 2)]
    assert commits.vacuumed(spark, path) == 0 and commits.vacuumed(spark, path, -10) == 1
    assert content(spark, path) == [("a", 1), ("b", 2)]


def test_two_writers(spark, tmp_path, monkeypatch):
    path, real, raced = str(tmp_path / "t"), commits._committed, []
    commits.append_keyed(kv(spark, ("a", 1)), path, ["k"])

    def second_is_first(files, found):
        if not raced:
            raced.append(found.version)
            assert commits.append_keyed(kv(spark, ("b", 20), ("c", 30)), path, ["k"]) == 2
        return real(files, found)

    monkeypatch.setattr(commits, "_committed", second_is_first)
    assert commits.append_keyed(kv(spark, ("b", 2), ("d", 4)), path, ["k"]) == 1  # b is the winner's
    assert raced == [1] and content(spark, path) == [("a", 1), ("b", 20), ("c", 30), ("d", 4)]
    monkeypatch.setattr(commits, "_committed", lambda files, found: False)
    with pytest.raises(RuntimeError, match="other writers"):
        commits.append_keyed(kv(spark, ("e", 5)), path, ["k"], attempts=2)


def test_compaction_keeps_rows_and_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        commits.append_rows(kv(spark, (f"k{i}", i)), path, "w", i)
    before = content(spark, path)
    assert commits.compacted(spark, path) == 4 and len(commits.manifest(spark, path).folders) == 1
    assert content(spark, path) == before and commits.append_rows(kv(spark, ("x", 1)), path, "w", 3) == 0
    assert commits.append_keyed(kv(spark, ("k0", 9), ("y", 1)), path, ["k"]) == 1
    assert commits.manifest(spark, path).rows == 5 == len(content(spark, path))


EVENTS = "w string, n bigint, t string, prior string, next string, doc string"
STATES = sorted({s for step in LEGAL_STEPS for s in step})


def events(rng, n=200):
    rows = []
    for i in range(n):
        prior, next_ = rng.choice([rng.choice(LEGAL_STEPS), (rng.choice([*STATES, None]), rng.choice([*STATES, None]))])
        doc = rng.choice(["{}", f'{{"i":{i}}}', "key AKIA" + "Q" * 16, "x" * 70_000, "é" * 32_768, "é" * 32_769, None])
        rows.append((rng.choice(["a", "b", "c"]), i // 2, rng.choice([None, *(f"t{k}" for k in range(60))]), prior, next_, doc))
    return rows


def by_hand(rows):
    out, logs = [], {}
    for w, n, t, prior, next_, doc in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "")):
        head, seen, left = logs.get(w, ("0" * 64, [], "needs_plan"))
        text = (doc or "")
        why = None
        if t is None:
            why = "missing_transition"
        elif (prior, next_) not in LEGAL_STEPS:
            why = "illegal_transition"
        elif next_ not in BOUNDARY_STATES:
            why = "not_a_boundary"
        elif len(text.encode()) > 65536:
            why = "payload_too_large"
        elif t in seen:
            why = "duplicate_transition"
        if why:
            out.append((w, n, t, why, None, None, None, None, None))
            continue
        secret = "AKIA" + "Q" * 16
        stored = text.replace(secret, f"<REDACTED:fingerprint={hashlib.sha256(secret.encode()).hexdigest()[:8]}>")
        new = hashlib.sha256(f"{head}\x1e{stored}".encode()).hexdigest()
        out.append((w, n, t, None, len(seen) + 1, head, new, prior == left, stored))
        logs[w] = (new, [*seen, t], next_)
    return out


def columns():
    return F.col("t"), F.col("prior"), F.col("next"), F.col("doc")


def rows_in(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_checkpoint_batch_equals_by_hand(spark):
    rows = events(random.Random(3))
    # Rows with equal order and id would come by what is stored; here they don't occur.
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    got = checkpoints.checkpoint_log(spark.createDataFrame(rows, EVENTS), "w", "n", *columns())
    want = by_hand(rows)
    assert rows_in(got) == sorted(want, key=repr)
    assert {r[3] for r in want} == {None, "missing_transition", "illegal_transition", "not_a_boundary", "payload_too_large", "duplicate_transition"}
    assert checkpoints.checkpoint_log(spark.createDataFrame([], EVENTS), "w", "n", *columns()).count() == 0


def test_checkpoint_stream_restarts(spark, tmp_path):
    rows = list({(r[0], r[1], r[2]): r for r in events(random.Random(8), 120)}.values())
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ledger_stream.file_stream(spark, str(tmp_path / "in"), EVENTS)
        log = checkpoints.checkpoint_stream(stream, "w", "n", *columns())
        # Each part is a run of its own: the state comes from the checkpoint folder.
        checkpoints.start(log, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    batch = checkpoints.checkpoint_log(spark.createDataFrame(rows, EVENTS), "w", "n", *columns())
    assert rows_in(commits.read(spark, str(tmp_path / "log")).drop("refused")) == rows_in(batch)
    kept = checkpoints.chain(spark, str(tmp_path / "log"))
    assert rows_in(kept) == rows_in(batch.where("reason is null").drop("reason"))
    assert rows_in(checkpoints.refused(spark, str(tmp_path / "log"))) == rows_in(batch.where("reason is not null").select("w", "n", "t" if "t" in batch.columns else "transition", "reason"))


def test_streams_take_nulls_and_dollars_as_batches_do(spark, tmp_path):
    rows = [(u, i, None if i % 4 == 1 else f"e{i}", None if i % 5 == 2 else 10 * i) for u in (1, 2) for i in range(12)]
    schema = "user_id bigint, event_id bigint, payload string, tokens bigint"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, batch = ledger_stream.file_stream(spark, str(tmp_path / "in"), schema), spark.createDataFrame(rows, schema)
    made = {"null_chain": ledger_stream.chained(stream, "user_id", "event_id", "payload"), "dollars": ledger_stream.admitted(stream, "user_id", "event_id", "tokens", 105, 400, "0.01", "2.5")}
    for name, df in made.items():
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    heads = ledger.chain_heads(batch, "user_id", "event_id", F.col("payload")).select("user_id", "event_id", "head")
    assert rows_in(spark.table("null_chain")) == rows_in(heads)
    verdicts = ledger.admissions(batch, "user_id", "event_id", "tokens", 105, 400, "0.01", "2.5")
    assert rows_in(spark.table("dollars")) == rows_in(verdicts)
    assert {r.verdict for r in verdicts.collect()} == {"admitted", "per_call_max_exceeded", "workflow_max_dollars_exceeded"}


def test_ingest_survives_a_batch_that_runs_again(spark, tmp_path, monkeypatch):
    for k in ("a", "b"):
        kv(spark, (k, 1), (k, 2), ("both", 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, out = ledger_stream.file_stream(spark, str(tmp_path / "in"), KV), str(tmp_path / "out")
    real = commits._committed

    def once_done_then_dead(files, found):
        real(files, found)
        raise RuntimeError("died after its commit")

    with monkeypatch.context() as m:
        m.setattr(commits, "_committed", once_done_then_dead)
        with pytest.raises(Exception, match="died after"):
            ledger_stream.idempotent_ingest(stream, out, ["k"], str(tmp_path / "cp")).awaitTermination(120)
    ledger_stream.idempotent_ingest(stream, out, ["k"], str(tmp_path / "cp")).awaitTermination(120)
    assert content(spark, out) == [("a", 1), ("b", 1), ("both", 3)]
