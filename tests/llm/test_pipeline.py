"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline
from oracle import connection, oracle_rows, rows_of

from ledgerlens.llm.queries import LLM

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_and_catch_planted(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = {"en": "the of and to in that with house river stone green walks under slowly".split(), "de": "der die und das nicht mit haus fluss stein grün geht unter langsam".split()}

    def text(lang, n=60):
        return ". ".join(" ".join(rng.choice(vocabulary[lang]) + str(rng.randrange(50)) * (rng.random() < 0.4) for _ in range(12)) for _ in range(n // 12))

    rows = [(i, text(lang), lang, f"s{i % 3}", 0) for i, lang in enumerate(["en", "de"] * 20)]
    item = text("en", 36)
    rows += [(100, rows[3][1], "de", "s0", 0), (101, rows[4][1].replace("river", "river", 1) + " end", "en", "s1", 0), (102, "1234 !!", None, "s1", 0), (103, text("en") + " " + item + " " + text("en"), "en", "s2", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(40))
    assert all(clean <= ids for ids in kept.values())
    assert 102 not in kept["language_id"] and 100 in kept["line_dedup"]
    assert 103 in kept["near_dedup"] and 103 not in kept["decontamination"]
    whole = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == kept["mixing"]


def test_queries_match_their_sql(spark):
    con = connection(SF)
    for name, sql in LLM.oracle_sql().items():
        assert rows_of(LLM.queries()[name](spark, SF)) == oracle_rows(con, sql), name


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, leaked_id bigint, root bigint, h bigint, size bigint"
    words = "the of and to in that with house river stone green walks under slowly".split()
    text = lambda i: " ".join(words[(i * k) % 14] + str(i) for k in range(40))
    rows = [(i, text(i), "en" if i % 3 else None, None if i % 4 else "s", None, 7, 7, 7, 7, 7) for i in range(12)]
    rows += [(None, text(50), None, None, None, 7, 7, 7, 7, 7), (3, text(3), "en", None, None, 7, 7, 7, 7, 7), (90, None, None, None, None, 7, 7, 7, 7, 7), (91, "", "en", "s", 0, 7, 7, 7, 7, 7)]
    for name, some in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "an item that no document holds at all"), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, d).write.parquet(f"{d}/{k}")
            docs = spark.read.parquet(f"{d}/{k}")
            if stage != "mixing":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect())
        assert ids == ([-1, *range(12)] if name == "full" else [])
