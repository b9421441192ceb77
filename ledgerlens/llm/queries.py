"""The thin queries of this subpackage; each derives its columns from its operator's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import brown, chat, decontaminate, html, language, lines, mixing, mpegts, neighbours, periodic, recompress, simhash, spelling
from ledgerlens.registry import Registry, table

LLM = Registry()


@LLM.query("op1_decontamination", decontaminate.ORACLE)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@LLM.query("op2_html")
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


@LLM.query("op3_media_columns")
def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.features(mpegts.packed(table(spark, sf_dir, "documents")))


@LLM.query("op4_substring_dedup", recompress.ORACLE)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.deduplicated(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@LLM.query("op5_chat", chat.ORACLE)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], rows.schema)
    pieces = chat.formatted(rows.unionByName(probe), "conv_id", _record(), ["turn", "role", "text"])
    return chat.digests(pieces, "conv_id")


def _record() -> Column:
    """A turn as JSON, in a layout that depends on the row: plain, a list of messages, or one with other names for the roles.
    The operator is told nothing but the JSON."""
    whole = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct("role", "text"), whole)
    messages = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), whole)
    spoken = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt")
    said = F.to_json(F.struct(F.array(F.struct(spoken.alias("from"), F.col("text").alias("value"))).alias("conversations")), whole)
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    return F.when((kind == 0) & spoken.isNotNull(), said).when(kind == 1, messages).otherwise(plain)


@LLM.query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.fit(docs))


@LLM.query("op7_mixing", mixing.ORACLE)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@LLM.query("op8_lm_scores")
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scored(table(spark, sf_dir, "documents"))


@LLM.query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@LLM.query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


@LLM.query("op11_periodic_runs", periodic.ORACLE)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic(periodic.planted(table(spark, sf_dir, "documents"))))


@LLM.query("op12_nearest_neighbours", neighbours.ORACLE)
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@LLM.query("op13_spelling_variants", spelling.ORACLE)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))
