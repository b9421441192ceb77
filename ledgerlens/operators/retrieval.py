"""Similar-case retrieval: exact nearest neighbours within partitions, verification after the top k, bands and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import band, cosine, normalised, vector_ok
from ledgerlens.registry import REGISTRY, table


def nearest(queries: DataFrame, store: DataFrame, partition: list[str], k: int = 5, others: bool = False, salts: int = 16) -> DataFrame:
    """(query_id, id, score, rank): the k best of a query's partition by cosine, ties to the smallest id (T4, V1).

    The equi-join on the partition columns prunes what is compared. The store's rows of a partition are dealt over `salts`
    tasks, each of which has its queries; Spark keeps the best k of a query in each task before its shuffle, so a large
    partition sends k rows a query and task, not all pairs. `others` leaves out the store's row of the query's own id.
    """
    salted = [*partition, "salt"]
    q = queries.select(*partition, "query_id", F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = q.join(store.select(*partition, F.pmod(F.hash("id"), F.lit(salts)).alias("salt"), "id", "embedding"), salted)
    if others:
        pairs = pairs.where("id <> query_id")
    scored = pairs.select(*partition, "query_id", "id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def funnel(
    queries: DataFrame, store: DataFrame, chain: DataFrame, model: str, partition: list[str], k: int = 5, high: float = 0.85, medium: float = 0.65, others: bool = False
) -> DataFrame:
    """(query_id, outcome, id, score): hit, degraded or the reason of a miss (V1, V2).

    The k best come first; records without a verified chain head and those of another model leave the k afterwards, so
    a query may end with fewer than k. The stage at which nothing is left is the reason of a miss (J5, J6).
    """
    top = nearest(queries, store, partition, k, others).join(store.select("id", "chain_head", "model"), "id")
    known = chain.select("chain_head").where("chain_head <> ''").distinct().withColumn("verified", F.lit(True))
    checked = top.join(known, "chain_head", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    ok = F.col("verified") & (F.col("model") == model)
    agg = checked.groupBy("query_id").agg(
        F.count_if("verified").alias("n_verified"), F.count_if(ok).alias("n_ok"), F.min(F.when(ok, F.struct((-F.col("score")).alias("s"), "id"))).alias("best")
    )
    score = -F.col("best.s")
    outcome = (
        F.when(F.col("n_verified").isNull(), "miss:empty_store").when(F.col("n_verified") == 0, "miss:all_candidates_chain_orphan")
        .when(F.col("n_ok") == 0, "miss:all_candidates_model_mismatch").when(band(score, high, medium) == "high", "hit")
        .when(band(score, high, medium) == "medium", "degraded").otherwise("miss:top1_below_floor")
    )
    return queries.select("query_id").join(agg, "query_id", "left").select("query_id", outcome.alias("outcome"), F.col("best.id").alias("id"), score.alias("score"))


def stale_models(store: DataFrame, model: str) -> DataFrame:
    """Records of other models: how many, and the first by id."""
    other = F.col("model") != model
    return store.agg(F.count_if(other).alias("excluded"), F.min(F.when(other, F.struct("id", "model"))).alias("f")).select(
        "excluded", F.col("f.id").alias("first_id"), F.col("f.model").alias("first_model")
    )


def cache_aside(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits in request order, distinct misses in first-seen order) (V3). requests has (pos, key)."""
    hits = requests.join(cache, key)
    misses = requests.groupBy(key).agg(F.min("pos").alias("first_pos")).join(cache, key, "left_anti")
    return hits, misses


def rebuilt(records: DataFrame, order: str, dim: int | Column, encode=None) -> DataFrame:
    """The store's rows from the canonical records (V5): of each id the last by `order`, with a usable vector, normalised.

    `encode` maps a DataFrame to one with its embeddings made anew. The result replaces the derived table as a whole.
    """
    last = records.groupBy("id").agg(F.max_by(F.struct(*[c for c in records.columns if c != "id"]), order).alias("r")).select("id", "r.*")
    made = encode(last) if encode is not None else last
    unit = made.where(vector_ok(F.col("embedding"), dim)).withColumn("embedding", normalised(F.col("embedding")))
    return unit.where("embedding is not null").drop(order)


def contained_ids(asked: DataFrame, store: DataFrame) -> DataFrame:
    return asked.join(store.select("id").distinct(), "id", "left_semi")


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    store = vectors.select(
        F.col("vec_id").alias("id"), "label", "embedding", F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("vec_id") % 10).cast("string"))).alias("chain_head"),
        F.when(F.col("vec_id") % 5 == 0, "old").otherwise("live").alias("model"),
    )
    return queries, store


_NEAREST = """
q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT vec_id AS id, label, embedding, CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'h' || (vec_id % 10) END AS chain_head,
             CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'live' END AS model FROM embeddings),
n AS (SELECT q.label, query_id, id, chain_head, model, round(greatest(-1, least(1, list_dot_product(q.embedding::DOUBLE[], s.embedding::DOUBLE[]))), 6) AS score
      FROM q JOIN s USING (label) WHERE query_id <> id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)
"""


@REGISTRY.query("knn_topk", f"WITH {_NEAREST} SELECT label, query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM n")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, store = _store(spark, sf_dir)
    return nearest(queries, store, ["label"], others=True)


@REGISTRY.query(
    "knn_bands",
    f"WITH {_NEAREST} SELECT query_id, id, CASE WHEN score >= 0.3 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS band FROM n",
)
def knn_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, store = _store(spark, sf_dir)
    return nearest(queries, store, ["label"], others=True).select("query_id", "id", band(F.col("score"), 0.3, 0.25).alias("band"))


@REGISTRY.query(
    "retrieval_funnel",
    f"""
    WITH {_NEAREST},
    c AS (SELECT *, chain_head IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') AS v FROM n),
    a AS (SELECT query_id, count(*) FILTER (v) AS nv, count(*) FILTER (v AND model = 'live') AS nk,
                 min_by(id, (-score, id)) FILTER (v AND model = 'live') AS id, max(score) FILTER (v AND model = 'live') AS score FROM c GROUP BY 1)
    SELECT q.query_id, CASE WHEN nv IS NULL THEN 'miss:empty_store' WHEN nv = 0 THEN 'miss:all_candidates_chain_orphan' WHEN nk = 0 THEN 'miss:all_candidates_model_mismatch'
             WHEN score >= 0.3 THEN 'hit' WHEN score >= 0.25 THEN 'degraded' ELSE 'miss:top1_below_floor' END AS outcome, id, score
    FROM q LEFT JOIN a USING (query_id)
    """,
)
def retrieval_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, store = _store(spark, sf_dir)
    chain = spark.sql("SELECT * FROM VALUES ('h1'), ('h2'), ('h3'), ('h4'), ('h5'), ('h6'), ('') AS t(chain_head)")
    return funnel(queries, store, chain, "live", ["label"], high=0.3, medium=0.25, others=True)


@REGISTRY.query("stale_models", f"WITH {_NEAREST} SELECT count(*) FILTER (model <> 'live') AS excluded, min(id) FILTER (model <> 'live') AS first_id, 'old' AS first_model FROM s")
def stale_models_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale_models(_store(spark, sf_dir)[1], "live")


@REGISTRY.query(
    "cache_aside_misses",
    "SELECT event_type AS key, min(event_id) AS first_pos FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1",
)
def cache_aside_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("key"))
    cache = spark.sql("SELECT * FROM VALUES ('view', 1), ('click', 2) AS t(key, vector)")
    return cache_aside(requests, cache, "key")[1]
