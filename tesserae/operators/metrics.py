"""Retrieval quality: precision, recall, reciprocal rank, nDCG and average precision at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ["precision_at_k", "recall_at_k", "mrr", "ndcg_at_k", "ap_at_k"]


def per_query(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row for each of ``queries`` (qid): ``ranked`` is (qid, id, rank), ``relevant`` (qid, id).

    The ideal list of nDCG is the retrieved labels re-sorted, so missing documents aren't punished; queries without
    relevant or retrieved documents have 0 everywhere.
    """
    truth = relevant.select("qid", "id").distinct()
    n_rel = truth.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = ranked.where(F.col("rank") <= k).join(truth, ["qid", "id"], "left_semi")
    seen = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    hits = hits.withColumn("seen", seen).groupBy("qid").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(F.col("seen") / F.col("rank")).alias("prec"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    rows = queries.select("qid").distinct().join(n_rel, "qid", "left").join(hits, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("hits").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "qid", zero(F.col("hits") / k).alias(NAMES[0]), zero(F.col("hits") / F.col("n_rel")).alias(NAMES[1]), zero(1 / F.col("first")).alias(NAMES[2]),
        zero(F.col("dcg") / ideal).alias(NAMES[3]), zero(F.col("prec") / F.least("n_rel", F.lit(k))).alias(NAMES[4]),
    )


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("num_queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 5).alias(f"avg_{c}") for c in NAMES])
