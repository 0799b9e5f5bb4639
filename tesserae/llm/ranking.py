"""Problem 5: one ranking from several scores of different scales.

Each score is turned into its empirical percentile within its group and list, ties averaged, and mapped through the
inverse normal distribution; items are ordered by the weighted mean of these values.

Ranks come from counts of distinct score values and distributed running sums, so that no group has to fit in a task.

Defined cases: a repeated row counts once, of several scores of an item in one list the best counts (NaN and null
none); an item missing from a list gets that list's middle, 0; an item without any score is not ranked; equal means
are ordered by id; a list whose scores are all equal says nothing (0 for each).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tesserae.plans.stage import materialize, prefix_sum


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse of the normal distribution function (0 < p < 1); percentiles repeat, so each is computed once."""
    from statistics import NormalDist

    values, codes = np.unique(p.to_numpy(float), return_inverse=True)
    inv = NormalDist().inv_cdf
    return pd.Series(np.array([inv(v) if 0 < v < 1 else np.nan for v in values])[codes])


def long_scores(df: DataFrame, group: str, item: str, lists: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """group, item, list and score: ``lists`` gives each list's score column and the rows it takes (None: all)."""
    own = []
    for name, (score, rows) in lists.items():
        value = F.col(score).cast("double")
        use = value.isNotNull() & ~F.isnan(value) & (F.lit(True) if rows is None else rows)
        own.append(F.when(use, F.struct(F.lit(name).alias("_l"), value.alias("_s"))))
    rows = df.where(F.col(item).isNotNull()).select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.explode(F.array_compact(F.array(*own))).alias("_v"))
    return rows.groupBy("_g", "_i", F.col("_v._l").alias("_l")).agg(F.max("_v._s").alias("_s"))


def normal_scores(scores: DataFrame) -> DataFrame:
    """(_g, _i, _l, _s) with ``_z``, the normal score of _s among the scores of its group and list."""
    scores = materialize(scores, "scores")
    counts = materialize(scores.groupBy("_g", "_l", "_s").agg(F.count("*").alias("_n")), "values")
    upto = prefix_sum(counts, ["_g", "_l"], ["_s"], ["_n"])
    size = counts.groupBy("_g", "_l").agg(F.sum("_n").alias("_size"))
    rank = F.col("cum__n") - (F.col("_n") - 1) / 2  # ties share the mean of their ranks
    share = upto.join(size, ["_g", "_l"]).select("_g", "_l", "_s", ((rank - 0.5) / F.col("_size")).alias("_p"))
    z = share.select("_g", "_l", "_s", F.round(normal_quantile("_p"), 12).alias("_z"))
    return scores.join(z, ["_g", "_l", "_s"])


def combined_ranking(
    df: DataFrame, group: str, item: str, lists: dict[str, tuple[str, Column | None]], weights: dict[str, float] | None = None
) -> DataFrame:
    """group, item, combined, rank: weighted mean of the normal scores over all ``lists``, best first."""
    weights = weights or dict.fromkeys(lists, 1.0)
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("_l")]
    total = float(sum(weights.values()))
    mean = normal_scores(long_scores(df, group, item, lists)).groupBy("_g", "_i").agg(F.round(F.sum(weight * F.col("_z")) / total, 9).alias("_c"))
    mean = materialize(mean.withColumn("_down", -F.col("_c")).withColumn("_one", F.lit(1).cast("long")), "means")
    ranked = prefix_sum(mean, ["_g"], ["_down", "_i"], ["_one"])
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_c").alias("combined"), F.col("cum__one").cast("int").alias("rank"))


def retrieval_lists(retrievers: tuple[str, ...] = ("dense", "sparse", "rerank")) -> dict[str, tuple[str, Column | None]]:
    """The lists of retrieval_results: each retriever's score, and the hybrid score."""
    lists: dict[str, tuple[str, Column | None]] = {r: ("score", F.col("retriever") == r) for r in retrievers}
    return lists | {"hybrid": ("hybrid_score", None)}
