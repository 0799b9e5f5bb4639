"""Fusion of ranked lists. Lists are rows (qid, id, retriever, score, rank); ties are ordered by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import italian_tokens
from tesserae.operators.bm25 import top

ALPHA, RRF_K = 0.3, 60


def minmax(rows: DataFrame) -> DataFrame:
    """``norm``: score scaled to 0..1 in its query and list; 1 where all are equal."""
    w = Window.partitionBy("qid", "retriever")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return rows.withColumn("norm", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def _blended(alpha: float = ALPHA) -> Column:
    return F.when(F.col("retriever") == "dense", 1.0).when(F.col("retriever") == "sparse", alpha)


def blend(rows: DataFrame, k: int = 5, alpha: float = ALPHA) -> DataFrame:
    """Dense plus ``alpha`` times sparse, both min-max scaled; what is missing counts 0."""
    scored = minmax(rows.where(F.col("retriever").isin("dense", "sparse"))).groupBy("qid", "id").agg(F.round(F.sum(_blended(alpha) * F.col("norm")), 6).alias("hybrid"))
    return top(scored, k, "hybrid")


def _reciprocal(constant: int = RRF_K, weights: dict[str, float] | None = None) -> Column:
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("retriever") == name, float(w)).otherwise(weight)
    return weight / (constant + F.col("rank"))


def rrf(rows: DataFrame, k: int = 5, constant: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion; ``weights`` of the lists, 1 for those not named."""
    scored = rows.groupBy("qid", "id").agg(F.round(F.sum(_reciprocal(constant, weights)), 9).alias("rrf"))
    return top(scored, k, "rrf")


def standardise(found: DataFrame, retriever: str, text: str = "text", size: int = 100) -> DataFrame:
    """qid, id, text, score, retriever, rank of a result list (qid, id, ``text``, score).

    An item without id is known by the first ``size`` characters of its text; of an item met twice the later place counts.
    """
    id_ = F.coalesce(F.col("id").cast("string"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, size))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "_id")
    rows = found.withColumn("_id", id_).withColumn("rank", F.row_number().over(order))
    later = F.row_number().over(Window.partitionBy("qid", "_id").orderBy(F.col("rank").desc()))
    rows = rows.withColumn("_n", later).where("_n = 1")
    return rows.select("qid", F.col("_id").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(retriever).alias("retriever"), "rank")


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 5, method: str = "blend", **how) -> DataFrame:
    """The best ``k`` of two result lists (qid, id, score, rank), blended or by reciprocal ranks, with the list's score.

    ``score`` is the dense score where the item has one, else the sparse one: the two have different scales.
    """
    lists = [x.select("qid", "id", "score", "rank", F.lit(name).alias("retriever")) for name, x in (("dense", dense), ("sparse", sparse))]
    rows = lists[0].unionByName(lists[1]).repartition("qid")  # all that follows stays in these partitions
    if method == "blend":
        value = F.round(F.sum(_blended(**how) * F.col("norm")), 6)
        rows = minmax(rows)
    else:
        value = F.round(F.sum(_reciprocal(**how)), 9)
    scored = rows.groupBy("qid", "id").agg(value.alias("fused"), F.min_by("score", "retriever").alias("score"))
    return top(scored, k, "fused").select("qid", "id", "fused", "rank", "score")


def hit_count(rows: DataFrame, k: int = 5, constant: int = RRF_K) -> DataFrame:
    """Grows with the number of lists an item is in only: the sum of 1 / (constant + i) over its hits."""
    n = F.sequence(F.lit(1), F.count("*").cast("int"))
    scored = rows.groupBy("qid", "id").agg(n.alias("_n"))
    scored = scored.select("qid", "id", F.round(F.aggregate("_n", F.lit(0.0), lambda a, i: a + 1 / (constant + i)), 9).alias("fused"))
    return top(scored, k, "fused")


def spread_mean(rows: DataFrame, k: int = 5, bonus: float = 0.2) -> DataFrame:
    """Mean score, raised by ``bonus`` for each further list the item is in."""
    scored = rows.groupBy("qid", "id").agg(F.round((1 + bonus * (F.count_distinct("retriever") - 1)) * F.avg("score"), 6).alias("fused"))
    return top(scored, k, "fused")


def score_sum(rows: DataFrame, k: int = 5) -> DataFrame:
    return top(rows.groupBy("qid", "id").agg(F.round(F.sum("score"), 6).alias("fused")), k, "fused")


def rerank(rows: DataFrame, k: int = 5, cut: int = 20) -> DataFrame:
    """Two stages: the best ``cut`` by fused rank, then by the re-ranker's score; items it didn't score come last."""
    first = rrf(rows.where(F.col("retriever") != "rerank"), cut)
    second = rows.where(F.col("retriever") == "rerank").select("qid", "id", F.col("score").alias("rerank_score"))
    both = first.select("qid", "id", "rrf").join(second, ["qid", "id"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rrf").desc(), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def only_in(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, id) that list ``a`` has and list ``b`` has not."""
    return rows.where(F.col("retriever") == a).select("qid", "id").distinct().join(rows.where(F.col("retriever") == b), ["qid", "id"], "left_anti")


# ---- re-ranking by a scorer

Scorer = Callable[[Column, Column], Column]


def picked_text(content: Column, text: Column, document: Column) -> Column:
    """What a re-ranker reads: the first of these that isn't empty."""
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(content), full(text), document, F.lit(""))


def term_overlap(query: Column, document: Column) -> Column:
    """Share of the query's terms that the document has; stands for a model that scores pairs of texts."""
    asked = F.array_distinct(italian_tokens(query))
    both = F.array_intersect(asked, italian_tokens(document))
    return F.when(F.size(asked) > 0, F.size(both) / F.size(asked)).otherwise(0.0)


def precut_to(candidates: DataFrame, cut: int = 20, precut: str = "fused") -> DataFrame:
    """The best ``cut`` candidates (qid, id, score, fused) of each query.

    They are cut by the fused value, or by ``precut='raw_score'``, where scores of different scales compete.
    """
    if precut not in ("fused", "raw_score"):
        raise ValueError(f"unknown cut {precut!r}")
    order = Window.partitionBy("qid").orderBy(F.col("fused" if precut == "fused" else "score").desc(), "id")
    return candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cut).drop("_n")


def relevant(kept: DataFrame, queries: DataFrame, scorer: Scorer = term_overlap) -> DataFrame:
    """``kept`` (qid, id, text, ...) with their ``relevance`` to the query (qid, text)."""
    asked = queries.select("qid", F.col("text").alias("_q"))
    return kept.join(asked, "qid").withColumn("relevance", F.round(F.coalesce(scorer(F.col("_q"), F.col("text")), F.lit(0.0)), 9)).drop("_q")


def scored(candidates: DataFrame, queries: DataFrame, cut: int = 20, precut: str = "fused", scorer: Scorer = term_overlap) -> DataFrame:
    """The best ``cut`` candidates (qid, id, text, score, fused) of each query (qid, text) with their ``relevance``."""
    return relevant(precut_to(candidates, cut, precut), queries, scorer)


def rerank_scored(rows: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` by relevance, then fused value and id; the items keep their own score."""
    order = Window.partitionBy("qid").orderBy(F.col("relevance").desc(), F.col("fused").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("text")


def mmr(rows: DataFrame, k: int = 5, penalty: float = 0.5) -> DataFrame:
    """qid, id, rank: ``k`` items one after the other, each the best of relevance less likeness to those taken before.

    Likeness is the share of common terms; ``penalty`` weighs it. An extension: the candidates of a query (at most the
    cut) are one row.
    """
    kind_q, kind_i = dict(rows.dtypes)["qid"], dict(rows.dtypes)["id"]

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qs, ids, ranks = [], [], []
            for q, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                left = {x["id"]: (x["relevance"], set(x["terms"] or [])) for x in items}
                like = dict.fromkeys(left, 0.0)
                for rank in range(1, min(k, len(left)) + 1):
                    value = {i: round((1 - penalty) * left[i][0] - penalty * like[i], 9) for i in left}
                    best = min(left, key=lambda i: (-value[i], i))
                    _, terms = left.pop(best)
                    for i, (_, own) in left.items():
                        like[i] = max(like[i], len(own & terms) / max(1, len(own | terms)))
                    qs.append(q)
                    ids.append(best)
                    ranks.append(rank)
            yield pa.RecordBatch.from_arrays([pa.array(qs, b.column(0).type), pa.array(ids, b.column(1).type.value_type.field("id").type), pa.array(ranks, pa.int32())], names=["qid", "id", "rank"])

    packed = rows.groupBy("qid").agg(F.collect_list(F.struct("id", "relevance", F.array_distinct(italian_tokens(F.col("text"))).alias("terms"))).alias("items"))
    return packed.mapInArrow(greedy, f"qid {kind_q}, id {kind_i}, rank int")


# ---- searches answered before


def with_cache(queries: DataFrame, cache: DataFrame, search: Callable[[DataFrame], DataFrame], key: Callable[[Column], Column]) -> DataFrame:
    """qid, id, score, rank, cached: results of ``queries`` (qid, text), looked up in ``cache`` (key, id, score, rank).

    What the cache hasn't is searched once for each key; ``search`` takes (qid, text) and gives (qid, id, score, rank).
    """
    asked = queries.select("qid", "text", key(F.col("text")).alias("key")).where("key is not null")
    have = asked.join(cache, "key").select("qid", "id", "score", "rank", F.lit(True).alias("cached"))
    missing = asked.join(cache.select("key").distinct(), "key", "left_anti")
    once = missing.groupBy("key").agg(F.min("text").alias("text")).withColumn("qid", F.xxhash64("key"))
    found = search(once.select("qid", "text")).withColumnRenamed("qid", "_h")
    new = missing.withColumn("_h", F.xxhash64("key")).join(found, "_h").select("qid", "id", "score", "rank", F.lit(False).alias("cached"))
    return have.unionByName(new)
