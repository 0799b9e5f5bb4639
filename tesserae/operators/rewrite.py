"""Query rewriting: keywords, decomposition, relevance feedback, and retrieval over all rewrites of a query.

Every rewrite is a row (qid, rewrite_no, rewrite), so a set of rewrites is retrieved with in one search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import feedback_tokens, italian_tokens

STRATEGIES = ("all", "core", "keywords", "general", "prf", "decompose", "hybrid")


def keywords(queries: DataFrame, weights: DataFrame, n: int = 3, least: int = 3) -> DataFrame:
    """qid, term, idf, rank: the ``n`` rarest terms of each query (qid, text) of ``least`` characters or more."""
    asked = queries.select("qid", F.explode(italian_tokens(F.col("text"))).alias("term")).distinct().where(F.char_length("term") >= least)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("idf", 9).desc(), "term"))
    return asked.join(weights.select("term", "idf"), "term").withColumn("rank", rank).where(F.col("rank") <= n)


def joined(ranked: DataFrame, term: str = "term") -> DataFrame:
    """qid and its terms in the order of rank, as one text ``rewrite``."""
    rows = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(term).alias("term")))).alias("k"))
    return rows.select("qid", F.array_join("k.term", " ").alias("rewrite"))


def feedback_terms(queries: DataFrame, ranked: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """qid, term, n, rank: the most frequent terms of the ranked documents that the query hasn't; equal ones by term."""
    have = queries.select("qid", F.explode(feedback_tokens(F.col("text"))).alias("term")).distinct()
    terms = ranked.select("qid", "id").join(docs, "id").select("qid", F.explode(feedback_tokens(F.col("text"))).alias("term"))
    counted = terms.groupBy("qid", "term").agg(F.count("*").alias("n")).join(have, ["qid", "term"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def decomposed(question: Column) -> Column:
    """The parts between `` e `` and `` o ``; nothing where there are none."""
    parts = F.split(question, " (e|o) ")
    return F.when(F.size(parts) > 1, parts).otherwise(F.lit([]).cast("array<string>"))


def rewrites(queries: DataFrame, weights: DataFrame, feedback: DataFrame | None = None, strategy: str = "all", core: Callable[[Column], Column] | None = None) -> DataFrame:
    """qid, rewrite_no, rewrite of each query (qid, text): the query first, each rewrite once, blank ones left out.

    ``core`` stands for a model that extracts the core of a question (the question itself by default), ``feedback``
    are the terms of :func:`feedback_terms`; without it there is no rewrite by relevance feedback.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    has = lambda *names: strategy in names
    rows = queries.select("qid", F.col("text").alias("q"))
    keys = keywords(queries, weights)
    rows = rows.join(joined(keys).withColumnRenamed("rewrite", "_kw"), "qid", "left")
    ordered = keys.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("k")).select("qid", F.col("k.term").alias("_k"))
    rows = rows.join(ordered, "qid", "left")
    if feedback is not None and has("all", "prf"):
        rows = rows.join(joined(feedback).withColumnRenamed("rewrite", "_fb"), "qid", "left")
    q = F.col("q")
    heart = core(q) if core else q
    none = F.lit([]).cast("array<string>")
    pairs = F.flatten(F.transform("_k", lambda a, i: F.transform(F.slice("_k", i + 2, F.size("_k")), lambda b: F.concat_ws(" ", a, b))))
    forms = [F.array(q)]
    forms += [F.array(heart)] if has("all", "core") else []
    forms += [F.array(F.col("_kw")), F.coalesce(pairs, none)] if has("all", "keywords") else []
    forms += [F.array(F.array_join(italian_tokens(q), " "))] if has("all", "general") else []
    if feedback is not None and has("all", "prf"):
        forms += [F.array(F.concat_ws(" ", q, F.col("_fb")))]
    forms += [decomposed(q)] if has("all", "decompose") else []
    forms += [F.array(F.concat_ws(" ", heart, F.col("_kw")))] if has("hybrid") else []
    clean = F.array_distinct(F.filter(F.transform(F.concat(*forms), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return rows.where(q.isNotNull()).select("qid", F.posexplode(clean).alias("rewrite_no", "rewrite"))


def multi_query(written: DataFrame, retrieve: Callable[[DataFrame], DataFrame], kind: str = "bigint") -> DataFrame:
    """qid, rewrite_no, id, score, rank of what ``retrieve`` finds for every rewrite.

    ``retrieve`` takes (qid, text) and gives (qid, id, score, rank); equal rewrites are searched once.
    """
    texts = written.select(F.col("rewrite").alias("text")).distinct().withColumn("qid", F.xxhash64("text"))
    found = retrieve(texts.select("qid", "text")).withColumnRenamed("qid", "_h")
    rows = written.select("qid", "rewrite_no", F.xxhash64("rewrite").alias("_h")).join(found, "_h").drop("_h")
    return rows.repartition("qid")  # what counts and ranks the items of a query stays in these partitions
