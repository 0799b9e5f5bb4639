"""Problem 8: sources mixed to target weights.

Low-discrepancy source schedule. Slot i of the mix takes the point frac(i * golden ratio) and, through the cumulative
weights (a join by order), a source; the slots of a source are ranked by a distributed running count, and its slot of
rank r is joined to its block r. Blocks hold equally many tokens: the documents of a source lie one after the other, in
an order shuffled by a seeded hash, repeated in rounds, and a document stands in the slot of the block it begins in. A
document is used once for each round in which all of its tokens lie in the source's blocks; what is left of them goes to
the documents that fill them best, at the end of the source's slots.

At every slot a source has had its share of the slots so far but for a few (the discrepancy of the golden ratio grows
with the logarithm of their number), so every stretch of the mix has about the target shares.

Without ``total_tokens`` the mix is as large as the weights allow: for every source that has tokens, ``max_repeats``
times its tokens is an upper bound on weight * size, so the scarcest source sets the size. With it, sources that can't
give their part give what they have, and what they fall short of is told. Sources without documents or with a weight of
0 or below take no part, and the other weights are scaled to 1.

Defined cases: null and empty texts have no tokens and are never chosen; null sources match no target; a null
``max_repeats`` is no cap, 0 or less takes the source out; if no source has a cap the mix holds every source about
once at least; repeated targets of a source are added up, with the smallest cap; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.tokens import encode_corpus
from tesserae.operators.joins import asof
from tesserae.plans.stage import materialize, prefix_sum, small

GOLDEN = (math.sqrt(5) - 1) / 2
#: Tokens of a block.
BLOCK_TOKENS = 256
#: Times a source's choice is brought nearer to its tokens by a single document.
ADJUSTMENTS = 2


def _few(df: DataFrame, label: str) -> DataFrame:
    """A row for each source of the targets, written, and broadcast if they are few."""
    return small(materialize(df, label))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Each target source's share of the weights, its tokens, and the tokens of the mix. One row for each target source."""
    goal = targets.where("source is not null").groupBy("source").agg(F.sum("target_weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = goal.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("double"))
    use = (F.col("weight") > 0) & (F.col("tokens") > 0) & (F.col("max_repeats").isNull() | (F.col("max_repeats") > 0))
    rows = rows.withColumn("_w", F.when(use, F.col("weight").cast("double")).otherwise(0.0))
    everything = Window.partitionBy(F.lit(0))  # the table of targets: a row for each source
    rows = rows.withColumn("share", F.when(F.col("_w") > 0, F.col("_w") / F.sum("_w").over(everything)).otherwise(0.0))
    cap = F.when(F.col("_w") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))
    once = F.when(F.col("_w") > 0, F.col("tokens") / F.col("share"))
    most = F.coalesce(F.min(cap).over(everything), F.max(once).over(everything), F.lit(0.0))
    if total_tokens is not None:
        most = F.when(F.max("_w").over(everything) > 0, F.lit(float(total_tokens))).otherwise(0.0)
    return rows.withColumn("mix_tokens", most).drop("_w")


def schedule(planned: DataFrame, block: float = BLOCK_TOKENS) -> DataFrame:
    """slot, source, nth: the source of every slot of the mix, and which of the source's slots it is, from 0."""
    spark = planned.sparkSession
    total = planned.agg(F.max("mix_tokens")).first()[0] or 0.0
    order = Window.partitionBy(F.lit(0)).orderBy("source")  # again a row for each source
    spans = planned.where("share > 0").withColumn("x", F.sum("share").over(order) - F.col("share")).withColumn("first", F.row_number().over(order) == 1)
    spans = spans.select(F.when(F.col("first"), -1.0).otherwise(F.col("x")).alias("x"), "source")
    points = spark.range(math.ceil(total / block)).select(F.col("id").alias("slot"), ((F.col("id") + 1) * GOLDEN % 1.0).alias("x"))
    hit = asof(points, spans, "x").select("slot", F.col("value.source").alias("source"), F.lit(1).cast("long").alias("one"))
    ranked = prefix_sum(materialize(hit, "slots"), ["source"], ["slot"], ["one"])
    return materialize(ranked.select("slot", "source", (F.col("cum_one") - 1).alias("nth")), "schedule")


def chosen_documents(sizes: DataFrame, planned: DataFrame, slots: DataFrame, block: float = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """source, doc_id, n_tokens, repeats and place (tokens of its source before it) of every chosen document, with its source's plan."""
    sizes = materialize(sizes.where("source is not null and n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")), "sizes")
    taken = slots.groupBy("source").agg(F.count("*").alias("taken"))
    limit = F.least(F.col("taken") * F.lit(float(block)), F.col("share") * F.col("mix_tokens"), F.coalesce(F.col("max_repeats") * F.col("tokens"), F.lit(math.inf)))
    goal = _few(planned.join(taken, "source").select("source", "tokens", "max_repeats", "taken", limit.alias("_goal")), "goals")
    shuffled = sizes.join(goal, "source").withColumn("_at", F.xxhash64(F.lit(seed), "doc_id"))
    laid = prefix_sum(shuffled, ["source"], ["_at", "doc_id"], ["n_tokens"])
    repeats = F.greatest(F.lit(0), F.floor((F.col("_goal") - F.col("cum_n_tokens")) / F.col("tokens") + 1 + 1e-9))
    repeats = F.when(F.col("max_repeats").isNull(), repeats).otherwise(F.least(repeats, F.col("max_repeats")))
    rows = laid.select("source", "doc_id", "n_tokens", "tokens", "max_repeats", "taken", "_goal", (F.col("cum_n_tokens") - F.col("n_tokens")).alias("place"), repeats.cast("int").alias("repeats"))
    for _ in range(ADJUSTMENTS):
        rows = adjust(materialize(rows, "mix"))
    return rows.where("repeats > 0")


def adjust(chosen: DataFrame) -> DataFrame:
    """Use one document of each source once more or once less, where that brings the source nearest to its tokens."""
    used = _few(chosen.groupBy("source").agg((F.max("_goal") - F.sum(F.col("n_tokens") * F.col("repeats"))).alias("_gap")), "gaps")
    rows = chosen.join(used, "source")
    more = F.when(F.col("max_repeats").isNull() | (F.col("repeats") < F.col("max_repeats")), F.abs(F.col("_gap") - F.col("n_tokens")))
    less = F.when(F.col("repeats") > 0, F.abs(F.col("_gap") + F.col("n_tokens")))
    left = F.least(more, less)
    change = F.struct(left.alias("left"), F.col("doc_id").alias("doc"), F.when(more == left, 1).otherwise(-1).alias("by"))
    best = _few(rows.where(left < F.abs("_gap")).groupBy("source").agg(F.min(change).alias("_best")), "changes")
    by = F.when(F.col("_best.doc") == F.col("doc_id"), F.col("_best.by")).otherwise(0)
    return chosen.join(best, "source", "left").withColumn("repeats", F.col("repeats") + F.coalesce(by, F.lit(0))).drop("_best")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, block: float = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """slot, source, doc_id, n_tokens, round: every use of every chosen document, at its place in the mix.

    ``sizes``: doc_id, source, n_tokens. The mix is read in the order of slot, round and doc_id.
    """
    planned = materialize(plan(sizes, targets, total_tokens), "plan")
    slots = schedule(planned, block)
    rows = chosen_documents(sizes, planned, slots, block, seed)
    uses = rows.select("source", "doc_id", "n_tokens", "tokens", "taken", "place", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("round"))
    nth = F.least(F.floor((F.col("round") * F.col("tokens") + F.col("place")) / block), F.col("taken") - 1)
    uses = uses.select("source", nth.cast("long").alias("nth"), "doc_id", "n_tokens", "round")
    return materialize(uses.join(slots, ["source", "nth"]).select("slot", "source", "doc_id", "n_tokens", "round"), "mixed")


def documents(mixed: DataFrame) -> DataFrame:
    """source, doc_id, n_tokens, repeats and first slot of every document of a mix."""
    return mixed.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").cast("int").alias("repeats"), F.min("slot").alias("first_slot"))


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """For each target source its share of the target weights and of the mix's tokens, and the tokens it falls short of."""
    got = documents(mixed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    rows = planned.join(got, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    actual = F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    short = F.greatest(F.lit(0.0), F.round(F.col("share") * F.col("mix_tokens") - F.col("used_tokens"), 3))
    return rows.select(
        "source", F.round("share", 9).alias("target_share"), F.round(actual, 9).alias("actual_share"), "used_tokens", short.alias("short_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )


def document_sizes(documents: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source and n_tokens of every document."""
    counted = encode_corpus(documents, tokenizer=tokenizer, count_only=True)
    return documents.select("doc_id", "source").join(counted, "doc_id")
