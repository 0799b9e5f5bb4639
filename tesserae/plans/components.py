"""Connected components by label propagation with pointer jumping, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.stage import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, component (its least node) of every node of ``edges``.

    A round gives each node the least label around it and then the label of that label, so the rounds grow with the
    logarithm of the longest path; it ends as soon as a round changes nothing. Labels are aggregated before they are
    shuffled, so a node with many edges is no hot spot. Labels that still change after ``rounds`` rounds are an error.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("label"))
        step = materialize(step, "step")
        above = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jump = step.join(above, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("component"))
        jump = materialize(jump, "labels")
        labels = jump.select("node", "component")
        if jump.where("was <> component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
