"""Joins by order and by range that need no equal keys, without gathering a group or crossing tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.stage import materialize, partitions


def asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``left`` with ``value``: the struct of the other columns of the last row of ``right`` with the same ``by`` up to ``on``.

    Both sides lie in one order in range partitions; a partition's rows look back in it, and what came before it is
    handed on by partition, so a key of any size is spread. Of right rows at one place the greatest counts; where there
    is none, ``value`` is null. Null ``on`` of the right are left out, of the left find nothing.
    """
    spark = left.sparkSession
    own = [c for c in left.columns if c not in (on, *by)]
    other = [c for c in right.columns if c not in (on, *by)]
    packed = F.struct(*[F.col(c) for c in other])
    a = left.select(*by, F.col(on), F.struct(F.lit(1).alias("_x"), *own).alias("_l"), F.lit(None).cast(right.select(packed.alias("r")).schema["r"].dataType).alias("_r"))
    b = right.where(F.col(on).isNotNull()).select(*by, F.col(on), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), packed.alias("_r"))
    rows = a.unionByName(b).withColumn("_side", F.col("_l").isNotNull().cast("int"))
    ranged = materialize(rows.repartitionByRange(partitions(spark), *by, on, "_side").withColumn("_pid", F.spark_partition_id()), "ordered")
    upto = Window.partitionBy("_pid", *by).orderBy(on, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_near", F.last("_r", True).over(upto))
    last = ranged.groupBy("_pid", *by).agg(F.max(F.when(F.col("_r").isNotNull(), F.struct(F.col(on).alias("o"), F.col("_r").alias("r")))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = last.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.last("_last", True).over(before).alias("_c"))
    same = [F.col("_pid") == F.col("_p")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    out = local.where("_l is not null").join(carried, reduce(lambda x, y: x & y, same))
    found = F.when(F.col(on).isNotNull(), F.coalesce("_near", F.col("_c.r")))
    return out.select(*by, on, *[F.col("_l")[c].alias(c) for c in own], found.alias(value))


def in_range(points: DataFrame, at: Column, ranges: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """Pairs of points and ranges with ``start <= at < end``; the expressions are numbers.

    Ranges are cut along a grid of ``width``, so that the join has a key; about a range's size makes few rows of each.
    """
    cell = lambda c: F.floor(c / width).cast("long")
    cut = ranges.where(start < end).withColumn("_from", start).withColumn("_to", end).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    placed = points.withColumn("_at", at).withColumn("_cell", cell(at))
    return placed.join(cut, "_cell").where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).drop("_cell", "_at", "_from", "_to")


def overlapping(a: DataFrame, b: DataFrame, a_range: tuple[Column, Column], b_range: tuple[Column, Column], width: float) -> DataFrame:
    """Pairs of rows whose half-open ranges overlap, each once: in the cell where the later of them begins."""
    cell = lambda c: F.floor(c / width).cast("long")
    cut = lambda rows, r, n: rows.where(r[0] < r[1]).withColumn(f"_s{n}", r[0]).withColumn(f"_e{n}", r[1]).withColumn("_cell", F.explode(F.sequence(cell(r[0]), cell(r[1]))))
    pairs = cut(a, a_range, 1).join(cut(b, b_range, 2), "_cell")
    meet = (F.col("_s1") < F.col("_e2")) & (F.col("_s2") < F.col("_e1")) & (F.col("_cell") == cell(F.greatest("_s1", "_s2")))
    return pairs.where(meet).drop("_cell", "_s1", "_e1", "_s2", "_e2")
