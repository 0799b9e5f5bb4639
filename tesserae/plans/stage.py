"""Helpers that shape the physical plan: lineage cuts, size-checked broadcasts and prefix sums."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_STAGES: list[str] = []

#: Rows up to which a written table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of a batch sent to Python, where the session names no limit.
ARROW_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return f"file://{_LOCAL['dir']}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if _LOCAL.get("shipped") == app:
        return
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str(2**31 - 1), str(2**63 - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))  # a batch of long texts stays small
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tesserae-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(os.path.join(folder, f"{root.name}.zip"), "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(os.path.join(folder, f"{root.name}.zip"))
    _LOCAL["shipped"] = app


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there.

    The files stay until :func:`drop_stages` or the end of the process, since results are lazy.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _STAGES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete every table written by :func:`materialize`; results that still read them are then invalid."""
    n = 0
    while _STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``written`` with a broadcast hint if its counted rows allow it, else as it is.

    ``written`` must be a materialised table, so that the count only reads file footers.
    """
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def prefix_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "cum_"
) -> DataFrame:
    """Inclusive running sums of ``values`` in each group of ``keys``, in the order of ``order``.

    No group is ever collected into one task: the rows are range-partitioned by keys and order, summed in each
    partition, and each partition adds the totals of the earlier partitions of its group; of those there are at most
    as many as partitions. Keys may be null (nulls are one group). ``keys`` + ``order`` must identify the rows, else
    the order of equal rows is arbitrary. ``df`` should be cheap to read twice (range bounds are sampled).
    """
    spark = df.sparkSession
    by = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(partitions(spark), *by).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    own = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged
    for v in values:
        local = local.withColumn(prefix + v, F.sum(v).over(own))
    totals = ranged.groupBy("_pid", *keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("_pid").alias("_p"),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values],
    )
    on = [F.col("_pid") == F.col("_p")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = local.join(totals, reduce(lambda a, b: a & b, on), "inner")
    for v in values:
        joined = joined.withColumn(prefix + v, F.col(prefix + v) + F.col(f"_b_{v}"))
    return joined.drop("_pid", "_p", *[f"_k{i}" for i in range(len(keys))], *[f"_b_{v}" for v in values])
