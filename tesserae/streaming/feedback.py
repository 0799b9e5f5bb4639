"""Feedback as a stream: ratings by window with a watermark, and an append-only sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.stage import shared_dir, ship


def rating_stream(spark: SparkSession, folder: str, schema: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Ratings counted by window and value from the Parquet files of a folder, as they arrive."""
    rows = spark.readStream.schema(schema).parquet(folder)
    at = F.to_timestamp("given_at", "yyyy-MM-dd HH:mm:ss")
    rows = rows.withColumn("at", at).withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), "rating").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "rating", "n")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """The stream's result after all files that are there, from an in-memory table."""
    spark = stream.sparkSession
    ship(spark)
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    place = f"{shared_dir(spark)}/stream-{table}"
    query = stream.writeStream.format("memory").queryName(table).outputMode("complete").option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(table)


def append_closed(stream: DataFrame, name: str) -> DataFrame:
    """What the watermark has closed after all files that are there, appended to a table of files and read from it."""
    spark = stream.sparkSession
    ship(spark)
    place = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def append_feedback(rows: DataFrame, path: str) -> DataFrame:
    """Append a stream of rated answers to a table of files, each row once; a table is made if there is none."""
    kept = rows.select("id", "given_at", "message_index", "question", "answer", "rating")
    query = kept.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return rows.sparkSession.read.schema(kept.schema).parquet(f"{path}/rows")
