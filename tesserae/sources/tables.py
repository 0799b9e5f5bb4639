"""Readers of the tables the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.stage import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks_memory without its all-null rows."""
    return read(spark, sf_dir, "chunks_memory").where("chunk_id is not null")
