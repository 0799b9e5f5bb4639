"""Breadth-first crawl of a link table, and what it is written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.stage import materialize


def depths(edges: DataFrame, start: str, max_depth: int = 10, max_pages: int | None = 200) -> DataFrame:
    """url, depth of the pages reached from ``start`` over ``edges`` (src, dst), nearest and then least url first."""
    spark = edges.sparkSession
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "links")
    seen = spark.createDataFrame([(start, 0)], "url string, depth int")
    front = seen
    for depth in range(1, max_depth + 1):
        new = front.join(edges, front["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        front = materialize(new.withColumn("depth", F.lit(depth)), "front")
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front)
    if max_pages is None:
        return seen
    return seen.orderBy("depth", "url").limit(max_pages)


def crawl(links: DataFrame, pages: DataFrame, start: str, max_depth: int = 10, max_pages: int | None = 200) -> DataFrame:
    """url, depth of the pages reached from ``start``: ``pages`` (url, fetched) that weren't fetched are neither given nor followed."""
    good = pages.where("fetched").select(F.col("url").alias("dst"))
    return depths(links.join(good, "dst", "left_semi"), start, max_depth, max_pages)


def sitemap(pages: DataFrame, start: str, day) -> DataFrame:
    """loc, lastmod, changefreq, priority of crawled pages (url)."""
    priority = F.when(F.col("url") == start, 1.0).otherwise(0.8)
    return pages.select(F.col("url").alias("loc"), F.lit(day).cast("date").alias("lastmod"), F.lit("weekly").alias("changefreq"), priority.alias("priority"))


def write_sitemap(rows: DataFrame, path: str) -> None:
    rows.write.format("xml").option("rowTag", "url").option("rootTag", "urlset").mode("overwrite").save(path)


def read_sitemap(spark, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod date, changefreq string, priority double").load(path)


def latest(rows: DataFrame) -> DataFrame:
    """One row for each loc: the last modified, then the highest priority."""
    w = Window.partitionBy("loc").orderBy(F.col("lastmod").desc_nulls_last(), F.col("priority").desc_nulls_last(), "changefreq")
    return rows.where("loc is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
