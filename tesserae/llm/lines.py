"""Problem 2: lines repeated across the documents of one site.

Incremental per-source line-count tables, kept in a folder. They hold, for each site and normalised line, the distinct
documents it was seen in -- at most ``threshold`` - 1 of them, since a line that reaches the threshold moves to the
table of crossed lines and needs no count any more -- and where every line stands. A new partition is merged as a delta:
only its own (site, line, document) rows are added, only its lines can cross, and what is written is a new version of
each table. Merges of any later session go on from the last version that was written whole. Only chunks that hold lines
crossed just now, or new ones with crossed lines, are rebuilt.

Defined cases: null source or content and image_ocr rows take no part (null content_type does); lines without a letter
are never counted; a document counts once for a line however often it repeats it, in one chunk or several; rows read
twice change nothing; empty tables give no lines. Only the named columns are used, so others may have any name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.stage import materialize, shared_dir, small

THRESHOLD = 10


def site(source: Column) -> Column:
    """Host of an address in lower case, without port and leading ``www.``."""
    host = F.regexp_extract(F.lower(source), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def normal(line: Column) -> Column:
    """Lower case, white space trimmed and squeezed, each run of digits ``0``."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(line), r"(?U)\s+", " "), r"^ | $", "")
    return F.regexp_replace(squeezed, r"\p{Nd}+", "0")


def line_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no, site, doc (hash of source), line (two hashes of the normalised line in its site)."""
    use = chunks.where("source is not null and content is not null and chunk_id is not null and (content_type is null or content_type <> 'image_ocr')")
    rows = use.select("chunk_id", "source", site(F.col("source")).alias("site"), F.posexplode(F.split("content", "\n")).alias("line_no", "raw"))
    rows = rows.where(F.col("raw").rlike(r"\p{L}")).withColumn("norm", normal(F.col("raw")))
    line = F.struct(F.xxhash64("site", "norm").alias("a"), F.hash("norm", "site").alias("b"))
    return rows.select("chunk_id", (F.col("line_no") + 1).alias("line_no"), F.xxhash64("source").alias("doc"), line.alias("line"))


_TABLES = {
    "seen": "line struct<a: bigint, b: int>, doc bigint", "crossed": "line struct<a: bigint, b: int>", "places": "chunk_id string, line_no int, line struct<a: bigint, b: int>", "done": "threshold int",
}


@dataclass(frozen=True)
class LineCounts:
    """The tables in ``folder``: a folder ``version=k`` in each for every delta, the last one ``done`` counts."""

    spark: SparkSession
    folder: str
    threshold: int = THRESHOLD

    def version(self) -> int:
        """The last version written whole; 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        return max([int(str(f.getPath().getName()).partition("=")[2]) for f in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))], default=0)

    def table(self, name: str, upto: int) -> DataFrame:
        if upto < 1:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*[f"{self.folder}/{name}/version={k}" for k in range(1, upto + 1)])

    def _write(self, rows: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.folder}/{name}/version={version}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(_TABLES[name]).parquet(path)

    def merge(self, chunks: DataFrame) -> DataFrame:
        """Merge a delta; gives the (chunk_id, line_no) to be removed that weren't before.

        These are the new chunks' lines that were or are crossed, and the older chunks' lines crossed just now.
        """
        old = self.version()
        rows = materialize(line_rows(chunks), "lines")
        places = self._write(rows.select("chunk_id", "line_no", "line"), "places", old + 1)
        docs = rows.select("line", "doc").distinct()
        crossed = self.table("crossed", old)
        if old:
            seen = self.table("seen", old)
            docs = docs.join(small(crossed), "line", "left_anti").join(seen, ["line", "doc"], "left_anti")
            docs = materialize(docs, "line-docs")
            had = seen.join(docs.select("line").distinct(), "line", "left_semi").unionByName(docs)
        else:
            docs = had = materialize(docs, "line-docs")
        over = self._write(had.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= self.threshold).select("line"), "crossed", old + 1)
        self._write(docs.join(small(over), "line", "left_anti"), "seen", old + 1)
        self._write(self.spark.createDataFrame([(self.threshold,)], _TABLES["done"]).coalesce(1), "done", old + 1)
        removed = places.join(small(self.table("crossed", old + 1)), "line", "left_semi")
        if old:
            removed = removed.unionByName(self.table("places", old).join(small(over), "line", "left_semi"))
        return removed.select("chunk_id", "line_no").distinct()

    def rebuilt(self, chunks: DataFrame, removed: DataFrame) -> DataFrame:
        """chunk_id and content, without any crossed line, of the chunks in ``removed`` only. ``chunks`` has old and new ones."""
        now = self.version()
        places = self.table("places", now).join(removed.select("chunk_id").distinct(), "chunk_id", "left_semi")
        return without_lines(chunks, places.join(small(self.table("crossed", now)), "line", "left_semi").select("chunk_id", "line_no"))


def deltas(chunks: DataFrame, parts: int = 2) -> list[DataFrame]:
    """``chunks`` in ``parts`` by the time of reading: rows without a time go with the first."""
    low, high = chunks.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    if low is None or low == high or parts < 2:
        return [chunks]
    cuts = [low + (high - low) * i / parts for i in range(1, parts)]
    at = F.coalesce(F.col("fetched_at"), F.lit(low))
    edges = [None, *cuts, None]
    return [
        chunks.where((F.lit(True) if a is None else at >= F.lit(a)) & (F.lit(True) if b is None else at < F.lit(b)))
        for a, b in zip(edges, edges[1:])
    ]


def repeated_lines(chunks: DataFrame, threshold: int = THRESHOLD, parts: int = 2) -> DataFrame:
    """(chunk_id, line_no) of every line that stands in at least ``threshold`` documents of its site."""
    state = _fresh(chunks, threshold)
    found = [state.merge(delta) for delta in deltas(chunks, parts)]
    return reduce(DataFrame.unionByName, found).distinct()


def clean_chunks(chunks: DataFrame, threshold: int = THRESHOLD, parts: int = 2) -> DataFrame:
    """chunk_id and content of every chunk with repeated lines, without them: rebuilt after each delta where it changes."""
    state, out, parts_ = _fresh(chunks, threshold), None, deltas(chunks, parts)
    for i, delta in enumerate(parts_):
        removed = state.merge(delta)
        so_far = reduce(DataFrame.unionByName, parts_[: i + 1])
        new = materialize(state.rebuilt(so_far, removed), "rebuilt")
        out = new if out is None else out.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)
    return out


def _fresh(chunks: DataFrame, threshold: int) -> LineCounts:
    return LineCounts(chunks.sparkSession, f"{shared_dir(chunks.sparkSession)}/line-counts-{uuid.uuid4().hex}", threshold)


def without_lines(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """chunk_id and content, without the removed lines, of the chunks that hold any; once for each chunk_id."""
    gone = removed.groupBy("chunk_id").agg(F.collect_set("line_no").alias("_gone"))
    rows = chunks.select("chunk_id", "content").join(gone, "chunk_id").dropDuplicates(["chunk_id"])
    kept = F.filter(F.split("content", "\n"), lambda _, i: ~F.array_contains("_gone", i + 1))
    return rows.select("chunk_id", F.array_join(kept, "\n").alias("content"))
