"""Readers and writers of the files around the tables: chunks, judgements, reports, feedback, cached vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = (
    "chunk_id string, source string, content_type string, title string, headers_context array<string>, keywords array<string>, entities array<array<string>>, "
    "content string, chunk_index int, metadata struct<alt_text: string, image_url: string>"
)
JUDGEMENT = "question_id bigint, question string, relevant_docs array<string>, document_content array<string>, is_multihop boolean, num_docs int"
FEEDBACK = "id bigint, given_at string, message_index int, question string, answer string, rating int"


@dataclass(frozen=True)
class Settings:
    """What the engine is told from outside, by the session's settings ``tesserae.<name>``."""

    embedding_model: str = "hashing"
    candidates: int = 50
    top_k: int = 5

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        got = {f: spark.conf.get(f"tesserae.{f}", None) for f in cls.__dataclass_fields__}
        return cls(**{f: type(getattr(cls, f))(v) for f, v in got.items() if v is not None})


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A line of JSON for each chunk, as UTF-8; null fields are written too."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Chunks from lines of JSON, or from files that hold one array each; null elements of an array are left out."""
    if not whole_file:
        return spark.read.schema(CHUNK).json(path).where("coalesce(chunk_id, source, content_type, title, content) is not null")
    shape = spark.createDataFrame([], CHUNK).schema.simpleString()
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<{shape}>")).alias("c"))
    return rows.where("c is not null").select("c.*")


def write_judgements(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_judgements(spark: SparkSession, path: str) -> DataFrame | None:
    """Judged questions; a single ``document_content`` becomes a list of one. None where nothing can be read."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(JUDGEMENT.replace("document_content array<string>", "document_content string")).json(path)
    content = F.when(F.col("document_content").startswith("["), F.from_json("document_content", "array<string>")).otherwise(F.array("document_content"))
    return rows.withColumn("document_content", F.when(F.col("document_content").isNotNull(), content))


def write_report(metrics: DataFrame, path: str, **metadata: str) -> bool:
    """The row of ``metrics`` as {metadata, metrics}; nothing is written where no query was evaluated."""
    kept = metrics.where("num_queries > 0")
    if kept.limit(1).count() == 0:
        return False
    told = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()], F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"))
    kept.select(F.to_json(F.struct(told.alias("metadata"), F.struct("*").alias("metrics"))).alias("value")).write.mode("overwrite").text(path)
    return True


def read_reports(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The metrics of every report of a folder, one row each; reports without metadata have the numbers at the top."""
    fields = "num_queries long, " + ", ".join(f"avg_{n} double" for n in names)
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"metadata map<string, string>, metrics struct<{fields.replace(' long', ': long').replace(' double', ': double')}>, {fields}").alias("r"))
    return text.select(*[F.coalesce(F.col(f"r.metrics.{n}"), F.col(f"r.{n}")).alias(n) for n in ["num_queries", *[f"avg_{n}" for n in names]]])


def write_failed(urls: DataFrame, path: str, url: str = "url") -> None:
    """One address a line, each once, in their order."""
    urls.select(url).where(F.col(url).isNotNull()).distinct().orderBy(url).write.mode("overwrite").text(path)


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("url"))


def write_vectors(vectors: DataFrame, path: str, id_: str = "chunk_id") -> None:
    """Vectors with the key of what they stand for."""
    vectors.select(id_, "embedding").write.mode("overwrite").parquet(path)


def cached_vectors(spark: SparkSession, rows: DataFrame, path: str, id_: str = "chunk_id") -> DataFrame:
    """``rows`` with their cached vector, by key: rows without one have null, vectors of other rows are left out."""
    if not exists(spark, path):
        return rows.withColumn("embedding", F.lit(None).cast("array<double>"))
    return rows.join(spark.read.parquet(path), id_, "left")


def feedback_table(spark: SparkSession, table: str, path: str) -> None:
    """Make the table of feedback where there is none."""
    spark.sql(f"create table if not exists {table} ({FEEDBACK}) using parquet location '{path}'")


def insert_feedback(rows: DataFrame, table: str) -> int:
    """Append complete rows (no null but in ``id``); gives how many were left out."""
    named = rows.select(*[c.split()[0] for c in FEEDBACK.split(", ")])
    whole = named.where("given_at is not null and message_index is not null and question is not null and answer is not null and rating between 1 and 3")
    whole.createOrReplaceTempView(f"_new_{table}")
    rows.sparkSession.sql(f"insert into {table} select * from _new_{table}")
    rows.sparkSession.catalog.dropTempView(f"_new_{table}")
    return named.count() - whole.count()


def export_csv(rows: DataFrame, path: str) -> bool:
    """CSV with a header; line ends and quotes inside fields are kept. False, and no file, where there are no rows."""
    if rows.limit(1).count() == 0:
        return False
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("lineSep", "\n").option("nullValue", "\\N").option("emptyValue", "").csv(path)
    return True


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").option("lineSep", "\n").option("nullValue", "\\N").option("emptyValue", "").csv(path)


def upsert(table: DataFrame, changes: DataFrame, key: str, gone: str | None = None) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their key, new ones added, and without those where ``gone`` is true.

    Tables are files that aren't changed: the result is written as the next version. Keys of ``changes`` are distinct.
    """
    kept = table.join(changes.select(key), key, "left_anti")
    new = changes.where(~F.coalesce(F.col(gone), F.lit(False))).select(*table.columns) if gone else changes.select(*table.columns)
    return kept.select(*table.columns).unionByName(new)
