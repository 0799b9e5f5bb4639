"""Queries that write files and read them again, each against the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import catalog as C
from tesserae.operators import metrics
from tesserae.plans.stage import shared_dir
from tesserae.queries.pages import _NODES, _site
from tesserae.registry import query
from tesserae.sources import files
from tesserae.sources.tables import read


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_ONE = f"with {C._CHUNKS}"


@query(f"""{_ONE} select chunk_id, source, content_type, title, array_to_string(headers_context, ' | ') as headers, len(keywords) as n_keywords, len(entities) as n_entities, md5(content) as content, coalesce(chunk_index, -1) as chunk_index, metadata.image_url as image_url from ch""")
def chunk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "chunks")
    names = [f.split(":")[0].split(" ")[0] for f in ("source", "content_type", "title", "headers_context", "keywords", "entities", "content", "chunk_index", "metadata")]
    files.write_chunks(C.once(spark, sf_dir, *names), path)
    rows = files.read_chunks(spark, path)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return rows.select(
        "chunk_id", "source", "content_type", "title", F.array_join("headers_context", " | ").alias("headers"), size("keywords").alias("n_keywords"), size("entities").alias("n_entities"),
        F.md5("content").alias("content"), F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), F.col("metadata.image_url").alias("image_url"),
    )


@query("select question_id, question, array_to_string(relevant_docs, ' ') as relevant_docs, len(document_content) as n_contents, is_multihop, num_docs from questions")
def judgement_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "judgements")
    files.write_judgements(read(spark, sf_dir, "questions"), path)
    rows = files.read_judgements(spark, path)
    n = F.when(F.col("document_content").isNotNull(), F.size("document_content"))
    return rows.select("question_id", "question", F.array_join("relevant_docs", " ").alias("relevant_docs"), n.alias("n_contents"), "is_multihop", "num_docs")


@query(C.SQL["eval_rrf"])
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "report")
    files.write_report(C.eval_rrf(spark, sf_dir), path, retriever="rrf", top_k="5")
    return files.read_reports(spark, path, metrics.NAMES)


@query(f"with {_NODES} select source as url from nd where n % 5 = 4")
def failed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "failed")
    files.write_failed(_site(spark, sf_dir).where("html is null"), path)
    return files.read_failed(spark, path)


@query("select v.vec_id, v.vec_id % 3 <> 0 as cached, case when v.vec_id % 3 <> 0 then round(list_sum(list_transform(v.embedding::double[], lambda x: x)), 6) end as total from embeddings v")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the vectors are cached, beside one that stands for nothing any more."""
    path = _place(spark, "vectors")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    stale = rows.where("vec_id % 3 = 1").select((-F.col("vec_id") - 1).alias("vec_id"), "embedding")
    files.write_vectors(rows.where("vec_id % 3 <> 0").unionByName(stale), path, "vec_id")
    found = files.cached_vectors(spark, rows.select("vec_id"), path, "vec_id")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return found.select("vec_id", F.col("embedding").isNotNull().alias("cached"), total.alias("total"))


_WHOLE = "from feedbacks where given_at is not null and message_index is not null and question is not null and answer is not null and rating between 1 and 3"


@query(f"select id, given_at, message_index, md5(question) as question, md5(answer) as answer, rating {_WHOLE}")
def feedback_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of feedback is made, filled in two steps, and read."""
    table = f"feedbacks_{uuid.uuid4().hex[:8]}"
    files.feedback_table(spark, table, _place(spark, "feedback"))
    files.feedback_table(spark, table, "ignored")  # it is there already
    rows = read(spark, sf_dir, "feedbacks")
    for part in (rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")):
        files.insert_feedback(part, table)
    return spark.table(table).select("id", "given_at", "message_index", F.md5("question").alias("question"), F.md5("answer").alias("answer"), "rating")


@query("select id, given_at, message_index, md5(question) as question, md5(answer) as answer, rating from feedbacks")
def feedback_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "csv")
    files.export_csv(read(spark, sf_dir, "feedbacks").select(*[c.split()[0] for c in files.FEEDBACK.split(", ")]), path)
    rows = files.import_csv(spark, path, files.FEEDBACK)
    return rows.select("id", "given_at", "message_index", F.md5("question").alias("question"), F.md5("answer").alias("answer"), "rating")


def _formats(name: str):
    @query("select event_type, count(*) as n, round(sum(value), 2) as value, max(ts) as last from events group by event_type")
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _place(spark, name)
        rows = read(spark, sf_dir, "events")
        exact = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        rows.write.format(name).options(**exact).save(path)
        back = spark.read.format(name).schema(rows.schema).options(**exact).load(path)
        return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.max("ts").alias("last"))

    return f


for _name in ("orc", "csv", "json"):
    _f = _formats(_name)
    C.QUERIES[f"events_{_name}"], C.SQL[f"events_{_name}"] = _f, C.SQL["f"]
del C.QUERIES["f"], C.SQL["f"]


@query("""select c_custkey, case when c_custkey % 7 = 0 then 'CHANGED' else c_mktsegment end as c_mktsegment, round(case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end, 2) as c_acctbal from customer where c_custkey % 11 <> 0
  union all select -c_custkey, 'NEW', 0.0 from customer where c_custkey % 13 = 0""")
def merged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update, delete and insert by key as one change of a table."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    path = _place(spark, "customers")
    rows.write.parquet(f"{path}/version=1")
    table = spark.read.parquet(f"{path}/version=1")
    old = table.where("c_custkey % 7 = 0 or c_custkey % 11 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"), (F.col("c_custkey") % 11 == 0).alias("gone"))
    new = table.where("c_custkey % 13 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.lit(False).alias("gone"))
    files.upsert(table, old.unionByName(new), "c_custkey", "gone").write.parquet(f"{path}/version=2")
    return spark.read.parquet(f"{path}/version=2")
