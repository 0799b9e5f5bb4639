"""Queries around an answer: context and prompt, history, citations, and what is counted of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae import catalog as C
from tesserae.functions import citations
from tesserae.functions import text as T
from tesserae.operators import fusion, joins
from tesserae.plans.stage import shared_dir
from tesserae.registry import query
from tesserae.sources import files
from tesserae.sources.tables import read
from tesserae.streaming import feedback

# ---- messages of a conversation: each day of feedback is one, a question and its answer are two messages

_MESSAGES = """ms as (select substring(given_at, 1, 10) as conv, row_number() over (partition by substring(given_at, 1, 10) order by given_at, id, i) as turn, id, role, text
  from (select *, unnest(['user', 'assistant']) as role, unnest([question, answer]) as text, unnest([0, 1]) as i from feedbacks))"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "feedbacks").select("id", "given_at", F.substring("given_at", 1, 10).alias("conv"), F.posexplode(F.array("question", "answer")).alias("i", "text"))
    turn = F.row_number().over(Window.partitionBy("conv").orderBy("given_at", "id", "i"))
    return rows.select("conv", turn.alias("turn"), "id", F.when(F.col("i") == 0, "user").otherwise("assistant").alias("role"), "text")


@query(f"with {_MESSAGES} select conv, cast(turn as int) as turn, role, md5(text) as text from ms qualify row_number() over (partition by conv order by turn desc) <= 10")
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten messages of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").desc()))
    return _messages(spark, sf_dir).withColumn("_b", back).where("_b <= 10").select("conv", "turn", "role", F.md5("text").alias("text"))


@query(f"with {_MESSAGES} select id, md5(before) as question, md5(text) as answer from (select *, lag(text) over (partition by conv order by turn) as before from ms) where role = 'assistant'")
def asked_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the message before it."""
    before = F.lag("text").over(Window.partitionBy("conv").orderBy("turn"))
    rows = _messages(spark, sf_dir).withColumn("before", before).where("role = 'assistant'")
    return rows.select("id", F.md5("before").alias("question"), F.md5("text").alias("answer"))


# ---- prompts

_PROMPT = f"""{C._LISTS}, {C._CHUNKS}, {C._DOCS}, {C._RRF}, cx as (select qid, source, min(rank) as first, list('CONTENUTO ' || no || ': ' || content order by no) as contents
    from (select *, row_number() over (partition by qid, source order by rank, id) as no from (select top.qid, top.id, top.rank, ch.source,
      '[Context: ' || coalesce(array_to_string(headers_context, ' → '), '') || ']' || chr(10) || substring(dt.text, 1, 500) || '...' as content from top join ch on top.id = ch.chunk_id join dt on dt.id = top.id)) group by qid, source),
cs as (select qid, string_agg('FONTE ' || coalesce(substring(md5(source), 1, 12), '') || ': ' || coalesce(source, '') || chr(10) || array_to_string(contents, chr(10)), chr(10) || chr(10) order by first) as context from cx group by qid)"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, context: the best items of each question by source, numbered in each, in the order they come first."""
    best = fusion.rrf(C.ranked_lists(spark, sf_dir)).select("qid", "id", "rank")
    extra = C.once(spark, sf_dir, "source", "headers_context").withColumnRenamed("chunk_id", "id")
    rows = best.join(C.chunk_docs(spark, sf_dir), "id").join(extra, "id").select("qid", "source", "rank", "id", T.preview(F.col("headers_context"), F.col("text")).alias("content"))
    return rows.transform(T.grouped_context)


@query(f"with {_PROMPT} select qid, 'CONTESTO:' || chr(10) || context || chr(10) || chr(10) || 'DOMANDA: ' || coalesce(question, '') as prompt from cs join questions on qid = question_id")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's message of the prompt: context by source, then the question."""
    rows = _contexts(spark, sf_dir).join(C.question_texts(spark, sf_dir), "qid")
    return rows.select("qid", T.user_prompt(F.col("context"), F.col("text")).alias("prompt"))


@query(f"""with {_PROMPT}, {_MESSAGES}, hs as (select list({{'role': case when role = 'user' then 'user' else 'system' end, 'content': text}} order by conv, turn) as h from (select * from ms where conv = (select max(conv) from ms) qualify row_number() over (order by turn desc) <= 10)),
  p as (select qid, [{{'role': 'system', 'content': 'Rispondi in italiano.'}}] || h || [{{'role': 'user', 'content': 'CONTESTO:' || chr(10) || context || chr(10) || chr(10) || 'DOMANDA: ' || coalesce(question, '')}}] as m from cs join questions on qid = question_id, hs)
  select qid, cast(unnest(range(0, len(m))) as int) as no, unnest(m).role as role, md5(unnest(m).content) as content from p""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of a prompt: rules, the last ten messages of the latest conversation (answers come as the system's), the question."""
    rows = _messages(spark, sf_dir)
    latest = rows.agg(F.max("conv").alias("conv"))
    back = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").desc()))
    last = rows.join(F.broadcast(latest), "conv").withColumn("_b", back).where("_b <= 10")  # one row
    role = F.when(F.col("role") == "user", "user").otherwise("system")
    told = last.agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content")))).alias("h"))  # ten messages
    told = told.select(F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("h"))
    own = _contexts(spark, sf_dir).join(C.question_texts(spark, sf_dir), "qid").select("qid", T.user_prompt(F.col("context"), F.col("text")).alias("p"))
    message = lambda r, c: F.array(F.struct(F.lit(r).alias("role"), c.alias("content")))
    all_ = F.concat(message("system", F.lit("Rispondi in italiano.")), F.col("h"), message("user", F.col("p")))
    out = own.join(F.broadcast(told), how="cross").select("qid", F.posexplode(all_).alias("no", "m"))  # one row
    return out.select("qid", "no", F.col("m.role").alias("role"), F.md5("m.content").alias("content"))


@query(f"""with {C._CHUNKS}, {C._DOCS}, s as (select chunk_id, content_type, md5(chunk_id || '-17') as draw from ch order by draw, chunk_id limit 550)
  select chunk_id, md5(substring(text, 1, 2000)) as single, md5(substring(text, 1, 1000)) as multi from s join dt on dt.id = chunk_id where content_type is distinct from 'image_ocr' and content_type is distinct from 'image'""")
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 550 chunks (a sampling operator), without images only afterwards, cut to the lengths that prompts allow."""
    drawn = C.once(spark, sf_dir, "content_type").withColumn("draw", F.md5(F.concat("chunk_id", F.lit("-17")))).orderBy("draw", "chunk_id").limit(550)
    kept = drawn.where(~F.coalesce(F.col("content_type").isin("image_ocr", "image"), F.lit(False)))
    rows = kept.join(C.chunk_docs(spark, sf_dir).withColumnRenamed("id", "chunk_id"), "chunk_id")
    return rows.select("chunk_id", F.md5(F.substring("text", 1, 2000)).alias("single"), F.md5(F.substring("text", 1, 1000)).alias("multi"))


# ---- citations


_LINKED = r"""cl as (select id, answer, regexp_extract_all(answer, '\[(\d+)\]\s*https?://\S+', 1) as ns, regexp_extract_all(answer, '\[\d+\]\s*(https?://\S+)', 1) as us, regexp_extract_all(answer, '\[''?(\d+)''?\]', 0) as marks,
  string_split_regex(answer, '\[''?\d+''?\]') as parts from feedbacks where answer is not null)"""


@query(rf"""with {_LINKED} select id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(case when list_position(ns, regexp_replace(marks[i], '\D', '', 'g')) > 0 then '[[' || regexp_replace(marks[i], '\D', '', 'g') || ']](' || us[list_position(ns, regexp_replace(marks[i], '\D', '', 'g'))] || ')' end, marks[i], '')), '') as linked,
  len(marks) as n_citations from cl""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in answers as links to the addresses that the answer gives for them; other numbers stay."""
    rows = read(spark, sf_dir, "feedbacks").where("answer is not null")
    linked = citations.link_numbers(F.col("answer"), citations.source_map(F.col("answer")))
    return rows.select("id", linked.alias("linked"), F.size(F.regexp_extract_all("answer", F.lit(citations.NUMBER), F.lit(0))).alias("n_citations"))


@query(f"""with {_PROMPT}, k as (select qid, string_agg(' [' || substring(md5(source), 1, 12) || ']', '' order by first) as cites, string_agg('[' || substring(md5(source), 1, 12) || '] ' || source, chr(10) order by substring(md5(source), 1, 12)) as refs from cx where source is not null group by qid)
  select qid, 'Vedi' || cites || ' e [0123456789ab].' || chr(10) || chr(10) || refs as answer from k""")
def answer_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that cites all its sources and one that isn't known, with its list of references."""
    best = fusion.rrf(C.ranked_lists(spark, sf_dir)).select("qid", F.col("id").alias("chunk_id"), "rank")
    rows = best.join(C.once(spark, sf_dir, "source", "content").where("source is not null and content is not null"), "chunk_id").groupBy("qid", "source").agg(F.min("rank").alias("first"))
    own = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("first", T.source_id(F.col("source")).alias("i"), "source"))).alias("s"))
    text = F.concat(F.lit("Vedi"), F.array_join(F.transform("s", lambda x: F.concat(F.lit(" ["), x["i"], F.lit("]"))), ""), F.lit(" e [0123456789ab].  "))
    known = F.map_from_entries(F.transform("s", lambda x: F.struct(x["i"], x["source"])))
    return own.select("qid", citations.with_references(text, known).alias("answer"))


# ---- counts and functions


@query("select rating, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as percent, round((select avg(rating) from feedbacks), 6) as mean from feedbacks group by rating")
def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "feedbacks").groupBy("rating").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # a row for each rating
    mean = F.sum(F.col("rating") * F.col("n")).over(everything) / F.sum(F.when(F.col("rating").isNotNull(), F.col("n"))).over(everything)
    return rows.select("rating", "n", F.round(100 * F.col("n") / F.sum("n").over(everything), 6).alias("percent"), F.round(mean, 6).alias("mean"))


@query(f"select count(*) as n_docs, cast(sum(len({C._TOKENS.format('text')})) as bigint) as total_tokens from documents where text is not null")
def token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null")
    return rows.agg(F.count("*").alias("n_docs"), F.sum(F.size(T.tokens(F.col("text")))).alias("total_tokens"))


@query("select doc_id, strftime(revised_at, '%Y-%m-%d') as day, strftime(revised_at, '%Y-%m-%dT%H:%M:%SZ') as utc, strftime(revised_at, '%d/%m/%Y %H:%M') as local from documents")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("revised_at")
    forms = {"day": "yyyy-MM-dd", "utc": "yyyy-MM-dd'T'HH:mm:ss'Z'", "local": "dd/MM/yyyy HH:mm"}
    return read(spark, sf_dir, "documents").select("doc_id", *[F.date_format(at, f).alias(n) for n, f in forms.items()])


@query("select event_id, cast(json_extract(props, '$.k') as int) as k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as told from events")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), told.alias("told"))


@query(f"""with {C._CHUNKS}, h as (select chunk_id, source, chunk_index, case when len(headers_context) > 0 then array_to_string(headers_context, ' | ') end as h from ch where source is not null and chunk_index is not null)
  select chunk_id, last_value(h ignore nulls) over (partition by source order by chunk_index, chunk_id rows unbounded preceding) as headers from h""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers in force at each chunk of a source: its own, or the last ones before it."""
    rows = C.once(spark, sf_dir, "source", "chunk_index", "headers_context").where("source is not null and chunk_index is not null")
    rows = rows.select("source", F.struct("chunk_index", "chunk_id").alias("at"), "chunk_id", F.when(F.size("headers_context") > 0, F.array_join("headers_context", " | ")).alias("h"))
    found = joins.asof(rows.select("source", "at", "chunk_id"), rows.where("h is not null").select("source", "at", "h"), "at", ["source"])
    return found.select("chunk_id", F.col("value.h").alias("headers"))


@query("select question_id, cast((row_number() over (order by question_id) - 1) // 32 as bigint) as batch from questions")
def question_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of 32 each question belongs to."""
    rows = C.numbered(read(spark, sf_dir, "questions").select("question_id"), ["question_id"], "n")
    return rows.select("question_id", F.floor(F.col("n") / 32).alias("batch"))


@query("select len(relevant_docs) > 1 as multihop, count(*) as n, cast(sum(len(case when len(relevant_docs) > 1 then document_content else document_content[:1] end)) as bigint) as contents from questions where relevant_docs is not null group by 1")
def judgements_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with one relevant document (its content a text) and with several, read from two files and put together."""
    rows, path = read(spark, sf_dir, "questions"), f"{shared_dir(spark)}/judgements-{uuid.uuid4().hex}"
    one = rows.where("size(relevant_docs) <= 1").select("question_id", "question", "relevant_docs", F.get("document_content", F.lit(0)).alias("document_content"))
    files.write_judgements(one, f"{path}/one")
    files.write_judgements(rows.where("size(relevant_docs) > 1"), f"{path}/many")
    both = files.read_judgements(spark, f"{path}/one").unionByName(files.read_judgements(spark, f"{path}/many"), allowMissingColumns=True)
    return both.groupBy((F.size("relevant_docs") > 1).alias("multihop")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("document_content").isNotNull(), F.size("document_content"))).alias("contents"))


@query("""with r as (select cast(substring(given_at, 1, 10) as timestamp) as day, rating, cast(given_at as timestamp) as t from feedbacks)
  select day, rating, count(*) as n from r where day + interval 1 day <= (select max(t) - interval 2 day from r) group by 1, 2""")
def rating_stream_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that the watermark has closed, appended to a table of files."""
    import os

    path = f"{sf_dir}/feedbacks.parquet"
    stream = feedback.rating_stream(spark, path if os.path.isdir(path) else f"{sf_dir}/feedbacks*.parquet", read(spark, sf_dir, "feedbacks").schema)
    return feedback.append_closed(stream, "ratings")


@query("select id, given_at, rating from feedbacks")
def feedback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback arriving as a stream of files, each row appended once."""
    import os

    path = f"{sf_dir}/feedbacks.parquet"
    folder = path if os.path.isdir(path) else f"{sf_dir}/feedbacks*.parquet"
    rows = spark.readStream.schema(read(spark, sf_dir, "feedbacks").schema).parquet(folder)
    return feedback.append_feedback(rows, f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}").select("id", "given_at", "rating")
