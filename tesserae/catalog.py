"""The registered queries of the retrieval engine and the SQL each one is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import bm25, chunking, crawl, dense, fusion, metrics, rewrite
from tesserae.plans.stage import materialize, prefix_sum
from tesserae.registry import QUERIES, SQL, query  # noqa: F401
from tesserae.sources.tables import chunks, read
from tesserae.streaming import feedback


# Parts of the SQL: one row for each chunk, tokens, judgements and ranked lists.
_CHUNKS = "ch as (select distinct on (chunk_id) * from chunks_memory where chunk_id is not null order by chunk_id, fetched_at)"
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_CUT = "|".join(c.replace("'", "''") for c in T.CONTRACTIONS)
_TERMS = (
    r"list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s'']', '', 'g'), '(^|[^\p{{L}}\p{{N}}_])(?:" + _CUT + r")([\p{{L}}\p{{N}}_])', '\1\2', 'g')), "
    r"'[\p{{L}}\p{{N}}_]+(?:''[\p{{L}}\p{{N}}_]+)*'), lambda w: length(w) >= 2 and w not in (" + _STOP + "))"
)
_FEEDBACK = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 and w not in (" + _STOP + "))"
_DOCUMENT = "coalesce(array_to_string(headers_context, ' | '), '') || chr(10) || chr(10) || coalesce(title, '') || chr(10) || coalesce(content, '')"
_LISTS = "rl as (select distinct question_id as qid, id, retriever, score, rank_no as rank from retrieval_results)"
_TRUTH = "truth as (select distinct question_id as qid, unnest(relevant_docs) as id from questions)"
_DOCS = f"dt as (select chunk_id as id, {_DOCUMENT} as text from ch where content is not null)"
_POST = f"""{_DOCS}, docs as (select id, {_TERMS.format('text')} as t from dt),
post as (select id, term, count(*) as tf, any_value(dl) as dl from (select id, len(t) as dl, unnest(t) as term from docs) group by id, term),
sz as (select count(*) as n, avg(len(t)) as avgdl from docs),
st as (select term, count(*) as df, cast(sum(tf) as bigint) as cf from post group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from st, sz),
idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw)"""


def bm25_sql(asked: str, k: int = 5, q: str = "q", sc: str = "sc", top: str = "top") -> str:
    """CTEs that rank the chunks for ``asked``, a select of qid and text."""
    return f"""{q} as (select qid, term, count(*) as qtf from (select qid, unnest({_TERMS.format('text')}) as term from ({asked})) group by qid, term),
  {sc} as (select qid, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
    from {q} join post using (term) join idf using (term), sz group by qid, id),
  {top} as (select *, row_number() over (partition by qid order by score desc, id) as rank from {sc} qualify rank <= {k})"""


_QUESTIONS = "select question_id as qid, question as text from questions"
_BM25 = f"{_CHUNKS}, {_POST}, {bm25_sql(_QUESTIONS)}"


def _metrics_sql(queries: str) -> str:
    return f"""
nrel as (select qid, count(*) as n_rel from truth group by qid),
h as (select qid, rank, row_number() over (partition by qid order by rank) as seen from top semi join truth using (qid, id)),
g as (select qid, count(*) as hits, min(rank) as first, sum(seen / rank) as prec, sum(1 / log2(rank + 1.0)) as dcg, sum(1 / log2(seen + 1.0)) as idcg from h group by qid),
pq as (select qid, round(coalesce(hits / 5, 0.0), 6) as precision_at_k, round(coalesce(hits / n_rel, 0.0), 6) as recall_at_k, round(coalesce(1 / first, 0.0), 6) as mrr,
  round(coalesce(dcg / idcg, 0.0), 6) as ndcg_at_k, round(coalesce(prec / least(n_rel, 5), 0.0), 6) as ap_at_k
  from (select distinct qid from ({queries})) left join nrel using (qid) left join g using (qid))"""


_SUMMARY = "select count(*) as num_queries, " + ", ".join(f"round(coalesce(avg({c}), 0.0), 5) as avg_{c}" for c in metrics.NAMES) + " from pq"


def once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row for each chunk: rows read twice are equal in all but the time."""
    return chunks(spark, sf_dir).select("chunk_id", *columns).dropDuplicates(["chunk_id"])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with a running number from 0 in the order of ``order``, without gathering them."""
    one = materialize(rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_all", F.lit(0)), "rows")
    return prefix_sum(one, ["_all"], order, ["_one"]).withColumn(name, F.col("cum__one") - 1).drop("cum__one", "_one", "_all")


def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and text of every chunk as it is indexed: headers, title and content."""
    rows = once(spark, sf_dir, "headers_context", "title", "content").where("content is not null")
    return rows.select(F.col("chunk_id").alias("id"), T.document_text(F.col("headers_context"), F.col("title"), F.col("content")).alias("text"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(bm25.index(chunk_docs(spark, sf_dir)), "index")


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "questions").select(F.col("question_id").alias("qid"), F.col("question").alias("text"))


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "questions").select(F.col("question_id").alias("qid"), F.explode("relevant_docs").alias("id"))


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "retrieval_results")
    return rows.select(F.col("question_id").alias("qid"), "id", "retriever", "score", F.col("rank_no").alias("rank")).distinct()


# ---- text and corpus statistics


@query(f"""with {_CHUNKS}, {_DOCS} select count(*) as n_chunks, min(w) as min_words, max(w) as max_words, round(avg(w), 6) as avg_words
  from (select len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w from dt)""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = chunk_docs(spark, sf_dir).select(words.alias("w"))
    return rows.agg(F.count("*").alias("n_chunks"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.round(F.avg("w"), 6).alias("avg_words"))


@query(f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, md5(array_to_string(t, ' ')) as key from (select doc_id, {_TOKENS.format('text')} as t from documents where text is not null)")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("key"))


@query(f"select question_id, array_to_string({_TERMS.format('question')}, ' ') as words from questions")
def italian_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "questions").select("question_id", F.array_join(T.italian_tokens(F.col("question")), " ").alias("words"))


@query(f"with {_CHUNKS}, {_POST} select term, df, cf from st")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_stats(chunk_index(spark, sf_dir))


@query(f"with {_CHUNKS}, {_POST} select term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.idf(chunk_index(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""with {_CHUNKS}, b as (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as gram from (select {_TOKENS.format('content')} as t from ch where content is not null))
  select gram, count(*) as n from b group by gram""")
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "content").where("content is not null").select(T.tokens(F.col("content")).alias("t"))
    pairs = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return rows.select(F.explode(pairs).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"with {_CHUNKS} select content_type, count(*) as n, cast(sum(length(content)) as bigint) as chars, count(distinct source) as pages from ch group by content_type")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "content_type", "content", "source")
    return rows.groupBy("content_type").agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars"), F.count_distinct("source").alias("pages"))


@query(f"with {_CHUNKS} select keyword, count(*) as n from (select unnest(keywords) as keyword from ch) group by keyword")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "keywords").select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query(f"with {_CHUNKS}, e as (select chunk_id, unnest(entities) as e from ch) select e[1] as entity, e[2] as label, count(distinct chunk_id) as n from e group by 1, 2")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "entities").select("chunk_id", F.explode("entities").alias("e"))
    return rows.groupBy(F.get("e", F.lit(0)).alias("entity"), F.get("e", F.lit(1)).alias("label")).agg(F.count_distinct("chunk_id").alias("n"))


# ---- retrieval


@query(f"with {_BM25} select qid, id, score, cast(rank as int) as rank from top")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.topk(chunk_docs(spark, sf_dir), question_texts(spark, sf_dir))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dense.topk(rows, rows.where("id % 50 = 0"))


_DENSE = """
pairs as (select q.vec_id as qid, d.vec_id as id, round(list_inner_product(q.embedding::double[], d.embedding::double[]), 9) as score
  from embeddings q, embeddings d where q.vec_id % 50 = 0 and q.vec_id <> d.vec_id and q.embedding is not null and d.embedding is not null),
top as (select *, row_number() over (partition by qid order by score desc, id) as rank from pairs qualify rank <= 5)"""


@query(f"with {_DENSE} select qid, id, round(score, 6) as score, cast(rank as int) as rank from top")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""with {_DENSE}, truth as (select q.vec_id as qid, d.vec_id as id from embeddings q join embeddings d on q.label = d.label and q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
  {_metrics_sql("select vec_id as qid from embeddings where vec_id % 50 = 0")} {_SUMMARY}""")
def eval_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    truth = asked.join(rows.select(F.col("vec_id").alias("id"), "label"), "label").where("qid <> id").select("qid", "id")
    return metrics.summary(metrics.per_query(asked, _neighbours(spark, sf_dir), truth))


# ---- fusion and re-ranking of the retrieved lists


@query(f"""with {_LISTS}, w as (select *, min(score) over p as lo, max(score) over p as hi from rl window p as (partition by qid, retriever))
  select qid, id, retriever, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as norm from w""")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.minmax(ranked_lists(spark, sf_dir)).select("qid", "id", "retriever", F.round("norm", 6).alias("norm"))


def _fused_sql(expr: str, name: str, where: str = "true", k: int = 5) -> str:
    return f"sc as (select qid, id, {expr} as {name} from rl where {where} group by qid, id), top as (select *, row_number() over (partition by qid order by {name} desc, id) as rank from sc qualify rank <= {k})"


_RRF = _fused_sql("round(sum(1 / (60 + rank)), 9)", "rrf")


@query(f"""with {_LISTS}, w as (select *, min(score) over p as lo, max(score) over p as hi from rl window p as (partition by qid, retriever)),
  sc as (select qid, id, round(sum(case retriever when 'dense' then 1.0 else 0.3 end * case when hi = lo then 1.0 else (score - lo) / (hi - lo) end), 6) as hybrid from w where retriever in ('dense', 'sparse') group by qid, id)
  select qid, id, hybrid, cast(row_number() over (partition by qid order by hybrid desc, id) as int) as rank from sc qualify rank <= 5""")
def hybrid_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.blend(ranked_lists(spark, sf_dir))


@query(f"with {_LISTS}, {_RRF} select qid, id, rrf, cast(rank as int) as rank from top")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(ranked_lists(spark, sf_dir))


@query(f"with {_LISTS}, {_fused_sql('round(list_sum(list_transform(range(1, count(*) + 1), lambda i: 1 / (60 + i))), 9)', 'fused')} select qid, id, fused, cast(rank as int) as rank from top")
def hit_count_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.hit_count(ranked_lists(spark, sf_dir))


@query(f"with {_LISTS}, {_fused_sql('round((1 + 0.2 * (count(distinct retriever) - 1)) * avg(score), 6)', 'fused')} select qid, id, fused, cast(rank as int) as rank from top")
def spread_mean_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.spread_mean(ranked_lists(spark, sf_dir))


@query(f"with {_LISTS}, {_fused_sql('round(sum(score), 6)', 'fused')} select qid, id, fused, cast(rank as int) as rank from top")
def score_sum_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.score_sum(ranked_lists(spark, sf_dir))


@query(f"""with {_LISTS}, {_fused_sql('round(sum(1 / (60 + rank)), 9)', 'rrf', "retriever <> 'rerank'", 20)},
  b as (select top.qid, top.id, rrf, score as rerank_score from top left join (select * from rl where retriever = 'rerank') r using (qid, id))
  select qid, id, rrf, rerank_score, cast(row_number() over (partition by qid order by rerank_score desc nulls last, rrf desc, id) as int) as rank from b qualify rank <= 5""")
def rerank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(ranked_lists(spark, sf_dir))


@query(f"with {_LISTS} select distinct qid, id, 'dense' as only_in from rl where retriever = 'dense' and (qid, id) not in (select (qid, id) from rl where retriever = 'sparse') union all select distinct qid, id, 'sparse' from rl where retriever = 'sparse' and (qid, id) not in (select (qid, id) from rl where retriever = 'dense')")
def list_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked_lists(spark, sf_dir)
    return fusion.only_in(rows, "dense", "sparse").withColumn("only_in", F.lit("dense")).unionByName(fusion.only_in(rows, "sparse", "dense").withColumn("only_in", F.lit("sparse")))


# ---- evaluation

_ASKED = "select question_id as qid from questions"


@query(f"with {_LISTS}, {_TRUTH}, {_RRF}, {_metrics_sql(_ASKED)} select * from pq")
def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_query(question_texts(spark, sf_dir), fusion.rrf(ranked_lists(spark, sf_dir)), relevant(spark, sf_dir))


@query(f"with {_BM25}, {_TRUTH}, {_metrics_sql(_ASKED)} {_SUMMARY}")
def eval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = question_texts(spark, sf_dir)
    return metrics.summary(metrics.per_query(asked, bm25.topk(chunk_docs(spark, sf_dir), asked), relevant(spark, sf_dir)))


@query(f"""with {_LISTS}, {_TRUTH}, {_RRF.replace('sc as', 'sc as', 1)}, {_metrics_sql(_ASKED)} {_SUMMARY}""")
def eval_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(eval_per_query(spark, sf_dir))


# ---- query rewriting


_PRF = f"""have as (select distinct question_id as qid, unnest({_FEEDBACK.format('question')}) as term from questions),
  w as (select qid, term, count(*) as n from (select top.qid, unnest({_FEEDBACK.format('dt.text')}) as term from top join dt using (id)) anti join have using (qid, term) group by 1, 2),
  prf as (select qid, term, n, cast(row_number() over (partition by qid order by n desc, term) as int) as rank from w qualify rank <= 3)"""


@query(f"with {_BM25}, {_PRF} select * from prf")
def prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = chunk_docs(spark, sf_dir), question_texts(spark, sf_dir)
    return rewrite.feedback_terms(asked, bm25.topk(docs, asked), docs)


_KEYWORDS = f"""{_CHUNKS}, {_POST}, kw as (select qid, term, idf, row_number() over (partition by qid order by round(idf, 9) desc, term) as rank
  from (select distinct question_id as qid, unnest({_TERMS.format('question')}) as term from questions) join idf using (term) where length(term) >= 3 qualify rank <= 3)"""


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.keywords(question_texts(spark, sf_dir), bm25.idf(chunk_index(spark, sf_dir)))


@query(f"with {_KEYWORDS} select qid, string_agg(term, ' ' order by rank) as rewrite from kw group by qid")
def keyword_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.joined(_keywords(spark, sf_dir))


@query(f"with {_KEYWORDS} select a.qid, a.term || ' ' || b.term as pair from kw a join kw b on a.qid = b.qid and a.rank < b.rank")
def keyword_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keywords(spark, sf_dir)
    a, b = k.select("qid", F.col("term").alias("x"), F.col("rank").alias("m")), k.select("qid", F.col("term").alias("y"), F.col("rank").alias("n"))
    return a.join(b, "qid").where("m < n").select("qid", F.concat_ws(" ", "x", "y").alias("pair"))


@query("""with r as (select question_id as qid, list_filter(list_transform([question, lower(question), regexp_replace(question, '[?!.]+\\s*$', '')] || regexp_split_to_array(regexp_replace(question, '[?!.]+\\s*$', ''), ' (e|o) '), lambda x: trim(x, ' ')), lambda x: x <> '') as l from questions where question is not null),
  e as (select qid, unnest(l) as rewrite, generate_subscripts(l, 1) as i from r)
  select qid, rewrite, cast(row_number() over (partition by qid order by min(i)) - 1 as int) as rewrite_no from e group by qid, rewrite""")
def rewrite_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, bare = F.col("question"), F.regexp_replace("question", r"[?!.]+\s*$", "")
    forms = F.concat(F.array(q, F.lower(q), bare), F.split(bare, " (e|o) "))
    rows = read(spark, sf_dir, "questions").where("question is not null").select(F.col("question_id").alias("qid"), F.array_distinct(F.filter(F.transform(forms, lambda x: F.trim(x)), lambda x: x != "")).alias("r"))
    return rows.select("qid", F.posexplode("r").alias("rewrite_no", "rewrite"))


@query("select question_id, md5(regexp_replace(trim(lower(question), ' '), '\\s+', ' ', 'g')) as key from questions")
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "questions").select("question_id", T.query_key(F.col("question")).alias("key"))


@query("select num_docs, coalesce(is_multihop, len(relevant_docs) > 1) as multihop, count(*) as n, round(avg(len(relevant_docs)), 6) as avg_relevant from questions group by 1, 2")
def combined_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "questions")
    hop = F.coalesce("is_multihop", F.size("relevant_docs") > 1)
    parts = [rows.where(hop == flag).withColumn("multihop", F.lit(flag)) for flag in (False, True)]
    return parts[0].unionByName(parts[1]).groupBy("num_docs", "multihop").agg(F.count("*").alias("n"), F.round(F.avg(F.size("relevant_docs")), 6).alias("avg_relevant"))


# ---- chunks and documents


@query(f"""with {_CHUNKS} select chunk_id, md5(coalesce(array_to_string(headers_context, ' | '), '') || chr(10) || chr(10) || coalesce(title, '') || chr(10) || coalesce(content, '')) as document_key,
  '[Context: ' || coalesce(array_to_string(headers_context, ' → '), '') || ']' || chr(10) || substring(content, 1, 500) || '...' as preview from ch""")
def format_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "headers_context", "title", "content")
    text = T.document_text(F.col("headers_context"), F.col("title"), F.col("content"))
    return rows.select("chunk_id", F.md5(text).alias("document_key"), T.preview(F.col("headers_context"), F.col("content")).alias("preview"))


@query(f"with {_CHUNKS} select chunk_id, sha256(source || '-' || cast(chunk_index as varchar)) as hash from ch where source is not null and chunk_index is not null")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "source", "chunk_index").where("source is not null and chunk_index is not null")
    return rows.select("chunk_id", T.chunk_hash(F.col("source"), F.col("chunk_index")).alias("hash"))


@query(f"""with {_CHUNKS}, c as (select chunk_id, length(trim('[' || coalesce(array_to_string(headers_context, ' | '), '') || '] ' || content, ' ')) as n from ch where content is not null)
  select chunk_id, n from c where n < 64""")
def short_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "headers_context", "content").where("content is not null")
    n = F.char_length(F.trim(F.concat(F.lit("["), F.coalesce(F.array_join("headers_context", " | "), F.lit("")), F.lit("] "), F.col("content"))))
    return rows.select("chunk_id", n.alias("n")).where("n < 64")


@query(f"with {_CHUNKS}, h as (select source, chunk_index, chunk_id, array_to_string(headers_context, ' | ') as h from ch where source is not null and chunk_index is not null), p as (select *, lag(h) over (partition by source order by chunk_index, chunk_id) as before from h) select chunk_id, h from p where h is distinct from before")
def header_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "source", "chunk_index", "headers_context").where("source is not null and chunk_index is not null")
    rows = rows.select("chunk_id", "source", "chunk_index", F.array_join("headers_context", " | ").alias("h"))
    before = F.lag("h").over(Window.partitionBy("source").orderBy("chunk_index", "chunk_id"))
    return rows.withColumn("before", before).where(~F.col("h").eqNullSafe(F.col("before"))).select("chunk_id", "h")


@query()
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pack_sentences(read(spark, sf_dir, "documents"))


@query("select doc_id, i // 512 as piece_no, substring(text, cast(i as bigint) + 1, 512) as piece from (select doc_id, text, unnest(range(0, length(text), 512)) as i from documents where length(text) > 512)")
def fixed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where(F.char_length("text") > 512)
    rows = rows.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(512))).alias("i"))
    return rows.select("doc_id", F.floor(F.col("i") / 512).alias("piece_no"), F.substring(F.col("text"), F.col("i") + 1, F.lit(512)).alias("piece"))


@query(f"select min(doc_id) as first_id, count(*) as n from (select doc_id, md5(array_to_string({_TOKENS.format('text')}, ' ')) as key from documents where text is not null) group by key having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("key"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("key")


@query(f"with {_CHUNKS} select chunk_id, md5(chunk_id || '-17') as draw from ch order by draw, chunk_id limit 100")
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir).select("chunk_id", F.md5(F.concat("chunk_id", F.lit("-17"))).alias("draw")).orderBy("draw", "chunk_id").limit(100)


@query(f"""with {_CHUNKS}, r as (select question_id, unnest(relevant_docs) as chunk_id, generate_subscripts(relevant_docs, 1) - 1 as pos from questions)
  select question_id, cast(pos as int) as pos, chunk_id, coalesce(title, '') || chr(10) || substring(coalesce(content, ''), 1, 500) || '...' as preview from r join ch using (chunk_id)""")
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "questions").select("question_id", F.posexplode("relevant_docs").alias("pos", "chunk_id"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, 500), F.lit("..."))
    return asked.join(once(spark, sf_dir, "title", "content"), "chunk_id").select("question_id", "pos", "chunk_id", text.alias("preview"))


# ---- pages and sitemap


@query("select loc, cast(lastmod as varchar) as lastmod, changefreq, priority, regexp_replace(loc, '[?#].*$', '') as url, loc like '%/wiki/index.php/%' and not regexp_matches(regexp_replace(loc, '^.*/wiki/index\\.php/', ''), '[:?]') as is_page from (select * from sitemap where loc is not null qualify row_number() over (partition by loc order by lastmod desc nulls last, priority desc nulls last, changefreq) = 1)")
def sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.latest(read(spark, sf_dir, "sitemap"))
    page = F.col("loc").contains("/wiki/index.php/") & ~F.regexp_replace("loc", r"^.*/wiki/index\.php/", "").rlike("[:?]")
    return rows.select("loc", F.col("lastmod").cast("string").alias("lastmod"), "changefreq", "priority", T.normal_url(F.col("loc")).alias("url"), page.alias("is_page"))


@query("select coalesce(s.loc, c.source) as url, s.loc is not null as in_sitemap, c.source is not null as has_chunks, coalesce(c.n, 0) as n from (select distinct loc from sitemap where loc is not null) s full join (select source, count(distinct chunk_id) as n from chunks_memory where source is not null group by source) c on s.loc = c.source")
def sitemap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "sitemap").where("loc is not null").select("loc").distinct()
    have = chunks(spark, sf_dir).where("source is not null").groupBy("source").agg(F.count_distinct("chunk_id").alias("n"))
    rows = pages.join(have, pages["loc"] == have["source"], "full_outer")
    return rows.select(F.coalesce("loc", "source").alias("url"), F.col("loc").isNotNull().alias("in_sitemap"), F.col("source").isNotNull().alias("has_chunks"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- context, prompts and citations

_CONTEXT = f"""{_LISTS}, {_CHUNKS}, {_RRF}, cx as (select qid, source, min(rank) as first, list(content order by rank, id) as contents from (select top.qid, top.id, top.rank, ch.source, ch.content from top join ch on top.id = ch.chunk_id where ch.content is not null) group by qid, source)"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = fusion.rrf(ranked_lists(spark, sf_dir)).select("qid", F.col("id").alias("chunk_id"), "rank")
    rows = best.join(once(spark, sf_dir, "source", "content").where("content is not null"), "chunk_id")
    grouped = rows.groupBy("qid", "source").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "content"))).alias("c"))
    return grouped.select("qid", "source", "first", F.col("c.content").alias("contents"))


@query(f"with {_CONTEXT} select qid, source, cast(first as int) as first, len(contents) as n, md5(array_to_string(contents, chr(10))) as key, substring(md5(source), 1, 12) as source_id from cx")
def context_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.array_join("contents", "\n"))
    return _context(spark, sf_dir).select("qid", "source", "first", F.size("contents").alias("n"), key.alias("key"), T.source_id(F.col("source")).alias("source_id"))


# ---- feedback and history


@query("select substring(given_at, 1, 10) as day, count(*) as n, round(avg(rating), 6) as mean_rating, count(distinct question) as questions from feedbacks group by 1")
def feedback_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "feedbacks").groupBy(F.substring("given_at", 1, 10).alias("day"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.count_distinct("question").alias("questions"))


@query("select question, id, given_at, rating from feedbacks where question is not null qualify row_number() over (partition by question order by given_at desc, id desc) <= 10")
def history_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("question").orderBy(F.col("given_at").desc(), F.col("id").desc()))
    rows = read(spark, sf_dir, "feedbacks").where("question is not null").select("question", "id", "given_at", "rating")
    return rows.withColumn("_back", back).where("_back <= 10").drop("_back")


@query("select id, question, cast(rating - lag(rating) over (partition by question order by given_at, id) as double) as change from feedbacks where question is not null")
def rating_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("rating").over(Window.partitionBy("question").orderBy("given_at", "id"))
    return read(spark, sf_dir, "feedbacks").where("question is not null").select("id", "question", (F.col("rating") - before).cast("double").alias("change"))


@query("select cast(substring(given_at, 1, 10) as timestamp) as day, rating, count(*) as n from feedbacks group by 1, 2")
def rating_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "feedbacks").schema
    import os

    path = f"{sf_dir}/feedbacks.parquet"
    folder = path if os.path.isdir(path) else f"{sf_dir}/feedbacks*.parquet"
    return feedback.run_once(feedback.rating_stream(spark, folder, schema), "ratings")


# ---- further relational coverage


@query("select user_id, cast(date_trunc('day', ts) as timestamp) as day, count(*) as n, count(distinct event_type) as kinds, round(sum(value), 2) as value from events group by 1, 2")
def events_by_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.round(F.sum("value"), 2).alias("value"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select r_name, n_name, round(sum(o_totalprice), 2) as total, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
