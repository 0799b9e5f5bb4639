"""The queries pN_... of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import lines, mixing, neardup, pairs, ranking, scans, spans, split, tokens
from tesserae.plans.stage import small
from tesserae.sources.tables import chunks, read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise_rows(chunks(spark, sf_dir))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(chunks(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(chunks(spark, sf_dir))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_chunks(chunks(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.label_pairs(read(spark, sf_dir, "feedbacks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(chunks(spark, sf_dir)).select("chunk_id", "kind")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_items(chunks(spark, sf_dir))
    return pieces.select("chunk_id", "source", "headers_context", "chunk_index", "piece_no", "piece_start", "content")


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.combined_ranking(read(spark, sf_dir, "retrieval_results"), "question_id", "id", ranking.retrieval_lists())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranking(spark, sf_dir).where("rank = 1").select("question_id", "id")


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranking(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(chunks(spark, sf_dir)).select("chunk_id_a", "chunk_id_b")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(chunks(spark, sf_dir))


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_links(chunks(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    back = tokens.decode_corpus(tokens.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", F.char_length("decoded").alias("n_chars"), same.alias("same"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = mixing.materialize(mixing.document_sizes(read(spark, sf_dir, "documents")), "counts")
    targets = read(spark, sf_dir, "mix_targets")
    return sizes, targets, mixing.mix(sizes, targets)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats and first slot, and their source's target and actual share."""
    sizes, targets, mixed = _mixed(spark, sf_dir)
    share = mixing.shares(mixed, mixing.plan(sizes, targets)).select("source", "target_share", "actual_share")
    return mixing.documents(mixed).join(small(mixing.materialize(share, "shares")), "source")


def p8_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document, at its slot."""
    return _mixed(spark, sf_dir)[2]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets, mixed = _mixed(spark, sf_dir)
    return mixing.shares(mixed, mixing.plan(sizes, targets))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(read(spark, sf_dir, "documents"))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_repaired, p2_found, p2_clean, p3_found, p4_found, p4_pieces, p5_found, p5_ranking, p6_found, p6_groups, p6_links, p7_ids, p7_decoded, p8_mix, p8_schedule, p8_shares,
        p9_found, p9_share,
    )
}

_ONCE = "(select distinct chunk_id, source, content, content_type from chunks_memory where chunk_id is not null)"

SQL: dict[str, str] = {
    "p2_found": rf"""
with l as (
  select chunk_id, source, regexp_replace(regexp_extract(lower(source), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') as site,
         unnest(string_split(content, chr(10))) as raw, generate_subscripts(string_split(content, chr(10)), 1) as line_no
  from {_ONCE} where source is not null and content is not null and (content_type is null or content_type <> 'image_ocr')),
n as (select *, regexp_replace(regexp_replace(regexp_replace(lower(raw), '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g'), '\p{{Nd}}+', '0', 'g') as norm
      from l where regexp_matches(raw, '\p{{L}}')),
c as (select site, norm from n group by site, norm having count(distinct source) >= 10)
select distinct chunk_id, cast(line_no as int) as line_no from n join c using (site, norm)""",
    "p4_found": rf"""
select distinct chunk_id, case when len(list_filter(string_split_regex(content, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]'), lambda w: length(w) > 512)) > 0 then 'unbroken' else 'divisible' end as kind
from {_ONCE} where length(content) > 512""",
}
