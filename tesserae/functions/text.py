"""Text expressions: tokens, keys, addresses. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The Italian function words left out of keyword work, and the contractions cut from word starts.
STOPWORDS = "a ad al alla alle ai agli allo anche che chi ci come con da dal dalla dalle dai dei del della delle degli dello di e ed è fra gli ha i il in la le lo ma mi ne nei nel nella nelle non o per più se si su sul sulla tra un una uno così torna".split()
CONTRACTIONS = ("l'", "un'", "all'", "d'", "dell'", "quest'", "nell'")
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def italian_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS, stem: Callable[[Column], Column] | None = None) -> Column:
    """Index terms: punctuation but apostrophes is dropped without a blank, contractions (in lower case) are cut off,

    then lower case, words of two characters or more, no stopwords. ``stem`` maps a word to its stem; none by default.
    """
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}_\s']", "")
    bare = F.regexp_replace(bare, rf"(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(CONTRACTIONS)})([\p{{L}}\p{{N}}_])", "$1$2")
    words = F.regexp_extract_all(F.lower(bare), F.lit(rf"{WORD}(?:'{WORD})*"), F.lit(0))
    words = F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(list(stopwords)))
    return F.transform(words, stem) if stem else words


def feedback_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Terms for relevance feedback: punctuation is a blank, no stopwords, more than one character."""
    return F.filter(tokens(text), lambda w: (F.char_length(w) >= 2) & ~w.isin(list(stopwords)))


def query_key(text: Column) -> Column:
    """MD5 of the lower-cased text with white space squeezed."""
    return F.md5(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "))


def normal_url(url: Column) -> Column:
    """The address without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def source_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def chunk_hash(source: Column, index: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("-"), index.cast("string")), 256)


def document_text(headers: Column, title: Column, content: Column) -> Column:
    """Headers, title and content as one indexed text; what is null is left empty."""
    none = F.lit("")
    return F.concat(F.coalesce(F.array_join(headers, " | "), none), F.lit("\n\n"), F.coalesce(title, none), F.lit("\n"), F.coalesce(content, none))


def preview(headers: Column, text: Column, size: int = 500) -> Column:
    return F.concat(F.lit("[Context: "), F.coalesce(F.array_join(headers, " → "), F.lit("")), F.lit("]\n"), F.substring(text, 1, size), F.lit("..."))


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space (no abbreviation list)."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1␞"), "␞"), lambda s: F.char_length(F.trim(s)) > 0)


def fields_text(fields: Sequence[str], df) -> Column:
    """The named columns as one text with blanks between; arrays are joined by blanks, what is null is empty."""
    kinds = dict(df.dtypes)
    parts = [F.array_join(f, " ") if kinds[f].startswith("array") else F.col(f) for f in fields]
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def grouped_context(rows: DataFrame) -> DataFrame:
    """qid, context: the contents (qid, source, rank, id, content) by source, numbered in each source, sources by best rank."""
    by = rows.groupBy("qid", "source").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", "id", "content"))).alias("c"))
    numbered = F.transform("c", lambda x, i: F.concat(F.lit("CONTENUTO "), (i + 1).cast("string"), F.lit(": "), x["content"]))
    head = F.concat(F.lit("FONTE "), F.coalesce(source_id(F.col("source")), F.lit("")), F.lit(": "), F.coalesce("source", F.lit("")))
    block = by.select("qid", F.struct("first", F.concat(head, F.lit("\n"), F.array_join(numbered, "\n")).alias("text")).alias("b"))
    return block.groupBy("qid").agg(F.sort_array(F.collect_list("b")).alias("b")).select("qid", F.array_join("b.text", "\n\n").alias("context"))


def user_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("CONTESTO:\n"), context, F.lit("\n\nDOMANDA: "), F.coalesce(question, F.lit("")))
