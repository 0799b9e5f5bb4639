"""Greedy sentence packing with sentence overlap, as one fold in the JVM, over plain texts and over the items of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import chunk_hash, sentences

SIZE, OVERLAP = 512, 128


def pack_sentences(docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk_no, content. Sentences are packed while their characters fit ``size`` (blanks between aren't counted);

    a full chunk leaves its last overlap/size part of sentences (at least one) to the next, so chunks may exceed the
    size. Longer sentences are cut into pieces of ``size``. Null and empty texts give no chunk.
    """
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.char_length(s) - 1, F.lit(size)), lambda i: F.substring(s, i + 1, size))
    parts = F.flatten(F.transform(sentences(F.col(text)), pieces))
    start = F.struct(F.lit([]).cast("array<string>").alias("buf"), F.lit(0).alias("n"), F.lit([]).cast("array<string>").alias("out"))
    length = lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + F.char_length(s))

    def step(state, s):
        keep = F.greatest(F.lit(1), F.floor(F.size(state["buf"]) * F.lit(overlap / size)).cast("int"))
        rest = F.slice(state["buf"], F.size(state["buf"]) - keep + 1, keep)
        fits = (state["n"] + F.char_length(s) <= size) | (F.size(state["buf"]) == 0)
        added = F.struct(F.concat(state["buf"], F.array(s)).alias("buf"), (state["n"] + F.char_length(s)).alias("n"), state["out"].alias("out"))
        flushed = F.struct(
            F.concat(rest, F.array(s)).alias("buf"), (length(rest) + F.char_length(s)).alias("n"), F.concat(state["out"], F.array(F.array_join(state["buf"], " "))).alias("out")
        )
        return F.when(fits, added).otherwise(flushed)

    done = F.aggregate(parts, start, step, lambda s: F.when(F.size(s["buf"]) > 0, F.concat(s["out"], F.array(F.array_join(s["buf"], " ")))).otherwise(s["out"]))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_), F.posexplode(done).alias("chunk_no", "content"))
    return rows


#: Characters a chunk must have, with its headers in front.
LEAST = 64

_CHUNK = "struct<content:string,context:array<string>,content_type:string,url:string,alt:string,no:int>"


def _pieces(text: Column, size: int) -> Column:
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.char_length(s) - 1, F.lit(size)), lambda i: F.substring(s, i + 1, size))
    return F.flatten(F.transform(sentences(text), cut))


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """The chunks of every page (url, title, items), in order.

    Sentences of paragraphs and texts are packed as in :func:`pack_sentences`, across items. Headers only change the
    context, which a chunk takes from where it is closed; a header equal to the last one changes nothing. A table, list
    or image closes the open chunk, leaves no overlap and is a chunk of its own with its own context. ``chunk_index``
    counts before chunks shorter than ``least`` characters (with ``[headers] `` in front) are left out; images have no
    index and always stay, with their alternative text where nothing was read in them.
    """
    none = F.lit([]).cast("array<string>")
    unit = lambda kind, content, context, url: F.struct(kind.alias("kind"), content.alias("content"), context.alias("context"), url.alias("url"))
    no_url = F.lit(None).cast("string")

    def units(item):
        text = item["type"].isin("paragraph", "text")
        packed = F.transform(_pieces(item["content"], size), lambda p: unit(F.lit("text"), p, none, no_url))
        return F.when(text, packed).otherwise(F.array(unit(item["type"], item["content"], item["context"], item["url"])))

    chunk = lambda content, context, kind, url, alt, no: F.struct(
        content.alias("content"), context.alias("context"), kind.alias("content_type"), url.alias("url"), alt.alias("alt"), no.alias("no")
    )
    state = lambda buf, n, ctx, head, no, out: F.struct(buf.alias("buf"), n.alias("n"), ctx.alias("ctx"), head.alias("head"), no.alias("no"), out.alias("out"))
    start = state(none, F.lit(0), none, no_url, F.lit(0), F.lit([]).cast(f"array<{_CHUNK}>"))
    length = lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + F.char_length(s))
    closed = lambda s: F.when(F.size(s["buf"]) > 0, F.array(chunk(F.array_join(s["buf"], " "), s["ctx"], F.lit("text"), no_url, no_url, s["no"]))).otherwise(F.lit([]).cast(f"array<{_CHUNK}>"))
    after = lambda s: s["no"] + F.when(F.size(s["buf"]) > 0, 1).otherwise(0)

    def step(s, u):
        text, size_ = u["content"], F.char_length(u["content"])
        header = state(s["buf"], s["n"], F.when(text.eqNullSafe(s["head"]), s["ctx"]).otherwise(u["context"]), text, s["no"], s["out"])
        image = u["kind"] == "image"
        own = F.when(image, chunk(no_url, u["context"], F.lit("image_ocr"), u["url"], text, F.lit(None).cast("int"))).otherwise(chunk(text, u["context"], u["kind"], no_url, no_url, after(s)))
        alone = state(none, F.lit(0), s["ctx"], s["head"], after(s) + F.when(image, 0).otherwise(1), F.concat(s["out"], closed(s), F.array(own)))
        keep = F.greatest(F.lit(1), F.floor(F.size(s["buf"]) * F.lit(overlap / size)).cast("int"))
        rest = F.slice(s["buf"], F.greatest(F.lit(1), F.size(s["buf"]) - keep + 1), keep)
        fits = (s["n"] + size_ <= size) | (F.size(s["buf"]) == 0)
        added = state(F.concat(s["buf"], F.array(text)), s["n"] + size_, s["ctx"], s["head"], s["no"], s["out"])
        flushed = state(F.concat(rest, F.array(text)), (length(rest) + size_), s["ctx"], s["head"], after(s), F.concat(s["out"], closed(s)))
        return F.when(u["kind"] == "header", header).when(u["kind"] != "text", alone).when(fits, added).otherwise(flushed)

    folded = F.aggregate(F.flatten(F.transform("items", units)), start, step, lambda s: F.concat(s["out"], closed(s)))
    rows = pages.select("url", "title", F.posexplode(folded).alias("pos", "_c")).select(F.col("url").alias("source"), "title", "pos", F.col("_c.*"))
    rows = rows.withColumnRenamed("url", "image_url")
    prefix = F.when(F.size("context") > 0, F.concat(F.lit("["), F.array_join("context", " | "), F.lit("] "))).otherwise("")
    image = F.col("content_type") == "image_ocr"
    rows = rows.where(image | (F.char_length(F.trim(F.concat(prefix, F.col("content")))) >= least))
    content = F.when(image, image_text(F.col("content"), F.col("alt"))).otherwise(F.col("content"))
    key = F.when(image, chunk_hash(F.col("image_url"), F.lit(0))).otherwise(chunk_hash(F.col("source"), F.col("no")))
    return rows.select(
        key.alias("chunk_id"), "source", "content_type", "title", F.array_distinct("context").alias("headers_context"), content.alias("content"),
        F.col("no").alias("chunk_index"), "pos", F.struct(F.col("alt").alias("alt_text"), "image_url").alias("metadata"),
    )


def image_text(read: Column, alt: Column) -> Column:
    """What was read in an image, or else its alternative text with a mark."""
    return F.when(read != "", read).otherwise(F.concat(F.lit("ALT_TEXT: "), F.coalesce(alt, F.lit(""))))
