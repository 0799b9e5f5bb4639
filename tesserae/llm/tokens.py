"""Problem 7: the whole corpus encoded with a public tokenizer.

Global distinct-word shuffle. Each text is split into pre-tokens with their positions; the words go through one
shuffle by word hash, where each distinct word is encoded once; the ids are joined back to the batches the words came
from and the texts are put together again by position. Words travel once for each batch of texts, not once for each
occurrence: a batch carries its own word list, and a text is a list of positions in that list.

Defined cases: null, empty and blank texts -- null and empty give an empty list, blank ones are encoded like any other.
Special tokens' strings are ordinary text. Repeated ids or texts give as many rows. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.stage import materialize, partitions

#: Where the public vocabularies lie; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the split pattern that belongs to the byte-level vocabularies, as published with them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text after which a batch is closed.
BATCH_CHARS = 6_000_000


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN).findall


def _hash(words: list[str], n: int) -> np.ndarray:
    import xxhash

    h = xxhash.xxh32_intdigest
    return np.fromiter((h(w) for w in words), np.int64, len(words)) % n


def _pack_batches(targets: int, batch_chars: int):
    """Rows of two kinds for each batch of texts: one with the texts as word numbers, and the words by target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, ctx, number = _splitter(), TaskContext.get(), 0
        task = f"{ctx.stageId()}.{ctx.partitionId()}"
        zip_ = zstandard.ZstdCompressor(level=3)
        keys: list[int] = []
        counts: list[int] = []
        codes: list[np.ndarray] = []
        words: dict[str, int] = {}
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = f"{task}.{number}"
            body = zip_.compress(np.concatenate(codes).astype(np.int32).tobytes() if codes else b"")
            head = struct.pack("<q", len(keys)) + np.array(keys, np.int64).tobytes() + np.array(counts, np.int64).tobytes()
            rows = {"batch": [key], "target": [-1], "texts": [head + body], "words": [None], "places": [None]}
            distinct = list(words)
            to = _hash(distinct, targets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(targets + 1))
            for t in range(targets):
                own = order[ends[t] : ends[t + 1]]
                if len(own):
                    for c, v in (("batch", key), ("target", t), ("texts", None), ("words", [distinct[i] for i in own]), ("places", own.tolist())):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_PACKED)

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = split(text) if text else []
                new = len(words)
                for w in set(found).difference(words):
                    words[w] = new
                    new += 1
                keys.append(row)
                counts.append(len(found))
                codes.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                chars += len(text or "")
                if chars >= batch_chars:
                    yield from flush()
                    number += 1
                    chars = 0
                    keys, counts, codes, words = [], [], [], {}
        if keys:
            yield from flush()

    return run


_PACKED = pa.schema([("batch", pa.string()), ("target", pa.int32()), ("texts", pa.binary()), ("words", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))])


def _encode_words(path: str, count_only: bool):
    """Each distinct word of a partition is encoded once; a row gives the ids of one batch's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        known: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for words in b.column("words").to_pylist():
                for w in set(words).difference(known):
                    known[w] = encode(w)
                ids = [known[w] for w in words]
                lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                flat = b"" if count_only else np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())).tobytes()
                out.append(struct.pack("<q", len(ids)) + lengths.tobytes() + flat)
            yield pa.RecordBatch.from_arrays([b.column("batch"), pa.array(out, pa.binary()), b.column("places")], names=["batch", "ids", "places"])

    return run


def _assemble(count_only: bool, key: str):
    def run(table: pa.Table) -> pa.Table:
        texts, lengths, starts, flats, base = None, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for body, ids, places in zip(table["texts"].to_pylist(), table["ids"].to_pylist(), table["places"].to_pylist()):
            if body is not None:
                texts = body
                continue
            (n,) = struct.unpack_from("<q", ids)
            own, flat = np.frombuffer(ids, np.int32, n, 8).astype(np.int64), np.frombuffer(ids, np.int32, -1, 8 + 4 * n)
            at = np.array(places, np.int64)
            if len(at) and at.max() >= len(lengths):
                grow = np.zeros(at.max() + 1 - len(lengths), np.int64)
                lengths, starts = np.concatenate([lengths, grow]), np.concatenate([starts, grow])
            lengths[at] = own
            starts[at] = base + np.cumsum(own) - own
            flats.append(flat)
            base += len(flat)
        (n,) = struct.unpack_from("<q", texts)
        keys = np.frombuffer(texts, np.int64, n, 8)
        counts = np.frombuffer(texts, np.int64, n, 8 + 8 * n)
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts[8 + 16 * n :]), np.int32)
        size = lengths[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        if count_only:
            return pa.table({key: pa.array(keys, pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64())})
        flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
        step = np.ones(int(size.sum()), np.int64)  # the places of the ids, as differences
        some = size > 0
        first = (np.cumsum(size) - size)[some]
        begin, length = starts[codes][some] if len(codes) else np.zeros(0, np.int64), size[some]
        if len(first):
            step[first] = begin - np.concatenate([[0], (begin + length - 1)[:-1]])
        values = pa.array(flat[np.cumsum(step)] if len(step) else flat[:0], pa.int32())
        return pa.table({key: pa.array(keys, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)})

    return run


def encode_corpus(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str = VOCABULARIES,
    count_only: bool = False,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """``key`` (a bigint) and ``ids`` of every row of ``df``; with ``count_only``, ``n_tokens`` instead of ``ids``.

    Only ``key`` and ``text`` are read; other columns may have any name. A text never leaves its batch, so one text may
    be as long as a task's memory allows.
    """
    path, targets = vocabulary(tokenizer, folder), partitions(df.sparkSession)
    packed = df.select(F.col(key).cast("long"), F.col(text).cast("string"))
    schema = "batch string, target int, texts binary, words array<string>, places array<int>"
    packed = materialize(packed.mapInArrow(_pack_batches(targets, batch_chars), schema), "pretokens")
    words = packed.where("target >= 0").select("batch", "target", "words", "places").repartitionById(targets, F.col("target"))
    encoded = words.mapInArrow(_encode_words(path, count_only), "batch string, ids binary, places array<int>")
    texts = packed.where("target < 0").select("batch", "texts", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("array<int>").alias("places"))
    both = texts.unionByName(encoded.withColumn("texts", F.lit(None).cast("binary")))
    result = f"{key} long, " + ("n_tokens long" if count_only else "ids array<int>")
    return both.groupBy("batch").applyInArrow(_assemble(count_only, key), result)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``text`` from ids: each id is looked up in the token-byte table, whose size is the vocabulary's.

    A null list gives an empty text; bytes that are no UTF-8 give U+FFFD.
    """
    path = vocabulary(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(map(reversed, _ranks(path).items()))
        for b in batches:
            texts = [b"".join(map(table.__getitem__, x or [])).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("long"), F.col(ids)).mapInArrow(run, f"{key} long, text string")
