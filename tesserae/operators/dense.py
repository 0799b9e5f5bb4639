"""Exact inner-product search, hashed text vectors, and an inverted-file index for approximate search.

Queries are packed once and meet the vectors block by block in a matrix product of single precision; pairs that may be
among the best are scored again in double. Of each query only the best k leave a task. Queries are broadcast where their
counted numbers are few (in groups, each for all vectors, where their results would be many), else blocks are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import italian_tokens
from tesserae.operators.best import Held, deal, listed, meet, packed_ids, shares, unpacked_ids
from tesserae.plans.stage import materialize

#: Numbers in query vectors up to which they are broadcast, and queries of a block beyond that.
BROADCAST_NUMBERS, BLOCK = 4_000_000, 2048
#: Vectors packed as one row where queries are dealt to groups, and pairs that are scored again at once.
PACK, PAIRS = 16_384, 2_000_000
#: Dimensions of hashed text vectors.
HASH_DIM = 64

Encoder = Callable[[list[list[str]]], np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, from the array's flat buffer."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Best:
    """The best ``k`` of every query so far, over blocks of items; equal scores (to nine places) by id."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.k, self.held = vectors, k, Held(len(vectors), k)
        self.rough, self.size = vectors.astype(np.float32), np.sqrt((vectors * vectors).sum(1))

    def add(self, ids: pa.Array, v: np.ndarray, barred: np.ndarray | None = None) -> None:
        """Scores in single precision tell which pairs may be among the best; those are scored in double precision.

        ``barred``: the query that each item may not be given to, or -1.
        """
        order = pc.sort_indices(ids)
        ids, v = ids.take(order), v[order.to_numpy()]
        rough = self.rough @ v.astype(np.float32).T
        # what single precision may be off, with room for the rounding
        off = (v.shape[1] + 8) * 2.0**-23 * self.size * np.sqrt((v * v).sum(1).max(initial=0.0)) + 2e-9
        floor, new = self.held.least - off, np.flatnonzero(self.held.least == -np.inf)
        if len(ids) > self.k and len(new):
            some = new if barred is None else new[~np.isin(new, barred)]
            floor[some] = np.partition(rough[some], len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * off[some]
        floor = np.nextafter(np.where(np.isfinite(floor), floor, -np.inf).astype(np.float32), np.float32(-np.inf))
        qs, cs, scores = [], [], []
        step = max(1, PAIRS // max(1, len(ids)))
        for at in range(0, len(rough), step):  # should all be in question
            q, c = np.nonzero(rough[at : at + step] >= floor[at : at + step, None])
            q += at
            if barred is not None:
                keep = barred[order.to_numpy()][c] != q
                q, c = q[keep], c[keep]
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.vectors[q[i : i + 65536]], v[c[i : i + 65536]]) for i in range(0, len(q), 65536))])
            score = np.round(score, 9)
            keep = np.flatnonzero(score >= self.held.least[q])
            by = keep[np.lexsort((c[keep], -score[keep], q[keep]))]
            by = by[np.arange(len(by)) - np.searchsorted(q[by], q[by]) < self.k]
            qs.append(q[by])
            cs.append(c[by])
            scores.append(score[by])
        if qs:
            self.held.add(np.concatenate(qs), np.concatenate(scores), ids.take(pa.array(np.concatenate(cs))))


def _barred(ids: pa.Array, qids: pa.Array, of: np.ndarray) -> np.ndarray:
    """Of each item the query of its own id, or -1."""
    at = pc.index_in(ids, value_set=qids.cast(ids.type)).fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, np.searchsorted(of, at, side="right") - 1, -1)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, other: bool = True, block: int = BLOCK) -> DataFrame:
    """qid, id, score, rank of the ``k`` nearest of ``vectors`` (id, embedding) to each of ``queries`` (id, embedding).

    Null vectors take no part. With ``other`` a vector is never its own neighbour; else equal queries are searched once.
    Equal scores (rounded to nine places) are ordered by id.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    asked = materialize(queries.where("id is not null and embedding is not null").select(F.col("id").alias("qid"), "embedding"), "queries")
    schema = f"qid {dict(asked.dtypes)['qid']}, id {dict(vectors.dtypes)['id']}, score double"
    numbers = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0

    def match(sent):
        """Of packed blocks, or of the items themselves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, qids, of = sent.value
            best = Best(q, k)

            def add(ids: pa.Array, v: np.ndarray) -> None:
                for at in range(0, len(ids), block):
                    some = ids.slice(at, block)
                    best.add(some, v[at : at + block], _barred(some, qids, of) if other else None)

            for b in batches:
                if b.schema.names[0] == "ids":
                    for i in range(b.num_rows):
                        ids = unpacked_ids(b.column(0)[i].as_buffer())
                        add(ids, np.frombuffer(b.column(1)[i].as_buffer(), np.float64).reshape(len(ids), -1))
                elif b.num_rows and len(q):
                    add(b.column(0), matrix(b.column(1)))
            if best.held.ids is not None:
                yield from best.held.rows(qids, of)

        return run

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                part = b.slice(at, PACK)
                cells = [packed_ids(part.column(0)), matrix(part.column(1)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["ids", "vectors"])

    if numbers <= BROADCAST_NUMBERS:
        table = asked.toArrow().combine_chunks()
        every = matrix(table.column("embedding").combine_chunks()) if table.num_rows else np.zeros((0, 0))
        bags: dict[bytes, list[int]] = {}
        for i in range(len(every)):
            bags.setdefault(every[i].tobytes() + (i.to_bytes(8) if other else b""), []).append(i)
        members = list(bags.values())
        groups, parts = shares(spark, max(1, len(members)), k)
        dealt = []
        for chosen in deal(len(members), groups):
            own, of = listed(members, chosen)
            qids = table.column("qid").combine_chunks().take(pa.array(own))
            dealt.append(match(spark.sparkContext.broadcast((every[own[of[:-1]]], qids, of))))
        if not parts:
            found = vectors.mapInArrow(dealt[0], schema)
        else:
            blocks = materialize(vectors.mapInArrow(packed, "ids binary, vectors binary"), "vectors")
            found = meet(blocks, dealt, parts, schema)
    else:

        def bundled(rows: DataFrame, name: str) -> DataFrame:
            numbered = rows.withColumn("_b", F.floor(F.monotonically_increasing_id() / block))  # in the rows' own partitions
            return numbered.groupBy("_b").agg(F.collect_list(rows.columns[0]).alias(f"{name}_ids"), F.collect_list("embedding").alias(f"{name}_vectors")).drop("_b")

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, v, qids, q = (b.column(c)[i].values for c in range(4))
                    best, of = Best(matrix(q), k), np.arange(len(qids) + 1)
                    best.add(ids, matrix(v), _barred(ids, qids, of) if other else None)
                    yield from best.held.rows(qids, of)

        found = bundled(vectors, "v").crossJoin(bundled(asked, "q")).mapInArrow(pairs, schema)  # blocks of stated queries
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# ---- vectors of texts


def hashing_encoder(dim: int = HASH_DIM) -> Encoder:
    """Counts of the words by hashed dimension and sign, scaled to length 1 (a text without words is 0 everywhere)."""

    def encode(texts: list[list[str]]) -> np.ndarray:
        known: dict[str, tuple[int, float]] = {}
        out = np.zeros((len(texts), dim))
        for i, words in enumerate(texts):
            for w in words:
                if w not in known:
                    h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                    known[w] = (h % dim, 1.0 if h // dim % 2 else -1.0)
                at, sign = known[w]
                out[i, at] += sign
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(size > 0, size, 1.0)

    return encode


def embed(texts: DataFrame, encoder: Encoder | None = None, id_: str = "id", text: str = "text", tokenizer: Callable[[Column], Column] = italian_tokens) -> DataFrame:
    """id, embedding of every text. ``encoder`` turns a batch of token lists into a matrix and may hold any model."""
    encode = encoder or hashing_encoder()
    kind = dict(texts.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = encode([x or [] for x in b.column(1).to_pylist()])
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * (v.shape[1] if b.num_rows else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], names=["id", "embedding"])

    return texts.select(F.col(id_).alias("id"), tokenizer(F.col(text)).alias("_t")).mapInArrow(run, f"id {kind}, embedding array<double>")


def embed_index(indexed: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """As :func:`embed` with hashed words, from an index of the texts (id, terms, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("terms").flatten().dictionary_encode()
            size = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
            hashed = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy(zero_copy_only=False)]
            count = b.column("tf").flatten().to_numpy(zero_copy_only=False) * np.where(hashed // dim % 2, 1.0, -1.0)
            out = np.bincount(np.repeat(np.arange(b.num_rows), size) * dim + hashed % dim, weights=count, minlength=b.num_rows * dim).reshape(b.num_rows, dim)
            norm = np.sqrt((out * out).sum(1, keepdims=True))
            out = out / np.where(norm > 0, norm, 1.0)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], names=["id", "embedding"])

    return indexed.select("id", "terms", "tf").mapInArrow(run, f"id {dict(indexed.dtypes)['id']}, embedding array<double>")


# ---- approximate search


def centroids(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means centroids of at most ``sample`` vectors (the least by hash of the id)."""
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = matrix(rows.column("embedding").combine_chunks())
    c = x[np.random.RandomState(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        for j in np.unique(own):
            c[j] = x[own == j].mean(0)
    return c


def _cells(sent, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            near = np.argsort(-(matrix(b.column(1)) @ c.T - 0.5 * (c * c).sum(1)), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, 1), int)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * near.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel().astype(np.int32)))], names=["id", "embedding", "cells"])

    return run


def build_index(vectors: DataFrame, cells: int = 16) -> tuple[DataFrame, np.ndarray]:
    """Every vector with its cell (the nearest of the centroids, which come from a bounded sample)."""
    c = centroids(vectors, cells)
    sent = vectors.sparkSession.sparkContext.broadcast(c)  # cells x dimensions
    rows = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    kinds = dict(rows.dtypes)
    listed = rows.mapInArrow(_cells(sent, 1), f"id {kinds['id']}, embedding {kinds['embedding']}, cells array<int>")
    return listed.select("id", "embedding", F.col("cells")[0].alias("cell")), c


def approximate_topk(indexed: DataFrame, c: np.ndarray, queries: DataFrame, k: int = 5, probes: int = 13, other: bool = True) -> DataFrame:
    """As :func:`topk`, among the vectors of each query's ``probes`` nearest cells only."""
    sent = queries.sparkSession.sparkContext.broadcast(c)
    asked = queries.where("id is not null and embedding is not null").select("id", "embedding")
    kinds = dict(asked.dtypes)
    asked = asked.mapInArrow(_cells(sent, probes), f"id {kinds['id']}, embedding {kinds['embedding']}, cells array<int>")
    asked = asked.select(F.col("id").alias("qid"), F.col("embedding").alias("_q"), F.explode("cells").alias("cell"))
    pairs = indexed.join(asked, "cell").where(F.col("id") != F.col("qid") if other else F.lit(True))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.round((matrix(b.column(2)) * matrix(b.column(3))).sum(1), 9) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["qid", "id", "score"])

    found = pairs.select("qid", "id", "embedding", "_q").mapInArrow(score, f"qid {kinds['id']}, id {dict(indexed.dtypes)['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
