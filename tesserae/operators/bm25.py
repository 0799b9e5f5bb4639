"""BM25 (Okapi) over an index of documents: built once, kept as a table, scored in blocks.

The index has one row for each document: its length and its distinct terms with their counts. A term is counted in the
document's own row, so building it shuffles nothing but the frequencies of terms, which are counted before they are
shuffled. Scoring sends the weighted query terms to the index, not the postings to the queries: every query meets blocks of
documents by their terms, heaviest first, and leaves out documents that can't reach its k-th score so far; only the best k
of each query leave a task. Where the queries' terms are too many to be broadcast, postings and query terms are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import italian_tokens
from tesserae.operators.best import Held, cut, deal, listed, meet, packed_ids, shares, unpacked_ids
from tesserae.plans.stage import materialize

K1, B = 1.5, 0.75
#: Terms of all queries up to which they are broadcast (24 bytes each); beyond it postings and query terms are joined.
BROADCAST_ROWS = 4_000_000
#: Documents of a block, and their terms that are asked for.
BLOCK_DOCS, BLOCK_HITS = 262_144, 8_000_000
_BLOCK = ["ids", "known", "ptr", "most", "docs", "part"]

Tokenizer = Callable[[Column], Column]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column("_t")
        flat = tokens.flatten().dictionary_encode()
        codes, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        key, tf = np.unique(doc * max(1, len(words)) + codes, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, len(words)), minlength=len(size)))]).astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(key % max(1, len(words)))))
        counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size.astype(np.int32)), terms, counts], names=["id", "dl", "terms", "tf"])


def index(docs: DataFrame, id_: str = "id", text: str = "text", tokenizer: Tokenizer = italian_tokens) -> DataFrame:
    """id, dl, terms, tf of every document; a null text has no terms."""
    kind = dict(docs.dtypes)[id_]
    none = F.lit([]).cast("array<string>")
    rows = docs.select(F.col(id_).alias("id"), F.coalesce(tokenizer(F.col(text)), none).alias("_t"))
    return rows.mapInArrow(_count_terms, f"id {kind}, dl int, terms array<string>, tf array<int>")


def postings(indexed: DataFrame) -> DataFrame:
    """term, id, tf, dl: a row for each term of a document."""
    rows = indexed.select("id", "dl", F.explode(F.arrays_zip("terms", "tf")).alias("_p"))
    return rows.select(F.col("_p.terms").alias("term"), "id", F.col("_p.tf").alias("tf"), "dl")


def term_stats(indexed: DataFrame) -> DataFrame:
    return postings(indexed).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(indexed: DataFrame) -> DataFrame:
    """term, df, idf: negative values become a quarter of the mean over the vocabulary."""
    size = indexed.agg(F.count("*").alias("n"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    rows = term_stats(indexed).join(F.broadcast(size), how="cross").withColumn("_raw", raw)  # one row of sizes
    mean = rows.agg(F.avg("_raw").alias("_mean"))
    rows = rows.join(F.broadcast(mean), how="cross")  # one row
    return rows.select("term", "df", F.when(F.col("_raw") < 0, 0.25 * F.col("_mean")).otherwise(F.col("_raw")).alias("idf"))


def save(indexed: DataFrame, path: str) -> None:
    """Write the index: documents, and the term statistics of all of them. It is always written anew."""
    indexed.write.mode("overwrite").parquet(f"{path}/documents")
    idf(indexed.sparkSession.read.parquet(f"{path}/documents")).write.mode("overwrite").parquet(f"{path}/terms")


def open_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents and terms of a written index; an empty index where none was written."""
    shapes = {"documents": "id string, dl int, terms array<string>, tf array<int>", "terms": "term string, df long, idf double"}

    def part(name: str) -> DataFrame:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], shapes[name])
        return spark.read.parquet(f"{path}/{name}")

    return part("documents"), part("terms")


def _packed(sent, k1: float, b_: float, avgdl: float):
    """Blocks of the documents that have a query term: ids in their order, and of each such term its documents and their share of the score."""

    def block(ids: list[pa.Array], doc: list[np.ndarray], term: list[np.ndarray], part: list[np.ndarray]) -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        order = pc.sort_indices(own).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        d, t, p = place[np.concatenate(doc)], np.concatenate(term), np.concatenate(part)
        by = np.lexsort((d, t))
        d, t, p = d[by], t[by], p[by]
        known, at = np.unique(t, return_index=True)
        cells = [packed_ids(own.take(pa.array(order))), known.astype(np.int64).tobytes(), np.append(at, len(t)).astype(np.int64).tobytes(), np.maximum.reduceat(p, at).tobytes(), d.tobytes(), p.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        ids, doc, term, part, n, hits = [], [], [], [], 0, 0
        for whole in batches:
            for from_ in range(0, whole.num_rows, BLOCK_DOCS):
                b = whole.slice(from_, BLOCK_DOCS)
                size = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pc.index_in(b.column("terms").flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(code >= 0)
                if not len(hit):
                    continue
                if n and (n + b.num_rows > BLOCK_DOCS or hits + len(hit) > BLOCK_HITS):
                    yield block(ids, doc, term, part)
                    ids, doc, term, part, n, hits = [], [], [], [], 0, 0
                own = np.repeat(np.arange(b.num_rows), size)[hit]
                tf = b.column("tf").flatten().to_numpy(zero_copy_only=False)[hit].astype(float)
                dl = b.column("dl").to_numpy(zero_copy_only=False).astype(float)[own]
                met, own = np.unique(own, return_inverse=True)
                ids.append(b.column("id").take(pa.array(met)))
                doc.append(own + n)
                term.append(code[hit])
                part.append(tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * dl / avgdl)))
                n, hits = n + len(met), hits + len(hit)
        if n:
            yield block(ids, doc, term, part)

    return run


def _scored(q: int, rows: slice, upto: int, floor: float, k: int, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of the block's first ``upto`` documents for a query, of those that may reach ``floor``.

    A document without any of the terms down to ``floor`` in what is left of the bounds can't reach it: only those with
    one are met, and the terms after are looked up for those still in question.
    """
    docs, part, acc = m["docs"], m["part"], m["acc"]
    terms = [x for x in zip(m["start"][rows], m["end"][rows], m["weight"][rows], m["rest"][rows]) if x[0] < x[1]]
    if upto < m["n"]:
        terms = [(s, s + int(np.searchsorted(docs[s:e], upto)), w, r) for s, e, w, r in terms]
        terms = [x for x in terms if x[0] < x[1]]
    need = sum(r >= floor for *_, r in terms)  # the bounds fall
    if not need:
        return np.zeros(0, np.int64), np.zeros(0)
    left = lambda j: terms[j][3] if j < len(terms) else 1e-6
    if need == 1:
        s, e, w, _ = terms[0]
        d, score = docs[s:e], w * part[s:e]
    else:
        for s, e, w, _ in terms[:need]:
            acc[docs[s:e]] += w * part[s:e]
        met = np.concatenate([docs[s:e] for s, e, _, _ in terms[:need]])
        d = met[acc[met] >= floor - left(need)]
        once = np.arange(len(d))
        m["seen"][d] = once
        d = d[m["seen"][d] == once]
        score = acc[d]
        acc[met] = 0.0
    for j in range(need, len(terms)):
        keep = score + left(j) >= floor
        if not keep.all():
            d, score = d[keep], score[keep]
        if not len(d):
            break
        s, e, w, _ = terms[j]
        own = docs[s:e]
        at = np.minimum(np.searchsorted(own, d), e - s - 1)
        score = score + np.where(own[at] == d, w * part[s:e][at], 0.0)
    score = np.round(score, 6)
    keep = np.flatnonzero(score >= floor)
    keep = keep[np.argsort(d[keep], kind="stable")]
    keep = keep[cut(score[keep], k)]
    return d[keep], score[keep]


def _match(sent, k: int):
    """The best ``k`` documents of every query of a group over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, at, term, weight, qids, of = sent.value
        held = Held(len(at) - 1, k)
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for b in batches:
            for row in range(b.num_rows):
                cells = {name: b.column(name)[row].as_buffer() for name in _BLOCK}
                ids, known, ptr = unpacked_ids(cells["ids"]), np.frombuffer(cells["known"], np.int64), np.frombuffer(cells["ptr"], np.int64)
                start, end, most = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64), np.zeros(n_terms)
                start[known], end[known], most[known] = ptr[:-1], ptr[1:], np.frombuffer(cells["most"], np.float64)
                bound = np.maximum(0.0, weight * most[term])
                order = np.lexsort((-bound, own))
                total = np.cumsum(bound[order][::-1])[::-1]  # what this term and the later ones of its query can add
                after = np.append(total, 0.0)[at[1:]]
                rest = total - np.repeat(after, np.diff(at)) + 1e-6 + 1e-12 * total[0]  # rounded to six places
                t = term[order]
                m = {
                    "docs": np.frombuffer(cells["docs"], np.int32).astype(np.int64), "part": np.frombuffer(cells["part"], np.float64), "n": len(ids), "acc": np.zeros(len(ids)), "seen": np.zeros(len(ids), np.int64),
                    "start": start[t].tolist(), "end": end[t].tolist(), "weight": weight[order].tolist(), "rest": rest.tolist(),
                }
                qs, ds, scores = [], [], []
                for q, (a, z, floor) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), held.least.tolist())):
                    if m["rest"][a] < floor:
                        continue
                    rows = slice(a, z)
                    for share in (64, 8) if floor == -np.inf else ():  # a bound from some documents first
                        _, some = _scored(q, rows, len(ids) // share, floor, k, m)
                        floor = some.min() if len(some) == k else floor
                    d, score = _scored(q, rows, len(ids), floor, k, m)
                    if len(d):
                        qs.append(np.full(len(d), q))
                        ds.append(d)
                        scores.append(score)
                if qs:
                    held.add(np.concatenate(qs), np.concatenate(scores), ids.take(pa.array(np.concatenate(ds))))
        yield from held.rows(qids, of)

    return run


def search(indexed: DataFrame, weights: DataFrame, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B, tokenizer: Tokenizer = italian_tokens, text: str = "text") -> DataFrame:
    """qid, id, score, rank of the best ``k`` documents that share a term with each of ``queries`` (qid, ``text``).

    ``weights`` gives each term's idf. Query terms count as often as they occur; equal scores are ordered by id;
    documents without a shared term are never ranked; ``k`` may exceed the number of documents. Queries of equal terms
    are searched once.
    """
    spark = indexed.sparkSession
    asked = queries.select("qid", F.explode(tokenizer(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(weights.select("term", "idf"), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    asked = materialize(asked, "query-terms")
    if asked.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _joined(indexed, asked, k, k1, b)
    table = asked.toArrow().combine_chunks()  # at most BROADCAST_ROWS
    coded = [pa.array([], c.type).dictionary_encode() if not len(c) else c.combine_chunks().dictionary_encode() for c in (table.column("qid"), table.column("term"))]
    query, term = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded)
    weight, qids, words = table.column("w").to_numpy(), coded[0].dictionary, coded[1].dictionary
    order = np.lexsort((term, query))
    query, term, weight = query[order], term[order], weight[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(qids)))]).tolist()
    bags: dict[bytes, list[int]] = {}
    for i in range(len(qids)):
        rows = slice(ends[i], ends[i + 1])
        bags.setdefault(term[rows].tobytes() + weight[rows].tobytes(), []).append(i)
    members = list(bags.values())
    groups, parts = shares(spark, max(1, len(members)), k)
    dealt = []
    for chosen in deal(len(members), groups):
        own, of = listed(members, chosen)
        rows = [np.arange(ends[members[i][0]], ends[members[i][0] + 1]) for i in chosen.tolist()]
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        dealt.append(_match(spark.sparkContext.broadcast((len(words), at, term[flat], weight[flat], qids.take(pa.array(own)), of)), k))
    mean = float(indexed.agg(F.avg("dl")).first()[0] or 1.0)
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(indexed.dtypes)['id']}, score double"
    packed = _packed(spark.sparkContext.broadcast(words.to_pylist()), k1, b, mean)
    if not parts:
        return top(indexed.mapInArrow(lambda batches: dealt[0](packed(batches)), schema), k)
    blocks = indexed.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(packed, ", ".join(f"{name} binary" for name in _BLOCK))
    return top(meet(materialize(blocks, "blocks"), dealt, parts, schema), k)


def _joined(indexed: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """The same by joining postings with the query terms."""
    mean = indexed.agg(F.avg("dl").alias("avgdl"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = postings(indexed).join(F.broadcast(mean), how="cross").select("term", "id", part.alias("_p"))  # one row
    scored = asked.join(hits, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("_p")), 6).alias("score"))
    return top(scored, k)


def topk(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B, tokenizer: Tokenizer = italian_tokens) -> DataFrame:
    """As :func:`search`, over an index of ``docs`` (id, text) made for this search."""
    indexed = materialize(index(docs, tokenizer=tokenizer), "index")
    return search(indexed, idf(indexed), queries, k, k1, b, tokenizer)


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col(by).desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
