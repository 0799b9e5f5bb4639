"""Problem 6: near-duplicate records with small edits.

Exact prefix join. A record is the set of its triples of successive words, put in one order for all records: the rarer
triples first, equally rare ones by hash. Two sets of m and n triples with a similarity of at least t have t / (1 + t) of
m + n triples in common, so the first of their common triples stands early enough in both for that many to follow; it is
among the first m - t m + 1 triples of each. A record is sent to the buckets of these triples with its size and the
triple's place, and records of a bucket are candidates if sizes and places leave enough triples. The Hamming distance of
the candidates' parity sketches, which is never above the symmetric difference, rules most of them out, and the rest is
verified on the triples themselves.

No triple is left out, and any order of the triples gives the same pairs, as long as it is one order for all records.
The order comes from a counting table of ``CELLS`` cells: every triple of every record is added to its cell, the tables
of the tasks are added up, and a cell's count is an upper bound of how many records have its triples. It doesn't depend
on how rows are cut into tasks. The bound also splits large buckets: a triple that more than ``SPLIT`` records may have
gets its records spread over groups by hash, and every pair of groups is a tile of its own, so no task holds more than
two groups of a bucket. (The mean count of a cell is all triples / ``CELLS``; where four times that exceeds ``SPLIT``,
from about 6e7 records of 70 triples on, it takes its place, unless ``cells`` is raised.)

The texts are read once: sets, sketches and counts are written by one pass. Records with equal sets are one class, which
is written once by each task. Entries of buckets travel as packed arrays by target partition, not as rows.

Defined cases: null contents and those of fewer words than ``min_words`` take no part; rows with one key count once;
empty tables give no pairs; texts are read whole; only key and content are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.stage import materialize, partitions

THRESHOLD = 0.6
MIN_WORDS = 20
#: Records of a bucket that are compared in one task; larger buckets are split into tiles.
SPLIT = 4096
#: Cells of the table of counts (a power of two; a byte each where it is broadcast), and of one part of it.
CELLS, SHARD = 1 << 22, 1 << 16
#: Candidates of a task that are made distinct and passed on at once.
FLUSH = 1_000_000
#: Characters of text turned into triples at once, and triples sent to buckets at once.
BLOCK_CHARS, BLOCK_TRIPLES = 4_000_000, 2_000_000
#: Bits of a parity sketch.
SKETCH_BITS = 512

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Triples:
    """Sets of triples of a block of texts: ``doc`` and ``value`` (48 bits) are sorted and without repeats."""

    def __init__(self, texts: list[str | None], min_words: int, known: dict[str, int]):
        import re

        import xxhash

        find = re.compile(r"[^\W_]+").findall
        hashes, counts = [], []
        for text in texts:
            words = find(text.lower()) if text else []
            if len(words) < max(3, min_words):
                counts.append(0)
                continue
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            counts.append(len(words))
        n = np.array(counts, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(n)), n)
        if len(h) >= 3:
            value = _mix(h[:-2] * _M1 + _mix(h[1:-1] * _M2 + _mix(h[2:] * _M3)))
            keep = doc[:-2] == doc[2:]
            packed = np.unique((doc[:-2][keep].astype(np.uint64) << np.uint64(48)) | (value[keep] >> np.uint64(16)))
        else:
            packed = np.zeros(0, np.uint64)
        self.doc = (packed >> np.uint64(48)).astype(np.int64)
        self.value = packed & np.uint64((1 << 48) - 1)
        self.size = np.bincount(self.doc, minlength=len(n)) if len(n) else np.zeros(0, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.used = np.flatnonzero(self.size)
        key = np.zeros(len(n), np.uint64)
        if len(packed):
            key[self.used] = np.add.reduceat(_mix(self.value + _M1), self.start[:-1][self.used])
        self.key = key.view(np.int64)


def _blocks_of_texts(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list]]:
    """Keys and texts in groups of at most 65,536 rows (a row's number must fit 16 bits)."""
    keys: list = []
    texts: list = []
    size = 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys.append(k)
            texts.append(t)
            size += len(t or "")
            if size >= chars or len(keys) == 65_536:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """Triples of a set of each size among which the first common one must be, whatever the partner's size."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def bit_sketches(t: Triples, docs: np.ndarray) -> np.ndarray:
    """Parity of the number of triples that fall on each bit, as a row of bytes for each of ``docs`` (ascending)."""
    out = np.zeros((len(docs), SKETCH_BITS // 8), np.uint8)
    for i in range(0, len(docs), 1024):
        own = docs[i : i + 1024]
        row = np.repeat(np.arange(len(own)), t.size[own])
        at = np.arange(len(row)) - np.repeat(np.cumsum(t.size[own]) - t.size[own] - t.start[own], t.size[own])
        bit = (_mix(t.value[at] + _M3) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount(row * SKETCH_BITS + bit, minlength=len(own) * SKETCH_BITS) & 1
        out[i : i + 1024] = np.packbits(odd.astype(np.uint8).reshape(len(own), SKETCH_BITS), axis=1)
    return out


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 byte by byte, the last bytes first: the high ones are mostly 0 and pack well."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0].astype(np.int64)


def may_be_similar(apart: np.ndarray, m: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sizes ``m`` and ``n`` and the Hamming distance of the sketches leave the threshold possible."""
    return (apart <= (m + n) * (1 - threshold) / (1 + threshold) + 1e-9) & (np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-9)


def _cell(value: np.ndarray, cells: int) -> np.ndarray:
    return (_mix(value * _M2 + _M1) & np.uint64(cells - 1)).astype(np.int64)


def _six(value: np.ndarray) -> np.ndarray:
    """48-bit values as rows of six bytes."""
    return np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, :6])


def _of_six(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of ``data`` (bytes) of the given sizes as a binary array."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


_SETS = "kind int, key string, class long, size int, sketch binary, triples binary"
_SETS_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.string()), ("class", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary()), ("triples", pa.binary())])


def _rows(n: int, kind: int, **columns: pa.Array) -> pa.RecordBatch:
    full = [pa.array(np.full(n, kind, np.int32)), *[columns.get(f.name, pa.nulls(n, f.type)) for f in list(_SETS_ARROW)[1:]]]
    return pa.RecordBatch.from_arrays(full, schema=_SETS_ARROW)


def _sets(min_words: int, cells: int):
    """Kind 0: key and class of each record; 1: size, sketch and triples of each class; 2: part ``size`` of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        sent: set[int] = set()
        counts = np.zeros(cells, np.uint32)
        for keys, texts in _blocks_of_texts(batches, BLOCK_CHARS):
            t = Triples(texts, min_words, known)
            yield _rows(len(t.used), 0, key=pa.array([str(keys[i]) for i in t.used], pa.string()), **{"class": pa.array(t.key[t.used])})
            fresh = np.zeros(len(texts), bool)
            for i in t.used.tolist():
                k = int(t.key[i])
                if k not in sent:
                    sent.add(k)
                    fresh[i] = True
            new = np.flatnonzero(fresh)
            value = t.value[fresh[t.doc]]
            counts += np.bincount(_cell(value, cells), minlength=cells).astype(np.uint32)
            sketch = _binary(bit_sketches(t, new), np.full(len(new), SKETCH_BITS // 8))
            yield _rows(len(new), 1, size=pa.array(t.size[new].astype(np.int32)), sketch=sketch, triples=_binary(_six(value), 6 * t.size[new]), **{"class": pa.array(t.key[new])})
            if len(known) > 2_000_000:
                known.clear()
            if len(sent) > 4_000_000:
                sent.clear()
        for i in range(0, cells, SHARD):
            if counts[i : i + SHARD].any():
                yield _rows(1, 2, size=pa.array([i // SHARD], pa.int32()), triples=pa.array([_planes(counts[i : i + SHARD])], pa.binary()))

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts added up by part, as eighths of their binary logarithm (rounded up), and their sum."""
    by: dict[int, np.ndarray] = {}
    for b in batches:
        for shard, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by[shard] = by.get(shard, 0) + _of_planes(counts)
    level = [np.minimum(np.ceil(8 * np.log2(1.0 + c)), 255).astype(np.uint8).tobytes() for c in by.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(level, pa.binary()), pa.array([int(c.sum()) for c in by.values()], pa.int64())], names=["shard", "level", "total"])


def groups_of(split: float) -> np.ndarray:
    """Groups into which a bucket is split, by the level of its count."""
    most = np.exp2(np.arange(256) / 8) - 1
    return np.exp2(np.ceil(np.log2(np.maximum(most / split, 1.0)))).astype(np.int64)


def _entries(levels: np.ndarray, split: float, threshold: float, targets: int):
    """Entries of the buckets by target: part of the bucket's hash, class, size, and triples left with the tile's side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groups_of(split)
        own, size, data = [], [], []
        n = 0

        def flush() -> pa.RecordBatch:
            key, m, value = np.concatenate(own), np.concatenate(size), _of_six(np.concatenate(data))
            doc, start = np.repeat(np.arange(len(m)), m), np.concatenate([[0], np.cumsum(m)])
            level = levels[_cell(value, len(levels))]
            order = np.argsort((level.astype(np.uint64) << np.uint64(48)) | value)
            order = order[np.argsort(doc[order], kind="stable")]
            left = start[doc + 1] - np.arange(len(doc))
            keep = m[doc] - left < prefix_length(m, threshold)[doc]
            doc, left, value, level = doc[keep], left[keep], value[order][keep], level[order][keep]
            part, side = _mix(value + _M2), np.zeros(len(doc), np.int64)
            if (g := groups[level]).max(initial=1) > 1:
                at = np.repeat(np.arange(len(g)), g)
                other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
                doc, left, part, g = doc[at], left[at], part[at], g[at]
                mine = (_mix(key.view(np.uint64)[doc] + _M3) % g.astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                side = np.where(low == high, 0, np.where(mine == low, 1, 2))
                part = np.where(g > 1, _mix(part + low.astype(np.uint64) * _M1 + high.astype(np.uint64) * _M3), part)
            to = (part % np.uint64(targets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(targets + 1))
            part, doc, left = (part >> np.uint64(32)).astype(np.uint32)[order], doc[order], (left + (side << 30))[order]
            out: dict[str, list] = {c: [] for c in _PACKED.names}
            for p in range(targets):
                x = slice(ends[p], ends[p + 1])
                if x.stop > x.start:
                    for c, v in zip(out, (p, part[x].tobytes(), key[doc[x]].tobytes(), _planes(m[doc[x]]), _planes(left[x]))):
                        out[c].append(v)
            return pa.RecordBatch.from_pydict(out, schema=_PACKED)

        for b in batches:
            own.append(b.column(0).to_numpy())
            size.append(b.column(1).to_numpy().astype(np.int64))
            data.append(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8))
            n += len(data[-1]) // 6
            if n >= BLOCK_TRIPLES:
                yield flush()
                own, size, data, n = [], [], [], 0
        if n:
            yield flush()

    return run


_PACKED = pa.schema([("target", pa.int32()), ("part", pa.binary()), ("class", pa.binary()), ("size", pa.binary()), ("left", pa.binary())])


def _pairs_of_buckets(part: np.ndarray, key: np.ndarray, size: np.ndarray, left: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different keys in one bucket whose sizes, and triples from the common one on, leave the threshold possible.

    In a tile of two groups (side 1 and 2) only pairs of both groups.
    """
    order = np.lexsort((key, size, part))
    part, key, size, left, side = part[order], key[order], size[order], left[order], side[order]
    once = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, bool)
    part, key, size, left, side = part[once], key[once], size[once], left[once], side[once]
    need = threshold / (1 + threshold)
    live = np.arange(len(key))
    shift = 1
    while len(live):
        live = live[live + shift < len(key)]
        other = live + shift
        live = live[(part[live] == part[other]) & (size[live] >= threshold * size[other] - 1e-9)]  # a bucket is sorted by size
        other = live + shift
        m = np.minimum(left[live], left[other]) >= need * (size[live] + size[other]) - 1e-9
        m &= (side[live] == 0) | (side[live] != side[other])
        if m.any():
            yield key[live[m]], key[other[m]]
        shift += 1


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    a, b = (np.concatenate(x) for x in zip(*found))
    ab = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
    ab = ab[np.concatenate([[True], (np.diff(ab, axis=0) != 0).any(1)])]
    for i in range(0, len(ab), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ab[i : i + 100_000, 0]), pa.array(ab[i : i + 100_000, 1])], names=["a", "b"])


def _collide(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        for b in batches:
            for part, own, size, left in zip(*(b.column(c).to_pylist() for c in ("part", "class", "size", "left"))):
                row = (np.frombuffer(part, np.uint32), np.frombuffer(own, np.int64), _of_planes(size), _of_planes(left))
                for to, x in zip(held, row):
                    to.append(x)
        if not held[0]:
            return
        part, own, size, left = (np.concatenate(x) for x in held)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for pair in _pairs_of_buckets(part, own, size, left & ((1 << 30) - 1), left >> 30, threshold):
            found.append(pair)
            n += len(pair[0])
            if n >= FLUSH:
                yield from _distinct(found)
                found, n = [], 0
        if found:
            yield from _distinct(found)

    return run


def _near(threshold: float):
    """Pairs whose sizes and sketches don't rule the threshold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            m, n = (b.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
            apart = np.bitwise_count(x ^ y).sum(1)
            yield b.select(["a", "b"]).filter(pa.array(may_be_similar(apart, m, n, threshold)))

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = []
            for x, y in zip(b.column("triples_a").to_pylist(), b.column("triples_b").to_pylist()):
                x, y = _of_six(np.frombuffer(x, np.uint8)), _of_six(np.frombuffer(y, np.uint8))
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim.append(both / (len(x) + len(y) - both))
            sim = np.array(sim, float)
            b = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], names=["a", "b", "similarity"])
            yield b.filter(pa.array(sim >= threshold - 1e-12))

    return run


def similar_classes(
    df: DataFrame, key: str, content: str, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, split: int = SPLIT, cells: int = CELLS
) -> tuple[DataFrame, DataFrame]:
    """Members (key, class) of the classes that have a link or several members, and links (a, b, similarity), a < b."""
    spark, targets = df.sparkSession, partitions(df.sparkSession)
    rows = df.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).cast("string"), F.col(content))
    sets = materialize(rows.mapInArrow(_sets(min_words, cells), _SETS), "sets")
    shards = sets.where("kind = 2").select("size", "triples").repartition(min(targets, max(1, cells // SHARD)), "size")
    levels, total = np.zeros(cells, np.uint8), 0
    for r in shards.mapInArrow(_levels, "shard int, level binary, total long").collect():  # ``cells`` bytes
        levels[r["shard"] * SHARD : (r["shard"] + 1) * SHARD] = np.frombuffer(r["level"], np.uint8)
        total += r["total"]
    sent = spark.sparkContext.broadcast(levels)
    entries = sets.where("kind = 1").select("class", "size", "triples").mapInArrow(
        _lazy(_entries, sent, max(split, 4 * total / cells), threshold, targets), "target int, part binary, class binary, size binary, left binary"
    )
    pairs = entries.repartitionById(targets, F.col("target")).mapInArrow(_collide(threshold), "a long, b long")
    pairs = materialize(pairs.distinct(), "candidates")
    one = sets.where("kind = 1").select("class", "size", "sketch").dropDuplicates(["class"])
    a, b = (one.select(F.col("class").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    near = pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_near(threshold), "a long, b long")
    near = materialize(near, "near")
    used = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    own = sets.where("kind = 1").select("class", "triples").join(used, "class", "left_semi").dropDuplicates(["class"])
    own = materialize(own, "triples")
    a, b = (own.select(F.col("class").alias(c), F.col("triples").alias(f"triples_{c}")) for c in "ab")
    links = near.join(a, "a").join(b, "b").select("a", "b", "triples_a", "triples_b").mapInArrow(_similar(threshold), "a long, b long, similarity double")
    links = materialize(links, "links")
    # rows read twice have one key and one class
    members = sets.where("kind = 0").select("key", "class").distinct()
    seen = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    live = links.select(F.explode(F.array("a", "b")).alias("class")).unionByName(seen).distinct()
    return materialize(members.join(live, "class", "left_semi"), "members"), links


def _lazy(make, sent, *args):
    """A task's function made in the task, from a broadcast value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(sent.value, *args)(batches)

    return run


def similar_pairs(df: DataFrame, key: str = "chunk_id", content: str = "content", threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """key_a, key_b (key_a < key_b), similarity of all pairs of records, members of one class included."""
    members, links = similar_classes(df, key, content, threshold, **how)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    both = both.unionByName(members.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity")).distinct())
    a, b = (members.select(F.col("class").alias(c), F.col("key").alias(f"{key}_{c}")) for c in "ab")
    return both.join(a, "a").join(b, "b").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b", "similarity")


def similar_groups(df: DataFrame, key: str = "chunk_id", content: str = "content", threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """key, representative, n_copies and n_links of every record with a near copy: the least key of its class, its size and links."""
    members, links = similar_classes(df, key, content, threshold, **how)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    size = members.groupBy("class").agg(F.count("*").alias("n_copies"), F.min("key").alias("representative"))
    rows = members.join(size, "class").join(ends, "class", "left")
    return rows.select(F.col("key").alias(key), "representative", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_links(df: DataFrame, key: str = "chunk_id", content: str = "content", threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """key_a, key_b (key_a < key_b), similarity of the representatives of linked classes: with the groups, every link once."""
    members, links = similar_classes(df, key, content, threshold, **how)
    least = members.groupBy("class").agg(F.min("key").alias("_k"))
    a, b = (least.select(F.col("class").alias(c), F.col("_k").alias(f"_{c}")) for c in "ab")
    rows = links.join(a, "a").join(b, "b")
    return rows.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"), "similarity")
