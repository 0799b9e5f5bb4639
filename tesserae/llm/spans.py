"""Problem 9: long exact spans shared between records.

MinHash banding of passages. The passages of a text are all its stretches of ``length`` characters; the signature of a
passage is the least hash of its ``GRAM``-grams. Tuned for full recall there is one band of one row: equal passages
always have equal signatures. Neighbouring passages share their signature and the gram it comes from, so a text sends
one signature for about 75 passages. Passages of different texts with one signature are candidates; these are verified
exactly, passage by passage, and the shared passages of a text are merged into the longest runs. Texts linked by a
shared span are clustered by components.

A pass over the texts sends signatures only; those seen in two texts fill a filter whose bits are 64 for each of them,
and a second pass sends the candidates' context (at most 2 * length characters) to where its signature is verified. With
more such signatures than ``FILTER_BITS`` allows there is no filter: the contexts are joined to the signatures instead.
Equal texts are one class, which is sent once from each task; in a class of several texts everything is shared.

A signature with more than ``HOT`` contexts (counted in the first pass) isn't gathered: the hashes of its passages are
grouped, least and greatest class of each are aggregated before they are shuffled, and those with two classes are joined
back to where they stand. Passages are compared by 64-bit hashes mixed with their signature (another 64 bits).

Defined cases: null texts and those shorter than ``length`` share nothing; a stretch that is repeated in one text only
isn't shared; texts of any length are read whole, in overlapping segments; repeated ids give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.components import components
from tesserae.plans.stage import materialize, partitions, small

LENGTH = 200
GRAM = 50
#: Characters hashed at once; longer texts are cut into segments that overlap by a passage.
BLOCK_CHARS = 2_000_000
#: Most bits of the filter of signatures, and contexts of a signature from which on it is spread.
FILTER_BITS, HOT = 1 << 28, 5_000

_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, for the hashes of all stretches of one size in a text."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n + 1:
            self.up = np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]).cumprod(dtype=np.uint64)

    def prefixes(self, cp: np.ndarray) -> np.ndarray:
        self.grow(len(cp))
        table = _mix(cp.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * self.up[: len(cp)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(table, dtype=np.uint64)])

    def hashes(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = len(prefix) - size
        return _mix((prefix[size:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def anchors(cp: np.ndarray, ends: np.ndarray, powers: Powers, length: int, gram: int):
    """For each run of passages with one signature: text number, first and last passage, place and hash of its gram.

    ``ends`` are the texts' ends in ``cp``.
    """
    h = powers.hashes(powers.prefixes(cp), gram)
    width = length - gram + 1
    if len(h) < width:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    place = np.uint64((1 << 22) - 1)
    least = _sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), width)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    full = sizes >= length
    first, count = starts[full], sizes[full] - length + 1
    s = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    doc = np.repeat(np.flatnonzero(full), count)
    at = (least[s] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(doc) != 0)])) if len(s) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(s)]]) - 1 if len(new) else new
    return doc[new], s[new], s[last], at[new], h[at[new]]


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple]]:
    """(row number, id, class, size, offset, text) in groups of about BLOCK_CHARS characters."""
    import xxhash

    out, chars = [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text is None:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            own = xxhash.xxh3_64_intdigest(raw)
            step = BLOCK_CHARS - length + 1
            for offset in range(0, max(1, len(text) - length + 1), step):
                part = text[offset : offset + BLOCK_CHARS]
                out.append((key, own, len(text), offset, part))
                chars += len(part)
                if chars >= BLOCK_CHARS:
                    yield out
                    out, chars = [], 0
    if out:
        yield out


def _runs(group: list[tuple], powers: Powers, length: int, gram: int):
    texts = [x[4] for x in group]
    ends = np.cumsum([len(t) for t in texts])
    joined = "".join(texts)
    return joined, np.concatenate([[0], ends[:-1]]), anchors(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends, powers, length, gram)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _signatures(targets: int, length: int, gram: int):
    """Packed signatures by target (32 bits each, with 32 bits of the class), and (class, id, size) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sent = Powers(), set()
        for group in _segments(batches, length):
            whole = [x for x in group if x[3] == 0]
            docs = np.array([[_signed(x[1]), x[0], x[2]] for x in whole], np.int64).reshape(-1, 3)
            out: dict[str, list] = {"target": [-1], "data": [docs.tobytes()], "more": [b""]}
            group = [x for x in group if x[2] >= length and (x[1], x[3]) not in sent]
            sent.update((x[1], x[3]) for x in group)
            if group:
                _, _, (doc, _, _, _, h) = _runs(group, powers, length, gram)
                own = np.array([x[1] for x in group], np.uint64)[doc] >> np.uint64(32)
                entry = np.stack([h, own], 1)
                to = (entry[:, 0] % np.uint64(targets)).astype(np.int64)
                key = (entry[:, 0] & ~np.uint64(0xFFFFFFFF)) | entry[:, 1]
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(targets + 1))
                for p in range(targets):
                    part, times = np.unique(key[order[cut[p] : cut[p + 1]]], return_counts=True)
                    # of a signature met in many texts, two classes are enough to tell, and how many there are
                    top = part >> np.uint64(32)
                    keep = np.ones(len(part), bool)
                    keep[2:] = top[2:] != top[:-2]
                    if len(part):
                        first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
                        n = np.add.reduceat(times, first).astype(np.uint64)
                        out["target"].append(p)
                        out["data"].append(part[keep].tobytes())
                        out["more"].append(((top[first] << np.uint64(32)) | n)[n > 2].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["target"], pa.int32()), pa.array(out["data"], pa.binary()), pa.array(out["more"], pa.binary())], names=["target", "data", "more"])
            if len(sent) > 4_000_000:
                sent.clear()

    return run


def _places(h: np.ndarray, targets: int) -> np.ndarray:
    """Target and high bits of a signature as one number."""
    return ((h % np.uint64(targets)) << np.uint64(32)) | (h >> np.uint64(32))


def _met(hot: int):
    """Signatures (as target and high bits) that came with two classes: those with up to ``hot`` contexts, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[list, list]] = {}
        for b in batches:
            for t, d, m in zip(*(b.column(c).to_pylist() for c in ("target", "data", "more"))):
                own = by.setdefault(t, ([], []))
                own[0].append(np.frombuffer(d, np.uint64))
                own[1].append(np.frombuffer(m, np.uint64))
        for t, (parts, more) in by.items():
            entry = np.concatenate(parts)
            part = np.unique(entry) >> np.uint64(32)
            twice = np.unique(part[1:][part[1:] == part[:-1]])
            more = np.concatenate(more)
            top = np.concatenate([entry >> np.uint64(32), more >> np.uint64(32)])
            n = np.concatenate([np.ones(len(entry), np.int64), (more & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            which = np.searchsorted(twice, top)
            hit = (which < len(twice)) & (twice[np.minimum(which, len(twice) - 1)] == top) if len(twice) else np.zeros(len(top), bool)
            many = np.bincount(which[hit], weights=n[hit], minlength=len(twice)) > hot if len(twice) else np.zeros(0, bool)
            place = ((np.uint64(t) << np.uint64(32)) | twice).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([t, t], pa.int32()), pa.array([False, True]), pa.array([place[~many].tobytes(), place[many].tobytes()], pa.binary()), pa.array([int((~many).sum()), int(many.sum())], pa.int64())], names=["target", "hot", "places", "n"])

    return run


def _words(bits: int):
    """Words of a filter with the bits of the places set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column(0).to_pylist():
                at = _mix(np.frombuffer(d, np.uint64)) % np.uint64(bits)
                word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                order = np.argsort(word, kind="stable")
                word, bit = word[order], bit[order]
                first = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0])) if len(word) else np.zeros(0, np.int64)
                joined = np.bitwise_or.reduceat(bit, first) if len(first) else bit
                yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(joined.view(np.int64))], names=["word", "bit"])

    return run


def _filter(places: DataFrame, n: int) -> np.ndarray:
    """A filter of 64 bits (a power of two in all) for each of ``n`` places."""
    bits = max(1 << 16, 1 << (64 * n - 1).bit_length() if n else 0)
    words = places.mapInArrow(_words(bits), "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()  # at most ``bits`` bits
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    at = _mix(place) % np.uint64(len(bits) * 64)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for d, hot in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            place = np.frombuffer(d, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.full(len(place), hot))], names=["place", "hot"])


_CONTEXT = "sig long, class long, start long, shift int, text string, place long, hot boolean"


def _contexts(sent, targets: int, length: int, gram: int):
    """Contexts of the signatures in either filter; of all, where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, done, filters = Powers(), set(), sent.value
        for group in _segments(batches, length):
            group = [x for x in group if x[2] >= length and (x[1], x[3]) not in done]
            done.update((x[1], x[3]) for x in group)
            if not group:
                continue
            joined, base, (doc, s0, s1, at, h) = _runs(group, powers, length, gram)
            place = _places(h, targets)
            hot = _has(filters[1], place) if filters else np.zeros(len(h), bool)
            hit = np.flatnonzero(hot | _has(filters[0], place)) if filters else np.arange(len(h))
            own = np.array([x[1] for x in group], np.uint64).view(np.int64)
            offset = np.array([x[3] for x in group], np.int64)
            d = doc[hit]
            texts = [joined[a:b] for a, b in zip(s0[hit].tolist(), (s1[hit] + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[hit].view(np.int64)), pa.array(own[d]), pa.array(s0[hit] - base[d] + offset[d]), pa.array((at[hit] - s0[hit]).astype(np.int32)), pa.array(texts, pa.string()),
                 pa.array(place[hit].view(np.int64)), pa.array(hot[hit])],
                names=["sig", "class", "start", "shift", "text", "place", "hot"],
            )
            if len(done) > 4_000_000:
                done.clear()

    return run


def _passages(rows: list[tuple], powers: Powers, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the row and key of every passage of some contexts."""
    sig, shift = np.array([r[0] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
    sizes = np.array([len(r[4]) for r in rows], np.int64)
    begins = np.cumsum(sizes) - sizes
    h = powers.hashes(powers.prefixes(np.frombuffer("".join(r[4] for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32)), length)
    count = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return row, nth, _mix(h[begins[row] + nth] + _mix(sig[row].view(np.uint64) + (nth - shift[row] + (1 << 20)).astype(np.uint64)))


def _keys(length: int):
    """key, class and place of every passage of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                rows = list(zip(*(b.slice(i, 4096).column(c).to_pylist() for c in range(5))))
                row, nth, key = _passages(rows, powers, length)
                own, start = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[row]), pa.array(start[row] + nth)], names=["key", "class", "at"])

    return run


def _spread(contexts: DataFrame, length: int) -> DataFrame:
    """The stretches and links of the contexts of hot signatures, passage by passage."""
    keys = contexts.select("sig", "class", "start", "shift", "text").mapInArrow(_keys(length), "key long, class long, at long")
    shared = keys.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("key", "least")
    met = materialize(keys.join(small(materialize(shared, "shared")), "key").select("class", "at", "least"), "met")
    stretches = met.select(F.lit(0).alias("kind"), "class", F.col("at").alias("a"), (F.col("at") + length).alias("b")).distinct()
    links = met.where("class <> least").select(F.lit(1).alias("kind"), "class", F.col("least").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    return stretches.unionByName(links)


def _verify_block(rows: list[tuple], powers: Powers, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """class, start, end of the shared stretches, and links (class, least class), of whole signature groups."""
    own, start = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    row, nth, key = _passages(rows, powers, length)
    order = np.lexsort((own[row], key))
    k, c = key[order], own[row][order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.concatenate([first, [len(k)]]))
    least, most = c[first], c[first + size - 1]
    shared = np.zeros(len(k), bool)
    shared[order] = np.repeat(least != most, size)
    link = np.stack([c, np.repeat(least, size)], 1)[np.repeat(least != most, size)]
    link = np.unique(link[link[:, 0] != link[:, 1]], axis=0) if len(link) else link
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(shared.astype(np.int8)) != 0)]))
    stop = np.concatenate([edge[1:], [len(row)]]) - 1
    keep = shared[edge]
    a, b = edge[keep], stop[keep]
    return own[row[a]], start[row[a]] + nth[a], start[row[b]] + nth[b] + length, link


def _verify(length: int):
    """Rows sorted by signature: stretches (kind 0) and links between classes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            own, a, b, link = _verify_block(rows, powers, length)
            kind = np.concatenate([np.zeros(len(own), np.int32), np.ones(len(link), np.int32)])
            x = np.concatenate([own, link[:, 0]])
            y = np.concatenate([a, link[:, 1]])
            z = np.concatenate([b, np.zeros(len(link), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y), pa.array(z)], names=["kind", "class", "a", "b"])

        held: list[tuple] = []
        chars = 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and chars > BLOCK_CHARS and held[-1][0] != r[0]:
                    yield from emit(held)
                    held, chars = [], 0
                held.append(r)
                chars += len(r[4])
        if held:
            yield from emit(held)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for d in b.column("data").to_pylist():
            x = np.frombuffer(d, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["class", "id", "size"])


def _stages(df: DataFrame, key: str, text: str, length: int, gram: int, hot: int = HOT, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (class, id, size), copies (classes of several documents) and the verified rows."""
    spark, targets = df.sparkSession, partitions(df.sparkSession)
    rows = df.select(F.col(key).cast("long"), F.col(text).cast("string"))
    packed = materialize(rows.mapInArrow(_signatures(targets, length, gram), "target int, data binary, more binary"), "signatures")
    met = packed.where("target >= 0").repartitionById(targets, F.col("target")).mapInArrow(_met(hot), "target int, hot boolean, places binary, n long")
    met = materialize(met, "met")
    n = {r["hot"]: r["n"] for r in met.groupBy("hot").agg(F.sum("n").alias("n")).collect()}
    filtered = 128 * sum(n.values()) <= filter_bits
    filters = [_filter(met.where(F.col("hot") == h).select("places"), n.get(h, 0)) for h in (False, True)] if filtered else None
    sent = spark.sparkContext.broadcast(filters)
    context = rows.mapInArrow(_contexts(sent, targets, length, gram), _CONTEXT)
    if not filtered:
        places = met.select("places", "hot").mapInArrow(_unpacked, "place long, hot boolean")
        context = context.drop("hot").join(places, "place")
    spread = n.get(True, 0) > 0
    if spread:
        context = materialize(context, "contexts")
    near = (context.where("not hot") if spread else context).select("sig", "class", "start", "shift", "text")
    near = near.repartition(targets, "sig").sortWithinPartitions("sig")
    checked = near.mapInArrow(_verify(length), "kind int, class long, a long, b long")
    if spread:
        checked = checked.unionByName(_spread(context.where("hot"), length))
    checked = materialize(checked, "stretches")
    docs = packed.where("target < 0").mapInArrow(_documents, "class long, id long, size long")
    docs = materialize(docs.where(F.col("size") >= length), "documents")
    copies = materialize(docs.groupBy("class").agg(F.countDistinct("id").alias("n")).where("n > 1").select("class"), "copies")
    return docs, copies, checked


def _merged(stretches: DataFrame) -> DataFrame:
    """Overlapping or touching stretches of a class as one: every class's rows are those of one text."""
    by = Window.partitionBy("class").orderBy("a", "b")
    upto = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = stretches.distinct().withColumn("_new", F.when(F.col("a") <= upto, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("class", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, **how: int) -> DataFrame:
    """key, span_start, span_end of the longest runs of characters that lie in a shared stretch of ``length``."""
    docs, copies, checked = _stages(df, key, text, length, gram, **how)
    return _spans(docs, copies, checked, key)


def _spans(docs: DataFrame, copies: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    part = _merged(checked.where("kind = 0").select("class", "a", "b").join(copies, "class", "left_anti"))
    found = docs.join(part, "class").select(F.col("id").alias(key), F.col("a").alias("span_start"), F.col("b").alias("span_end"))
    whole = docs.join(copies, "class", "left_semi").select(F.col("id").alias(key), F.lit(0).cast("long").alias("span_start"), F.col("size").alias("span_end"))
    return found.unionByName(whole)


def shared_share(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, **how: int) -> DataFrame:
    """key, n_chars, shared_chars, share and cluster of every text that shares a stretch.

    ``cluster`` is the least class among the texts linked to it, directly or through others.
    """
    docs, copies, checked = _stages(df, key, text, length, gram, **how)
    spans = materialize(_spans(docs, copies, checked, key), "spans")
    size = docs.select(F.col("id").alias(key), "class", "size").dropDuplicates([key])
    total = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars")).join(size, key)
    linked = components(checked.where("kind = 1").select(F.col("class").alias("a"), F.col("a").alias("b")).distinct())
    rows = total.join(linked, total["class"] == linked["node"], "left")
    share = F.round(F.col("shared_chars") / F.col("size"), 9)
    return rows.select(key, F.col("size").alias("n_chars"), "shared_chars", share.alias("share"), F.coalesce("component", "class").alias("cluster"))
