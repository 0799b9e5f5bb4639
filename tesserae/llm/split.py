"""Problem 4: items over a size limit cut into overlapping pieces at natural boundaries.

Pointer doubling. The boundaries of all texts of an Arrow batch form one table; each boundary is joined to its farthest
legal successor -- the start of the next piece, including the overlap -- by binary search, and the successor table is
squared until every start reachable from a text's beginning is marked, so that all greedy cuts come out in
log2(pieces) steps instead of one after the other.

A piece ends at the last sentence or line end in the second half of its reach, else at the last white space, else, in a
run without white space, at a grid of the overlap's width counted from the run's start. It begins up to ``overlap``
characters before the last one's end, at a sentence start if there is one, else a word start; where every such start
would end no later than the piece before, there is no overlap.

Defined cases: null contents give no piece, contents up to the limit (also empty ones) one piece; sizes are code
points; rows with one key are one item; pieces joined without their overlaps are the content; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.stage import materialize, prefix_sum, small

LIMIT = 512
OVERLAP = 128
#: The characters Unicode counts as white space.
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Characters of text cut together.
BLOCK_CHARS = 2_000_000


def _space(cp: np.ndarray) -> np.ndarray:
    table = np.zeros(12289, bool)
    table[SPACES] = True
    return table[np.minimum(cp, 12288)] & (cp <= 12288)


def cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Starts and ends of each text's pieces, and whether it has a run of over ``limit`` without white space."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = int(base[-1])
    space = _space(cp)
    after = np.zeros(total + 1, bool)  # a word starts here
    after[1:total] = space[:-1] & ~space[1:] if total else False
    after[base[:-1][sizes > 0]] = True
    words = np.flatnonzero(after)
    # a sentence or line starts here: the white space before it holds a line end or follows a full stop
    stop = np.isin(cp, np.array([46, 33, 63, 8230], np.uint32))
    line = cp == 10
    marks = np.concatenate([[0], np.cumsum(line)])
    last = np.maximum.accumulate(np.where(space, -1, np.arange(total))) if total else np.zeros(0, np.int64)
    before = last[np.maximum(words - 1, 0)] if len(words) else words
    strong = (before < 0) | stop[np.maximum(before, 0)] | (marks[words] - marks[np.maximum(before, 0)] > 0) if len(words) else np.zeros(0, bool)
    first = np.isin(words, base[:-1])
    strong = strong | first
    sentences = words[strong]
    # where no word starts within the limit, a grid of the overlap's width
    doc_end = base[1:][np.searchsorted(base, words, "right") - 1] if len(words) else words
    follow = np.minimum(np.concatenate([words[1:], [total]]), doc_end) if len(words) else words
    wide = np.flatnonzero(follow - words > limit)
    step = max(1, overlap)
    grid = np.concatenate([np.arange(words[i] + step, follow[i], step) for i in wide]) if len(wide) else np.zeros(0, np.int64)
    nodes = np.union1d(words, grid).astype(np.int64)
    if not len(nodes):
        return [(np.zeros(1, np.int64), np.array([n]), False) for n in sizes]
    end_of = base[1:][np.searchsorted(base, nodes, "right") - 1]

    def back(table: np.ndarray, at: np.ndarray) -> np.ndarray:  # the last entry up to at
        i = np.searchsorted(table, at, "right") - 1
        return np.where(i >= 0, table[np.maximum(i, 0)], -1) if len(table) else np.full(len(at), -1)

    def ahead(table: np.ndarray, at: np.ndarray) -> np.ndarray:  # the first entry from at on
        i = np.searchsorted(table, at, "left")
        return np.where(i < len(table), table[np.minimum(i, len(table) - 1)], total + 1) if len(table) else np.full(len(at), total + 1)

    reach = nodes + limit
    stops = back(sentences, reach)
    ends = np.where(stops > nodes + limit // 2, stops, -1)
    word = back(words, reach)
    ends = np.where((ends < 0) & (word > nodes), word, ends)
    ends = np.where(ends < 0, np.maximum(back(grid, reach), nodes + 1), ends)
    ends = np.where(end_of <= reach, end_of, ends)
    place = lambda p: np.minimum(np.searchsorted(nodes, p), len(nodes) - 1)
    nxt = ends.copy()
    low = np.maximum(ends - overlap, nodes + 1)
    for table in (grid, words, sentences):  # the last that fits counts most
        start = ahead(table, low)
        fits = (start < ends) & (ends < end_of)
        fits &= ends[place(np.where(fits, start, nodes))] > ends
        nxt = np.where(fits, start, nxt)
    final = ends >= end_of
    jump = np.where(final, np.arange(len(nodes)), place(nxt))
    seen = np.zeros(len(nodes), bool)
    seen[place(base[:-1][sizes > 0])] = True
    while True:  # squaring: after k rounds all starts up to 2 ** k pieces on are marked
        more = seen.copy()
        more[jump[seen]] = True
        square = jump[jump]
        if (more == seen).all() and (square == jump).all():
            break
        seen, jump = more, square
    chosen = np.flatnonzero(seen)
    of = np.searchsorted(base, nodes[chosen], "right") - 1
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    gaps = np.zeros(len(texts), bool)
    runs = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    edge = np.union1d(np.concatenate([[0], runs, [total]]), base)
    long_ = np.flatnonzero(np.diff(edge) > limit)
    long_ = long_[~space[edge[long_]]] if total else long_
    gaps[np.searchsorted(base, edge[long_], "right") - 1] = True
    out = []
    for i, n in enumerate(sizes):
        own = chosen[bounds[i] : bounds[i + 1]] if n else chosen[:0]
        out.append((nodes[own] - base[i], ends[own] - base[i], bool(gaps[i])) if len(own) else (np.zeros(1, np.int64), np.array([n]), False))
    return out


def cut_items(df: DataFrame, content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with ``_starts``, ``_ends`` (array<int>, counted in code points from 0) and ``_unbroken``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(content).to_pylist()
            starts, ends, runs, i = [], [], [], 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars < BLOCK_CHARS):
                    chars += len(texts[j] or "")
                    j += 1
                for t, (s, e, r) in zip(texts[i:j], cuts([t or "" for t in texts[i:j]], limit, overlap)):
                    starts.append(None if t is None else s)
                    ends.append(None if t is None else e)
                    runs.append(None if t is None else r)
                i = j
            extra = [pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(runs, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "_starts", "_ends", "_unbroken"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, _starts array<int>, _ends array<int>, _unbroken boolean")


def oversized(df: DataFrame, key: str = "chunk_id", content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, kind and n_pieces of every item over the limit."""
    long_ = df.where(F.char_length(content) > limit).select(key, content)
    kind = F.when(F.max("_unbroken"), "unbroken").otherwise("divisible")
    return cut_items(long_, content, limit, overlap).groupBy(key).agg(kind.alias("kind"), F.max(F.size("_starts")).alias("n_pieces"))


def split_items(
    df: DataFrame, key: str = "chunk_id", content: str = "content", group: str = "source", order: str = "chunk_index",
    limit: int = LIMIT, overlap: int = OVERLAP,
) -> DataFrame:
    """Every piece of every item, with all columns of ``df``; ``content`` is the piece and ``order`` a new running number.

    Numbers run from 0 in each ``group``, over its items by old number (nulls first) and key. ``piece_no`` counts in
    the item, ``piece_start`` is the piece's place in it.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(content).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    items = materialize(cut_items(rows, content, limit, overlap), "cuts")
    # repeats are found and pieces numbered without the texts, which move once, to their numbers
    sizes = items.select(F.col(key).alias("_k"), F.struct("_row", F.col(group).alias("g"), F.col(order).alias("o"), F.size("_starts").cast("long").alias("n")).alias("_m"))
    number = sizes.groupBy("_k").agg(F.min("_m").alias("_m")).select("_k", F.col("_m._row").alias("_row"), F.col("_m.g").alias("_g"), F.col("_m.o").alias("_o"), F.col("_m.n").alias("_n"))
    ends = prefix_sum(materialize(number, "sizes"), ["_g"], ["_o", "_k"], ["_n"]).select("_row", (F.col("cum__n") - F.col("_n")).alias("_first"))
    pieces = items.join(small(materialize(ends, "first")), "_row")
    pieces = pieces.select("*", F.posexplode(F.arrays_zip("_starts", "_ends")).alias("piece_no", "_p"))
    text = F.substring(F.col(content), F.col("_p._starts") + 1, F.col("_p._ends") - F.col("_p._starts"))
    new = {content: text, order: (F.col("_first") + F.col("piece_no")).cast("int")}
    return pieces.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], "piece_no", F.col("_p._starts").alias("piece_start"))
