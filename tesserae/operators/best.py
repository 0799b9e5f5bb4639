"""The best k of every query, where many queries meet many items.

Of each query every task sends k rows, so few queries are sent to all partitions of the items, while many are dealt to
groups: the items are written once, packed in blocks, and each group meets all blocks in one task or in a few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.stage import partitions

#: Rows that leave the tasks of a search together, and queries of a group at most.
ROWS, GROUP = 1_000_000, 16_384


def shares(spark: SparkSession, queries: int, k: int) -> tuple[int, int]:
    """Groups of queries, and tasks of each; one group with 0 tasks where the items' own partitions will do."""
    cores = spark.sparkContext.defaultParallelism
    if queries * k * max(partitions(spark), cores) <= ROWS:
        return 1, 0
    parts = max(1, min(3 * cores, ROWS // (queries * k)))
    return min(queries, max(-(-3 * cores // parts), -(-queries // GROUP))), parts


def meet(blocks: DataFrame, match: Iterable[Callable], parts: int, schema: str) -> DataFrame:
    """The rows of every group's ``match`` over all ``blocks``, in ``parts`` tasks for each group."""
    return reduce(DataFrame.unionByName, [blocks.coalesce(parts).mapInArrow(f, schema) for f in match])


def packed_ids(ids: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("id", ids.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
    return out.getvalue().to_pybytes()


def unpacked_ids(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def cut(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest; of equal ones the first."""
    if len(score) <= k:
        return np.arange(len(score))
    low = np.partition(score, len(score) - k)[len(score) - k]
    over = np.flatnonzero(score > low)
    return np.concatenate([over, np.flatnonzero(score == low)[: k - len(over)]])


class Held:
    """The best ``k`` of each of ``n`` queries so far, as flat arrays; equal scores by id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if not len(q):
            return
        if self.ids is not None:
            q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), pa.concat_arrays([self.ids, ids])
        order = np.lexsort((-score, q))
        same = (np.diff(q[order]) == 0) & (np.diff(score[order]) == 0)
        if same.any():  # only these are ordered by id
            tied = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            place = np.zeros(len(q), np.int64)
            place[tied[pc.sort_indices(ids.take(pa.array(tied))).to_numpy()]] = np.arange(len(tied))
            order = np.lexsort((place, -score, q))
        own = q[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.q, self.score, self.ids = q[order], score[order], ids.take(pa.array(order))
        self.least[q[last]] = score[last]

    def rows(self, qids: pa.Array, of: np.ndarray) -> Iterable[pa.RecordBatch]:
        """qid, id, score; ``qids`` are the queries' own ids, those of query i from ``of[i]`` to ``of[i + 1]``."""
        for at in range(0, len(self.q), 200_000):
            q, score, ids = self.q[at : at + 200_000], self.score[at : at + 200_000], self.ids.slice(at, 200_000)
            times = of[q + 1] - of[q]
            row = np.repeat(np.arange(len(q)), times)
            own = of[q][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(own)), ids.take(pa.array(row)), pa.array(score[row])], names=["qid", "id", "score"])


def deal(n: int, groups: int) -> list[np.ndarray]:
    """The queries of each group, every ``groups``-th."""
    return [np.arange(g, n, groups) for g in range(groups)]


def listed(members: list[list[int]], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of the chosen queries one after the other, and where those of each begin."""
    own = [members[i] for i in chosen.tolist()]
    flat = np.fromiter((x for m in own for x in m), np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(m) for m in own])]).astype(np.int64)
