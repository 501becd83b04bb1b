"""Exact top-k inner-product search by no-random-access aggregation.

Candidates stay in their partitions and are taken a block at a time. For every dimension a block has a list of its
components, sorted; queries read a list from the top where their own component is positive and from the bottom where it is
negative. Lists are only read in their order, all to the same depth, which grows step by step; what one reading gives serves
all queries of a set that are still open, so the bounds of a step are two matrix products over them.

After a step a query's `frontier` is the sum of the products at the places that were reached: no vector can score more in
what was not read. A candidate that was met has that bound plus, for each of its components that was read, what its product
lies above the frontier's; its lower bound takes the lists' far ends instead. The bar is the k-th best score so far, over the
blocks before; the first block takes the k-th best lower bound. A query stops once candidates not met cannot reach the bar
and few of those met can; it does not begin on a block whose list heads add up to less than its bar. The few are resolved:
their final scores are summed in integers, so ties are true ties and go to the smaller identifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 2**63 - 1
#: Share of the lists that the first step on the first block reads, and how it grows from step to step.
FIRST, GROWTH = 1 / 4, 1.25
#: Reading goes on while more than k and more than one of this many of a block's candidates may qualify.
FEW = 32
#: So many queries share a reading.
QUERIES = 512


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id and `v`, floor(scale * x) as 64-bit integers; rows without a key, or with a null or non-finite component, go."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, kind: type):
        self.ids, self.values, self.kind = ids, values, kind  # (n,), (n, dim) integers
        by_list = np.ascontiguousarray(values.T).astype(kind)
        self.up = np.argsort(by_list, axis=1, kind="stable")
        self.at = np.take_along_axis(by_list, self.up, axis=1)

    def heads(self, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
        """What no vector of the block can exceed, by query."""
        return plus @ self.at[:, -1] + minus @ self.at[:, 0]

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What `depth` entries from either end give: for each candidate and list, what the component lies above the upper
        frontier and below the lower one, 0 where it was not read; and the frontiers."""
        n = len(self.ids)
        high, low = self.at[:, n - depth], self.at[:, depth - 1]
        above, below = np.zeros((2, len(high), n), self.kind)
        np.put_along_axis(above, self.up[:, n - depth :], self.at[:, n - depth :] - high[:, None], axis=1)
        np.put_along_axis(below, self.up[:, :depth], self.at[:, :depth] - low[:, None], axis=1)
        return above, below, high, low


@dataclass
class Reading:
    """What was read: entries of lists by the queries, of how many there are, and how many candidates were resolved."""

    entries: int = 0
    of: int = 0
    resolved: int = 0


def qualified(lists: Lists, plus: np.ndarray, minus: np.ndarray, bars: np.ndarray, own: list, k: int, share: float, log: Reading) -> Iterator[tuple[int, np.ndarray, float]]:
    """For each query (its positive and its negative components) the places of the candidates that may be among the best
    `k`, others being below its bar or below k of these, and the share of the lists that was read, `share` or more."""
    n, dim = len(lists.ids), len(lists.at)
    log.of += len(bars) * n * dim
    left = np.flatnonzero(lists.heads(plus, minus) >= bars)
    while len(left):
        depth = min(n, max(1, int(share * n)))
        above, below, high, low = lists.read(depth)
        p, m = plus[left], minus[left]
        upper = p @ above + m @ below + (p @ high + m @ low)[:, None]
        bar = bars[left]
        for at, i in enumerate(left.tolist()):
            if own[i] is not None:
                upper[at, own[i]] = -np.inf
        if n > k and (unknown := np.flatnonzero(bar == -np.inf)).size:
            # unread components are at least the far end of their list
            rise = lists.at[:, :1], lists.at[:, -1:]
            met = [np.where(read != 0, read + (front[:, None] - far), 0) for read, front, far in zip((above, below), (high, low), rise, strict=True)]
            lower = p[unknown] @ met[0] + m[unknown] @ met[1] + (p[unknown] @ lists.at[:, 0] + m[unknown] @ lists.at[:, -1])[:, None]
            lower[upper[unknown] == -np.inf] = -np.inf
            bar[unknown] = np.partition(lower, n - k, axis=1)[:, n - k]
        may = (upper >= bar[:, None]) & (upper > -np.inf)
        few = (may.sum(axis=1) <= max(k, n // FEW)) | (depth == n)
        for at in np.flatnonzero(few).tolist():
            places = np.flatnonzero(may[at])
            log.entries += depth * dim
            log.resolved += len(places)
            yield int(left[at]), places, share
        left = left[~few]
        share *= GROWTH


class Best:
    """The best `k` of each query so far, over blocks."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), best first
        self.share = FIRST * GROWTH  # what most queries read of the block before
        self.log = Reading()

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        most = float(np.abs(self.queries.astype(float)).max(initial=0)) * float(np.abs(values.astype(float)).max(initial=0)) * max(values.shape[1], 1)
        if most >= 2.0**50:  # beyond that doubles are not exact: sums are taken in Python's integers, of all candidates
            return self.in_python(ids, values)
        kind = np.float32 if most < 2.0**22 else np.float64
        lists, plain = Lists(ids, values, kind), self.queries.astype(kind)
        by_id = np.argsort(ids, kind="stable")
        first, end = np.searchsorted(ids[by_id], self.ids, "left"), np.searchsorted(ids[by_id], self.ids, "right")
        own = [by_id[a:b] if b > a else None for a, b in zip(first, end, strict=True)]
        bars = np.array([-x[-1][0] if len(x) == self.k else -np.inf for x in self.found], kind)
        shares = []
        for start in range(0, len(bars), QUERIES):
            part = slice(start, start + QUERIES)
            for i, left, share in qualified(lists, np.maximum(plain[part], 0), np.minimum(plain[part], 0), bars[part], own[part], self.k, max(FIRST, self.share / GROWTH), self.log):
                shares.append(share)
                scores = values[left] @ self.queries[start + i]
                order = np.lexsort((ids[left], -scores))[: self.k]
                self.keep(start + i, zip((-scores[order]).tolist(), ids[left[order]].tolist(), strict=True))
        if shares:
            self.share = min(1.0, float(np.median(shares)))

    def in_python(self, ids: np.ndarray, values: np.ndarray) -> None:
        held = values.astype(object)
        for i, query in enumerate(self.queries.astype(object)):
            scores = (min(max(int(s), -LONGEST - 1), LONGEST) for s in held @ query)
            self.keep(i, sorted((-s, int(x)) for s, x in zip(scores, ids, strict=True) if x != self.ids[i])[: self.k])

    def keep(self, i: int, more) -> None:
        self.found[i] = sorted([*self.found[i], *more])[: self.k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = 4096, query_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's `k` highest inner products among all vectors but its own.

    Components are floor(scale * x), x as a double; score is their integer inner product, ties go to the smaller vec_id.
    Vectors that are null or hold null or non-finite components take no part, nor do rows without an identifier; a query
    is compared with vectors of its own length. Rows with a query's identifier are its own; of several queries of one
    identifier one is asked. An identifier that is repeated is ranked once for each row. Fewer candidates than k give all of
    them; without queries or candidates there are no rows; other columns are left out. Scaled components and scores beyond
    64 bits are held at the ends of that range.

    Candidates are never moved: queries go to them, dealt by a hash of their identifier into sets of about `query_bytes`
    that are broadcast one after the other. A task hands on at most k rows for each query.
    """
    candidates = quantised(vectors, key, vector, scale)
    asked = quantised(queries, key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    sets = max(1, -(-size // query_bytes))
    rows = [found_by_task(candidates, asked.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == i).toArrow(), k, block) for i in range(sets)]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found_by_task(candidates: DataFrame, asked: pa.Table, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: the best `k` of each task's candidates for each query."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    ids, flat, cuts = columns(asked)
    for dim in np.unique(np.diff(cuts)).tolist():
        own = np.flatnonzero(np.diff(cuts) == dim)
        by_dim[dim] = ids[own], flat[cuts[own][:, None] + np.arange(dim)] if dim else np.empty((len(own), 0), np.int64)
    shared = candidates.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(*own, k) for dim, own in shared.value.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {dim: [] for dim in best}

        def read(dim: int) -> None:
            if held[dim]:
                best[dim].add(*(np.concatenate(x) for x in zip(*held[dim], strict=True)))
                held[dim] = []

        for batch in batches:
            for start in range(0, batch.num_rows, block):
                ids, flat, cuts = columns(batch.slice(start, block))
                for dim in np.unique(np.diff(cuts)).tolist():
                    if dim not in best:
                        continue
                    own = np.flatnonzero(np.diff(cuts) == dim)
                    held[dim].append((ids[own], flat[cuts[own][:, None] + np.arange(dim)]))
                    if sum(len(x) for x, _ in held[dim]) >= block:
                        read(dim)
        for dim, own in best.items():
            read(dim)
            out = [(int(q), i, -s) for q, found in zip(own.ids, own.found, strict=True) for s, i in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def columns(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers, all components in a row, and where each vector's begin, with the end."""
    v = rows.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    cuts = np.concatenate([[0], np.cumsum(np.asarray(v.value_lengths(), np.int64))]).astype(np.int64)
    return rows.column("id").to_numpy(), np.asarray(v.flatten(), np.int64), cuts
