"""Operator 5, exact top-k search by inner product: MaxScore.

Vectors are dealt to shards; a shard's postings hold, per term (dimension),
the vectors that have it with their integer weights, in order of ids.  For a
query, the postings' largest and smallest weights bound what a term can add.
Terms are ordered by that bound.  The weakest terms whose bounds together do
not pass the threshold (the k-th best score so far) are non-essential: a
vector that has none of the others can't enter the result.  The shard is
read in blocks: the postings of the essential terms are traversed, and the
non-essential terms are probed, strongest first, only for the vectors found
there that can still pass the threshold.  Each block may raise the threshold,
and with it the number of non-essential terms; once all terms are, the rest
of the shard is not read.  The shards' best are merged.

All scores are exact integers: products run in double precision only where
every partial sum stays under 2^53, else in 64-bit integers, else in Python
integers (a score over 64 bits then fails the query).

A shard takes ``SHARD_ROWS`` vectors on average, so its memory does not grow
with the corpus, and queries stream through it in batches.

Defined cases: vectors that are null, or hold a null or non-finite
component, take no part, nor do rows with a null id; rows that repeat an id
are rows of their own, as queries (each has its ranks) and as candidates
(also of each other); components missing from a shorter vector count as 0,
an empty vector scores 0 with all; ties go to the smaller id; very long
vectors only make a shard larger; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import to_workers
from .store import keep

#: Vectors of a shard, on average, and shards at least (for small inputs).
SHARD_ROWS = 32768
LEAST_SHARDS = 12
#: Vectors of a shard's first block, which sets a threshold, and of later ones at most.
FIRST_BLOCK = 512
BLOCK = 8192
GROWTH = 8
#: Terms probed between two looks at what can still compete.
TERMS_AT_ONCE = 4


def non_essential(ahead: list, threshold) -> int:
    """How many of the weakest terms can't pass the threshold together (``ahead[m]``: bounds of the weakest m, summed)."""
    if threshold is None:
        return 0
    return max((m for m, most in enumerate(ahead) if most <= threshold), default=0)


class Shard:
    """Postings of one shard's vectors, in order of ids (``rows``: their row numbers)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.n = len(ids)
        self.place = {int(rows[i]): at for at, i in enumerate(order)}
        width = max((len(v) for v in vectors), default=0)
        matrix = np.zeros((width, self.n), vectors[0].dtype if vectors else np.int64)
        for at, i in enumerate(order):
            matrix[:len(vectors[i]), at] = vectors[i]
        # a term's postings: places of the vectors that have it, and the weights; a term that most vectors
        # have keeps a weight for each place instead (no places, 0 where a vector lacks it)
        self.postings = []
        for weights in matrix:
            there = np.flatnonzero(weights)
            self.postings.append((None, weights) if 2 * len(there) > self.n else (there, weights[there]))
        zero = lambda p: p[0] is not None or not len(p[1])
        self.high = np.array([max([*([0] if zero(p) else []), *([p[1].max()] if len(p[1]) else [])]) for p in self.postings], matrix.dtype)
        self.low = np.array([min([*([0] if zero(p) else []), *([p[1].min()] if len(p[1]) else [])]) for p in self.postings], matrix.dtype)
        self.largest = max([0, *map(abs, self.high.tolist()), *map(abs, self.low.tolist())])

    def _traverse(self, terms: list[int], q: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the terms' postings from place ``at`` to ``end``, and which places any of them holds."""
        sums, met = np.zeros(end - at, q.dtype), np.zeros(end - at, bool)
        for t in terms:
            there, weights = self.postings[t]
            if there is None:
                sums += q[t] * weights[at:end]
                met[:] = True
            else:
                a, b = np.searchsorted(there, (at, end))
                sums[there[a:b] - at] += q[t] * weights[a:b]
                met[there[a:b] - at] = True
        return sums, met

    def _probe(self, t: int, q: np.ndarray, places: np.ndarray, sums: np.ndarray) -> None:
        """Add term ``t`` to the sums of the vectors at ``places``."""
        there, weights = self.postings[t]
        if there is None:
            sums += q[t] * weights[places]
        elif len(there):
            at = np.minimum(np.searchsorted(there, places), len(there) - 1)
            has = there[at] == places
            sums[has] += q[t] * weights[at[has]]

    def search(self, row: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the best k vectors but that of ``row``, best first."""
        terms = [t for t in range(min(len(query), len(self.postings))) if query[t]]
        size = sum(abs(int(query[t])) for t in terms) * max(1, int(self.largest))
        kind = np.float64 if size < 2 ** 53 else np.int64 if size < 2 ** 63 else object
        q = query.astype(kind)
        bound = {t: max(int(query[t]) * int(self.high[t]), int(query[t]) * int(self.low[t])) for t in terms}
        terms.sort(key=lambda t: (bound[t], t))
        ahead = [0]
        for t in terms:
            ahead.append(ahead[-1] + bound[t])
        own = self.place.get(row)
        best: list[tuple] = []  # (-score, place): of equal scores the earlier place is the smaller id
        threshold, at, step = None, 0, max(k, FIRST_BLOCK)
        while at < self.n:
            end = min(self.n, at + step)
            weak = non_essential(ahead, threshold)
            if threshold is not None and terms and weak == len(terms):
                break
            sums, met = self._traverse(terms[weak:], q, at, end)
            # without a non-essential term a vector may compete that has no term at all (score 0)
            keep_ = met if weak else np.ones(end - at, bool)
            if own is not None and at <= own < end:
                keep_[own - at] = False
            if threshold is not None:
                keep_ &= (sums + ahead[weak] > threshold).astype(bool)
            places = np.flatnonzero(keep_)
            sums = sums[places]
            places += at
            for i in range(weak - 1, -1, -1):
                if not len(places):
                    break
                self._probe(terms[i], q, places, sums)
                if i % TERMS_AT_ONCE == 0:
                    may = (sums + ahead[i] > threshold).astype(bool)
                    places, sums = places[may], sums[may]
            if len(places) > k:
                edge = np.partition(sums, len(sums) - k)[len(sums) - k]
                may = (sums >= edge).astype(bool)
                places, sums = places[may], sums[may]
            best = sorted([*best, *zip((-sums).tolist(), places.tolist())])[:k]
            if len(best) == k:
                threshold = -best[-1][0]
            at, step = end, min(GROWTH * step, BLOCK)
        return [(-int(s), int(self.ids[i])) for s, i in best]


def _as_rows(lists: pa.ListArray) -> list[np.ndarray]:
    """Integer vectors of a list<double> column (values are whole)."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.int64) if not len(flat) or np.abs(flat).max() < 2.0 ** 62 else np.array([int(x) for x in flat], object)
    ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _searcher(k: int):
    def run(batches):
        """Rows come sorted by shard, and in it by kind: its vectors, then the queries."""
        at, ids, rows, vectors, shard = None, [], [], [], None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            columns = (batch[c].to_pylist() for c in ("shard", "query", "row", "id"))
            for s, query, row, i, v in zip(*columns, _as_rows(batch["vector"])):
                if s != at:
                    at, ids, rows, vectors, shard = s, [], [], [], None
                if not query:
                    ids.append(i)
                    rows.append(row)
                    vectors.append(v.astype(np.int32) if v.dtype != object and (not len(v) or np.abs(v).max() < 2 ** 31) else v)
                    continue
                if shard is None:
                    kind = object if any(r.dtype == object for r in vectors) else np.int64 if any(r.dtype == np.int64 for r in vectors) else np.int32
                    shard, vectors = Shard(np.array(ids, np.int64), np.array(rows, np.int64), [r.astype(kind) for r in vectors]), []
                found += [(row, i, score, j) for score, j in shard.search(row, v, k)]
            if found:
                names = ("query_row", "query_id", "score", "vec_id")
                yield pa.record_batch({n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*found))})

    return run


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as a double, or null if the vector takes no part."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: _floor(scale * x.cast("double"))))


def _floor(x: Column) -> Column:
    """floor as a double, also beyond the range of longs (where doubles are whole)."""
    return F.when(F.abs(x) < 2.0 ** 62, F.floor(x).cast("double")).otherwise(x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Per query row, its k best other rows: query_id, rank (from 1), vec_id, score."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("vector"), is_query.alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    shards = max(LEAST_SHARDS, math.ceil(rows.count() / SHARD_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "row", "id", "vector")
    asked = rows.filter("asked").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "row", "id", "vector")
    met = dealt.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "query", "id", "row")
    best = met.mapInArrow(_searcher(k), "query_row long, query_id long, score long, vec_id long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


to_workers(sys.modules[__name__])
