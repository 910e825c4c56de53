"""Operator 3, benchmark decontamination by SimHash windows.

Every benchmark item of w words has the SimHash of its weighted 5-word
shingles (weight: how often the shingle comes).  Every window of w words of
a document that shares enough shingles with the items of that size to reach
the similarity at all gets a SimHash too (others cannot pass the last test).
The 64-bit fingerprints are cut into 8 blocks; two fingerprints within
``radius`` differ in some block by at most radius // 8 bits, so looking a
window's blocks up among all block values that near an item's finds every
item within the radius.  Those candidates are verified by the exact weighted
Jaccard similarity of the shingles (sum of minima over sum of maxima).  A
shingle that comes more than once moves many votes together, so the distance
tells little: where the item or the window has one, the item is verified if it
shares shingles enough, whatever the distance.

Benchmark texts are collected in blocks of at most ``BLOCK_BYTES``, one pass
over the documents each, so what is shipped to tasks stays bounded however
large the benchmark grows.

Words are runs of letters, digits and underscores, lower-cased.  Defined
cases: null or empty texts and items match nothing; an item of fewer than 5
words is one shingle; a document shorter than an item is one window; copies
of an item or a document all report; a pair's best window is reported, ties
to the first; null ids are kept; extra columns are not read by ``find_leaks``
and pass unchanged through ``drop_leaks``.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import arrays
from .arrays import to_workers

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of windows at similarity 0.8 differ by about 10 of 64 bits, if no shingle is repeated; 23 is over 4 deviations more.
RADIUS = 23
BLOCKS = 8
BLOCK_BYTES = 1 << 20
UNKNOWN = np.uint64(0)
BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fingerprint(shingles: np.ndarray, weights: np.ndarray) -> int:
    """SimHash: the sign of each bit's weighted vote."""
    votes = ((shingles[:, None] & BIT) != 0) * 2.0 - 1.0
    return int(BIT[(votes * weights[:, None]).sum(axis=0) > 0].sum(dtype=np.uint64))


def similarity(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return low / (a.total() + b.total() - low) if low else 0.0


def near_bytes(radius: int) -> list[list[int]]:
    """Per byte value, the values within ``radius`` bits."""
    return [[y for y in range(256) if (x ^ y).bit_count() <= radius] for x in range(256)]


class Matcher:
    """A block of benchmark items with its word numbers, shingles and fingerprint index."""

    def __init__(self, items: list[tuple[object, str]], similar: float, radius: int):
        self.similar, self.radius = similar, radius
        self.items = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if w]
        # words get random numbers; those of no item get others when a window needs them
        vocabulary = sorted({w for _, ws in self.items for w in ws})
        self.number = dict(zip(vocabulary, self._hash(vocabulary).tolist()))
        self.shingles = [self._shingles(np.array([self.number[w] for w in ws], np.uint64)) for _, ws in self.items]
        self.bags = [Counter(s.tolist()) for s in self.shingles]
        every = np.unique(np.concatenate(self.shingles)) if self.items else np.zeros(0, np.uint64)
        self.every = every
        self.seen = np.zeros(1 << 20, bool)  # by the lowest bits: a shingle of no item mostly fails here
        self.seen[every & np.uint64((1 << 20) - 1)] = True
        near = near_bytes(radius // BLOCKS)
        self.prints = [self._print(b) for b in self.bags]
        # per size and block: block value -> items with a block value within radius // BLOCKS bits
        self.index: dict[tuple[int, int], list[list[int]]] = {}
        for k, (_, ws) in enumerate(self.items):
            for b in range(BLOCKS):
                table = self.index.setdefault((len(ws), b), [[] for _ in range(256)])
                for value in near[self.prints[k] >> 8 * b & 255]:
                    table[value].append(k)
        # per size: the items that hold a shingle, and of them those that repeat one
        self.holders: dict[int, dict[int, list[int]]] = {}
        self.uneven: dict[int, dict[int, list[int]]] = {}
        for k, bag in enumerate(self.bags):
            for lists in [self.holders, *[self.uneven] * (max(bag.values()) > 1)]:
                of_size = lists.setdefault(len(self.items[k][1]), {})
                for x in bag:
                    of_size.setdefault(x, []).append(k)
        self.sizes = sorted({len(ws) for _, ws in self.items})
        # the sizes of the items that hold a shingle: only windows of these are worth a look
        self.sizes_of: dict[int, list[int]] = {}
        for s, (_, ws) in zip(self.shingles, self.items):
            for x in set(s.tolist()):
                self.sizes_of.setdefault(x, []).append(len(ws))
        self.sizes_of = {x: sorted(set(n)) for x, n in self.sizes_of.items()}

    @staticmethod
    def _hash(words: list[str]) -> np.ndarray:
        texts = pa.array(words, pa.string())
        data, offsets = arrays.utf8(texts)
        hasher = arrays.WordHasher(fold_ascii=False)
        hasher.separator[:] = False  # a word is hashed whole
        return hasher.words(data, offsets)[0]

    @staticmethod
    def _shingles(numbers: np.ndarray) -> np.ndarray:
        if len(numbers) >= SHINGLE:
            return arrays.shingles(numbers, SHINGLE)
        return arrays.text_shingles(numbers, numbers, 0, len(numbers), SHINGLE)

    @staticmethod
    def _print(bag: Counter) -> int:
        return fingerprint(np.fromiter(bag.keys(), np.uint64, len(bag)), np.fromiter(bag.values(), np.float64, len(bag)))

    def windows(self, numbers: np.ndarray, n_words: int) -> dict[int, np.ndarray]:
        """Per window size, the starts of the windows that hold enough shingles of items of that size to be similar."""
        starts: dict[int, np.ndarray] = {}
        if n_words >= SHINGLE and len(self.every):
            runs = arrays.shingles(numbers, SHINGLE)
            at = np.flatnonzero(self.seen[runs & np.uint64((1 << 20) - 1)])
            place = np.searchsorted(self.every, runs[at])
            at = at[self.every[np.minimum(place, len(self.every) - 1)] == runs[at]]
            hits: dict[int, list[int]] = {}
            for i in at.tolist():
                for w in self.sizes_of[int(runs[i])]:
                    hits.setdefault(w, []).append(i)
            for w, places in hits.items():
                held = min(w, n_words) - SHINGLE + 1  # shingles of a window
                least = self.similar * (w - SHINGLE + 1 + held) / (1 + self.similar) - 1e-9
                if len(places) >= least:
                    first = np.arange(max(0, places[0] - held + 1), min(places[-1], max(0, n_words - w)) + 1)
                    own = np.searchsorted(places, first + held) - np.searchsorted(places, first)
                    first = first[own >= least]
                    if len(first):
                        starts[w] = first
        for w in self.sizes:  # items of under 5 words: their single shingle is the whole window
            if w < SHINGLE and n_words >= w:
                known = np.flatnonzero(numbers[:n_words - w + 1] != UNKNOWN)
                if len(known):
                    starts[w] = known
        return starts

    def sharing(self, bag: Counter, w: int) -> set[int]:
        """The items of w words that share shingles enough with a window, if it or the item repeats a shingle."""
        lists = (self.holders if max(bag.values()) > 1 else self.uneven).get(w, {})
        shared: Counter = Counter()
        for x, n in bag.items():
            for k in lists.get(x, ()):
                shared[k] += min(n, self.bags[k][x])
        return {k for k, low in shared.items() if low * (1 + self.similar) >= self.similar * (bag.total() + self.bags[k].total()) - 1e-9}

    def matches(self, text: str) -> dict[int, tuple[float, int, int]]:
        """Per item (by place), the best window: similarity, first word, Hamming distance."""
        words = words_of(text)
        numbers = np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        where = self.windows(numbers, len(words))
        for w, starts in sorted(where.items()):
            for a in starts.tolist():
                part, own = words[a:a + w], numbers[a:a + w]
                if w < SHINGLE and (own == UNKNOWN).any():
                    continue
                if (own == UNKNOWN).any():
                    own = own.copy()
                    strange = np.flatnonzero(own == UNKNOWN)
                    own[strange] = self._hash([part[j] for j in strange])
                bag = Counter(self._shingles(own).tolist())
                mark = self._print(bag)
                near = {k for b in range(BLOCKS) for k in self.index[w, b][mark >> 8 * b & 255]}
                sure = self.sharing(bag, w)
                for k in sorted(near | sure):
                    distance = (mark ^ self.prints[k]).bit_count()
                    if (k in sure or distance <= self.radius) and (s := similarity(bag, self.bags[k])) >= self.similar and s > best.get(k, (0.0,))[0]:
                        best[k] = (s, a, distance)
        return best


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Yield lists of (id, text) of at most BLOCK_BYTES together (one item at least)."""
    rows = benchmark.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col).isNotNull())
    block, held = [], 0
    for r in rows.orderBy(id_col, text_col).toLocalIterator():
        if block and held + len(r[1]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1])
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", similar: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per (document, item) with a window at the similarity or over it: ids, similarity, first_word, n_words, hamming."""
    spark = docs.sparkSession
    item_type = to_arrow_type(benchmark.schema[item_id_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)["id"], dict(benchmark.dtypes)[item_id_col]
    schema = f"id {kinds[0]}, item {kinds[1]}, similarity double, first_word long, n_words long, hamming int"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_id_col, item_text_col):
        out = out.union(rows.mapInArrow(_finder(spark.sparkContext.broadcast(items), similar, radius, item_type), schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_id_col})


def _finder(items, similar: float, radius: int, item_type: pa.DataType):
    def run(batches):
        matcher = Matcher(items.value, similar, radius)
        for batch in batches:
            ids, texts = batch["id"], arrays.filled(batch["text"])
            out = []
            for a, b in arrays.pieces(texts):
                for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    out += [(i, matcher.items[k][0], s, at, len(matcher.items[k][1]), h) for k, (s, at, h) in sorted(matcher.matches(text).items())]
            if out:
                i, item, s, at, n, h = zip(*out)
                yield pa.record_batch({"id": ids.take(pa.array(i)), "item": pa.array(item, item_type), "similarity": pa.array(s, pa.float64()),
                                       "first_word": pa.array(at, pa.int64()), "n_words": pa.array(n, pa.int64()), "hamming": pa.array(h, pa.int32())})

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
               similar: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without a window that matches an item."""
    at = docs.columns.index(text_col)

    def keeper(items):
        def run(batches):
            matcher = Matcher(items.value, similar, radius)
            for batch in batches:
                texts = arrays.filled(batch.column(at))
                clean = [not matcher.matches(t) for a, b in arrays.pieces(texts) for t in texts.slice(a, b - a).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for items in item_blocks(benchmark, item_id_col, item_text_col):
        docs = docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


to_workers(sys.modules[__name__])
