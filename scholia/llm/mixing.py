"""Operator 7, mixing sources to target weights.

Each source's documents, in a pseudorandom order, form one stream of words
that is packed into blocks of a fixed length.  A mix is a row of slots, cut
into output shards; every shard draws how many of its slots each source gets
(multinomial counts, conditioned on the sources' totals so that no target is
missed by chance).  A source's slots are mapped through pseudorandom
permutations of its block numbers, one permutation per pass over the source,
and joined to the blocks by number.  The last slot of a source takes only
the words its target still lacks.

Defined cases: a null or empty text has no words and is never taken; a null
source is a source of its own, last in order; null and repeated ids are
kept, a row each; an empty table, or one without words, gives targets and
takings of 0; extra columns are not read.
"""

from __future__ import annotations

import sys
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import to_workers
from .store import keep

#: Words of a block, slots of an output shard.
BLOCK = 512
SHARD_SLOTS = 4096
#: The sources' weights, repeating, and the cap as a multiple of a source's size.
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a source whose words are counted before the running sums: each is a window of its own.
PARTS = 1024
#: Bound on the number of sources (their names and sizes are planned on the driver).
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights=WEIGHTS, cap: int = CAP) -> list[float]:
    """Shares of all words by weight; a source stops at ``cap`` times its size, the excess reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        full = {i for i in open_ if left * w[i] / total > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ -= full
    return out


class Permutation:
    """A pseudorandom permutation of 0 .. n - 1: a Feistel network, walked until it lands inside."""

    ROUNDS = 4

    def __init__(self, n: int, key: tuple[int, ...]):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(1, 1 << 63, self.ROUNDS, dtype=np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xD1342543DE82EF95)
        return ((x ^ x >> np.uint64(29)) * np.uint64(0xAF251AF3B0F025B5) >> np.uint64(24)) & self.mask

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            a, b = (b ^ self._mixed(a, key), a) if back else (b, a ^ self._mixed(b, key))
        return a << self.half | b

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._step(np.asarray(x, np.uint64), back)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._step(x[out], back)
        return x.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, True)


@dataclass(frozen=True)
class Share:
    """What the mix takes of one source."""

    number: int
    source: str | None
    size: int
    target: float
    slots: int
    last: int  # words in the last slot

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK)

    def words(self) -> int:
        return min(round(self.target), CAP * self.size)


def share(number: int, source: str | None, size: int, target: float, seed: int = SEED) -> Share:
    """Slots for the target's words: whole passes, and as many slots of the next pass as it takes."""
    me = Share(number, source, size, target, 0, 0)
    if not me.words():
        return me
    n = me.blocks
    passes, rest = divmod(me.words(), size)
    if not rest:  # the last slot is whole: as long as the block that the last pass ends with
        end = int(Permutation(n, (seed, number, passes - 1))([n - 1])[0])
        return Share(number, source, size, target, passes * n, _length(me, end))
    short = int(Permutation(n, (seed, number, passes)).inverse([n - 1])[0])  # where the short block comes
    lack = n * BLOCK - size
    slots = -(-rest // BLOCK)
    if slots > short and slots * BLOCK - lack < rest:
        slots += 1
    end = int(Permutation(n, (seed, number, passes))([slots - 1])[0])
    before = (slots - 1) * BLOCK - (lack if short < slots - 1 else 0)
    return Share(number, source, size, target, passes * n + slots, min(rest - before, _length(me, end)))


def _length(s: Share, block: int) -> int:
    return min(BLOCK, s.size - block * BLOCK)


def draw(rng: np.random.Generator, totals: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` slots each source gets, out of ``totals`` slots: counts drawn source by source."""
    out, rest = np.zeros(len(totals), np.int64), int(totals.sum())
    for i, good in enumerate(totals.tolist()):
        bad = rest - good
        low, high = max(0, n - bad), min(good, n)
        if low == high:
            got = low
        elif rest < 10 ** 9:
            got = int(rng.hypergeometric(good, bad, n))
        else:  # numpy's draw ends here; at this size the counts are normal to many digits
            p = good / rest
            got = int(min(high, max(low, round(rng.normal(n * p, (n * p * (1 - p) * (rest - n) / (rest - 1)) ** 0.5)))))
        out[i], n, rest = got, n - got, bad
    return out


def shard_counts(shares_slots: np.ndarray, shard: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard, slots of each in it).

    Shards are halved again and again; each half's counts are drawn with a
    seed of its own, so a shard finds its counts alone, in log2(shards) draws.
    """
    first, end = 0, shards
    before, totals = np.zeros(len(shares_slots), np.int64), shares_slots.copy()
    every = int(totals.sum())
    edge = lambda k: min(k * SHARD_SLOTS, every)
    while end - first > 1:
        middle = (first + end) // 2
        left = draw(np.random.default_rng((seed, first, end)), totals, edge(middle) - edge(first))
        if shard < middle:
            totals, end = left, middle
        else:
            before, totals, first = before + left, totals - left, middle
    return before, totals


def slots(spark: SparkSession, shares: list[Share], seed: int = SEED) -> DataFrame:
    """One row per slot: shard, slot, source number, pass, block, words it takes of the block."""
    counts = np.array([s.slots for s in shares], np.int64)
    shards = -(-int(counts.sum()) // SHARD_SLOTS)
    plan = spark.sparkContext.broadcast(([astuple(s) for s in shares], counts))  # plain values: a broadcast pickles classes by name

    def run(frames):
        held, numbers = [Share(*s) for s in plan.value[0]], plan.value[1]
        for frame in frames:
            for shard in frame["id"]:
                before, own = shard_counts(numbers, int(shard), shards, seed)
                parts = []
                for s, first, n in zip(held, before.tolist(), own.tolist()):
                    at = np.arange(first, first + n, dtype=np.int64)
                    for p in range(first // s.blocks, (first + n - 1) // s.blocks + 1) if n else ():
                        mine = at[at // s.blocks == p]
                        block = Permutation(s.blocks, (seed, s.number, p))(mine % s.blocks)
                        words = np.minimum(BLOCK, s.size - block * BLOCK)
                        words[mine == s.slots - 1] = s.last
                        parts.append(pd.DataFrame({"source": s.number, "pass": p, "block": block, "words": words}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    order = np.random.default_rng((seed, 1, int(shard))).permutation(len(out))
                    yield out.iloc[order].assign(shard=shard, slot=np.arange(len(out)))[["shard", "slot", "source", "pass", "block", "words"]]

    schema = "shard long, slot long, source int, pass int, block long, words long"
    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, shards, 1, tasks).mapInPandas(run, schema)


@dataclass
class Mix:
    """``rows``: row, id, source number, size, start (first word in the source's stream); ``slots``; ``shares``."""

    rows: DataFrame
    slots: DataFrame
    shares: list[Share]

    def segments(self) -> DataFrame:
        """One row per document part in a block: source, block, row, first word in the document, offset in the block, words."""
        end = F.col("start") + F.col("size")
        at = self.rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))))
        low = F.greatest("start", F.col("block") * BLOCK)
        return at.select("source", "block", "row", "id", (low - F.col("start")).alias("first_word"), (low - F.col("block") * BLOCK).alias("offset"),
                         (F.least(end, (F.col("block") + 1) * BLOCK) - low).alias("n_words"))

    def mixed(self) -> DataFrame:
        """The mix itself: per slot, the document parts it holds, in order of shard, slot and offset."""
        n = F.greatest(F.lit(0), F.least(F.col("n_words"), F.col("words") - F.col("offset")))
        # both sides grow with the corpus; the slots' size is unknown to the planner, which would broadcast them
        return (self.slots.hint("merge").join(self.segments(), ["source", "block"])
                .select("shard", "slot", "source", "pass", "block", "row", "id", "first_word", "offset", n.alias("n_words")).filter("n_words > 0"))

    def taken(self) -> DataFrame:
        """One row per document: row, id, source number, size, taken."""
        took = self.mixed().groupBy("row").agg(F.sum("n_words").alias("taken"))
        return self.rows.join(took, "row", "left").select("row", "id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("name"), size.alias("size"))
    sized = keep(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # a row number that stays
    sums = sized.groupBy("name").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r["name"] is None, r["name"] or ""))
    aims = targets([r["size"] for r in sums])
    shares = [share(i, r["name"], r["size"], t, seed) for i, (r, t) in enumerate(zip(sums, aims))]
    names = spark.createDataFrame([(s.source, s.number) for s in shares], "name string, source int")
    rows = sized.join(F.broadcast(names), sized["name"].eqNullSafe(names["name"])).select("row", "id", "source", "size")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    # running sums: of the parts of a source, then inside each part
    of_part = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("part")
    of_part = of_part.select("source", "part", (F.sum("words").over(w) - F.col("words")).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("h", "id", "size", "row")
    rows = rows.withColumn("run", F.sum("size").over(inside) - F.col("size")).join(of_part, ["source", "part"])
    rows = keep(rows.select("row", "id", "source", "size", (F.col("base") + F.col("run")).alias("start")), "mix-rows")
    return Mix(rows, slots(spark, shares, seed), shares)


def mix_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's), taken (words the mix takes of it)."""
    m = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    facts = docs.sparkSession.createDataFrame([(s.number, s.size, s.target) for s in m.shares], "source int, source_size long, target double")
    out = m.taken().join(F.broadcast(facts), "source")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


to_workers(sys.modules[__name__])
