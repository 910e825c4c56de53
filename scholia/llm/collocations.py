"""Operator 11, phrase collocations: mergeable Misra-Gries summaries.

Phrases are runs of one to LONGEST words inside a piece of a text, counted
per language.  Every phrase has a 64-bit hash, of which some bits choose one
of ``parts`` hash partitions.

* Pass 0 adds up words per language and occurrences (mass) per partition.
* Pass 1 sums up phrases by Misra-Gries: a task counts its texts' phrases
  (hash and count), each partition merges what all tasks have.  A merged
  summary with more counters than its capacity takes the count of the first
  counter too many from all of them.  As the capacity exceeds mass /
  ``least``, no phrase loses ``least`` or more, so each with that many
  occurrences survives.  The loss is carried along: a counter that could not
  have had ``least`` occurrences before it is dropped.
* Pass 2 counts the survivors exactly: tasks pick them by a Bloom filter over
  the survivors (of at most BLOOM_BITS bits) and add up their own, each
  partition adds up what all tasks have.  What the filter lets through beside
  is counted too and then found too rare.

In pass 2 phrases are told apart by two independent 64-bit hashes.  Scores
are computed in decimals of 38 digits.

Defined cases: A-Z are lower-cased; a null text is empty; a null lang is
``und``, the same as that text; empty texts and tables give no phrase; very
long texts are worked through whole; repeated rows count as often as they
come; ids and extra columns are not read; ties are ranked by a, then by the
phrase's bytes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .arrays import to_workers
from .skew import salted_join
from .store import keep

LONGEST = 4
#: Pieces end at these bytes; words within a piece at spaces and tabs.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Counters of one partition's summary to aim at, and bounds on the number of partitions.
CAPACITY, MOST_PARTS = 1 << 18, 1 << 14
#: Occurrences that a task gathers before it sums them up, counters that it holds, phrases and bytes of texts that it holds in pass 2.
GATHER, HOLD, HOLD_PHRASES, HOLD_BYTES = 1 << 19, 2 << 20, 1 << 19, 1 << 24
BLOOM_BITS = 1 << 26
LOW = np.uint64(0xFFFFFFFF)


class Phrases:
    """Phrases of a batch of texts as arrays over their words."""

    def __init__(self, both: bool = False):
        gaps = PIECE_ENDS + b" \t"
        self.hashers = [arrays.WordHasher(separators=gaps, seed=arrays.SEED + i) for i in range(1 + both)]
        self.ends = np.zeros(256, bool)
        self.ends[list(PIECE_ENDS)] = True

    def __call__(self, texts: pa.Array, langs: pa.Array):
        """Per piece of the batch: bytes, words' starts and ends, words' hashes (of each kind), word counts of the texts, language of each
        word, and the number of the piece of text that each word is in."""
        texts = arrays.filled(texts)
        langs = langs.fill_null("und").cast(pa.string())
        for a, b in arrays.pieces(texts):
            data, offsets = arrays.utf8(texts.slice(a, b - a))
            if not len(data):
                continue
            starts, stops = self.hashers[0].spans(data, offsets)
            words = [h.words(data, offsets)[0] for h in self.hashers]
            coded = langs.slice(a, b - a).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            counts = np.diff(np.searchsorted(starts, offsets))
            row = np.repeat(np.arange(b - a), counts)
            closed = np.concatenate([[0], np.flatnonzero(self.ends[data])])
            place = np.searchsorted(closed, starts, "right") + row * 2  # goes up at each piece's end and at each text
            yield data, starts, stops, words, names, codes[row], place


def lang_seed(name: str) -> np.uint64:
    import hashlib

    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def runs(words: np.ndarray, place: np.ndarray, lang: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all runs of ``k`` words within a piece; ``lang`` is a number per word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(place[:n] == place[k - 1:])
    total = np.zeros(len(at), np.uint64)
    for j, f in enumerate(np.random.default_rng((arrays.SEED, k, salt)).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)):
        total += words[at + j] * f
    return at, arrays.mix(total ^ arrays.mix(lang[at] + np.uint64(k)))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition in the high 32 bits of a key, a hash within it in the low ones."""
    return (hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | hashes & LOW


def _measure(parts: int):
    def run(batches):
        phrases, mass, words = Phrases(), np.zeros(parts, np.int64), {}
        for batch in batches:
            for _, _, _, (hashes,), names, code, place in phrases(batch["text"], batch["lang"]):
                for name, n in zip(names, np.bincount(code, minlength=len(names)).tolist()):
                    words[name] = words.get(name, 0) + n
                lang = np.array([lang_seed(x) for x in names], np.uint64)[code]
                for k in range(1, LONGEST + 1):
                    mass += np.bincount((part_of(runs(hashes, place, lang, k)[1], parts) >> np.uint64(32)).astype(np.int64), minlength=parts)
        there = np.flatnonzero(mass)
        yield pa.record_batch({"lang": pa.array([*words, *[None] * len(there)], pa.string()), "part": pa.array([*[None] * len(words), *there.tolist()], pa.int32()),
                               "n": pa.array([*words.values(), *mass[there].tolist()], pa.int64())})

    return run


class Summary:
    """Misra-Gries counters over sorted keys; ``lost`` is the most that any key has lost."""

    def __init__(self, capacity: int | None = None):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        self.more.append((keys, counts))
        self.waiting += len(keys)
        self.lost += lost
        if self.waiting >= max(GATHER, self.capacity or 0):
            self.merge()

    def merge(self) -> None:
        if not self.more:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.more]])
        counts = np.concatenate([self.counts, *[c for _, c in self.more]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.more, self.waiting = [], 0
        if self.capacity is not None and len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut
            self.lost += cut


def _sum_up(parts: int):
    """Summaries of a task's texts, a row per partition: packed low hashes and counts."""

    def rows(summary: Summary) -> pa.RecordBatch:
        summary.merge()
        part = (summary.keys >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(parts + 1))
        low, counts = (summary.keys & LOW).astype(np.uint32), np.minimum(summary.counts, (1 << 32) - 1).astype(np.uint32)
        there = [p for p in range(parts) if edges[p + 1] > edges[p]]
        return pa.record_batch({"part": pa.array(there, pa.int32()), "low": pa.array([low[edges[p]:edges[p + 1]].tobytes() for p in there], pa.binary()),
                                "counts": pa.array([counts[edges[p]:edges[p + 1]].tobytes() for p in there], pa.binary())})

    def run(batches):
        phrases, summary = Phrases(), Summary()
        for batch in batches:
            for _, _, _, (hashes,), names, code, place in phrases(batch["text"], batch["lang"]):
                lang = np.array([lang_seed(x) for x in names], np.uint64)[code]
                keys = np.concatenate([part_of(runs(hashes, place, lang, k)[1], parts) for k in range(1, LONGEST + 1)])
                summary.add(keys, np.ones(len(keys), np.int64))
                if len(summary.keys) > HOLD:
                    yield rows(summary)
                    summary = Summary()
        if summary.more or len(summary.keys):
            yield rows(summary)

    return run


def _merge(capacity: dict[int, int], least: int):
    """Rows sorted by part to its survivors: keys whose count may have been ``least`` or more."""

    def survivors(part: int, summary: Summary) -> pa.RecordBatch:
        summary.merge()
        may = summary.counts + summary.lost >= least
        return pa.record_batch({"key": pa.array((np.uint64(part << 32) | summary.keys[may]).view(np.int64)), "lost": pa.array(np.full(int(may.sum()), summary.lost), pa.int64())})

    def run(batches):
        at, summary = None, None
        for batch in batches:
            for part, low, counts in zip(batch["part"].to_pylist(), batch["low"].to_pylist(), batch["counts"].to_pylist()):
                if part != at:
                    if summary is not None:
                        yield survivors(at, summary)
                    at, summary = part, Summary(capacity[part])
                summary.add(np.frombuffer(low, np.uint32).astype(np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64))
        if summary is not None:
            yield survivors(at, summary)

    return run


def bloom_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    x = arrays.mix(keys + np.uint64(0x632BE59BD9B4E019))
    return [x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)]


def _bloom(survivors: DataFrame) -> np.ndarray:
    """Packed bits of a Bloom filter of the survivors: 16 bits each, BLOOM_BITS at most."""
    n = survivors.count()
    bits = 1 << 16
    while bits < min(BLOOM_BITS, 16 * n):
        bits *= 2

    def run(batches):
        hit = np.zeros(bits, bool)
        for batch in batches:
            for p in bloom_places(batch["key"].to_numpy().view(np.uint64), bits):
                hit[p] = True
        words = np.packbits(hit, bitorder="little").view("<i8")
        there = np.flatnonzero(words)
        yield pa.record_batch({"word": pa.array(there, pa.int64()), "bits": pa.array(words[there], pa.int64())})

    out = np.zeros(bits // 64, "<i8")
    rows = survivors.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


class Counted:
    """Exact counts by two hashes, with one value per phrase (a place in a text, or the phrase itself) carried along."""

    def __init__(self):
        self.held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), None]
        self.more: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, *columns: np.ndarray) -> None:
        self.more.append(list(columns))
        self.waiting += len(columns[0])
        if self.waiting >= max(GATHER, len(self.held[0])):
            self.merge()

    def merge(self) -> None:
        if not self.more:
            return
        all_of = self.more if self.held[3] is None else [self.held, *self.more]
        one, two, n, value = (np.concatenate([x[i] for x in all_of]) for i in range(4))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[order], first) if len(first) else n
        self.held = [one[first], two[first], n, value[order[first]]]
        self.more, self.waiting = [], 0


def _count(parts: int, shared):
    """Occurrences of the phrases that the filter lets through, added up in each task: a row per partition with their hashes, counts and
    texts (the language, a line end, the phrase)."""

    def run(batches):
        bits = shared.value
        phrases, sums = Phrases(both=True), Counted()
        raws, size, langs, numbers = [], 0, [], {}

        def rows() -> pa.RecordBatch:
            nonlocal sums, raws, size
            sums.merge()
            one, two, n, value = sums.held
            raw = b"".join(raws)
            texts = [f"{langs[c]}\n{b' '.join(raw[a:b].split()).lower().decode()}" for a, b, c in zip(value["start"].tolist(), value["stop"].tolist(), value["lang"].tolist())] if value is not None else []
            part = (part_of(one, parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            there = [order[edges[p]:edges[p + 1]] for p in range(parts)]
            sums, raws, size = Counted(), [], 0
            return pa.record_batch({"part": pa.array([p for p, x in enumerate(there) if len(x)], pa.int32()),
                                    **{c: pa.array([v[x].tobytes() for x in there if len(x)], pa.binary()) for c, v in (("first", one), ("second", two), ("counts", n))},
                                    "texts": pa.array([[texts[i] for i in x] for x in there if len(x)], pa.list_(pa.string()))})

        for batch in batches:
            for data, starts, stops, (one, two), names, code, place in phrases(batch["text"], batch["lang"]):
                lang = np.array([lang_seed(x) for x in names], np.uint64)[code]
                number = np.array([numbers.setdefault(x, len(numbers)) for x in names], np.int32)[code]
                langs = list(numbers)
                for k in range(1, LONGEST + 1):
                    at, first = runs(one, place, lang, k)
                    listed = np.ones(len(first), bool)
                    for p in bloom_places(part_of(first, parts), len(bits) * 8):
                        listed &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    at = at[listed]
                    value = np.empty(len(at), PLACE)
                    value["start"], value["stop"], value["lang"] = starts[at] + size, stops[at + k - 1] + size, number[at]
                    sums.add(first[listed], runs(two, place, lang, k, 1)[1][listed], np.ones(len(at), np.int64), value)
                raws.append(data.tobytes())
                size += len(data)
                if len(sums.held[0]) > HOLD_PHRASES or size > HOLD_BYTES:
                    yield rows()
        if raws:
            yield rows()

    return run


PLACE = np.dtype([("start", "<i8"), ("stop", "<i8"), ("lang", "<i4")])


def _add_up(least: int):
    """Rows sorted by part to its phrases with ``least`` occurrences or more."""

    def frequent(counted: Counted) -> pa.RecordBatch:
        counted.merge()
        _, _, n, texts = counted.held
        enough = np.flatnonzero(n >= least)
        split = [texts[i].rsplit("\n", 1) for i in enough]
        return pa.record_batch({"lang": pa.array([x for x, _ in split], pa.string()), "words": pa.array([x.count(" ") + 1 for _, x in split], pa.int32()),
                                "phrase": pa.array([x for _, x in split], pa.string()), "n": pa.array(n[enough], pa.int64())})

    def run(batches):
        at, counted = None, None
        for batch in batches:
            for i, part in enumerate(batch["part"].to_pylist()):
                if part != at:
                    if counted is not None:
                        yield frequent(counted)
                    at, counted = part, Counted()
                one, two, n = (np.frombuffer(batch[c][i].as_py(), t) for c, t in (("first", np.uint64), ("second", np.uint64), ("counts", np.int64)))
                texts = np.empty(len(one), object)
                texts[:] = batch["texts"][i].as_py()
                counted.add(one, two, n, texts)
        if counted is not None:
            yield frequent(counted)

    return run


def frequent_phrases(docs: DataFrame, *, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of 1 to LONGEST words with ``least`` occurrences or more, and (lang, n) of all words."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    # a word takes two bytes at least, so this is above the mass that capacities allow for, until MOST_PARTS
    parts = int(min(MOST_PARTS, max(1, -(-LONGEST * (size // 2) // (least * CAPACITY)))))
    measured = keep(rows.mapInArrow(_measure(parts), "lang string, part int, n long").groupBy("lang", "part").agg(F.sum("n").alias("n")), "phrase-mass")
    capacity = {r["part"]: r["n"] // least + 1 for r in measured.filter("part IS NOT NULL").collect()}  # MOST_PARTS numbers at most
    summed = rows.mapInArrow(_sum_up(parts), "part int, low binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    survivors = keep(summed.mapInArrow(_merge(capacity, least), "key long, lost long"), "phrase-survivors")
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(survivors))
    counted = rows.mapInArrow(_count(parts, shared), "part int, first binary, second binary, counts binary, texts array<string>")
    counted = counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_add_up(least), "lang string, words int, phrase string, n long")
    return keep(counted, "phrases"), measured.filter("lang IS NOT NULL").select("lang", "n")


def exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, inside: int = 80, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    A phrase that lies in a longer one with ``inside`` hundredths of its
    occurrences or more is left out.
    """
    found, totals = frequent_phrases(docs, least=least, text_col=text_col, lang_col=lang_col)
    key = F.xxhash64("lang", "phrase")
    words = F.split("phrase", " ", -1)
    # each candidate with its cuts, and each with its parts that lie inside
    candidates = found.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", words.alias("w"))

    def run_of(start, length) -> Column:
        return F.array_join(F.slice("w", start, length), " ")

    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run_of(F.lit(1), F.col("k")).alias("left"), run_of(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = keep(cuts.withColumn("left_key", F.xxhash64("lang", "left")).withColumn("right_key", F.xxhash64("lang", "right")), "phrase-cuts")
    # keys are hashes, so that they are narrow; the phrase itself decides
    of_left = found.select(key.alias("left_key"), F.col("lang").alias("lang2"), F.col("phrase").alias("phrase2"), F.col("n").alias("l"))
    of_right = found.select(key.alias("right_key"), F.col("lang").alias("lang3"), F.col("phrase").alias("phrase3"), F.col("n").alias("r"))
    met = salted_join(cuts, of_left, "left_key").filter("lang = lang2 AND left = phrase2").drop("lang2", "phrase2", "left_key")
    counts = cuts.groupBy("right_key").agg(F.count("*").alias("n"))
    met = salted_join(met, of_right, "right_key", counts=counts).filter("lang = lang3 AND right = phrase3")
    score = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = met.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    spans = [F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for k in range(2, LONGEST) for s in range(1, LONGEST - k + 2)]
    fits = F.filter(F.array(*spans), lambda x: (x["k"] < F.col("words")) & (x["s"] + x["k"] - 1 <= F.col("words")))
    held = candidates.filter("words > 2").select("lang", "a", "w", F.explode(fits).alias("x")).select("lang", run_of(F.col("x.s"), F.col("x.k")).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    # a phrase inside a candidate is one itself
    kept = scored.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * exact("longer") < inside * exact("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's rows are ranked in 64 portions first, so that none goes whole to one task
    portion = kept.withColumn("portion", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = portion.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "portion").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


to_workers(sys.modules[__name__])
