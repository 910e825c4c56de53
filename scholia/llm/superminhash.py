"""Operator 12, near duplicates by SuperMinHash.

A document is the set of its word shingles.  Each shingle draws one random
permutation of the ROWS places of a signature, step by step: at step j it
takes a random place among those it has not had, with the value j plus a
random fraction; a place keeps the least value that any shingle gives it.
Two sets agree in a place with the probability of their Jaccard similarity,
and as a shingle's ranks are tied to one another the number of places that
agree varies less than with independent hashes.  A value of step j is below
all of step j + 1, so a text is done as soon as every place has a value:
a long one after the first step.

Signatures are cut into bands of BAND_ROWS; sets that agree in a whole band
share a bucket.  Two sets at the least similarity of 0.8 share none of the 32
buckets with a chance of 5 in 100 million.

Not all pairs of a bucket are made.  Round one compares its members with two
pivots: the member with the most company over all its buckets (the original
of edited copies) and one other.  Round two compares only members that are
still in different components: those outside a bucket's largest component
with the rest.  Where that would be more than CROWD pairs (a bucket of many
texts that share a passage, or are copies somewhat less alike than 0.8), the
bucket's sets go an exact way: rarest shingles first, sets that are similar
enough share one of their first few, which texts that share only what is
common don't; candidates are made from that index alone.  Pairs whose
signatures agree in less than AGREE of the places are left out (a pair at 0.8
is 5.5 standard deviations above), all others are confirmed by the exact
intersection of the full sets.

Links are grouped by union-find within each task, which leaves a forest, and
by large and small stars over the forests of all tasks.  No number, list or
fingerprint of all documents reaches the driver but a Bloom filter of a
fixed size.

Defined cases: A-Z are lower-cased, words are runs without 0x20 and 0x09 to
0x0D; fewer words than a shingle's make one shingle of them all; a null or
empty text, or one without words, has no shingles, links with nothing and is
its own component; a very long text is worked through in blocks and keeps all
its shingles; repeated rows and ids are kept, a row each; a null id is kept,
a component's smallest id leaves nulls out, and such a row counts as kept
only if its component has no id at all; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import to_workers
from .components import components
from .jaccard import BLOOM_BITS, Join, Sets, _bloom, _fetch
from .skew import salted_join
from .store import keep

ROWS, BAND_ROWS = 128, 4
BANDS = ROWS // BAND_ROWS
#: Pairs of one bucket in round two beyond which its sets go the exact way.
CROWD = 1024
#: Least share of equal places, for a similarity of 0.8.
AGREE = 0.6
#: Pairs whose shingles one task gets of one set.
PAIRS_AT_ONCE = 64
UNSET = np.uint32(0xFFFFFFFF)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set of 64-bit hashes ``values[offsets[i]:offsets[i + 1]]``: step in the high 8 bits, fraction below."""
    n_sets = len(offsets) - 1
    out = np.full(n_sets * ROWS, UNSET, np.uint32)
    owner = np.repeat(np.arange(n_sets), np.diff(offsets))
    seed, order = arrays.mix(values + np.uint64(0x9E3779B97F4A7C15)), None
    for step in range(ROWS):
        if not len(seed):
            break
        draw = arrays.mix(seed + np.uint64((step + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(ROWS - step) >> np.uint64(32)).astype(np.int64)
        value = np.uint32(step << 24) | (draw >> np.uint64(40)).astype(np.uint32)
        if step:
            each = np.arange(len(seed))
            place = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, step]
        else:
            place = pick
        cell = owner * ROWS + place
        free = out[cell] >= np.uint32(step << 24)  # earlier steps have lower values
        np.minimum.at(out, cell[free], value[free])
        open_sets = (out.reshape(n_sets, ROWS) == UNSET).any(axis=1)
        left = open_sets[owner]
        if step == 0:  # a long text is done here: its shingles never get a permutation each
            owner, seed, pick = owner[left], seed[left], pick[left]
            order = np.tile(np.arange(ROWS, dtype=np.uint8), (len(seed), 1))
            order[np.arange(len(seed)), pick] = 0
        elif left.sum() < 0.7 * len(left):
            owner, seed, order = owner[left], seed[left], order[left]
    return out.reshape(n_sets, ROWS)


def _profile(words: int):
    """Per text: set size and digest; and the signature, for the first text with this set in this task."""

    def run(batches):
        sets, told = Sets(words), set()
        for batch in batches:
            n, ids, new, found = [], [], [], []

            def sign():
                offsets = np.cumsum([0, *map(len, found)])
                # the low 16 bits of a place's value tell values apart but for a chance of 1 in 65,536
                return [s.tobytes() for s in signatures(np.concatenate(found), offsets).astype(np.uint16)] if found else []

            signed: list = []
            held = 0
            for h in sets(batch["text"]):
                n.append(len(h))
                ids.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                new.append(bool(len(h)) and ids[-1] not in told)
                if new[-1]:
                    told.add(ids[-1])
                    found.append(h)
                    held += len(h)
                    if held > 1 << 15:
                        signed += sign()
                        found, held = [], 0
            signed += sign()
            at = iter(signed)
            yield pa.record_batch({"id": batch["id"], "n": pa.array(n, pa.int64()), "set_id": pa.array(ids, pa.binary()),
                                   "signature": pa.array([next(at) if x else None for x in new], pa.binary())})

    return run


def band_factors(seed: int, k: int) -> np.ndarray:
    return np.random.default_rng(arrays.SEED + seed).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)


def _bands(batches):
    """One row per set and band: the bucket's key, which holds the band in its lowest bits."""
    factors = band_factors(101, BAND_ROWS)
    for batch in batches:
        if not batch.num_rows:
            continue
        s = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        bands = np.arange(BANDS, dtype=np.uint64)
        keys = arrays.mix((s * factors).sum(axis=2, dtype=np.uint64) + arrays.mix(bands)) & ~np.uint64(BANDS - 1) | bands
        for a in range(0, len(keys), 2048):
            part = keys[a:a + 2048]
            yield pa.record_batch({"key": pa.array(part.reshape(-1).view(np.int64)), **{c: batch[c].slice(a, len(part)).take(pa.array(np.repeat(np.arange(len(part)), BANDS))) for c in ("set_id", "size")}})


def _texts_of(bloom, words: int):
    """The texts whose set's digest is in the Bloom filter, once per task and set."""

    def run(batches):
        bits, sets, told = np.frombuffer(bloom.value, np.uint8), Sets(words), set()
        for batch in batches:
            take = []
            for h in sets(batch["text"]):
                d = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
                new = d is not None and d not in told and all(bits[p >> 3] >> (p & 7) & 1 for p in (x % BLOOM_BITS for x in np.frombuffer(d, "<u8").tolist()))
                take.append(new)
                if new:
                    told.add(d)
            chosen = batch["text"].filter(pa.array(take, pa.bool_()))
            yield pa.record_batch({"id": pa.nulls(len(chosen), pa.int64()), "text": chosen})

    return run


def _agreeing(batches):
    """The pairs whose signatures agree in enough places."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, ROWS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= AGREE))


def _forest(batches):
    """Union-find over the links of each batch: a row per node that isn't its root, (node, root)."""
    for batch in batches:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.record_batch({"u": pa.array([x for x, _ in rows], pa.binary()), "v": pa.array([r for _, r in rows], pa.binary())})


def groups(links: DataFrame) -> DataFrame:
    """Components of ``links`` (u, v): node and component, its smallest node."""
    return components(links.mapInArrow(_forest, "u binary, v binary"))


class NearDuplicates:
    """The steps of one run; ``docs`` has id and text."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.rows = keep(docs.mapInArrow(_profile(words), f"id {dict(docs.dtypes)['id']}, n long, set_id binary, signature binary"), "near-rows")
        signed = self.rows.filter("signature IS NOT NULL").groupBy("set_id").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
        #: One row per distinct set.
        self.sets = keep(signed, "near-sets")

    def sizes_fit(self, n: str, m: str) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def buckets(self) -> DataFrame:
        """key, set_id, size (of the set) and n (members) of the buckets of several sets."""
        bands = self.sets.select("set_id", F.col("n").alias("size"), "signature").mapInArrow(_bands, "key long, set_id binary, size long")
        counts = keep(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-counts")
        return keep(salted_join(bands, counts, "key", counts=counts), "near-buckets")

    def fit(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with the similarity, as links (u, v)."""
        pairs = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        if not pairs.head(1):
            return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        one, two = (self.sets.select(F.col("set_id").alias(c), F.col("signature").alias(x)) for c, x in (("a", "x"), ("b", "y")))
        signed = salted_join(salted_join(pairs, one, "a", least=PAIRS_AT_ONCE), two, "b", counts=pairs.groupBy("b").agg(F.count("*").alias("n")), least=PAIRS_AT_ONCE)
        close = keep(signed.mapInArrow(_agreeing, "a binary, b binary"), "near-close")
        ends = close.select(F.col("a").alias("set_id")).union(close.select(F.col("b").alias("set_id"))).distinct()
        bloom = self.docs.sparkSession.sparkContext.broadcast(_bloom(ends))
        got = self.docs.select("text").mapInArrow(_fetch(bloom, self.words), "set_id binary, shingles array<long>")
        got = keep(got.dropDuplicates(["set_id"]), "near-shingles")
        both = F.size(F.array_intersect("x", "y"))
        enough = 100 * both >= self.percent * (F.size("x") + F.size("y") - both)
        met = salted_join(salted_join(close, got.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a", least=PAIRS_AT_ONCE),
                          got.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b", counts=close.groupBy("b").agg(F.count("*").alias("n")), least=PAIRS_AT_ONCE)
        return keep(met.filter(enough).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")

    def first_round(self, buckets: DataFrame) -> DataFrame:
        company = buckets.groupBy("set_id").agg(F.sum("n").alias("company"))
        pivots = buckets.join(company, "set_id").groupBy("key").agg(F.max(F.struct("company", "set_id", "size")).alias("most"), F.min(F.struct("set_id", "size")).alias("other"))
        pivots = keep(pivots.select("key", F.array(F.struct("most.set_id", "most.size"), "other").alias("pivots")), "near-pivots")
        counts = buckets.groupBy("key").agg(F.first("n").alias("n"))
        met = salted_join(buckets.select("key", "set_id", "size"), pivots, "key", counts=counts).withColumn("pivot", F.explode("pivots"))
        met = met.select(F.col("set_id").alias("a"), F.col("pivot.set_id").alias("b"), "size", F.col("pivot.size").alias("size2"))
        return self.fit(met.filter((F.col("a") != F.col("b")) & self.sizes_fit("size", "size2")))

    def second_round(self, buckets: DataFrame, links: DataFrame) -> DataFrame:
        found = groups(links).select(F.col("node").alias("set_id"), F.col("component").alias("label"))
        labelled = buckets.select("key", "set_id", "size").join(found, "set_id", "left").withColumn("label", F.xxhash64(F.coalesce("label", "set_id")))
        wide = self._several(keep(labelled, "near-labels"))
        large = F.col("others") * F.col("n") > CROWD
        found = self.fit(self._across(wide.filter(~large)))
        crowded = keep(wide.filter(large).select("set_id").distinct(), "near-crowded")
        return found.union(self.crowded_links(crowded, links)) if crowded.head(1) else found

    def crowded_links(self, crowded: DataFrame, links: DataFrame) -> DataFrame:
        """Links between sets of ``crowded`` that ``links`` leave in different components, by their rarest shingles."""
        bloom = self.docs.sparkSession.sparkContext.broadcast(_bloom(crowded))
        texts = keep(self.docs.select("text").mapInArrow(_texts_of(bloom, self.words), "id long, text string"), "near-crowded-texts")
        return Join(texts, self.words, self.percent).second_round(links)

    def _several(self, members: DataFrame) -> DataFrame:
        """Members of the buckets that hold several labels, with the largest label, the bucket's size and how many have another."""
        sizes = members.groupBy("key", "label").agg(F.count("*").alias("c"))
        lists = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("labels"))
        lists = keep(lists.filter("labels > 1").select("key", F.col("top.label").alias("main"), "n", (F.col("n") - F.col("top.c")).alias("others")), "near-lists")
        return keep(salted_join(members, lists, "key", counts=lists.select("key", "n")), "near-several")

    def _across(self, members: DataFrame) -> DataFrame:
        """Pairs of members of one bucket with different labels and compatible sizes, those of its largest label as one side only."""
        x = members.filter("label <> main").select("key", F.col("set_id").alias("a"), "size", "label")
        y = members.select("key", F.col("set_id").alias("b"), F.col("size").alias("size2"), F.col("label").alias("label2"))
        return x.join(y, "key").filter((F.col("label") != F.col("label2")) & self.sizes_fit("size", "size2")).select("a", "b")

    def links(self) -> DataFrame:
        buckets = self.buckets()
        first = self.first_round(buckets)
        return first.union(self.second_round(buckets, first))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included), kept (it is that one).

    ``percent``: least similarity in hundredths, 80 or more (the bands are laid out for 0.8).
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100: the bands find similarities of 0.8 and more")
    run = NearDuplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, percent)
    found = groups(run.links()).select(F.col("node").alias("set_id"), "component")
    some = run.rows.filter("n > 0").select("id", "n", "set_id")
    low = some.groupBy("set_id").agg(F.min("id").alias("low")).join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    low = keep(low, "near-lowest")
    lowest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    of_set = salted_join(low, lowest, "component").select("set_id", "component_id")
    out = salted_join(some, keep(of_set, "near-of-set"), "set_id").select("id", "n", "component_id")
    out = out.union(run.rows.filter("n = 0").select("id", "n", F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


to_workers(sys.modules[__name__])
