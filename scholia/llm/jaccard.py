"""Operator 8, n-gram Jaccard join: a grouped prefix join.

A document is the set of its word shingles.  All shingles are ordered by how
often their hash bucket comes in the corpus (rare first), then by hash; two
sets of n and m shingles with a Jaccard similarity of t or more then share a
shingle among the first n - ceil(t n) + 1 and m - ceil(t m) + 1.  Documents
with equal prefixes and size are one group; groups that share a prefix
shingle and have compatible sizes are candidates; candidate groups are
expanded to their members (distinct sets), which are filtered by parity
bitmaps (their Hamming distance is at most the size of the symmetric
difference) and verified by an exact intersection.

Linked groups need not be compared pair by pair to know their component, so
candidates come in two rounds.  Round one compares each group with two
pivots per shingle.  Round two compares only groups that round one left in
different components; in each shingle's list, the groups outside its
largest component are met with the rest.  Together they miss no link between
components, and a cluster of n near copies costs about n comparisons.

Nothing about all documents reaches the driver: the bucket counts are one
vector of a fixed size, the Bloom filter another.

Defined cases: A-Z are lower-cased, words are runs without 0x20 and 0x09 to
0x0D; fewer words than a shingle's make one shingle of them all; a null or
empty text, or one without words, has no shingles, links with nothing and is
its own component; repeated rows and ids are kept, a row each; a null id is
kept, and a component's smallest id leaves nulls out; extra columns are not
read; an empty table gives an empty result.
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
from .store import keep

#: Buckets of the shingle counts that the order goes by.
BUCKET_BITS = 20
SLICES = 64
#: Prefix shingles per part of the index.
PART_SHINGLES = 1 << 19
#: Bits of the Bloom filter over the sets that have to be fetched.
BLOOM_BITS = 1 << 23


class Sets:
    """Shingle sets of batches: yields the sorted distinct hashes of each text."""

    def __init__(self, words: int):
        self.k, self.hasher = words, arrays.WordHasher()

    def runs(self, column: pa.Array):
        texts = arrays.filled(column)
        for a, b in arrays.pieces(texts):
            words, at = self.hasher.words(*arrays.utf8(texts.slice(a, b - a)))
            yield words, at, arrays.shingles(words, self.k)

    def __call__(self, column: pa.Array):
        for words, at, runs in self.runs(column):
            for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
                yield np.unique(arrays.text_shingles(runs, words, first, end, self.k))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(hashes: np.ndarray) -> bytes:
    """Bitmap of a power of two of bits, about as many as the set has elements: how often each bit is hit, modulo 2."""
    bits = max(64, 1 << max(0, len(hashes) // 2).bit_length())
    hit = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Least possible size of the symmetric difference: Hamming distance of the bitmaps, the longer one folded."""
    if len(a) < len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    half = 4 * len(a)
    while half >= 8 * len(b):
        x = (x >> half) ^ (x & ((1 << half) - 1))
        half //= 2
    return (x ^ y).bit_count()


def _count(words: int):
    def run(batches):
        sets, counts, seen = Sets(words), np.zeros(1 << BUCKET_BITS, np.int64), False
        for batch in batches:
            for _, _, runs in sets.runs(batch["text"]):
                # runs across two texts are counted too: the order may be any, if it is one for all
                counts += np.bincount((runs >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
                seen = True
        if seen:
            yield arrays.counts_to_rows(counts, SLICES)

    return run


PROFILE = "n long, set_id binary, gid long, bitmap binary, prefix binary"


def _profile(order, words: int, percent: int):
    """Per text: set size, digest, group number, bitmap; and the prefix, for the first text of a group in this task."""

    def run(batches):
        rank, sets, told = order.value, Sets(words), set()
        for batch in batches:
            rows: list[tuple] = []
            for h in sets(batch["text"]):
                if not len(h):
                    rows.append((0, None, None, None, None))
                    continue
                place = np.argsort(rank[h >> np.uint64(64 - BUCKET_BITS)], kind="stable")  # hashes are sorted: ties go by hash
                head = h[place[:prefix_length(len(h), percent)]].tobytes()
                gid = int.from_bytes(hashlib.blake2b(head + len(h).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                rows.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), gid, parity(h), None if gid in told else head))
                told.add(gid)
            n, s, g, b, p = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch({"id": batch["id"], "n": pa.array(n, pa.int64()), "set_id": pa.array(s, pa.binary()), "gid": pa.array(g, pa.int64()),
                                   "bitmap": pa.array(b, pa.binary()), "prefix": pa.array(p, pa.binary())})

    return run


def _pack(parts: int):
    """Prefixes to one row per part and batch: the shingles of the part, with group, size and place of each."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = [np.frombuffer(p, np.uint64) for p in batch["prefix"].to_pylist()]
            lengths = np.array([len(h) for h in heads])
            token = np.concatenate(heads)
            row = np.repeat(np.arange(len(heads)), lengths)
            cells = np.empty(len(token), CELL)
            cells["token"], cells["gid"], cells["n"] = token, batch["gid"].to_numpy()[row], batch["n"].to_numpy()[row]
            cells["pos"] = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            part = (token % np.uint64(parts)).astype(np.int64)
            cells = cells[np.argsort(part, kind="stable")]
            ends = np.cumsum(np.bincount(part, minlength=parts))
            there = [(p, cells[a:b].tobytes()) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if b > a]
            yield pa.record_batch({"part": pa.array([t[0] for t in there], pa.int32()), "cells": pa.array([t[1] for t in there], pa.binary())})

    return run


CELL = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _shared(percent: int):
    """Rows sorted by part: the cells whose shingle another group of compatible size has too."""

    def prune(cells: list[bytes]) -> pa.RecordBatch:
        c = np.frombuffer(b"".join(cells), CELL)
        c = c[np.lexsort((c["gid"], c["n"], c["token"]))]
        new = np.ones(len(c), bool)  # a group may come from several tasks
        new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["gid"][1:] != c["gid"][:-1]) | (c["n"][1:] != c["n"][:-1])
        c = c[new]
        n = c["n"].astype(np.int64)
        close = (c["token"][1:] == c["token"][:-1]) & (100 * n[:-1] >= percent * n[1:])
        own = np.zeros(len(c), bool)
        own[1:] |= close
        own[:-1] |= close
        c = c[own]
        return pa.record_batch({"token": pa.array(c["token"].view(np.int64) if c["token"].flags.c_contiguous else np.ascontiguousarray(c["token"]).view(np.int64)),
                                "gid": pa.array(np.ascontiguousarray(c["gid"])), "n": pa.array(c["n"].astype(np.int64)), "pos": pa.array(c["pos"].astype(np.int64))})

    def run(batches):
        at, held = None, []
        for batch in batches:
            for part, cells in zip(batch["part"].to_pylist(), batch["cells"].to_pylist()):
                if part != at and held:
                    yield prune(held)
                    held = []
                at = part
                held.append(cells)
        if held:
            yield prune(held)

    return run


def _near(percent: int):
    """Keeps the pairs of sets whose sizes and bitmaps allow the similarity."""

    def run(batches):
        for batch in batches:
            good = []
            for n, m, a, b in zip(batch["n"].to_pylist(), batch["m"].to_pylist(), batch["bitmap"].to_pylist(), batch["bitmap2"].to_pylist()):
                # |A & B| = (n + m - d) / 2 and |A | B| = (n + m + d) / 2
                d = distance(a, b)
                good.append(100 * (n + m - d) >= percent * (n + m + d))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _fetch(bloom, words: int):
    """The shingle sets whose digest is in the Bloom filter, once per task and set."""

    def run(batches):
        bits, sets, told = np.frombuffer(bloom.value, np.uint8), Sets(words), set()
        ids, found, held = [], [], 0

        def out():
            values = pa.array(np.concatenate(found), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)
            return pa.record_batch({"set_id": pa.array(ids, pa.binary()), "shingles": lists})

        for batch in batches:
            for h in sets(batch["text"]):
                if len(h):
                    raw = h.tobytes()
                    d = hashlib.blake2b(raw, digest_size=16).digest()
                    if d not in told and all(bits[p >> 3] >> (p & 7) & 1 for p in (x % BLOOM_BITS for x in np.frombuffer(d, "<u8").tolist())):
                        told.add(d)
                        ids.append(d)
                        found.append(h.view(np.int64))
                        held += len(h)
                        if held >= PART_SHINGLES:
                            yield out()
                            ids, found, held = [], [], 0
        if ids:
            yield out()

    return run


def _bloom(ids: DataFrame) -> bytes:
    """Bloom filter of the digests in ``set_id``: one vector of BLOOM_BITS bits whatever the input."""

    def run(batches):
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            if batch.num_rows:
                bits[np.frombuffer(b"".join(batch["set_id"].to_pylist()), "<u8") % np.uint64(BLOOM_BITS)] = True
        if bits.any():
            words = np.packbits(bits, bitorder="little").view("<i8")
            there = np.flatnonzero(words)
            yield pa.record_batch({"word": pa.array(there, pa.int64()), "bits": pa.array(words[there], pa.int64())})

    out = np.zeros(BLOOM_BITS // 64, "<i8")
    rows = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


class Join:
    """The steps of one join; ``docs`` has id and text."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.context = docs.sparkSession.sparkContext
        counts = arrays.sum_counts(docs.select("text").mapInArrow(_count(words), arrays.COUNT_SCHEMA), SLICES, 1 << BUCKET_BITS)
        order = self.context.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
        kind = dict(docs.dtypes)["id"]
        self.rows = keep(docs.mapInArrow(_profile(order, words, percent), f"id {kind}, {PROFILE}"), "jaccard-rows")
        some = self.rows.filter("n > 0")
        #: One row per distinct set.
        self.sets = keep(some.groupBy("set_id").agg(F.first("gid").alias("gid"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "jaccard-sets")
        heads = some.filter("prefix IS NOT NULL").select("gid", "n", "prefix")
        total = heads.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
        parts = int(max(1, -(-total // PART_SHINGLES)))
        packed = heads.mapInArrow(_pack(parts), "part int, cells binary").repartition(parts, "part").sortWithinPartitions("part")
        #: token, gid, n, pos of the prefix shingles that groups of compatible sizes share.
        self.index = keep(packed.mapInArrow(_shared(percent), "token long, gid long, n long, pos long"), "jaccard-index")

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m))

    def expanded(self, pairs: DataFrame, mine: DataFrame, other: DataFrame) -> DataFrame:
        """Group pairs (g, h) to pairs of members (a, b): sets of ``mine`` in g with sets of ``other`` in h."""
        x = mine.select(F.col("gid").alias("g"), F.col("set_id").alias("a"), "n", "bitmap", *[F.col(c) for c in mine.columns if c == "label"])
        y = other.select(F.col("gid").alias("h"), F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("bitmap2"),
                         *[F.col(c).alias("label2") for c in other.columns if c == "label"])
        return pairs.join(x, "g").join(y, "h").filter((F.col("a") != F.col("b")) & self.sizes_fit(F.col("n"), F.col("m")))

    def near(self, members: DataFrame) -> DataFrame:
        found = members.select("a", "b", "n", "m", "bitmap", "bitmap2").mapInArrow(_near(self.percent), "a binary, b binary")
        return keep(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-near")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets with the similarity, by their exact intersection, as links (u, v)."""
        ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))).distinct()
        bloom = self.context.broadcast(_bloom(ends))
        got = self.docs.select("text").mapInArrow(_fetch(bloom, self.words), "set_id binary, shingles array<long>")
        got = keep(got.dropDuplicates(["set_id"]), "jaccard-shingles")
        a = got.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
        b = got.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        fit = 100 * both >= self.percent * (F.size("x") + F.size("y") - both)
        return keep(pairs.join(a, "a").join(b, "b").filter(fit).select(F.col("a").alias("u"), F.col("b").alias("v")), "jaccard-links")

    def first_round(self) -> DataFrame:
        """Each group with two pivots of every list it is in; inside a group, each set with the first.

        The first pivot has the shingle earliest in its own order: it has the
        fewest shingles rarer than what the list shares, as the original of
        edited copies has.  The second is any (the smallest number).
        """
        ends = self.index.groupBy("token").agg(F.min(F.struct("pos", "gid")).alias("first"), F.min("gid").alias("high"))
        ends = ends.select("token", F.col("first.gid").alias("low"), "high")
        met = self.index.select("token", "gid").join(ends, "token")
        pairs = met.select(F.explode(F.array("low", "high")).alias("g"), F.col("gid").alias("h")).filter("g <> h").distinct()
        heads = self.sets.groupBy("gid").agg(F.min("set_id").alias("set_id"))
        firsts = self.sets.join(heads, ["gid", "set_id"])
        more = self.sets.groupBy("gid").count().filter("count > 1").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
        return self.verified(self.near(self.expanded(pairs.union(more), firsts, self.sets)))

    def second_round(self, links: DataFrame) -> DataFrame:
        """All candidates between sets that ``links`` leave in different components."""
        found = components(links).select(F.col("node").alias("set_id"), F.col("component").alias("label"))
        labelled = keep(self.sets.join(found, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "jaccard-labels")
        # a group's label: its sets' if they have one, else one of its own
        own = F.when(F.min("label") == F.max("label"), F.xxhash64(F.min("label"))).otherwise(F.xxhash64(F.lit("mixed"), F.col("gid")))
        of_group = labelled.groupBy("gid").agg(own.alias("label"), F.count("*").alias("members"), (F.min("label") != F.max("label")).alias("mixed"))
        cells = keep(self.index.join(of_group.select("gid", "label"), "gid"), "jaccard-cells")
        lists = cells.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"))
        several = lists.filter("labels > 1").select("token", "main")
        left = keep(cells.join(several, "token"), "jaccard-lists")
        x = left.filter("label <> main").select("token", F.col("gid").alias("g"), "n", "pos", "label")
        y = left.select("token", F.col("gid").alias("h"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("label").alias("label2"))
        # most that two sets can share if this is the first shingle they have in common
        most = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos2"))
        fits = self.sizes_fit(F.col("n"), F.col("m")) & (100 * most >= self.percent * (F.col("n") + F.col("m") - most))
        pairs = x.join(y, "token").filter((F.col("label") != F.col("label2")) & fits)
        pairs = pairs.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
        inner = of_group.filter("mixed").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
        members = self.expanded(pairs.union(inner), labelled, labelled).filter("label <> label2")
        near = self.near(members)
        return self.verified(near) if near.head(1) else links.limit(0)


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    join = Join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, percent)
    links = join.first_round()
    links = links.union(join.second_round(links))
    found = components(links).select(F.col("node").alias("set_id"), "component")
    some = join.rows.filter("n > 0")
    low = some.groupBy("set_id").agg(F.min("id").alias("low")).join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    lowest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    of_set = low.join(lowest, "component").select("set_id", "component_id")
    out = some.join(of_set, "set_id").select("id", "n", "component_id").union(join.rows.filter("n = 0").select("id", "n", F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row of ``docs`` per component: the first by (id, nulls last; row number); rows without shingles all stay."""
    row, key = (next(n for i in range(len(docs.columns) + 1) if (n := f"{name}_{i}") not in docs.columns) for name in ("row", "key"))
    # stored, so that a row keeps its number
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-numbered")
    keys = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = similar_components(numbered.select(keys.alias(key), text_col), id_col=key, text_col=text_col, words=words, percent=percent)
    drop = found.filter(F.col(f"{key}.row") != F.col("component_id.row")).select(F.col(f"{key}.row").alias(row))
    return numbered.join(keep(drop, "jaccard-drop"), row, "left_anti").select(docs.columns)


to_workers(sys.modules[__name__])
