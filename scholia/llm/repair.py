"""Operator 13, conversation structure repair: a persistent audit DP.

A conversation, in order of its turns, is repaired by edits (Keep, Rerole,
Delete, Insert) so that its role initials read ``(s?(ua)+)?``.  A DP over
the rows keeps, for each state of that pattern, the cheapest edits so far;
of equally cheap ones the one whose letters come first in ASCII order.

Edits so far are linked nodes (``Edits``): a node holds one letter (or the
letters of a whole segment), its parent, its binary-lifting ancestors and the
rolling hash of all letters up to it, so states share their common prefix.
Two candidates of equal cost are compared by the longest common prefix, found
by lifting both while their hashes differ; what the hashes call equal is
verified letter by letter up to the node that both share, and if it isn't
equal the whole letters are compared.

Spark does the rest.  Rows are dealt by range of (conversation, turn, role,
text), so a conversation of any length is spread over partitions; repeated
rows are found by a grouped minimum.  Each partition runs the DP over
segments of at most SEGMENT rows, from every state that a segment may begin
in; a second, much smaller pass joins the segments of a conversation in
order, with the same nodes.  Texts are shuffled twice: once into their order,
once to meet their edits, where repaired lines are put together in pieces of
at most PIECE characters (or one line).  Only a hash is made from a whole
conversation in one task, piece by piece, as SHA-256 has to be; a task never
holds more than a piece, and an audit is one value of the result.

Defined cases: nulls in role or text, and null keys in the damage's
``conv_id:turn``, are one space; rows with a null conv_id are one
conversation; rows of one turn go by role, the first 64 characters of the
text, then its digest; an empty role has no initial and can't be kept; role
and text are compared as they are after damage; extra columns are not read;
very long texts are moved whole and seldom; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import sys
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import to_workers
from .skew import salted_join
from .store import keep

#: Rows of a segment; characters of a repaired piece.
SEGMENT, PIECE = 512, 1 << 20
#: States: nothing yet, after the system row, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: State after a row with this initial is kept (or rerolled, for u and a), by state before.
AFTER = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


class Edits:
    """Linked nodes of edit letters.  Node 0 is the empty beginning."""

    def __init__(self):
        self.parent, self.depth, self.level, self.code, self.text, self.up = [0], [0], [0], [0], [""], [()]
        self._powers = [1]

    def _power(self, n: int) -> int:
        while len(self._powers) <= n:
            self._powers.append(self._powers[-1] * BASE % MODULUS)
        return self._powers[n]

    def add(self, parent: int, text: str, code: int | None = None) -> int:
        """A node with ``text`` after ``parent``; ``code``: the hash of ``text``, if known."""
        if code is None:
            code = reduce(lambda h, c: (h * BASE + ord(c)) % MODULUS, text, 0)
        node, up, at = len(self.parent), [parent], parent
        while len(self.up[at]) >= len(up) and at:
            at = self.up[at][len(up) - 1]
            up.append(at)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + len(text))
        self.level.append(self.level[parent] + 1)
        self.code.append((self.code[parent] * self._power(len(text)) + code) % MODULUS)
        self.text.append(text)
        self.up.append(tuple(up))
        return node

    def letters(self, node: int, stop: int = 0) -> str:
        """The letters after the node ``stop`` (an ancestor) up to ``node``."""
        out = []
        while node != stop:
            out.append(self.text[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def _lift(self, node: int, level: int) -> int:
        while (high := self.level[node] - level) > 0:
            up = self.up[node]
            node = up[min(high.bit_length(), len(up)) - 1]
        return node

    def _like(self, x: int, y: int) -> bool:
        return self.code[x] == self.code[y] and self.depth[x] == self.depth[y]

    def _same(self, x: int, y: int) -> bool:
        """Verify letter by letter that two nodes which the hash calls equal are; walks to their shared node only."""
        a = b = ""
        while x != y:
            if self.level[x] >= self.level[y]:
                a, x = self.text[x] + a, self.parent[x]
            else:
                b, y = self.text[y] + b, self.parent[y]
            k = min(len(a), len(b))
            if k:
                if a[len(a) - k:] != b[len(b) - k:]:
                    return False
                a, b = a[:len(a) - k], b[:len(b) - k]
        return a == b

    def before(self, x: int, y: int) -> bool:
        """Whether the letters of ``x`` come before those of ``y`` in ASCII order."""
        if x == y:
            return False
        level = min(self.level[x], self.level[y])
        p, q = self._lift(x, level), self._lift(y, level)
        if not self._like(p, q):
            for k in range(len(self.up[p]) - 1, -1, -1):
                if k < len(self.up[p]) and not self._like(self.up[p][k], self.up[q][k]):
                    p, q = self.up[p][k], self.up[q][k]
            a, b = self.text[p], self.text[q]
            p, q = self.parent[p], self.parent[q]
            if not (a.startswith(b) or b.startswith(a)) and self._same(p, q):
                return a < b
        if not self._same(p, q):  # two different texts with one hash
            p = q = 0
        return self.letters(x, p) < self.letters(y, q)


class Best:
    """The cheapest edits for each state that can be reached: state -> (cost, node)."""

    def __init__(self, edits: Edits, start: dict[int, tuple[int, int]]):
        self.edits, self.at = edits, dict(start)

    def offer(self, into: dict, state: int, cost: int, parent: int, text: str, code: int | None = None) -> None:
        known = into.get(state)
        if known is None or cost < known[0]:
            into[state] = (cost, self.edits.add(parent, text, code))
        elif cost == known[0]:
            node = self.edits.add(parent, text, code)
            if self.edits.before(node, known[1]):
                into[state] = (cost, node)

    def insert(self) -> None:
        """Rows put in here: at most a user and an assistant pay."""
        for state in (EMPTY, SYSTEM, ASSISTANT):
            if state in self.at:
                self.offer(self.at, USER, self.at[state][0] + INSERT, self.at[state][1], "I")
        if USER in self.at:
            self.offer(self.at, ASSISTANT, self.at[USER][0] + INSERT, self.at[USER][1], "I")

    def row(self, initial: str, bad: bool, cut_off: bool) -> None:
        self.insert()
        out: dict = {}
        more = CUT_OFF if cut_off else 0
        for state, (cost, node) in self.at.items():
            self.offer(out, state, cost + DELETE, node, "D")
            if not bad:
                if state in AFTER.get(initial, ()):
                    self.offer(out, AFTER[initial][state], cost + more, node, "K")
                self.offer(out, ASSISTANT if state == USER else USER, cost + REROLE + more, node, "R")
        self.at = out

    def end(self) -> tuple[int, int]:
        """Cost and node of the cheapest edits of a whole conversation."""
        self.insert()
        ends = [self.at[s] for s in (EMPTY, ASSISTANT) if s in self.at]
        best = ends[0]
        for e in ends[1:]:
            if e[0] < best[0] or e[0] == best[0] and self.edits.before(e[1], best[1]):
                best = e
        return best


def segment_cells(rows: list[tuple[str, bool, bool]], first: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letters) of the best edits of some rows; ``first``: a conversation begins here."""
    out = []
    for start in ((EMPTY,) if first else range(4)):
        best = Best(Edits(), {start: (0, 0)})
        for r in rows:
            best.row(*r)
        out += [(start, state, cost, best.edits.letters(node)) for state, (cost, node) in sorted(best.at.items())]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with the contract's faults put in; ``copy`` tells repeats apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    body = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(0), F.when(F.col("fault") == 3, 1).otherwise(0))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), F.explode(copies).alias("copy"))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows stored in order, with their part (a range of the order), their place in it, and the faults that a row alone shows."""
    width = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    order = ["conv_id", "turn", "role", "head", "digest"]
    keyed = keyed.repartitionByRange(width, *order).sortWithinPartitions(*order)
    keyed = keyed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() % (1 << 33))
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    keyed = keyed.withColumn("blank", last == "").withColumn("cut_off", ~last.isin(".", "!", "?", ""))
    return keep(keyed.select("conv_id", "turn", "role", "text", "digest", "part", "place", "blank", "cut_off"), "repair-rows")


def with_repeats(ordered: DataFrame) -> DataFrame:
    """Narrow rows (no text) with ``again``: role and text were seen earlier in the conversation."""
    group = F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull(), "digest")
    some = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "part", "place", "blank", "cut_off", "digest", group.alias("group"))
    counts = ordered.select("conv_id", "digest", group.alias("group"), "part", "place")
    # a key (group) may be shared by chance: the conversation and digest tell
    firsts = counts.groupBy("group", "conv_id", "digest").agg(F.min(F.struct("part", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = keep(firsts, "repair-repeats")
    narrow = keep(some, "repair-narrow")
    met = salted_join(narrow, firsts.select("group", F.struct("conv_id", "digest", "first").alias("f")).groupBy("group").agg(F.collect_list("f").alias("firsts")), "group", "left",
                      counts=firsts.groupBy("group").agg(F.sum("n").alias("n")))
    mine = F.filter("firsts", lambda f: f["conv_id"].eqNullSafe(F.col("conv_id")) & (f["digest"] == F.col("digest")))
    again = F.coalesce(F.exists(mine, lambda f: f["first"] != F.struct("part", "place")), F.lit(False))
    return met.select("conv_id", "turn", "initial", "part", "place", "blank", "cut_off", again.alias("again"))


SEGMENT_FIELDS = ("part int, seg long, first boolean, rows long, blank long, duplicate long, truncated long, illegal long, "
                  "initial string, final string, low long, high long, turns long, begin long, cells array<struct<a:int,b:int,cost:long,letters:string>>")


def _segments(conv_type: pa.DataType):
    """Rows in order of (part, place) to segments of one conversation each."""

    def run(batches):
        rows: list[tuple] = []
        conv, part, whole = None, None, False  # whole: the conversation surely begins at its first row here
        begun = False  # an earlier segment of this run was given out
        out: list[dict] = []

        def cut() -> None:
            nonlocal rows, begun
            if not rows:
                return
            turns = [t for t, *_ in rows if t is not None]
            pairs = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:]))
            first = whole and not begun
            faults = [(i, blank or again, cut_off and not again and not blank) for _, i, _, blank, cut_off, again in rows]
            cells = segment_cells(faults, first)
            out.append({"conv_id": conv, "part": part, "seg": rows[0][2], "first": first, "rows": len(rows),
                        "blank": sum(r[3] for r in rows), "duplicate": sum(r[5] and not r[3] for r in rows), "truncated": sum(f[2] for f in faults), "illegal": pairs,
                        "initial": rows[0][1], "final": rows[-1][1], "low": min(turns, default=None), "high": max(turns, default=None),
                        "turns": len(set(turns)), "begin": rows[0][2], "cells": [dict(zip(("a", "b", "cost", "letters"), c)) for c in cells]})
            rows, begun = [], True

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_pylist(out, schema=SEGMENT_SCHEMA.insert(0, pa.field("conv_id", conv_type)))
            out = []
            return batch

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "part", "turn", "initial", "place", "blank", "cut_off", "again")]
            for c, p, turn, initial, place, blank, cut_off, again in zip(*columns):
                if p != part or c != conv:
                    cut()
                    whole, begun = p == part, False  # what a part begins with may have begun in the part before
                    conv, part = c, p
                elif len(rows) >= SEGMENT:
                    cut()
                rows.append((turn, initial, place, blank, cut_off, again))
            if len(out) > 2000:
                yield flush()
        cut()
        if out:
            yield flush()

    return run


CELL_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
SEGMENT_SCHEMA = pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("first", pa.bool_()), ("rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                            ("truncated", pa.int64()), ("illegal", pa.int64()), ("initial", pa.string()), ("final", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
                            ("turns", pa.int64()), ("begin", pa.int64()), ("cells", CELL_TYPE)])
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, part int, begin long, state int, letters string, done boolean"
RESULT_SCHEMA = pa.schema([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("part", pa.int32()), ("begin", pa.int64()),
                          ("state", pa.int32()), ("letters", pa.string()), ("done", pa.bool_())])


def _join_segments(conv_type: pa.DataType):
    """Segments in order of (conversation, part, seg): the result of each conversation (``done``) and the letters of each of its segments."""

    def run(batches):
        conv, there, best, places, sums, high, low, turns, last, edge = None, False, None, [], {}, None, None, 0, None, None
        out: list[dict] = []

        def close() -> None:
            if not there:
                return
            cost, node = best.end()
            edits, path = best.edits, []
            while node:
                path.append(node)
                node = edits.parent[node]
            path.reverse()
            pieces = [edits.text[n] for n in path]  # one node a segment, then those put in at the end
            letters = pieces[:len(places)]
            letters[-1] += "".join(pieces[len(places):])
            audit = "".join(letters)
            gaps = 0 if high is None else high - low + 1 - turns
            out.append({"conv_id": conv, "gaps": gaps, **sums, "cost": cost, "audit": audit, "done": True})
            states = [EMPTY] + [state_of[n] for n in path[:len(places) - 1]]
            for (part, begin), piece, before in zip(places, letters, states):
                out.append({"conv_id": conv, "part": part, "begin": begin, "letters": piece, "state": before, "done": False})

        state_of: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_pylist(out, schema=RESULT_SCHEMA.insert(0, pa.field("conv_id", conv_type)))
            out = []
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if not there or r["conv_id"] != conv:
                    close()
                    conv, there, best, places, high, low, turns, last, edge = r["conv_id"], True, Best(Edits(), {EMPTY: (0, 0)}), [], None, None, 0, None, None
                    sums, state_of = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), {}
                new: dict = {}
                for cell in r["cells"]:
                    if cell["a"] in best.at:
                        cost, node = best.at[cell["a"]]
                        best.offer(new, cell["b"], cost + cell["cost"], node, cell["letters"])
                best.at = new
                state_of |= {node: state for state, (_, node) in new.items()}
                places.append((r["part"], r["begin"]))
                for c in sums:
                    sums[c] += r[c]
                sums["illegal"] += last is not None and last + r["initial"] not in LEGAL
                last = r["final"]
                if r["high"] is not None:
                    turns += r["turns"] - (edge is not None and edge == r["low"])
                    edge = high = r["high"]
                    low = r["low"] if low is None else low
            if len(out) > 5000:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def _lines(conv_type: pa.DataType):
    """Texts and segment letters in order of (part, place), letters first: repaired lines put together in pieces."""

    def run(batches):
        state, letters, at, tail = EMPTY, "", 0, 0
        conv, part, first, held, size = None, None, 0, [], 0
        out: list[tuple] = []

        def cut() -> None:
            nonlocal held, size
            if held:
                out.append((conv, part, first, "\n".join(held)))
            held, size = [], 0

        def put(role: str, text: str, place: int) -> None:
            nonlocal first, size
            if not held:
                first = place
            held.append(f"{role}:{text}")
            size += len(text)

        def flush() -> pa.RecordBatch:
            nonlocal out
            conv_ids, parts, firsts, texts = zip(*out)
            out = []
            return pa.record_batch([pa.array(conv_ids, conv_type), pa.array(parts, pa.int32()), pa.array(firsts, pa.int64()), pa.array(texts, pa.large_string()).cast(pa.string())],
                                   names=["conv_id", "part", "place", "piece"])

        for batch in batches:
            for c, p, place, role, text, new, begin in zip(*(batch[x].to_pylist() for x in ("conv_id", "part", "place", "role", "text", "letters", "state"))):
                if p != part or c != conv:
                    cut()
                    conv, part = c, p
                if new is not None:
                    state, letters, at, tail = begin, new, 0, len(new.rstrip("I"))
                    continue
                while True:
                    edit = letters[at]
                    at += 1
                    if edit == "K":
                        state = AFTER[role[:1]][state]
                        put(role, text, place)
                    elif edit in "RI":
                        state = ASSISTANT if state == USER else USER
                        put("assistant" if state == ASSISTANT else "user", text if edit == "R" else "", place)
                    if edit != "I":
                        break
                while tail <= at < len(letters):  # put in at the end of the conversation
                    state = ASSISTANT if state == USER else USER
                    put("assistant" if state == ASSISTANT else "user", "", place)
                    at += 1
                if size > PIECE:
                    cut()
            if out:
                yield flush()
        cut()
        if out:
            yield flush()

    return run


def _hashes(conv_type: pa.DataType):
    """Pieces in order of (conversation, part, place): SHA-256 of each conversation's pieces, newline-joined."""

    def run(batches):
        conv, digest = None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch = pa.record_batch([pa.array([c for c, _ in out], conv_type), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])
            out = []
            return batch

        for batch in batches:
            for c, piece in zip(batch["conv_id"].to_pylist(), batch["piece"].to_pylist()):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(piece.encode())
            yield flush()
        if digest is not None:
            out.append((conv, digest.hexdigest()))
        yield flush()

    return run


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair ``rows`` (conv_id, turn, role, text, none null but conv_id and turn).

    Two tables: per conversation its faults, cost and audit; and the repaired
    lines (``role:text``, newline-joined) in pieces by conv_id, part, place.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = dict(rows.dtypes)["conv_id"]
    conv_type = to_arrow_type(rows.schema["conv_id"].dataType)
    width = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = in_order(rows)
    narrow = with_repeats(ordered).repartition(width, "part").sortWithinPartitions("part", "place")
    segments = keep(narrow.mapInArrow(_segments(conv_type), f"conv_id {kind}, {SEGMENT_FIELDS}"), "repair-segments")
    joined = segments.repartition(width, "conv_id").sortWithinPartitions("conv_id", "part", "seg")
    results = keep(joined.mapInArrow(_join_segments(conv_type), f"conv_id {kind}, {RESULT}"), "repair-results")
    letters = results.filter("NOT done").select("conv_id", "part", F.col("begin").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "letters", "state")
    texts = ordered.select("conv_id", "part", "place", "role", "text", F.lit(None).cast("string").alias("letters"), F.lit(None).cast("int").alias("state"))
    both = letters.union(texts).withColumn("kind", F.col("letters").isNull()).repartition(width, "part").sortWithinPartitions("part", "place", "kind")
    lines = both.drop("kind").mapInArrow(_lines(conv_type), f"conv_id {kind}, part int, place long, piece string")
    return results.filter("done").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), lines


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Damage ``conversations`` (conv_id, turn, role, text) by the contract's rule, repair it, and tell of each original conversation
    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = dict(conversations.dtypes)["conv_id"]
    conv_type = to_arrow_type(conversations.schema["conv_id"].dataType)
    width = max(conversations.sparkSession.sparkContext.defaultParallelism, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    results, lines = repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    pieces = lines.repartition(width, "conv_id").sortWithinPartitions("conv_id", "part", "place")
    hashes = pieces.mapInArrow(_hashes(conv_type), f"conv_id {kind}, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    known = results.withColumnRenamed("conv_id", "known_id").join(hashes.withColumnRenamed("conv_id", "hash_id"), F.col("known_id").eqNullSafe(F.col("hash_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(known, F.col("id").eqNullSafe(F.col("known_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


to_workers(sys.modules[__name__])
