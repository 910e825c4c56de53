"""Operator 10, secret scans: a trigram inverted index in front of the rules.

From each rule's regular expression a Boolean trigram query is derived: every
text the rule can match holds, for each clause, all trigrams of one of the
clause's alternatives.  Each piece of the corpus (a few MB of whole texts)
gets an inverted index of the trigrams that queries name, as a bitmap of
texts per trigram; postings are combined by the query, and only the texts
left are verified with the rule.  A rule without a mandatory trigram scans
every text.  The index of a piece lives as long as its scan, so the corpus
is read once, nothing is shuffled, and a lost executor repeats only its pieces.

Defined cases: a null or empty text has no spans; repeated rows are scanned
alike and each kept; null ids are kept; extra columns are not read by
``scan`` and pass unchanged through ``redact``; very long texts are scanned
whole; spans of two rules may overlap, and then both are reported; redaction
joins overlapping spans into one.
"""

from __future__ import annotations

import hashlib
import re
import sys
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import to_workers


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` of which ``group`` has ``least`` characters or more; shorter ones are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


#: The patterns of the kinds and their least lengths.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Alternatives of one clause; a part with more is taken as unknown.
ALTERNATIVES = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of alternatives (one must) of lower-case trigrams (all present)."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if min(map(len, strings)) >= 3:
            clauses.append([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])

    def exact(items) -> set[str] | None:
        """All strings the items can match, if they are few."""
        out = {""}
        for op, arg in items:
            got = one(op, arg)
            if got is None:
                return None
            out = {a + b for a in out for b in got}
            if len(out) > ALTERNATIVES:
                return None
        return out

    def one(op, arg) -> set[str] | None:
        if op is K.LITERAL:
            return {chr(arg).lower()}
        if op is K.IN and all(x[0] is K.LITERAL for x in arg) and len(arg) <= 4:
            return {chr(x[1]).lower() for x in arg}
        if op is K.SUBPATTERN:
            return exact(arg[3])
        if op is K.BRANCH:
            each = [exact(x) for x in arg[1]]
            return None if any(x is None for x in each) else set().union(*each)
        if op is K.MAX_REPEAT and arg[1] == 1:
            got = exact(arg[2])
            return got if got is None or arg[0] else got | {""}
        return None

    strings = {""}
    for op, arg in parser.parse(pattern):
        got = one(op, arg)
        joined = {a + b for a in strings for b in got} if got is not None else set()
        if got is None or len(joined) > ALTERNATIVES:
            close(strings)
            joined = got or {""}
        strings = joined
    close(strings)
    return clauses


class Scanner:
    """The rules with their queries, and the index over one piece of the corpus at a time."""

    def __init__(self, rules):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        names = sorted({t for _, _, q in self.rules for clause in q for alt in clause for t in alt})
        grams = sorted({g for t in names for g in self._bytes(t)})
        self.number = {g: i for i, g in enumerate(grams)}
        self.lookup = np.zeros(1 << 24, np.uint8 if len(grams) < 256 else np.uint32)
        for g, i in self.number.items():
            self.lookup[g] = i + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    @staticmethod
    def _bytes(trigram: str) -> list[int]:
        """Codes of the byte trigrams in the UTF-8 of three characters."""
        b = trigram.encode()
        return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row per indexed trigram, a column per text."""
        out = np.zeros((len(self.number) + 1, len(offsets) - 1), bool)
        if len(data) >= 3:
            low = self.fold[data]
            hits = self.lookup[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(hits)
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[text + 1]
            out[hits[at[inside]], text[inside]] = True
        return out[1:]

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        left = np.ones(postings.shape[1], bool)
        for clause in query:
            any_of = np.zeros(postings.shape[1], bool)
            for alternative in clause:
                any_of |= postings[[self.number[g] for t in alternative for g in self._bytes(t)]].all(axis=0)
            left &= any_of
        return np.flatnonzero(left)

    def piece(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text, its spans (start, rule number, end) in order."""
        strings = texts.to_pylist()
        out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
        index = self.postings(*arrays.utf8(texts))
        for k, (rule, regex, query) in enumerate(self.rules):
            for i in self.candidates(query, index):
                for m in regex.finditer(strings[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out

    def batch(self, column: pa.Array):
        texts = arrays.filled(column)
        for a, b in arrays.pieces(texts):
            yield from self.piece(texts.slice(a, b - a))


def named(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, rules=RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_<kind> per rule, spans (kind:start:end, code points), spans_sha256."""

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            found = list(scanner.batch(batch["text"]))
            said = [named(s, rules) for s in found]
            yield pa.record_batch({
                "id": batch["id"],
                **{f"n_{r.kind}": pa.array([sum(x[1] == k for x in s) for s in found], pa.int64()) for k, r in enumerate(rules)},
                "spans": pa.array(said, pa.string()),
                "spans_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said], pa.string()),
            })

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"n_{r.kind} long" for r in rules)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {kinds}, spans string, spans_sha256 string").withColumnRenamed("id", id_col)


def redact_text(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, rules=RULES, *, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``length_col``, if given and there, gets the new number of characters."""
    schema, names = docs.schema, docs.columns
    length_col = length_col if length_col in names else None

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            spans = list(scanner.batch(columns[text_col]))
            if hit := [i for i, s in enumerate(spans) if s]:
                texts = columns[text_col].to_pylist()
                lengths = columns[length_col].to_pylist() if length_col else None
                for i in hit:
                    texts[i] = redact_text(texts[i], spans[i], mark)
                    if length_col and lengths[i] is not None:
                        lengths[i] = len(texts[i])
                columns[text_col] = pa.array(texts, columns[text_col].type)
                if length_col:
                    columns[length_col] = pa.array(lengths, columns[length_col].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, schema)


to_workers(sys.modules[__name__])
