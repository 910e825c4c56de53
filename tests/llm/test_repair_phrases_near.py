"""Operators 11 to 13: brute force, guarantees of their parts, and defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from scholia.llm import arrays, collocations, repair, superminhash  # noqa: E402
from scholia.llm.skew import salted_join  # noqa: E402

SPACE = r"[^\x20\x09-\x0D]+"


def _lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# --- op11

def _phrases(docs, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cands.items():
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(q[i:i + len(p)] == p for (l2, q), b in cands.items() if l2 == lang and len(q) > len(p) and 100 * b >= 80 * a for i in range(len(q) - len(p) + 1))
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


def _corpus(seed, texts=120):
    rng = random.Random(seed)
    words = ["a", "B", "çé", "dd", "e-e", "F", "g g", "h", "I", "jj", "😀", "k"]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "fr", None, "und"]), make()) for _ in range(texts)]
    return rows + [("en", None), ("en", ""), (None, " . "), ("de", "Only one text here. Only one text here"), ("en", "x y z " * 5000)] + rows[:10]


@pytest.mark.parametrize("least,top", [(3, 2000), (12, 7)])
def test_collocations(spark, least, top):
    docs = _corpus(least)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("doc_id", F.lit(None).cast("long"))
    got = [tuple(r) for r in collocations.collocations(df, least=least, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == _phrases(docs, least, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=80), min_size=1, max_size=6), st.integers(2, 9))
def test_merged_summaries_keep_what_is_frequent(tasks, least):
    mass = sum(map(len, tasks))
    merged = collocations.Summary(mass // least + 1)
    for t in tasks:
        one = collocations.Summary()
        one.add(np.array(t, np.uint64), np.ones(len(t), np.int64))
        one.merge()
        merged.add(one.keys, one.counts)
        merged.merge()
    true = Counter(itertools.chain(*tasks))
    left = dict(zip(merged.keys.tolist(), merged.counts.tolist()))
    assert merged.lost < least and len(left) <= merged.capacity
    for key, n in true.items():
        assert n - merged.lost <= left.get(key, 0) <= n
        assert n < least or key in left


# --- op12

def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(SPACE, _lower(t))
        out.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    return out


def _near(rows, percent=80):
    sets = _sets([t for _, t in rows])
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None), default=None) if sets[i] else doc
        out[doc, len(sets[i]), low, doc == low] += 1
    return out


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    shared = rng.choices(words, k=45)
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 5, 12, 60, 200]))
        for _ in range(rng.randint(1, 6)):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((doc, " ".join(copy)))
            doc += 1
    for _ in range(150):  # a common passage that links nothing, many in one bucket
        rows.append((doc, " ".join(shared + rng.choices(words, k=25))))
        doc += 1
    rows += [(None, rows[0][1]), (None, "alone without an id " * 3), (3, rows[9][1]), (7, None), (8, ""), (9, " \n "), (9, " \n "), (10, "one two"), (11, "ONE  two"), (12, "Long " + "x y z q r " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("set_id", F.lit(2))
    got = Counter(tuple(r) for r in superminhash.near_duplicates(df, words=4).collect())
    assert got == _near(rows)
    assert superminhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        superminhash.near_duplicates(df, percent=79)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "CROWD", 0)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.random()}" for w in base)) for i in range(60)]
    got = Counter(tuple(r) for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect())
    assert got == _near(rows)


def test_pass_two_keeps_phrases_of_one_hash_apart():
    one, two = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    c = collocations.Counted()
    c.add(one, two, np.array([1, 1, 1, 1]), np.array(["a", "b", "a", "c"], object))
    c.merge()
    c.add(one[:1], two[:1], np.array([4]), np.array(["a"], object))
    c.merge()
    assert sorted(zip(c.held[3], c.held[2].tolist())) == [("a", 6), ("b", 1), ("c", 1)]


def _one_by_one(values):
    """SuperMinHash element by element: a shuffled order of places, each step's place taking step + fraction if it is less."""
    out = [1 << 32] * superminhash.ROWS
    for v in values:
        seed, places = arrays.mix(np.array([v], np.uint64) + np.uint64(0x9E3779B97F4A7C15)), list(range(superminhash.ROWS))
        for step in range(superminhash.ROWS):
            draw = int(arrays.mix(seed + np.uint64((step + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))[0])
            k = step + ((draw & 0xFFFFFFFF) * (superminhash.ROWS - step) >> 32)
            places[step], places[k] = places[k], places[step]
            out[places[step]] = min(out[places[step]], step << 24 | draw >> 40)
    return out


def test_signatures_stop_early_without_a_change():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 40, 700, 3000)]
    got = superminhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert got.tolist() == [_one_by_one(s.tolist()) for s in sets]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    off = []
    for n in (10, 200):
        for _ in range(150):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[:int(0.9 * n)], rng.integers(0, 1 << 63, n - int(0.9 * n), dtype=np.uint64)])
            a, b = superminhash.signatures(np.concatenate([x, y]), np.array([0, n, 2 * n]))
            off.append((a == b).mean() - 0.9 / 1.1)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.036  # independent hashes: 0.034


def test_salted_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), "id")
    left = left.withColumn("k", F.when(F.col("id") % 11 > 0, F.col("k")))
    right = spark.range(0, 40, 2).select(F.col("id").alias("k"), F.lit("x").alias("v")).union(spark.createDataFrame([(7, "y"), (None, "z")], "k long, v string"))
    for how in ("inner", "left"):
        got, want = salted_join(left, right, "k", how, least=20), left.join(right, "k", how)
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


# --- op13

def _damage(rows):
    out = {}
    text = lambda x: " " if x is None else str(x)
    for conv, turn, role, body in rows:
        out.setdefault(conv, [])
        fault = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if fault == 0:
            continue
        body = "" if fault == 1 else re.sub("[.!?]", "", body) if fault == 2 else body
        out[conv] += [(turn, "user" if fault == 4 else role, body)] * (2 if fault == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {conv: sorted(rs, key=key) for conv, rs in out.items()}


def _faults(rows):
    seen, out = set(), []
    for _, role, body in rows:
        nonblank = re.sub(r"[\x20\x09-\x0D]", "", body)
        out.append("blank" if not nonblank else "duplicate" if (role, body) in seen else "truncated" if nonblank[-1] not in ".!?" else "")
        seen.add((role, body))
    return out


def _search(rows, faults):
    """All edits within a cost, cheapest and ASCII-least first, tried by the pattern itself."""
    best = (4 * len(rows), "D" * len(rows), ())

    def go(i, cost, audit, done):
        nonlocal best
        if cost > best[0] or len(done) > 1 and not "suauauauauauaua".startswith("".join(d[:1] for d in done)) and not "uauauauauauauaua".startswith("".join(d[:1] for d in done)):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(d[:1] for d in done)):
                best = min(best, (cost, audit, done))
        else:
            _, role, body = rows[i]
            extra = 3 if faults[i] == "truncated" else 0
            go(i + 1, cost + 4, audit + "D", done)
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, cost + extra, audit + "K", (*done, f"{role}:{body}"))
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + extra, audit + "R", (*done, f"{new}:{body}"))
        if len(done) < 9:
            for new in ("user", "assistant"):
                go(i, cost + 3, audit + "I", (*done, f"{new}:"))

    go(0, 0, "", ())
    return best


def _repaired(rows):
    for conv, rs in _damage(rows).items():
        faults = _faults(rs)
        cost, audit, lines = _search(rs, faults)
        turns = [t for t, *_ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        yield conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _talks(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            body = rng.choice(["Yes.", "No", "  ", "é! \n", "ok ", None, f"t{rng.random()}?", "Yes."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 2, None]), role, body))
    return rows


@pytest.mark.parametrize("segment", [512, 2])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "PIECE", 3)
    rows = _talks(segment)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("part", F.lit("clash")).withColumn("copy", F.lit(0))
    assert Counter(tuple(r) for r in repair.repaired_conversations(df).collect()) == Counter(_repaired(rows))
    assert repair.repaired_conversations(df.limit(0)).count() == 0


def _dp(rows, faults):
    """The same DP with whole strings in place of nodes."""
    at = {0: (0, "")}

    def offer(into, state, way):
        into[state] = min(into.get(state, way), way)

    def put_in():
        for s in (0, 1, 3):
            if s in at:
                offer(at, 2, (at[s][0] + 3, at[s][1] + "I"))
        if 2 in at:
            offer(at, 3, (at[2][0] + 3, at[2][1] + "I"))

    for (_, role, _), fault in zip(rows, faults):
        put_in()
        new, more = {}, 3 if fault == "truncated" else 0
        for s, (cost, audit) in at.items():
            offer(new, s, (cost + 4, audit + "D"))
            if fault not in ("blank", "duplicate"):
                if s in repair.AFTER.get(role[:1], ()):
                    offer(new, repair.AFTER[role[:1]][s], (cost + more, audit + "K"))
                offer(new, 3 if s == 2 else 2, (cost + 3 + more, audit + "R"))
        at = new
    put_in()
    return min(at[s] for s in (0, 3) if s in at)


def test_repair_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 50)
    rng = random.Random(9)
    rows = [(4, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{t}.", "", "z" * 300000 + "."] if t == 7 else ["Yes.", "no", f"{t}.", ""])) for t in range(3000)]
    got = repair.repaired_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).first()
    rs = _damage(rows)[4]
    faults = _faults(rs)
    assert (got["cost"], got["audit"]) == _dp(rs, faults)
    assert (got["blank"], got["duplicate"], got["truncated"]) == tuple(faults.count(x) for x in ("blank", "duplicate", "truncated"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from(["D", "I", "K", "R", "KI", "DDK", "DD"])), max_size=40), st.booleans())
def test_edits_compare_as_their_letters(steps, collide):
    edits = repair.Edits()
    if collide:  # hashes that tell nothing: comparisons must verify
        edits._like = lambda x, y: edits.depth[x] == edits.depth[y]
    texts = [""]
    for at, letters in steps:
        at %= len(texts)
        edits.add(at, letters)
        texts.append(texts[at] + letters)
    for x, y in itertools.product(range(len(texts)), repeat=2):
        assert edits.letters(x) == texts[x] and edits.before(x, y) == (texts[x] < texts[y])
