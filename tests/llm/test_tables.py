"""Operators 2, 5, 6, 7, 8, 9 and the pipeline: brute force and defined cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from scholia.llm import jaccard, mixing, topk, urls, warc, wrappers  # noqa: E402
from scholia.llm.components import components  # noqa: E402
from scholia.llm.queries import URL_RULES  # noqa: E402

URLS = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "http://example.com", "ftp://x.net/es/9#t", "http://net/fr/", "nonsense", None, "://", "http://évil.NET/es/",
        "http://a..com/x", "http://com", "http://xcom/", "http://y.org/en/#/", "http://a.b.c.d.e.net/fr/" + "z" * 50000, "http://h?//x://y.com/"]


def _judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    import re

    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i % 9 or None, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("host", F.lit(0))
    got = urls.judge_urls(pages, URL_RULES)
    assert Counter(tuple(r) for r in got.collect()) == Counter((i % 9 or None, *_judge(u)) for i, u in enumerate(URLS))
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    listed = universe.filter(F.substring("key", 4, 9).cast("int") % 37 == 0)
    c = urls.Cascade.build(listed, universe)
    assert len(c.levels) > 1
    assert universe.filter(c.has("key")).exceptAll(listed).count() == 0 and listed.filter(~F.expr(c.has("key"))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u1", "<p>a</p>"), (1, "u\r\n2", "<p>a</p>"), (1, "u\r\n2", "<p>a</p>"), (7, None, None), (8, "e", ""), (None, "n", "é"), (9, "long", "x" * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("payload", F.lit(0))
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    got = Counter(tuple(r) for r in warc.archived_pages(spark, path).collect())
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert got == want and warc.read_payloads(spark, path).count() == 4
    whole = sorted(bytes(r["record"]) for r in warc.records(spark, path).collect())
    assert len(whole) == len(rows) and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in whole)
    assert any(b"\r\n\r\n" + "é".encode() + b"\r\n\r\n" in r for r in whole)
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.archived_pages(spark, str(tmp_path / "b")).count() == 0
    spark.createDataFrame([(bytearray(hashlib.sha256(b"x").digest()), bytearray(b"y"))], "sha256 binary, payload binary").write.parquet(str(tmp_path / "c/payloads"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_payloads(spark, str(tmp_path / "c")).collect()


def test_warc_of_a_hot_payload(spark, tmp_path):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(4000)]
    path = str(tmp_path / "hot")
    warc.write_archive(spark.createDataFrame([(i, f"u{i}", x) for i, x in rows], "page_id long, url string, html string"), path)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived_pages(spark, path).collect()}
    assert got == {i: (len(x), "revisit", 1) if x == "same" and i > 1 else (len(x), "response", None) for i, x in rows}
    whole = Counter(bytes(r["record"]).split(b"\r\n\r\n")[1].decode() for r in warc.records(spark, path).collect())
    assert whole == Counter(x for _, x in rows)


def _top(rows, k):
    """Each query row's best k other rows, by comparing all."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (i, v) in enumerate(good):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for place, (j, w) in enumerate(good) if place != at)[:k]
            out.update((i, r, j, -s) for r, (s, j) in enumerate(scores, 1))
    return out


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, r.gauss(0, 0.2), -0.3]) for _ in range(9)]) for i in range(400)]
    rows += [(50, None), (400, [0.1] * 9), (400, [-0.1] * 9), (401, [0.1, None]), (402, [float("nan")]), (403, [float("inf")] * 9), (None, [0.1]), (404, []), (405, [0.5, 0.5])]
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(600, [3e8] * 3), (601, [-3e8, 3e8, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(0))
    got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == _top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert topk.top_k(df.filter("vec_id = 100"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_max_score_splits_terms_by_their_bounds():
    assert topk.non_essential([0, 5, 11, 30], None) == 0
    assert topk.non_essential([0, 5, 11, 30], 11) == 2 and topk.non_essential([0, 5, 11, 30], 29) == 2
    assert topk.non_essential([0, 5, 11, 30], 30) == 3 and topk.non_essential([0, 5], -1) == 0
    assert topk.non_essential([0, -4, 3], -2) == 1
    r = np.random.default_rng(5)
    n = 3000
    vectors = [(r.integers(-90, 90, 12) * (r.random(12) < 0.5)).astype(np.int32) for _ in range(n)]
    shard = topk.Shard(np.arange(n) // 2, np.arange(n), vectors)
    traversed, probed = [], []
    walk, probe = shard._traverse, shard._probe
    shard._traverse = lambda terms, q, at, end: (traversed.append(len(terms)), walk(terms, q, at, end))[1]
    shard._probe = lambda t, q, places, sums: (probed.append(len(places)), probe(t, q, places, sums))[1]
    for row in range(0, n, 100):
        scores = sorted((-int(vectors[row] @ v), i // 2) for i, v in enumerate(vectors) if i != row)[:5]
        assert [(-s, i) for s, i in scores] == shard.search(row, vectors[row], 5)
    assert min(traversed) < max(traversed) and 0 < sum(probed) < n * len(probed)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5))
def test_permutations(n, key):
    p = mixing.Permutation(n, (1, key))
    x = p(np.arange(n))
    assert sorted(x.tolist()) == list(range(n)) and p.inverse(x).tolist() == list(range(n))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=9))
def test_targets_and_shares(sizes):
    aims = mixing.targets(sizes)
    assert all(t <= 3 * s + 1e-6 for t, s in zip(aims, sizes)) and abs(sum(aims) - sum(sizes)) < 1e-6 * (1 + sum(sizes))
    for i, (s, t) in enumerate(zip(sizes, aims)):
        me = mixing.share(i, "x", s, t)
        got = 0
        for j in range(me.slots):
            block = int(mixing.Permutation(me.blocks, (mixing.SEED, i, j // me.blocks))([j % me.blocks])[0])
            got += me.last if j == me.slots - 1 else min(mixing.BLOCK, s - block * mixing.BLOCK)
        assert got == me.words()


def test_shard_counts_add_up():
    slots = np.array([70000, 1, 0, 33333])
    shards = -(-int(slots.sum()) // mixing.SHARD_SLOTS)
    done = np.zeros(4, np.int64)
    for k in range(shards):
        before, own = mixing.shard_counts(slots, k, shards)
        assert (before == done).all() and own.sum() == min(mixing.SHARD_SLOTS, int(slots.sum()) - k * mixing.SHARD_SLOTS)
        done += own
    assert (done == slots).all()


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i % 300 or None, "w " * r.randint(0, 90), r.choice(["a", "b", "ü", None, "tiny"] if i < 5 else ["a", "b", "ü", None])) for i in range(320)]
    rows += [(900, None, "none"), (901, "x\u00a0y\x0bz " * 9000, "a"), rows[7], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(0))
    got = [tuple(x) for x in mixing.mix_counts(docs).collect()]
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert Counter((x[0], x[1]) for x in got) == Counter((i, words(t)) for i, t, _ in rows)
    assert all(x[4] <= 3 * x[1] for x in got) and abs(sum(x[4] for x in got) - sum(x[1] for x in got)) <= 6
    assert Counter(got) == Counter(tuple(x) for x in mixing.mix_counts(docs.repartition(3)).collect())
    m = mixing.mix(docs)
    assert m.mixed().agg(F.sum("n_words")).first()[0] == sum(x[4] for x in got)
    assert mixing.mix_counts(docs.limit(0)).count() == 0


def _components(rows, k=4, percent=85):
    import re

    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                at[root(a)] = root(b)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return Counter((i, len(s), low.get(root(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_components(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdef") for _ in range(2))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 5, 30, 60]))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            rows.append((n := n + 1, " ".join(copy)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \t "), (None, rows[3][1]), (rows[5][0], rows[5][1]), (n + 4, rows[0][1].upper()), (n + 5, "one"), (n + 6, "ONE"), (n + 7, "w " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("label", F.lit(0))
    got = Counter(tuple(x) for x in jaccard.similar_components(docs).collect())
    assert got == _components(rows)
    assert jaccard.similar_components(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2 ** 63), max_size=200), st.sets(st.integers(0, 2 ** 63), max_size=200), st.integers(0, 100))
def test_parity_bitmaps_never_exceed_the_difference(a, b, share):
    b = b | set(list(a)[:len(a) * share // 100])
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard.distance(jaccard.parity(x), jaccard.parity(y)) <= len(a ^ b)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=/x>Home</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<aside class=sidebar><p>Side {i}</p></aside><div class="ad-box">Buy {i} now</div>{main}<form><input name=q><p>Search</p></form>
<section id="comments"><p>Reader {i} says</p></section><footer>&copy; host {i}</footer>"""


def test_wrappers(spark):
    article = lambda i: f"<article><h1>Head &amp; {i}</h1><p><b>First\n  part {i}<br><p>Second &lt;{i}&gt; <a href=/l>link</a> end</p><div class='share'>Share {i}</div><p>Same line</p></article>"
    div = lambda i: f"<div id=content><h2>Title {i}</h2><p>{'Body text of page ' * 9}{i}</p><p>Tail {i}</div>"
    rows = [(i, "http://a.org/x", PAGE.format(i=i, main=article(i))) for i in range(6)] + [(i, "http://b.org/x", PAGE.format(i=i, main=div(i))) for i in range(10, 16)]
    rows += [(20, "http://a.org/", None), (21, None, ""), (None, "x", "<p>Plain &eacute;</p>tail"), (22, "http://c.org/", "<article><p>cut o"), (22, "http://c.org/", "<article><p>cut o")]
    rows += [(23, "http://d.org/", "<article>" + "<p>long text</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("path", F.lit(0))
    got = Counter((r["page_id"], r["url"], r["text"]) for r in wrappers.extract(pages).collect())
    want = Counter((i, "http://a.org/x", f"Head & {i}\nFirst part {i}\nSecond <{i}> link end\nSame line") for i in range(6))
    want.update((i, "http://b.org/x", f"Title {i}\n{'Body text of page ' * 9}{i}\nTail {i}") for i in range(10, 16))
    want.update([(20, "http://a.org/", ""), (21, None, ""), (None, "x", "Plain é\ntail"), (22, "http://c.org/", "cut o"), (22, "http://c.org/", "cut o"), (23, "http://d.org/", "\n".join(["long text"] * 5000))])
    assert got == want
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from scholia.llm import decontaminate, secret_scan

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, d).collect()
    kept = {r["doc_id"] for r in out}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(kept) == len(out) and not any(labels.get(i) == 0 and zlib.crc32(str(i).encode()) % 4 != 2 for i in kept)
    left = spark.createDataFrame([(i, before[i]) for i in kept], "doc_id long, text string")
    assert decontaminate.find_leaks(left, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    assert all(c[0] == c[2] for c in _components([(i, before[i]) for i in sorted(kept)]))
    redacted = secret_scan.redact(docs)
    assert redacted.columns == docs.columns and secret_scan.scan(redacted).filter("spans <> ''").count() == 0


def test_near_duplicate_stage_takes_five_words_and_eighty_percent(spark):
    import corpus_pipeline

    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for changed in (0, 5, 15, 20, 21, 25, 30, 60):
        base = [word() for _ in range(200)]
        rows += [(len(rows) + 1, " ".join(base)), (len(rows) + 2, " ".join(base[:200 - changed] + [word() for _ in range(changed)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x["doc_id"] for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {i for i, _, low in _components(rows, 5, 80) if i == low}
    assert kept != {i for i, _, low in _components(rows) if i == low}


def _read(*mains):
    """What the pages of one host, each in the frame of PAGE, are read as."""
    host = None
    trees = [wrappers.parse(PAGE.format(i=i, main=m)) for i, m in enumerate(mains)]
    for t in trees:
        host = wrappers.merge(host, wrappers.skeleton(t)) if host else wrappers.skeleton(t)
    return [wrappers.page_text(root, wrappers.wrapper(host)) for root in trees]


def test_wrappers_read_all_like_siblings():
    parts = lambda i, tag: "".join(f"<{tag} class=part><h2>Part {k} of {i}</h2><p>{'Words ' * (5 + k)}{i} {k}</p></{tag}>" for k in range(3))
    want = lambda i: "\n".join(f"Part {k} of {i}\n{'Words ' * (5 + k)}{i} {k}" for k in range(3))
    assert _read(*[f"<div class=post>{parts(i, 'section')}</div>" for i in range(4)]) == [want(i) for i in range(4)]
    assert _read(*[parts(i, "article") for i in range(4)]) == [want(i) for i in range(4)]
    rows = lambda i: "".join(f"<tr><td><p>Cell {i} {k}</p><p>more of {i}</p></td></tr>" for k in range(3))
    assert _read(*[f"<table>{rows(i)}</table>" for i in range(4)]) == ["\n".join(f"Cell {i} {k}\nmore of {i}" for k in range(3)) for i in range(4)]
    same = "<article><p>One part</p></article><article><p>and the other</p></article>"
    assert _read(same.replace("One", "First"), same, same, same)[1] == "One part\nand the other"


def test_wrappers_read_all_slots():
    body = lambda i: f"<div class=content><h2>Part {i}</h2><p>{i} {'words of the body ' * 20}</p></div>"
    text = lambda i: f"Part {i}\n{i} {'words of the body ' * 20}".rstrip()
    lead = lambda i: f"<div class=tagline>Same on all</div><h1>Title {i}</h1><p class=lead>Lead {i}</p>{body(i)}"
    assert _read(*map(lead, range(4))) == [f"Title {i}\nLead {i}\n{text(i)}" for i in range(4)]
    two = lambda i: f"{body(i)}<div class=more><p>Second container {i}</p></div>"
    assert _read(*map(two, range(4))) == [f"{text(i)}\nSecond container {i}" for i in range(4)]
    cards = lambda i: f"<div id=story><p>{i} {'story ' * 50}end</p></div><article class=card>Teaser {i}</article><article class=card>Other {i}</article>"
    assert _read(*map(cards, range(4))) == [f"{i} {'story ' * 50}end\nTeaser {i}\nOther {i}" for i in range(4)]
    links = lambda i: f"{body(i)}<p class=note>See {i} <a href=/x>a link that is longer than the rest</a></p>"
    assert _read(*map(links, range(4))) == [f"{text(i)}\nSee {i} a link that is longer than the rest" for i in range(4)]
    assert _read(two(1), two(1)) == [f"{text(1)}\nSecond container 1"] * 2


def test_wrappers_of_deep_and_many_nodes():
    deep = lambda i: "<div>" * 10000 + f"<p>Deep {i}</p>tail<p>" + "</div>" * 10000
    assert _read(*map(deep, range(3))) == [f"Deep {i}\ntail" for i in range(3)]
    assert _read("<b>" * 5000 + "x <nav>no</nav>") == ["x"]
    own = lambda i: f"<div id=story><p>Story {i}</p></div>" + "".join(f"<div class=c{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'xyz'[k]}><p>own {i} {k}</p></div>" for k in range(3))
    assert _read(*map(own, range(100))) == [f"Story {i}\n" + "\n".join(f"own {i} {k}" for k in range(3)) for i in range(100)]
    host = None
    for i in range(3000):
        t = wrappers.skeleton(wrappers.parse(f"<p>Text {i}</p>" + "".join(f"<div class={w}>own</div>" for w in (f"a{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26 % 26]}{'abcdefgh'[i // 676]}",))))
        host = wrappers.merge(host, t) if host else t
        assert len(host[wrappers.CHILDREN]) <= wrappers.MOST_CHILDREN
    assert host[wrappers.PAGES] == 3000 and wrappers.sum_of(host, wrappers.PLAIN) == sum(len(f"Text {i}") + 3 for i in range(3000))


def test_wrappers_leave_out_comments_and_standing_parts():
    talk = lambda i: f"<article><h1>T {i}</h1><p>short text {i}</p></article><section id=comments><article>{f'Reader {i} writes much ' * 30}</article></section>"
    assert _read(*map(talk, range(4))) == [f"T {i}\nshort text {i}" for i in range(4)]
    plain = lambda i: f"<div class=story><h1>T {i}</h1><p>short text {i}</p></div><ol class=comments><li><article>{f'Reader {i} writes much ' * 30}</article></li></ol>"
    assert _read(*map(plain, range(4))) == [f"T {i}\nshort text {i}" for i in range(4)]
    parts = lambda i: f"<div class=tagline>Tagline of the site</div><div class=one><p>{f'story {i} ' * 6}</p></div><div class=two><p>{f'more {i} ' * 5}</p></div><div class=legal>Copyright 2020 all rights</div>"
    assert _read(*map(parts, range(4))) == [f"{f'story {i} ' * 6}".rstrip() + f"\n{f'more {i} ' * 5}".rstrip() for i in range(4)]
    assert _read("<article><header><h1>Kept</h1></header><p>One page</p></article>") == ["Kept\nOne page"]
    assert _read("<div><p>One page only</p></div>") == ["One page only"]


def test_wrappers_judge_furniture_by_the_template():
    body = lambda i: f"<h2>Part {i}</h2><p>{i} {'words of the body ' * 20}</p>"
    text = lambda i: f"Part {i}\n{i} {'words of the body ' * 20}".rstrip()
    names = ["class='content has-sidebar'", "id='main-no-sidebar'", "class='entry related-topic'", "class='social-science'", "class=sidebar", "id=comments"]
    for name in names:
        assert _read(*[f"<div {name}>{body(i)}</div>" for i in range(4)]) == [text(i) for i in range(4)], name
        beside = [f"<div {name}><p>Few {i}</p></div><div class=story>{body(i)}</div>" for i in range(4)]
        assert _read(*beside) == [("" if name in names[4:] else f"Few {i}\n") + text(i) for i in range(4)], name
    form = lambda i: f"<form id=aspnetForm><div class=ad>Ad {i}</div><div class=x>{body(i)}</div><div class='share-buttons'>Share {i}</div></form>"
    assert _read(*map(form, range(4))) == [text(i) for i in range(4)]
    main = lambda i: f"<div class=widget><main><p>Main {i}</p></main></div><section class=related-posts>{body(i)}</section>"
    assert all(f"Main {i}" in t for i, t in enumerate(_read(*map(main, range(4)))))
    assert _read(*[f"<aside><article>Card {i}</article></aside><article>{body(i)}</article>" for i in range(4)]) == [text(i) for i in range(4)]
    alike = [f"<article>Same on both</article><div class=ad>Some ad {i}</div>" for i in range(2)]
    assert [t.split("\n")[-1] for t in _read(*alike)] == ["Same on both"] * 2


def test_wrappers_compare_whole_texts():
    opening = "This standing intro of more than sixty-four characters opens every story here"
    story = lambda i: f"<div class=story>{opening} and then comes story {i}</div><div class=byline><p>By {i}</p><p>on day {i}</p></div>"
    assert _read(*map(story, range(4))) == [f"{opening} and then comes story {i}\nBy {i}\non day {i}" for i in range(4)]
    own = lambda i: f"<div class=slug-{'abcd'[i]}><p>Only text of page {i}</p></div><div class=byline><p>By {i}</p><p>on day {i}</p></div>"
    assert _read(*map(own, range(4))) == [f"Only text of page {i}\nBy {i}\non day {i}" for i in range(4)]
    # a constant node in some elements of a run only is still constant, and an empty page lacks nothing
    run = wrappers.skeleton(wrappers.parse("<section><h2>A</h2><p>x</p></section><section><h2>A</h2></section><section><p>y</p></section>"))
    assert [(c[wrappers.PAGES], [d[wrappers.PAGES] for d in c[wrappers.CHILDREN]]) for c in run[wrappers.CHILDREN]] == [(1, [1, 1])]


def test_one_row_per_component(spark):
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(40)) for name in "abcd")
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "z"), (None, a, "n"), (None, b, "m"), (None, b, "m"), (5, c + " end", "near"), (4, c, "c"), (5, d, "unique"), (6, "", "e"), (6, None, "e"), (None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_0 string").withColumn("key", F.lit("clash"))
    kept = jaccard.one_per_component(docs)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(1, a), (None, b), (4, c), (5, d), (6, ""), (6, None), (None, None)])
    assert kept.columns == docs.columns and jaccard.one_per_component(docs.limit(0)).count() == 0
