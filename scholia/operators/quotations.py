"""Quotation finding: n-gram overlap, TF-IDF and a logistic score.

The reference corpus (verses) is turned once into a weight table
``(verse_id, gram, n_v, w, verse_len)``.  Document pages are cut into
word n-grams, counted per page, joined to that table on the gram and
summed per (page, verse) in a single aggregation that yields all three
features at once (token product, TF-IDF product, matched proportion).
Pairs are pruned, scored, cut at an acceptance probability and the best
version of each reference is kept per item.

Plan shape, per call (see README "Design and scale notes"):

* broadcast path (weight table under ``broadcast_bytes``, added up):
  scan -> one shuffle of the text by page -> explode grams -> broadcast join
  with the weights -> sums per (page, verse) in the same stage.
  A page is one input row, so counting grams per page first would only add
  a shuffle of already-final (page, gram) counts (``count_first=True``
  keeps that variant).
* shuffle path (large reference corpus): grams that a verse has are counted
  per page first, then joined to the weights by a shuffle on the gram; grams
  found in many verses are salted over ``salt_buckets`` so one common gram
  cannot pin one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import uuid_of
from ..functions.text import drop_last_words, explode_ngrams, strip_version, version_bonus
from ..session import cut_lineage, spread

FEATURES = ("tokens", "tfidf", "proportion")
#: Largest weight table or gram list that is broadcast; each row counts its texts and ROW_BYTES.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64
#: Newton steps of the match model move no coefficient by more.
MAX_STEP = 1.0


@dataclass(frozen=True)
class MatchModel:
    """Centre/scale constants and logistic coefficients (feature order: FEATURES).

    The defaults are a placeholder model of ours; use :func:`fit_match_model`
    to learn one from labelled pairs.
    """
    intercept: float = -4.0
    coefficients: tuple = (0.02, 0.5, 6.0)
    means: tuple = (0.0, 0.0, 0.0)
    scales: tuple = (1.0, 1.0, 1.0)


@dataclass(frozen=True)
class QuotationParams:
    n: int = 2                   # words per gram
    min_tokens: float = 5.0      # prune: tokens >= min_tokens OR tfidf >= min_tfidf
    min_tfidf: float = 1.0
    min_probability: float = 0.57
    preferred_label: str = "KJV"
    bonus: float = 0.05
    idf: str = "smooth_denominator"   # or 'log1p'
    model: MatchModel = field(default_factory=MatchModel)

    def validate(self) -> "QuotationParams":
        if self.n < 1:
            raise ValueError("n must be at least 1")
        for name in ("min_tokens", "min_tfidf"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not 0 <= self.min_probability <= 1:
            raise ValueError("min_probability must lie in [0, 1]")
        if self.idf not in ("smooth_denominator", "log1p"):
            raise ValueError("idf must be 'smooth_denominator' or 'log1p'")
        return self


def verses_from_passages(passages: DataFrame, key: str = "item_id", text: str = "text",
                         label_a: str = "KJV", label_b: str = "ASV", drop_words: int = 2) -> DataFrame:
    """Two versions of every passage: the text as is, and without its last words."""
    a = passages.select(F.concat(F.lit("Passage "), F.col(key).cast("string"), F.lit(f" ({label_a})")).alias("verse_id"),
                        F.col(text).alias("text"))
    b = passages.select(F.concat(F.lit("Passage "), F.col(key).cast("string"), F.lit(f" ({label_b})")).alias("verse_id"),
                        drop_last_words(F.col(text), drop_words).alias("text"))
    return a.unionByName(b)


def verse_gram_counts(verses: DataFrame, n: int = 2) -> DataFrame:
    """(verse_id, gram, n_v): the verse document-term table."""
    return (explode_ngrams(verses, ["verse_id"], "text", n)
            .groupBy("verse_id", "gram").agg(F.count(F.lit(1)).alias("n_v")))


def verse_weights(verses: DataFrame, n_verses: int, n: int = 2, idf: str = "smooth_denominator") -> DataFrame:
    """(verse_id, gram, n_v, w, verse_len, df).

    ``w = n_v / verse_len * idf(gram)`` with ``idf = ln(N / (df + 1))``
    (``'smooth_denominator'``) or ``ln(1 + N / df)`` (``'log1p'``), N the
    number of verses.  ``verse_len`` is the verse's gram total.
    """
    counts = verse_gram_counts(verses, n)
    # Grouped aggregates joined back (not windows): a gram found in a third
    # of all verses is pre-aggregated map-side instead of landing whole in
    # one window task.
    lens = counts.groupBy("verse_id").agg(F.sum("n_v").alias("verse_len"))
    dfs = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    out = counts.join(lens, "verse_id").join(dfs, "gram")
    N = F.lit(float(n_verses))
    idf_col = F.log(N / (F.col("df") + 1)) if idf == "smooth_denominator" else F.log1p(N / F.col("df"))
    out = out.withColumn("w", F.col("n_v") / F.col("verse_len") * idf_col)
    return out.select("verse_id", "gram", "n_v", "w", "verse_len", "df")


@dataclass
class ReferenceCorpus:
    """Verse weights, built once per corpus and kept in the shared folder."""
    weights: DataFrame
    n_verses: int
    n_bytes: int
    params: QuotationParams

    @classmethod
    def build(cls, verses: DataFrame, params: QuotationParams | None = None,
              persist: bool = True) -> "ReferenceCorpus":
        params = (params or QuotationParams()).validate()
        n_verses = verses.select("verse_id").distinct().count()
        w = verse_weights(verses, n_verses, params.n, params.idf)
        if persist:
            w = cut_lineage(w)
        size = w.agg(F.sum(F.octet_length("gram") + F.octet_length("verse_id") + F.lit(ROW_BYTES))).first()[0]
        return cls(w, n_verses, size or 0, params)


def vocabulary_bytes(vocab: DataFrame) -> int:
    return vocab.agg(F.sum(F.octet_length("gram") + F.lit(ROW_BYTES))).first()[0] or 0


def page_gram_counts(pages: DataFrame, keys: list[str], n: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """(keys..., gram, n_d) -- grams of every page, counted per page."""
    g = explode_ngrams(spread(pages.select(*keys, "text"), keys=keys), keys, "text", n)
    if vocabulary is not None:
        g = g.join(vocabulary, "gram", "left_semi")
    return g.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n_d"))


def potential_matches(pages: DataFrame, corpus: ReferenceCorpus, keys=("item_id",),
                      broadcast_bytes: int = BROADCAST_BYTES, salt_buckets: int = 16,
                      hot_df: int = 64, count_first: bool = False) -> DataFrame:
    """(keys..., verse_id, tokens, tfidf, proportion) for every pair sharing a gram.

    ``tokens`` is the sum over shared grams of n_v * n_d (a product, not a
    count of distinct grams), ``tfidf`` the sum of w * n_d and
    ``proportion`` = tokens / verse_len.
    """
    keys = list(keys)
    p = corpus.params
    w = corpus.weights.select("gram", "verse_id", "n_v", "w", "verse_len", "df")
    if corpus.n_bytes <= broadcast_bytes and not count_first:
        # One shuffle, of the text: every gram occurrence meets the broadcast weights and
        # is summed per (page, verse) in the same stage (n_d = 1 per occurrence
        # gives the same sums as counting first).
        g = explode_ngrams(spread(pages.select(*keys, "text"), keys=keys), keys, "text", p.n)
        joined = g.join(F.broadcast(w), "gram").withColumn("n_d", F.lit(1).cast("long"))
    elif corpus.n_bytes <= broadcast_bytes:
        vocab = F.broadcast(w.select("gram").distinct())
        dg = page_gram_counts(pages, keys, p.n, vocab)
        joined = dg.join(F.broadcast(w), "gram")
    else:
        # Only grams that some verse has are counted and shuffled.
        vocab = w.select("gram").distinct()
        if vocabulary_bytes(vocab) <= broadcast_bytes:
            vocab = F.broadcast(vocab)
        dg = page_gram_counts(pages, keys, p.n, vocab)
        # Salt grams that occur in many verses: their page rows are spread
        # over salt_buckets tasks and their verse rows copied to each.
        salt = F.when(F.col("df") >= hot_df, F.lit(salt_buckets)).otherwise(F.lit(1))
        ws = (w.withColumn("salt", F.explode(F.sequence(F.lit(0), salt - 1))))
        hot = w.filter(F.col("df") >= hot_df).select("gram").distinct().withColumn("hot", F.lit(True))
        # A hot gram fills at least hot_df weight rows, so the hot list has at most
        # n_bytes / hot_df bytes: a proven bound, checked before broadcasting.
        if corpus.n_bytes // max(hot_df, 1) <= broadcast_bytes:
            hot = F.broadcast(hot)
        dg = (dg.join(hot, "gram", "left")
              .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*keys), F.lit(salt_buckets)))
                          .otherwise(F.lit(0))).drop("hot"))
        joined = dg.join(ws, ["gram", "salt"]).drop("salt")
    return (joined.groupBy(*keys, "verse_id")
            .agg(F.sum(F.col("n_v") * F.col("n_d")).alias("tokens"),
                 F.sum(F.col("w") * F.col("n_d")).alias("tfidf"),
                 F.max("verse_len").alias("verse_len"))
            .withColumn("proportion", F.col("tokens") / F.col("verse_len"))
            .drop("verse_len"))


def keep_candidates(potential: DataFrame, min_tokens: float, min_tfidf: float) -> DataFrame:
    """Prune: tokens >= t OR tfidf >= s (NULL tfidf only passes on tokens)."""
    return potential.filter((F.col("tokens") >= min_tokens) | (F.col("tfidf") >= min_tfidf))


def score(potential: DataFrame, model: MatchModel) -> DataFrame:
    """Add ``probability``: logistic of the centred and scaled features."""
    logit = F.lit(model.intercept)
    for name, b, m, s in zip(FEATURES, model.coefficients, model.means, model.scales):
        logit = logit + F.lit(b) * ((F.col(name) - F.lit(m)) / F.lit(s))
    return potential.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))


def best_version(scored: DataFrame, keys: list[str], params: QuotationParams) -> DataFrame:
    """Keep one version per (keys, reference): highest bonus-adjusted probability,
    verse_id ascending on ties.  The bonus only picks; output keeps the raw value."""
    s = (scored.withColumn("reference_id", strip_version("verse_id"))
         .withColumn("prob_adj", version_bonus("verse_id", "probability", params.preferred_label, params.bonus)))
    # Grouped min over (-prob_adj, verse_id, ...): same pick as a sorted
    # window, but partially aggregated map-side and without a sort.
    rest = [c for c in s.columns if c not in keys and c not in ("reference_id", "prob_adj", "verse_id")]
    best = F.min(F.struct((-F.col("prob_adj")).alias("_neg"), F.col("verse_id"),
                          *[F.col(c) for c in rest])).alias("_b")
    return s.groupBy(*keys, "reference_id").agg(best) \
        .select(*keys, "reference_id", "_b.verse_id", *[F.col(f"_b.{c}") for c in rest])


def find_quotations(pages: DataFrame, corpus: ReferenceCorpus, keys=("item_id",),
                    destination: str = "quotations", watch: dict | None = None, **join_opts) -> DataFrame:
    """(job_id, keys..., reference_id, verse_id, probability).

    ``pages`` carries ``keys`` and ``text``, and may carry ``page_seq``; a page
    is all rows of a (keys, page_seq), or without that column each row by
    itself.  Features are never summed over pages: every page is scored, and a
    verse counts with its best page.  When there is no ``job_id`` one is
    derived from the item id and destination (uuid-shaped md5).
    ``watch``: Observations by name (potential, kept, found), which count the
    rows of these steps as ``n`` while the result is written.
    """
    def seen(df: DataFrame, name: str) -> DataFrame:
        return df.observe(watch[name], F.count(F.lit(1)).alias("n")) if watch and name in watch else df

    keys = list(keys)
    p = corpus.params
    page = next((c for c in ("page_seq",) if c in pages.columns), None)
    if page is None:
        page, pages = "_page", pages.withColumn("_page", F.monotonically_increasing_id())
    pot = seen(potential_matches(pages, corpus, [*keys, page] if page not in keys else keys, **join_opts), "potential")
    kept = seen(keep_candidates(pot, p.min_tokens, p.min_tfidf), "kept")
    scored = score(kept, p.model).filter(F.col("probability") >= p.min_probability)
    if page not in keys:
        scored = scored.groupBy(*keys, "verse_id").agg(F.max("probability").alias("probability"))
    best = seen(best_version(scored, keys, p), "found")
    if "job_id" in keys:
        return best.select(*keys, "reference_id", "verse_id", "probability")
    return best.select(uuid_of(F.col(keys[0]), F.lit(destination)).alias("job_id"), *keys,
                       "reference_id", "verse_id", "probability")


def page_quotations_to_item(pages: DataFrame, corpus: ReferenceCorpus, item: str = "item_id",
                            page: str = "page_seq", **join_opts) -> DataFrame:
    """Quotations found page by page, one row per (item, reference).

    Each (item, verse) keeps its best page (highest probability, lowest
    page_seq); then the best version per reference is chosen as usual.
    """
    p = corpus.params
    pot = potential_matches(pages, corpus, [item, page], **join_opts)
    scored = score(keep_candidates(pot, p.min_tokens, p.min_tfidf), p.model)
    # Best page per (item, verse) as a grouped min over a struct: partial
    # aggregation keeps an item with very many pages from pinning one task.
    best = F.min(F.struct((-F.col("probability")).alias("neg"), F.col(page).alias("pg"),
                          F.col("probability").alias("p"))).alias("b")
    per_item = scored.groupBy(item, "verse_id").agg(best).select(
        item, "verse_id", F.col("b.pg").alias(page), F.col("b.p").alias("probability"))
    accepted = per_item.filter(F.col("probability") >= p.min_probability)
    return best_version(accepted, [item], p).select(item, "reference_id", "verse_id", page, "probability")


def match_statistics(potential: DataFrame, params: QuotationParams) -> DataFrame:
    """One row: potential pairs, kept pairs, percent kept, accepted pairs."""
    keep = (F.col("tokens") >= params.min_tokens) | (F.col("tfidf") >= params.min_tfidf)
    scored = score(potential, params.model)
    return scored.agg(
        F.count(F.lit(1)).alias("n_potential"),
        F.count_if(keep).alias("n_kept"),
        F.count_if(keep & (F.col("probability") >= params.min_probability)).alias("n_accepted"),
    ).withColumn("pct_kept", F.round(F.when(F.col("n_potential") > 0,
                                            F.col("n_kept") * 100.0 / F.col("n_potential")), 1))


def label_pairs(potential: DataFrame, pages: DataFrame, verses: DataFrame, item: str = "item_id") -> DataFrame:
    """``potential`` with a 0/1 ``label``: does the page text hold the verse text word for word?

    A page that holds a verse has its grams but, at most, the first and the
    last (whose outer words may be parts of longer ones), so the token
    product is at least the verse's length less two.  Only pairs with as much
    are compared, and each text moves once, to the verses asked of it.
    """
    length = F.round(F.col("tokens") / F.col("proportion"))
    asked = potential.filter(F.col("tokens") + 2 >= length).select(item, "verse_id") \
        .join(verses.select("verse_id", F.col("text").alias("verse_text")), "verse_id") \
        .groupBy(item).agg(F.collect_list(F.struct("verse_id", "verse_text")).alias("_asked"))
    held = pages.select(item, "text").join(asked, item).select(
        item, F.explode(F.filter("_asked", lambda v: F.instr(F.col("text"), v["verse_text"]) > 0)["verse_id"]).alias("verse_id"))
    return potential.join(held.distinct().withColumn("_held", F.lit(1)), [item, "verse_id"], "left") \
        .withColumn("label", F.coalesce("_held", F.lit(0))).drop("_held")


def fit_match_model(pairs: DataFrame, label: str = "label", max_iter: int = 50,
                    reg: float = 0.0, tolerance: float = 1e-10) -> MatchModel:
    """Learn centre/scale constants and logistic coefficients from labelled pairs.

    ``pairs`` carries the three FEATURES and a 0/1 ``label``.  Newton's method
    (reweighted least squares): one aggregate gives centres and scales, then
    one aggregate a step gives the log-loss, its gradient and its second
    derivatives as 15 sums, and the driver solves four equations.  A step moves
    no coefficient by more than MAX_STEP, and one that raises the loss is halved.  ``reg`` penalises squared coefficients (not
    the intercept) by reg / 2 each, beside the mean loss; where a feature tells the
    labels apart without error only reg > 0 gives a finite result.  No pairs, or pairs of one label, are
    an error.  Cut the lineage of ``pairs`` first: each step reads them.
    """
    import numpy as np

    y = F.col(label).cast("double")
    first = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("ones"),
                      *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_samp(f).alias(f"s_{f}") for f in FEATURES]).first()
    n, ones = first["n"], first["ones"] or 0
    if not 0 < ones < n:
        raise ValueError(f"labels of both kinds are needed: {ones:g} of {n} are 1")
    means = [float(first[f"m_{f}"]) for f in FEATURES]
    scales = [float(first[f"s_{f}"] or 0) or 1.0 for f in FEATURES]
    varies = np.array([True, *[bool(first[f"s_{f}"]) for f in FEATURES]])
    x = [F.lit(1.0), *[(F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(FEATURES, means, scales)]]
    width = len(x)
    ridge = n * reg * np.diag([0.0] + [1.0] * (width - 1))

    def sums(beta) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((F.lit(float(b)) * v for b, v in zip(beta[1:], x[1:])), F.lit(float(beta[0])))
        # log(1 + e^z) - y z without overflow
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z
        p = 1 / (1 + F.exp(-z))
        row = pairs.select(y.alias("y"), p.alias("p"), loss.alias("loss"), *[v.alias(f"x{i}") for i, v in enumerate(x)]).agg(
            F.sum("loss"), *[F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))) for i in range(width)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("p") * (1 - F.col("p"))) for i in range(width) for j in range(i, width)]).first()
        second = np.zeros((width, width))
        second[np.triu_indices(width)] = row[1 + width:]
        second = second + np.triu(second, 1).T
        return row[0] + float(beta @ ridge @ beta) / 2, np.array(row[1:1 + width]) - ridge @ beta, second + ridge

    beta = np.zeros(width)
    beta[0] = np.log(ones / (n - ones))
    loss, gradient, second = sums(beta)
    for _ in range(max_iter):
        # a feature that never varies has no sums of its own: least squares leaves it at 0, but for rounding
        step = np.where(varies, np.linalg.lstsq(second, gradient, rcond=None)[0], 0.0)
        step = step * min(1.0, MAX_STEP / max(np.abs(step).max(), MAX_STEP))
        while True:
            trial = sums(beta + step)
            if trial[0] <= loss * (1 + 1e-12) or np.abs(step).max() < tolerance:
                break
            step = step / 2
        beta, (loss, gradient, second) = beta + step, trial
        if np.abs(step).max() < tolerance * max(1.0, np.abs(beta).max()):
            break
    return MatchModel(intercept=float(beta[0]), coefficients=tuple(map(float, beta[1:])),
                      means=tuple(means), scales=tuple(scales))


def quotation_count(found: DataFrame) -> DataFrame:
    """One row: number of quotations found."""
    return found.agg(F.count(F.lit(1)).alias("n_quotations"))


def save_quotations(found: DataFrame, path: str) -> None:
    """Append quotations with the stored column types (probability as float)."""
    found.select("job_id", "item_id", "reference_id", "verse_id",
                 F.col("probability").cast("float").alias("probability")) \
        .write.mode("append").parquet(path)


def quotation_run(pages: DataFrame, corpus: ReferenceCorpus, path: str, **options) -> dict[str, int]:
    """Find quotations, append them to ``path``, and count them in the same pass.

    Returns n_potential, n_kept and n_quotations.  A stage that runs again
    after an executor is lost may count its rows twice; the stored rows are
    right then too (``quotation_count``)."""
    from pyspark.sql import Observation

    watch = {name: Observation(name) for name in ("potential", "kept", "found")}
    save_quotations(find_quotations(pages, corpus, watch=watch, **options), path)
    return {f"n_{'quotations' if k == 'found' else k}": o.get["n"] for k, o in watch.items()}


def export_potential(potential: DataFrame, path: str) -> None:
    """CSV dump (with header) of the potential matches, before pruning."""
    potential.write.mode("overwrite").option("header", True).csv(path)
