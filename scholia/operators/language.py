"""Sentence language detection with character n-gram profiles.

Profiles: per language, all character 3-grams of labelled text with add-one
smoothing, ``logp = ln((c + 1) / (total + V))``
(total = the language's gram count, V = number of distinct profile
grams over all languages).  A gram missing
from a language's profile scores ``unseen = ln(1 / (total + V))``.
Grams are counted where the text is read, in Arrow batches: what leaves a
task is a row per language and distinct gram of about ``CHUNK`` code points.

Detection: a sentence is scored where its page is read, in Arrow batches
against a broadcast (gram -> per-language gain) table: no row per gram and
no exchange.  The table has a row per distinct gram and a number per
language; if that comes to more than ``BROADCAST_BYTES``, the sentences'
grams are joined with it by a shuffle and summed per sentence.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import LANGUAGE_NAMES, LANGUAGE_TAGS, map_lookup
from ..functions.text import explode_char_ngrams, letters_only, sentences
from ..session import spread

UNDETERMINED = "UND"
#: Largest gain table that is broadcast.
BROADCAST_BYTES = 64 << 20
#: A gram of so many code points fits a 64-bit number.
MAX_CODED = 3
#: Bits of a code point.
WIDTH = 21
#: Most possible grams of an alphabet that get a place in a table.
MAX_PLACES = 1 << 20
#: Code points counted or scored at a time.
CHUNK = 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks bring their functions along: executors need no package path


def _coded_grams(texts: list[str], n: int, rank=None, base: int = 1 << WIDTH):
    """The ``n``-grams of the texts as numbers to this base, text by text, and how many each text has.
    A digit is a code point or, with ``rank``, the code point's place there (its last place for those beyond)."""
    import numpy as np
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    counts = np.maximum(lens - n + 1, 0)
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), counts
    if rank is not None:
        points = rank[np.minimum(points, len(rank) - 1)]
    grams = points[:m].copy()
    for i in range(1, n):
        grams *= base
        grams += points[i:i + m]
    inside = np.ones(len(points), dtype=bool)
    for i in range(1, n):                        # a gram ends in its own text
        inside[np.cumsum(lens) - i] = False
    return grams[inside[:m]], counts


def _counter(n: int):
    """mapInArrow body: rows (lang, _letters) -> (lang, gram, count), a gram once per language and chunk of text."""
    chunk = CHUNK

    def count(texts):
        import numpy as np
        codes, counts = np.unique(_coded_grams(texts, n)[0], return_counts=True)
        points = np.stack([(codes >> (WIDTH * (n - 1 - i))) & ((1 << WIDTH) - 1) for i in range(n)], axis=1).astype("<u4")
        joined = points.tobytes().decode("utf-32-le")
        return [joined[i:i + n] for i in range(0, len(joined), n)], counts

    def tally(batches):
        import pyarrow as pa
        for batch in batches:
            of = batch.schema.field("lang").type
            parts, sizes = {}, {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_letters")):
                text = text.as_py() or ""
                for at in range(0, len(text) - n + 1, chunk):
                    piece = text[at:at + chunk + n - 1]
                    parts.setdefault(lang, []).append(piece)
                    sizes[lang] = sizes.get(lang, 0) + len(piece)
                    if sizes[lang] >= chunk:
                        grams, counts = count(parts.pop(lang))
                        del sizes[lang]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), of), pa.array(grams, pa.string()), pa.array(counts, pa.int64())],
                                                         names=["lang", "gram", "count"])
            for lang, texts in parts.items():
                grams, counts = count(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), of), pa.array(grams, pa.string()), pa.array(counts, pa.int64())],
                                                 names=["lang", "gram", "count"])
    return tally


def train_profiles(labelled: DataFrame, label: str = "lang", text: str = "text", n: int = 3,
                   label_map: dict | None = LANGUAGE_TAGS) -> DataFrame:
    """(lang, gram, count): every gram of each language.  A tag that
    ``label_map`` does not have is a language under its own name."""
    src = labelled.select(
        (F.coalesce(map_lookup(F.col(label), label_map), F.col(label)) if label_map else F.col(label)).alias("lang"), text)
    src = spread(src.filter(F.col("lang").isNotNull()))
    if n <= MAX_CODED:
        letters = src.select("lang", letters_only(text).alias("_letters"))
        schema = T.StructType([letters.schema["lang"], T.StructField("gram", T.StringType()), T.StructField("count", T.LongType())])
        return letters.mapInArrow(_counter(n), schema).groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    return explode_char_ngrams(src, ["lang"], text, n).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("count"))


@dataclass
class Profiles:
    """Profile table ``(lang, gram, count, logp)`` plus per-language constants.

    The constants (one per language) are the only values brought to the
    driver; the table stays distributed.
    """
    table: DataFrame
    languages: list[str]
    unseen: dict
    vocabulary: int

    @classmethod
    def build(cls, counts: DataFrame) -> "Profiles":
        from ..session import cut_lineage
        t = cut_lineage(counts.select("lang", "gram", "count"))
        totals = {r["lang"]: r["total"] for r in
                  t.groupBy("lang").agg(F.sum("count").alias("total")).collect()}
        V = t.select("gram").distinct().count()
        langs = sorted(totals)
        denom = {L: float(totals[L] + V) for L in langs}
        table = t.withColumn("logp", F.log((F.col("count") + 1) / map_lookup(F.col("lang"), denom)))
        return cls(table, langs, {L: math.log(1.0 / denom[L]) for L in langs}, V)

    def gains(self) -> DataFrame:
        """(gram, g_0 .. g_k): logp - unseen per language, 0 where absent."""
        cols = [F.sum(F.when(F.col("lang") == L, F.col("logp") - F.lit(self.unseen[L])).otherwise(F.lit(0.0)))
                .alias(f"g_{i}") for i, L in enumerate(self.languages)]
        return self.table.groupBy("gram").agg(*cols)


def sentence_table(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., sentence_seq, sentence)."""
    return pages.select(*keys, F.posexplode(sentences(F.col(text))).alias("sentence_seq", "sentence")) \
        .withColumn("sentence_seq", F.col("sentence_seq").cast("int"))


def _places(codes, n: int):
    """(rank, places) that find a gram's place in ``codes`` by number: ``rank`` of each code point in the profiles'
    alphabet (0: not there), ``places`` by the ranks of a gram (-1: not there).  (None, None) for an alphabet
    with more than ``MAX_PLACES`` possible grams, whose grams are searched for."""
    import numpy as np
    digits = np.stack([(codes >> (WIDTH * (n - 1 - i))) & ((1 << WIDTH) - 1) for i in range(n)])
    alphabet = np.unique(digits)
    base = len(alphabet) + 1
    if not len(codes) or base ** n > MAX_PLACES:
        return None, None
    rank = np.zeros(alphabet[-1] + 2, dtype=np.int64)
    rank[alphabet] = np.arange(1, base)
    places = np.full(base ** n, -1, dtype=np.int32)
    places[sum(rank[d] * base ** (n - 1 - i) for i, d in enumerate(digits))] = np.arange(len(codes))
    return rank, places


def _detector(profiles: Profiles, n: int, min_margin: float):
    """mapInArrow body: rows with ``_letters`` -> the same rows with ``lang``."""
    import numpy as np
    gains = profiles.gains().toPandas()
    code = lambda g: sum(ord(c) << (WIDTH * (n - 1 - i)) for i, c in enumerate(g))
    codes = np.array([code(g) for g in gains["gram"]], dtype=np.int64)
    order = np.argsort(codes)
    codes = codes[order]
    table = gains[[f"g_{i}" for i in range(len(profiles.languages))]].to_numpy(dtype=float)[order]
    unseen = np.array([profiles.unseen[L] for L in profiles.languages])
    shared = profiles.table.sparkSession.sparkContext.broadcast((codes, table, unseen, *_places(codes, n)))
    langs, und, chunk = list(profiles.languages), UNDETERMINED, CHUNK

    def score(texts, codes, table, unseen, rank, places):
        k = len(texts)
        grams, count = _coded_grams(texts, n) if rank is None else _coded_grams(texts, n, rank, int(rank.max()) + 1)
        if not len(grams) or not len(codes):
            return [und] * k
        owner = np.repeat(np.arange(k), count)
        if rank is None:
            at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
            hit = codes[at] == grams
        else:
            at = places[grams]
            hit = at >= 0
        at, owner = at[hit], owner[hit]
        known = np.bincount(owner, minlength=k)
        totals = np.stack([np.bincount(owner, weights=table[at, i], minlength=k) + count * unseen[i]
                           for i in range(len(langs))], axis=1)
        best = totals.argmax(axis=1)             # ties go to the first language
        sure = known > 0
        if len(langs) > 1:
            top = np.sort(totals, axis=1)
            sure &= ~(top[:, -1] - top[:, -2] < min_margin * count)
        return [langs[b] if s else und for b, s in zip(best, sure)]

    def detect(batches):
        import pyarrow as pa
        for batch in batches:
            texts = batch.column("_letters").to_pylist()
            out, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size >= chunk:
                    out += score(part, *shared.value)
                    part, size = [], 0
            out += score(part, *shared.value)
            cols = [c for c in batch.schema.names if c != "_letters"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + [pa.array(out, pa.string())], names=[*cols, "lang"])
    return detect


def sentence_languages(pages: DataFrame, profiles: Profiles, keys=("item_id",), n: int = 3,
                       min_margin: float = 0.0) -> DataFrame:
    """(keys..., sentence_seq, lang): best language per sentence, or ``UND``.

    ``UND`` when none of the sentence's grams is in any profile, or when the
    best score beats the second by less than ``min_margin`` per gram.
    """
    keys = list(keys)
    sk = keys + ["sentence_seq"]
    sents = sentence_table(spread(pages.select(*keys, "text")), keys)
    if n <= MAX_CODED and profiles.vocabulary * (40 + 8 * len(profiles.languages)) <= BROADCAST_BYTES:
        coded = sents.select(*sk, letters_only("sentence").alias("_letters"))
        schema = T.StructType([coded.schema[k] for k in sk] + [T.StructField("lang", T.StringType())])
        return coded.mapInArrow(_detector(profiles, n, min_margin), schema)
    grams = explode_char_ngrams(sents, sk, "sentence", n, outer=True)
    langs, gains = profiles.languages, profiles.gains()
    g = grams.join(gains, "gram", "left")
    agg = g.groupBy(*sk).agg(
        F.count("gram").alias("_n"),
        F.count("g_0").alias("_known"),
        *[F.coalesce(F.sum(f"g_{i}"), F.lit(0.0)).alias(f"_s{i}") for i in range(len(langs))])
    scores = [F.col("_n") * F.lit(profiles.unseen[L]) + F.col(f"_s{i}") for i, L in enumerate(langs)]
    agg = agg.select(*sk, "_n", "_known", *[s.alias(f"_t{i}") for i, s in enumerate(scores)])
    t = [F.col(f"_t{i}") for i in range(len(langs))]
    best = F.greatest(*t) if len(t) > 1 else t[0]
    best_lang = F.coalesce(*[F.when(t[i] == best, F.lit(L)) for i, L in enumerate(langs)])
    second = F.sort_array(F.array(*t), asc=False)[1] if len(t) > 1 else F.lit(float("-inf"))
    und = (F.col("_known") == 0) | ((best - second) < F.lit(min_margin) * F.col("_n"))
    # Sentences without any gram (no letters) have _known = 0 and are UND too.
    return agg.select(*sk, F.when(und, F.lit(UNDETERMINED)).otherwise(best_lang).alias("lang"))


def language_counts(detected: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, lang, sentences): sentences per language over all pages of the item."""
    return detected.groupBy(item, "lang").agg(F.count(F.lit(1)).cast("int").alias("sentences"))


def multilingual_items(counts: DataFrame, item: str = "item_id", min_sentences: int = 2,
                       min_share: float = 0.2) -> DataFrame:
    """(item, n_languages, languages): items with at least two detected
    languages, each having >= ``min_sentences`` sentences and >= ``min_share``
    of the item's determined sentences (UND does not count)."""
    det = counts.filter(F.col("lang") != UNDETERMINED)
    # Per-item total by a window: an item has at most one row per language,
    # so each window group is bounded by the number of languages.
    j = det.withColumn("_total", F.sum("sentences").over(Window.partitionBy(item)))
    ok = j.filter((F.col("sentences") >= min_sentences) &
                  (F.col("sentences") >= F.lit(min_share) * F.col("_total")))
    return (ok.groupBy(item).agg(F.count(F.lit(1)).alias("n_languages"),
                                 F.array_join(F.sort_array(F.collect_list("lang")), ",").alias("languages"))
            .filter(F.col("n_languages") >= 2))


def dominant_language(counts: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, lang, sentences): the language with most sentences (UND excluded;
    ties to the smaller code)."""
    det = counts.filter(F.col("lang") != UNDETERMINED)
    best = det.groupBy(item).agg(F.min(F.struct((-F.col("sentences")).alias("neg"), F.col("lang"))).alias("b"))
    return best.select(item, F.col("b.lang").alias("lang"), (-F.col("b.neg")).cast("int").alias("sentences"))


def language_agreement(counts: DataFrame, declared: DataFrame, item: str = "item_id",
                       names: str = "languages") -> DataFrame:
    """(item, detected, declared, agrees): dominant detected language against
    the item's declared language names mapped to codes (a name without a
    code stands for itself)."""
    dom = dominant_language(counts, item)
    codes = declared.select(item, F.transform(F.col(names), lambda x: F.coalesce(map_lookup(F.lower(x), LANGUAGE_NAMES), x))
                            .alias("_codes"))
    j = dom.join(codes, item, "left")
    return j.select(item, F.col("lang").alias("detected"),
                    F.array_join(F.array_sort(F.coalesce(F.col("_codes"), F.array().cast("array<string>"))), ",")
                    .alias("declared"),
                    F.coalesce(F.array_contains(F.col("_codes"), F.col("lang")), F.lit(False)).alias("agrees"))


def save_language_counts(counts: DataFrame, path: str, item: str = "item_id",
                         destination: str = "language") -> None:
    """Append (job_id, item_id, lang, sentences) rows; a job id is derived
    from the item when absent.  One write per call, so an item's counts are
    committed together."""
    from ..functions.records import uuid_of
    if "job_id" not in counts.columns:
        counts = counts.withColumn("job_id", uuid_of(F.col(item), F.lit(destination)))
    counts.select("job_id", F.col(item).alias("item_id"), "lang", F.col("sentences").cast("int")) \
        .write.mode("append").parquet(path)
