"""Column -> Column text functions (all JVM-side, no Python UDF).

Every rule can be written without look-around, as the SQL oracle does; one
(:data:`ABBREVIATION_DOT`) looks behind, which finds the same places sooner.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators and abbreviations used by the sentence splitter.
WORD_SPLIT = r"[^\p{L}\p{N}]+"
ABBREVIATIONS = r"(^|[\s(])(Mr|Mrs|Ms|Dr|Prof|St|Sr|Sra|Hr|Fr|Nr|vs|etc|bzw|usw|z\.B|e\.g|i\.e)\."
# The same dot, looked for by itself: only what stands before a dot is compared with the list, not every word.
ABBREVIATION_DOT = rf"\.(?<={ABBREVIATIONS})"
# Both rules of a sentence's end in one pass: white space after a stop, else line breaks (the group is empty then).
SENTENCE_END = r"([.!?])\s+|[\r\n]+"
SENT_MARK = "\u0001"   # marks a sentence boundary inside a string
DOT_MARK = "\u0002"    # protects the dot of an abbreviation


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_tokens(col) -> Column:
    """Lower-cased word tokens: runs of letters and digits.

    Separators at both ends are cut first, so the split yields no empty
    tokens and no per-element filter is needed."""
    t = F.regexp_replace(F.lower(_c(col)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(t == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(t, WORD_SPLIT))


def shifted_ngrams(items, n: int, sep: str = " ") -> Column:
    """Consecutive ``n``-element grams of an array, joined by ``sep``.

    Built from ``n`` shifted slices zipped together, so the input array
    expression is evaluated a fixed number of times per row (a lambda that
    slices the array per position would re-evaluate it per gram).
    """
    a = _c(items)
    length = F.size(a) - F.lit(n - 1)
    if n == 1:
        return a
    cols = [F.slice(a, k + 1, F.greatest(length, F.lit(1))) for k in range(n)]
    zipped = F.arrays_zip(*cols)
    zipped = F.transform(zipped, lambda z: F.concat_ws(sep, *[z[str(i)] for i in range(n)]))
    return F.when(length >= 1, zipped).otherwise(F.array().cast("array<string>"))


def word_ngrams(words, n: int) -> Column:
    """Consecutive ``n``-word grams joined by one space; empty when too short."""
    return shifted_ngrams(words, n, " ")


def text_ngrams(col, n: int) -> Column:
    return word_ngrams(word_tokens(col), n)


def _explode_shifted(df, keys, arr: str, n: int, sep: str, out: str, outer: bool = False):
    """Rows (keys..., gram): one per window of ``n`` consecutive elements of
    the array column ``arr``.  The ``n`` shifted slices are zipped and
    exploded, and the elements are joined after the explode, so no lambda
    runs per element and no row carries the whole input along."""
    gen = F.explode_outer if outer else F.explode
    if n == 1:
        return df.select(*keys, gen(arr).alias(out))
    length = F.greatest(F.size(arr) - F.lit(n - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(F.col(arr), k + 1, length) for k in range(n)])
    z = df.select(*keys, gen(zipped).alias("_z"))
    return z.select(*keys, F.concat_ws(sep, *[F.col("_z")[str(k)] for k in range(n)]).alias(out))


def explode_ngrams(df, keys, text: str, n: int, out: str = "gram"):
    """Rows (keys..., gram) with one row per word n-gram of ``text``.

    The word array is projected once before the grams are built, so the
    tokeniser runs once per row.
    """
    keys = list(keys)
    words = df.select(*keys, word_tokens(text).alias("_words"))
    return _explode_shifted(words, keys, "_words", n, " ", out)


def explode_char_ngrams(df, keys, text: str, n: int = 3, out: str = "gram", outer: bool = False):
    """Rows (keys..., gram) per character n-gram of :func:`letters_only` text.

    Texts are normalised so that no gram is all blanks.  With ``outer`` an
    input without grams keeps one row with a NULL gram.
    """
    keys = list(keys)
    chars = df.select(*keys, F.split(letters_only(text), "").alias("_chars"))
    g = _explode_shifted(chars, keys, "_chars", n, "", out, outer)
    return g.withColumn(out, F.when(F.col(out) != F.lit(""), F.col(out)))


def letters_only(col) -> Column:
    """Lower case, every run of non-letters becomes one space, padded by spaces."""
    squeezed = F.regexp_replace(F.lower(_c(col)), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.trim(squeezed), F.lit(" "))


def char_ngrams(col, n: int = 3) -> Column:
    """Character ``n``-grams of :func:`letters_only` text (all-blank grams dropped)."""
    chars = F.split(letters_only(col), "")
    grams = shifted_ngrams(chars, n, "")
    return F.filter(grams, lambda g: F.trim(g) != F.lit(""))


def sentences(col) -> Column:
    """Split text into sentences.

    A sentence ends at ``.``, ``!`` or ``?`` followed by white space, or at a
    line break.  Dots of a fixed list of abbreviations do not end a sentence.
    Pieces are trimmed; empty ones are dropped.
    """
    t = F.regexp_replace(_c(col), ABBREVIATION_DOT, DOT_MARK)
    t = F.regexp_replace(t, SENTENCE_END, "$1" + SENT_MARK)
    t = F.replace(t, F.lit(DOT_MARK), F.lit("."))
    parts = F.transform(F.split(t, SENT_MARK), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != F.lit(""))


def drop_last_words(col, k: int = 2) -> Column:
    """Remove the last ``k`` white-space separated words."""
    pattern = r"\s*" + r"\s+".join([r"\S+"] * k) + r"\s*$"
    return F.regexp_replace(_c(col), pattern, "")


def strip_version(col) -> Column:
    """``'Matthew 1:1 (KJV)'`` -> ``'Matthew 1:1'`` (greedy, like the reference)."""
    return F.regexp_replace(_c(col), r" \(.+\)", "")


def version_bonus(verse_id, probability, label: str = "KJV", bonus: float = 0.05) -> Column:
    """Probability plus ``bonus`` when the verse id contains ``label``."""
    p = _c(probability)
    return F.when(F.instr(_c(verse_id), label) > 0, p + F.lit(bonus)).otherwise(p)
