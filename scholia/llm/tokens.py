"""Operator 1, token counts: a digest cache in front of the tokenizer.

Each text's normalised content gets a SHA-256 digest; digests are joined to
the counts stored for this tokenizer version; only distinct contents without
a stored count are encoded, and their counts are appended to the cache.

A tokenizer that drops white space (``drops_blanks``) gives a text as many
tokens as its words have: contents then have their blank runs made one
space, and a task encodes each distinct word once (in a memo of at most
``MEMO_WORDS``).  Other tokenizers encode whole contents.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted alike and each kept; null ids are kept; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import to_workers
from .skew import salted_join
from .store import keep, read_if_there

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Texts handed to the tokenizer at once, in bytes.
ENCODE_BYTES = 1 << 20
MEMO_WORDS = 300_000


def blank_runs_as_one(text: Column) -> Column:
    """Content for tokenizers that drop white space: ASCII white space runs become one space."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def tokenizer_version(vocabulary: bytes, kind: str, normal: str = "") -> str:
    """Digest of the vocabulary file, its library, that library's version and how contents are normalised."""
    library = __import__({"json": "tokenizers", "model": "sentencepiece"}[kind])
    return hashlib.sha256(f"{kind} {library.__version__} {normal} ".encode() + vocabulary).hexdigest()[:32]


def counter(vocabulary: bytes, kind: str):
    """A function from a list of texts to their token counts, without added special tokens."""
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary.decode())
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
    return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]


def by_words(count):
    """The counts of texts as the sums of their words' counts, each distinct word counted once."""
    memo: dict[str, int] = {}

    def run(texts: list[str]) -> list[int]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        split = [t.split(" ") for t in texts]
        new = list(set().union(*split) - memo.keys())
        memo.update(zip(new, count(new)))
        return [sum(map(memo.__getitem__, words)) for words in split]

    return run


def _encoder(vocabulary, kind: str, drops_blanks: bool):
    def encode(batches):
        count = None
        for batch in batches:
            texts = arrays.filled(batch["content"])
            out: list[int] = []
            for a, b in arrays.pieces(texts, ENCODE_BYTES):
                if count is None:
                    count = counter(vocabulary.value, kind)
                    count = by_words(count) if drops_blanks else count
                out += count(texts.slice(a, b - a).to_pylist())
            yield pa.record_batch({"digest": batch["digest"], "n_tokens": pa.array(out, pa.int64())})

    return encode


def token_counts(docs: DataFrame, vocabulary_path: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 drops_blanks: bool = False) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens.

    ``cache_path``: a Parquet folder in shared storage, one partition per
    tokenizer version; it is made if absent and only ever appended to.
    ``drops_blanks``: the tokenizer cuts at white space and drops it.
    """
    spark = docs.sparkSession
    kind = vocabulary_path.rsplit(".", 1)[-1]
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()  # a vocabulary file: a few MB whatever the corpus
    version = tokenizer_version(vocabulary, kind, "one blank" if drops_blanks else "as is")  # the contents of a cache partition are normalised alike
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), (blank_runs_as_one(text) if drops_blanks else text).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))

    def stored() -> DataFrame | None:
        cache = read_if_there(spark, cache_path, CACHE_SCHEMA)
        return cache.filter(F.col("tokenizer") == version).select("digest", "n_tokens") if cache is not None else None

    known = stored()
    distinct = rows.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct if known is None else distinct.join(known, "digest", "left_anti")
    counted = misses.mapInArrow(_encoder(spark.sparkContext.broadcast(vocabulary), kind, drops_blanks), "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    # two runs at once may both store a content: equal counts, so any one will do
    counts = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # narrow and stored: copies of one content, of which there may be very many, are dealt over tasks
    asked = keep(rows.select("id", "n_bytes", "digest"), "token-rows")
    return salted_join(asked, counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


to_workers(sys.modules[__name__])
