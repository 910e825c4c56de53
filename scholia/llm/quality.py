"""Operator 4, quality classifier: Naive Bayes support vectors.

A text's features are indicators of hashed n-grams: byte 1- to 4-grams with
case kept, and 1- to 3-grams of "this word repeats the one before".  Each
indicator is scaled by its class log-count ratio, counted over every
training row; a linear model with hinge loss is fitted on the scaled vectors
(brought to unit length by the number of indicators) by dual coordinate
descent; its margin becomes a score by a logistic curve.

The fit takes at most ``sample_rows`` training rows, chosen by a hash of the
id; the log-count ratios, the split and the scores cover all rows.

Defined cases: a null text is empty and scored as such; rows without a label
(or with a null one) do not train; with no training rows, or one class only,
the score is that class's share (0.5 without rows); repeated rows count as
often as they come; null ids are kept and never held out nor joined to a
label; extra columns pass unchanged through ``filter_quality``.
"""

from __future__ import annotations

import sys
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import to_workers
from .store import join_small

#: Feature buckets.
BITS = 16
SLICES = 16
#: Bound on the rows that the linear model is fitted on.
SAMPLE_ROWS = 8192
PASSES = 12


@dataclass
class Model:
    weights: np.ndarray  # of the scaled indicators: ratio times fitted weight
    bias: float
    slope: float
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def ngram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram at each byte, for n from 1 to 4 (those at the end are left out).

    ``data`` is a block: a long text's blocks overlap by three bytes.
    """
    out, code = [], np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        code = (code[:len(data) - n + 1] | data[n - 1:].astype(np.uint32) << np.uint32(8 * (n - 1))) if len(data) >= n else np.zeros(0, np.uint32)
        x = (code ^ np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x = (x ^ x >> np.uint32(15)) * np.uint32(0xC2B2AE35)
        out.append((x >> np.uint32(32 - BITS)).astype(np.uint16))
    return out


def repeat_buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of the runs of repeated words in one text: repeats of 1, 2 and 3 words in a row, and their share in eighths."""
    if len(words) < 2:
        return np.zeros(0, np.int64)
    again = words[1:] == words[:-1]
    two = again[1:] & again[:-1]
    three = two[1:] & two[:-1]
    share = int(8 * again.mean())
    names = [j for j, x in enumerate((again, two, three)) if x.any()] + [3 + j for j in range(1, share + 1)]
    return (np.array(names, np.int64) * 7919 + 104729) & ((1 << BITS) - 1)


def text_features(column: pa.Array):
    """Yield a bitmap of present buckets per text (the same array, filled anew)."""
    texts = arrays.filled(column)
    hasher = arrays.WordHasher(fold_ascii=False)
    present = np.zeros(1 << BITS, bool)
    for a, b in arrays.pieces(texts):
        data, offsets = arrays.utf8(texts.slice(a, b - a))
        grams = ngram_buckets(data) if b - a > 1 else None
        words, at = hasher.words(data, offsets)
        for i in range(b - a):
            present[:] = False
            first, end = offsets[i], offsets[i + 1]
            if grams is None:  # one text, of any length
                for block in range(0, len(data), arrays.PIECE_BYTES):
                    for g in ngram_buckets(data[block:block + arrays.PIECE_BYTES + 3]):
                        present[g] = True
            else:
                for n, g in enumerate(grams, 1):
                    present[g[first:max(first, end - n + 1)]] = True
            present[repeat_buckets(words[at[i]:at[i + 1]])] = True
            yield present


def fit(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, passes: int = PASSES, cost: float = 1.0) -> Model:
    """Hinge-loss linear model on (label 0 or 1, present buckets) by dual coordinate descent."""
    n = len(rows)
    y = np.array([1.0 if label else -1.0 for label, _ in rows])
    # values are worked out anew at each step: held, they would take many times the memory of the bucket numbers
    scale = np.array([1 / np.sqrt(max(1, len(idx))) for _, idx in rows])
    square = np.array([float((ratio[idx] ** 2).sum()) * c * c + 1.0 for (_, idx), c in zip(rows, scale)])
    # both classes weigh the same in total
    limit = cost * np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    weights, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(n)
    order = np.random.default_rng(arrays.SEED)
    for _ in range(passes):
        for i in order.permutation(n):
            idx = rows[i][1]
            v = ratio[idx] * scale[i]
            slack = y[i] * (weights[idx] @ v + bias) - 1.0
            new = min(max(alpha[i] - slack / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[idx] += step * v
                bias += step
                alpha[i] = new
    margins = np.array([(weights[idx] @ ratio[idx]) * c + bias for (_, idx), c in zip(rows, scale)])
    slope, shift = logistic(margins, y)
    return Model((weights * ratio).astype(np.float32), bias, slope, shift)


def logistic(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the curve from margins to scores, with smoothed targets, by Newton steps."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(g * margins).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def in_training(doc_id: Column) -> Column:
    """Whether a row may train: crc32 of the id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2, F.lit(True))


def _class_counts(batches):
    counts = np.zeros((2, (1 << BITS) + SLICES), np.int64)
    seen = False
    for batch in batches:
        for label, present in zip(batch["quality"].to_pylist(), text_features(batch["text"])):
            counts[label, :1 << BITS] += present
            counts[label, 1 << BITS] += 1
            seen = True
    if seen:
        yield arrays.counts_to_rows(counts.reshape(-1), 2 * SLICES)


def _sample_features(batches):
    for batch in batches:
        packed = [np.flatnonzero(p).astype(np.uint16).tobytes() if p.sum() < (1 << BITS) // 16 else np.packbits(p).tobytes() + b"\0"
                  for p in text_features(batch["text"])]
        yield pa.record_batch({"quality": batch["quality"], "h": batch["h"], "features": pa.array(packed, pa.binary())})


def unpack(features: bytes) -> np.ndarray:
    """Sorted bucket numbers: 16-bit numbers, or (an odd length) a bitmap of 8 KB."""
    if len(features) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(features[:-1], np.uint8))).astype(np.uint16)
    return np.frombuffer(features, np.uint16)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` that may train."""
    known = labels.filter(F.col(label_col).isin(0, 1) & in_training(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("quality"))
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    rows = join_small(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known, "id", rows=2_000_000)
    width = 2 * ((1 << BITS) + SLICES)
    counts = arrays.sum_counts(rows.select("quality", "text").mapInArrow(_class_counts, arrays.COUNT_SCHEMA), 2 * SLICES, width).reshape(2, -1)
    down, up = counts[0, 1 << BITS], counts[1, 1 << BITS]
    if not down or not up:
        share = (up / (up + down)) if up + down else 0.5
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    p, q = 1.0 + counts[1, :1 << BITS], 1.0 + counts[0, :1 << BITS]
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # about sample_rows rows by a hash, then at most so many; each is 8 KB at most
    part = min(1.0, 1.2 * sample_rows / (up + down))
    h = F.xxhash64(F.lit("quality"), "id")
    sample = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    sample = sample.mapInArrow(_sample_features, "quality int, h long, features binary").orderBy("h", "features").limit(sample_rows).toLocalIterator()
    model = fit([(r["quality"], unpack(bytes(r["features"]))) for r in sample], ratio)
    arrays.release()  # the sample was thousands of small arrays, which the driver would go on holding through later stages
    return model


def margins(model: Model, column: pa.Array) -> np.ndarray:
    out = [float(model.weights[present].sum(dtype=np.float64)) / np.sqrt(max(1, present.sum())) for present in text_features(column)]
    return np.array(out, np.float64) + model.bias


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, score, predicted (1 if the score reaches the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # plain values: a broadcast pickles classes by name

    def run(batches):
        fitted = Model(*shared.value)
        for batch in batches:
            s = fitted.score(margins(fitted, batch["text"]))
            yield pa.record_batch({"id": batch["id"], "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # plain values: a broadcast pickles classes by name
    at = docs.columns.index(text_col)

    def run(batches):
        fitted = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(fitted.score(margins(fitted, batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


to_workers(sys.modules[__name__])
