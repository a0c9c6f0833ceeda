"""Quality classifier by Bradley-Terry pairwise ranking (operator 9).

A document's features are the shares of its words by shape (runs of lower
case letters, capitals and digits each count as one sign, so ``THE!!`` is
``A!``), hashed into columns, and a few numbers on repetition and length.
From labelled documents, preference pairs (a good one, a bad one) are drawn;
the score is linear and learned by logistic loss on the difference of the
features of a pair.  A quantile of the scores of the labelled documents is
the threshold, and the score is mapped to 0..1 so that the threshold is 0.3.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest
hashes of their doc_id, whatever the size of the corpus.  The features are
centred and scaled over all rows, and the threshold and the slope come from
the scores of all labelled rows, by a histogram.  Features and scores cover
every whole text.  doc_id, lang, source and labels are never
inputs of a score.

Defined results: a null or empty text has all-zero features and a score; a
null doc_id has no label and is not held out; labels that are null or of
unknown documents are left out, repeated ones count each; without both kinds
of label every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column
from .wordseq import split_words

SHAPES = 64
NUMBERS = 6
FOLDS = 5
SAMPLE = 20_000
PAIRS = 60_000
RIDGE = 1e-3
THRESHOLD = 0.3


@dataclass
class Ranking:
    """Scores by ``weights`` over scaled features; ``cut`` is the raw score
    at the threshold."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, feats: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(feats), 0.5)
        raw = ((feats - self.center) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)), -35, 35)))


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``SHAPES + NUMBERS`` features per text."""
    words = split_words(texts)
    docs, doc, n = len(texts), words.doc, np.diff(words.off)
    shape = words.vocab
    for run, sign in ((r"[\p{Ll}\p{Lo}\p{Lm}]+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, run, sign)
    for mark in "!#$%&*|.-_=+~":  # a run of one sign counts once
        shape = pc.replace_substring_regex(shape, "[" + ("\\" + mark) + "]+", mark)
    shapes = shape.dictionary_encode()
    slot = np.array([zlib.crc32(s.encode()) % SHAPES for s in shapes.dictionary.to_pylist()], np.int64)
    slot = slot[shapes.indices.to_numpy(zero_copy_only=False)] if len(slot) else slot
    out = np.zeros((docs, SHAPES + NUMBERS))
    some = np.maximum(n, 1)
    if len(words.code):
        out[:, :SHAPES] = np.bincount(doc * SHAPES + slot[words.code], minlength=docs * SHAPES).reshape(docs, SHAPES) / some[:, None]
        again = np.r_[False, (words.code[1:] == words.code[:-1]) & (doc[1:] == doc[:-1])]
        out[:, SHAPES] = np.bincount(doc, again, docs) / some
        pair = np.unique(doc * (int(words.code.max()) + 1) + words.code)
        distinct = np.bincount(pair // (int(words.code.max()) + 1), minlength=docs)
        out[:, SHAPES + 1] = distinct / some
        out[:, SHAPES + 2] = np.log1p(n - distinct)
        length = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False)
        out[:, SHAPES + 3] = np.bincount(doc, length[words.code], docs) / some
        out[:, SHAPES + 4] = np.bincount(doc, length[words.code] == 1, docs) / some
        out[:, SHAPES + 5] = np.log1p(n)
    return out


def featurised(docs: DataFrame) -> DataFrame:
    """``(doc_id, feats)`` of every document."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                feats = features(column(part, "text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, feats.size + 1, feats.shape[1]), pa.int32()),
                                                 pa.array(feats.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), lists], ["doc_id", "feats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, feats array<float>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def moments(feats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows.  Batches add up as
    whole numbers of 2**-32, so no order of the partitions changes a bit."""
    whole = pa.decimal128(38, 0)

    def run(batches):
        for batch in batches:
            x = column(batch, "feats").flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPES + NUMBERS).astype(np.float64)
            sums, squares = ([Decimal(int(v * 2.0 ** 32)) for v in y.sum(axis=0)] for y in (x, x * x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([len(x)] * len(sums), pa.int64()), pa.array(sums, whole),
                 pa.array(squares, whole)], ["k", "n", "s", "q"])

    rows = (feats.select("feats").mapInArrow(run, "k int, n long, s decimal(38,0), q decimal(38,0)")
            .groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("k").collect())
    if not rows or not rows[0][1]:
        return np.zeros(SHAPES + NUMBERS), np.ones(SHAPES + NUMBERS)
    mean = [Fraction(int(s), n << 32) for _, n, s, _ in rows]
    spread = [Fraction(int(q), n << 32) - m * m for (_, n, _, q), m in zip(rows, mean)]
    return np.array([float(m) for m in mean]), np.maximum([math.sqrt(max(v, 0)) for v in spread], 1e-3)


def bins_of(raw: np.ndarray) -> np.ndarray:
    """Bins in the order of the scores, a 2048th of a power of two wide."""
    bits = raw.astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF) - 1, bits) >> 12


def histogram(rows: DataFrame, center: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bins of the raw scores of ``rows(l_quality, feats)`` in order, as
    ``least, most, bad, good``."""
    def run(batches):
        for batch in batches:
            x = column(batch, "feats").flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPES + NUMBERS)
            raw = ((x.astype(np.float64) - center) / scale) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(bins_of(raw)), pa.array(raw), column(batch, "l_quality").cast(pa.int32())],
                                             ["bin", "raw", "good"])

    found = (rows.select("l_quality", "feats").mapInArrow(run, "bin long, raw double, good int").groupBy("bin")
             .agg(F.min("raw"), F.max("raw"), F.sum(1 - F.col("good")), F.sum("good")).orderBy("bin").collect())
    return np.array([tuple(r)[1:] for r in found], np.float64)


def middle(bins: np.ndarray, count: np.ndarray) -> float:
    """Median score, to the width of a bin."""
    at = int(np.searchsorted(np.cumsum(count), count.sum() / 2))
    return float(bins[at, 0] + bins[at, 1]) / 2


def fit(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Learn from the labels of documents that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").alias("l_quality")).where(
        F.col("l_quality").isin(0, 1) & ~held_out(F.col("l_id")))
    marked = feats.join(marks, F.col("doc_id") == F.col("l_id"))
    rows = (marked.orderBy(F.xxhash64("doc_id"), "doc_id", "l_quality").limit(sample).select("l_quality", "feats").toArrow())
    y = rows["l_quality"].to_numpy()
    x = rows["feats"].combine_chunks().flatten().to_numpy().reshape(len(y), SHAPES + NUMBERS).astype(np.float64) if len(y) else np.zeros((0, SHAPES + NUMBERS))
    center, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(center, scale, center, 0.0, 0.0)
    center, scale = moments(feats)
    z = (x - center) / scale
    draw = np.random.default_rng(0)
    d = z[draw.choice(good, PAIRS)] - z[draw.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(12):  # Newton steps on the pairwise logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        grad = RIDGE * w - d.T @ p / PAIRS
        hess = (d * (p * (1 - p))[:, None]).T @ d / PAIRS + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 10 / (np.linalg.norm(step) + 1e-12))
    bins = histogram(marked, center, scale, w)
    bad, good = bins[:, 2], bins[:, 3]
    # the quantile with the fewest documents on the wrong side
    wrong = np.r_[0, np.cumsum(good)] + np.r_[bad.sum(), bad.sum() - np.cumsum(bad)]
    best = np.flatnonzero(wrong == wrong.min())
    at = int(best[len(best) // 2])
    cut = (bins[max(0, at - 1), 1] + bins[min(len(bins) - 1, at), 0]) / 2
    spread = middle(bins, good) - middle(bins, bad)
    return Ranking(center, scale, w, float(cut), float(8 / max(spread, 1e-9)))


def scored(feats: DataFrame, model: Ranking) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of featurised documents."""
    def run(batches):
        for batch in batches:
            x = column(batch, "feats").flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPES + NUMBERS)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(model.score(x.astype(np.float64)))], ["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def passing(docs: DataFrame, model: Ranking) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    names = docs.columns
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keep = [model.score(features(column(part, "text"))) >= THRESHOLD
                    for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.select(*names).mapInArrow(run, docs.schema)
