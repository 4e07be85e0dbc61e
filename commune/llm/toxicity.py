"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Every window
of a document (a run of whole words of about ``WINDOW`` characters, lower-cased) is compressed
with both; the difference of the two lengths is how much better the toxic dictionary explains
it. The differences over all windows of the whole text give a few statistics, and a logistic
calibration on training rows turns these into a score in (0, 1).

Training
* A dictionary is raw content: common words of the whole sample (the same in both, at the
  same distance from the window, so ordinary text compresses alike) after the words that
  are specific to the class.
* A word is specific to a class if it stands in significantly more different contexts there
  (z-score and rate ratio). Counting distinct (word, next word) pairs instead of occurrences
  keeps copies of one document from counting many times.
* The sample is bounded: ``max_toxic`` and ``max_ordinary`` labelled rows, in the order of a
  hash of the id. Counting is a Spark job; the driver receives one row per frequent word.

Defined results: a null text is an empty one; a text without a window has statistics zero
and gets the calibrated score of those; a null label is no label. Repeated rows are scored
alike, each of them. With no toxic or no ordinary training row every score is the share of
toxic rows (0 without any label). Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from commune.llm.common import give_back, held_out, labelled_sample, table, text_or_empty

#: Characters of a window; a longer word is cut.
WINDOW = 64
#: Bounds of the training sample, in labelled rows.
MAX_TOXIC, MAX_ORDINARY = 1500, 4000
#: Bounds of the dictionaries, in words.
BASE_WORDS, CLASS_WORDS = 1500, 1000
#: A class word has at least this z-score and this ratio of rates.
MIN_Z, MIN_RATIO = 6.0, 5.0
#: Contexts that a word needs to be counted at all.
MIN_COUNT = 8

_WINDOWS = re.compile(r"\S.{0,%d}(?!\S)|\S{1,%d}" % (WINDOW - 1, WINDOW), re.S)


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionary contents, and the calibration: weights over standardised statistics."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0


def windows(text: str) -> list[bytes]:
    return [w.encode("utf-8", "replace") for w in _WINDOWS.findall(text.lower())]


def _compressor(content: bytes):
    # The same explicit parameters for both dictionaries: zstandard would otherwise choose
    # other match finders for contents of different sizes, which adds noise.
    params = zs.ZstdCompressionParameters(window_log=16, hash_log=15, chain_log=15, search_log=4, min_match=3,
                                          target_length=32, strategy=zs.STRATEGY_LAZY2, write_checksum=False,
                                          write_content_size=False, write_dict_id=False)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=d, compression_params=params).compress


N_STATS = 8


def statistics(text: str, by_toxic, by_ordinary) -> list[float]:
    """Largest difference, mean of the two and four largest, mean, excess over 3, log count, products."""
    ws = windows(text)
    if not ws:
        return [0.0] * N_STATS
    d = np.fromiter((len(by_ordinary(w)) - len(by_toxic(w)) for w in ws), np.float64, len(ws))
    top = np.sort(d)[::-1]
    most, mean, size = top[0], d.mean(), math.log1p(len(ws))
    return [most, top[:2].mean(), top[:4].mean(), mean, np.maximum(d - 3, 0).sum(), size, most * size, mean * size]


def _class_words(sample: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Words of the toxic class, of the ordinary class, and common ones; rarest or weakest first."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    pairs = (sample.select("toxic", words.alias("w"))
             .select("toxic", F.explode(F.arrays_zip(F.col("w"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))))
                     .alias("p"))
             .select("toxic", F.col("p.w").alias("word"), F.col("p").getField("1").alias("next")).distinct())
    counts = pairs.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    total = counts.agg(F.sum("a"), F.sum("b")).first()
    n_a, n_b = int(total[0] or 0), int(total[1] or 0)
    if not n_a or not n_b:
        return [], [], []
    rows = [(r.word, int(r.a), int(r.b)) for r in
            counts.where(F.col("a") + F.col("b") >= MIN_COUNT).orderBy(F.desc(F.col("a") + F.col("b")), "word")
            .limit(200_000).collect()]
    toxic, ordinary, common = [], [], []
    for w, a, b in rows:
        p = (a + b) / (n_a + n_b)
        z = (a / n_a - b / n_b) / math.sqrt(p * (1 - p) * (1 / n_a + 1 / n_b))
        ratio = ((a + 1) / n_a) / ((b + 1) / n_b)
        if z > MIN_Z and ratio > MIN_RATIO:
            toxic.append((z, w))
        elif z < -MIN_Z and ratio < 1 / MIN_RATIO:
            ordinary.append((-z, w))
        else:
            common.append(w)
    best = lambda found: [w for _, w in sorted(found)[-CLASS_WORDS:]]
    return best(toxic), best(ordinary), common[:BASE_WORDS][::-1]


def _calibrate(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray, ridge: float = 0.5):
    """Logistic regression by Newton's method on standardised columns plus an intercept."""
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (row_weight * (p - y)) + ridge * w
        step = np.linalg.solve((z * (row_weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC,
        max_ordinary: int = MAX_ORDINARY) -> ToxicityModel:
    """Model from a bounded sample of the labelled rows outside the evaluation fold."""
    sample, rows = labelled_sample(documents, labels, F.col("toxic"), {1: max_toxic, 0: max_ordinary})
    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    prior = n1 / max(n1 + n0, 1)
    sample = sample.withColumnRenamed("label", "toxic").cache()
    try:
        toxic, ordinary, base = _class_words(sample)
        if not toxic:
            return ToxicityModel(b"", b"", prior=prior)
        content = lambda words: f" {' '.join(words)} ".encode()
        model = ToxicityModel(content(toxic + base), content(ordinary + base), prior=prior)
        got = sample.select("toxic", statistics_column(model, F.col("text")).alias("s")).collect()
    finally:
        sample.unpersist()
    y = np.array([r.toxic for r in got], float)
    # Rows weigh as in the whole labelled table, whose classes the sample doesn't keep.
    share = np.where(y == 1, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    mean, scale, w = _calibrate(np.array([r.s for r in got], float), y, share * len(y) / share.sum())
    return ToxicityModel(model.toxic, model.ordinary, tuple(mean), tuple(scale), tuple(w), prior)


def statistics_column(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, o = _compressor(model.toxic), _compressor(model.ordinary)
        for b in batches:
            yield pd.Series([statistics(x, t, o) for x in b])

    return stats(text_or_empty(text))


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score of a text in [0, 1]; 0.5 and above is toxic."""
    if not model.weights:
        return F.lit(float(model.prior))
    z = np.array(model.mean), np.array(model.scale), np.array(model.weights)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, o = _compressor(model.toxic), _compressor(model.ordinary)
        for b in batches:
            x = np.array([statistics(s, t, o) for s in b]).reshape(len(b), N_STATS)
            v = np.c_[(x - z[0]) / z[1], np.ones(len(x))] @ z[2]
            yield pd.Series(1 / (1 + np.exp(-np.clip(v, -30, 30))))
        give_back()

    return score(text_or_empty(text))


def classify(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted), one row per row of ``documents``."""
    scored = documents.select("doc_id", score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't judged toxic, all their columns unchanged."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(score_column(model, F.col("text")) < 0.5)
