"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 junk, 1 well-formed but toxic, 2 good. With features x of a text,
P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector is shared by all grades, the
thresholds are ordered. The expected grade is the sum of the tails P(grade > k); selection is
by the tail P(grade >= 1).

Features are hashed text: each word gives its lower-cased self, its last letters and its shape
(runs of letter case, digits and other characters) as features, and a mark if it repeats the
word before; a text's features are the square roots of their means over its words, so that a
passage of junk in a long text still shows. The places of a word's features are remembered.

The fit reads a bounded sample: ``LIMITS`` labelled rows per grade, in the order of a hash of the
id; rows weigh as in the whole labelled table. Every text is scored whole.

Defined results: a text without words (null included) has expected grade and tail 0. Null
labels are no labels. Without labels of two grades, every other text has tail 1 and the top
grade. Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import give_back, held_out, labelled_sample, table, text_or_empty

BUCKETS = 2048
GRADES = 3
#: Bound of the training sample: labelled rows per grade.
LIMITS = {0: 1500, 1: 1000, 2: 2000}
#: Words whose features a task remembers, none of them longer than ``LONGEST_KEPT`` characters.
KEPT_WORDS, LONGEST_KEPT = 50_000, 64
MIN_TAIL = 0.5
_UPPER, _LOWER_RUN = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+")


def shape(word: str) -> str:
    """Runs of capitals become A, of other letters a, of digits 0; other characters stay."""
    return re.sub(r"\d+", "0", _LOWER_RUN.sub("a", _UPPER.sub("A", word)))


def buckets_of(word: str) -> tuple[int, int, int]:
    h = xxhash.xxh32_intdigest
    return (h("w" + word.lower()) % BUCKETS, h("e" + word[-3:]) % BUCKETS, h("s" + shape(word)) % BUCKETS)


REPEAT = xxhash.xxh32_intdigest("repeats the word before") % BUCKETS


def features(text: str, known: dict) -> np.ndarray:
    """Square roots of the mean hashed features of a text's words (zeros without words)."""
    x = np.zeros(BUCKETS, np.float32)
    words = text.split()
    if words:
        at = []
        for w in words:
            b = known.get(w)
            if b is None:
                b = buckets_of(w)
                if len(w) <= LONGEST_KEPT:
                    if len(known) > KEPT_WORDS:
                        known.clear()
                    known[w] = b
            at += b
        x += np.bincount(at, minlength=BUCKETS)
        x[REPEAT] += sum(a == b for a, b in pairwise(words))
        x /= len(words)
    return np.sqrt(x)


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...] = ()
    thresholds: tuple[float, ...] = ()
    offset: float = 0.0


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def fit_cumulative(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray, grades: int = GRADES, ridge: float = 1e-2,
                   steps: int = 300) -> QualityModel:
    """Maximum likelihood with a ridge by Adam on standardised features; thresholds by positive gaps."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-8, scale, np.inf).astype(np.float32)
    z = ((x - mean) / scale).astype(np.float32)
    share = np.array([row_weight[y <= k].sum() for k in range(grades - 1)]) / row_weight.sum()
    start = np.log((share + 1e-3) / (1 - share + 1e-3))
    par = np.concatenate([np.zeros(x.shape[1]), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    d, rw = x.shape[1], row_weight / row_weight.sum()
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        gaps = np.exp(par[d + 1:])
        cuts = par[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = z @ par[:d].astype(np.float32)
        below = np.concatenate([np.zeros((1, len(y))), _sigmoid(cuts[:, None] - s), np.ones((1, len(y)))])
        rows = np.arange(len(y))
        hi, lo = below[y + 1, rows], below[y, rows]
        like = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        grad_s = rw * (d_hi - d_lo)
        grad_cut = np.array([-(rw * d_hi)[y == k].sum() + (rw * d_lo)[y == k + 1].sum() for k in range(grades - 1)])
        later = np.cumsum(grad_cut[::-1])[::-1]
        grad = np.concatenate([z.T @ grad_s.astype(np.float32) + ridge * par[:d], [later[0]], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        par = par - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    w = par[:d] / scale
    cuts = par[d] + np.concatenate([[0.0], np.cumsum(np.exp(par[d + 1:]))])
    return QualityModel(tuple(w.tolist()), tuple(cuts.tolist()), float(-(w * mean).sum()))


def grade_column() -> Column:
    """The graded rating of a row of labels."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def fit(documents: DataFrame, labels: DataFrame, limits: dict[int, int] = LIMITS) -> QualityModel:
    sample, counts = labelled_sample(documents, labels, grade_column(), limits)

    @F.pandas_udf("binary")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for b in batches:
            yield pd.Series([features(t, known).tobytes() for t in b])

    got = sample.where(F.col("text").rlike(r"\S")).select("label", vector("text").alias("x")).collect()
    y = np.array([r.label for r in got], int)
    if len(set(y.tolist())) < 2:
        return QualityModel()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), BUCKETS)
    taken = np.bincount(y, minlength=GRADES)
    row_weight = np.array([counts.get(k, 0) / max(taken[k], 1) for k in range(GRADES)])[y]
    return fit_cumulative(x, y, row_weight)


def rating_column(model: QualityModel, text: Column) -> Column:
    """struct<expected double, tail double>: expected grade, and P(grade >= 1)."""
    w, cuts = np.array(model.weights), np.array(model.thresholds)

    @F.pandas_udf("expected double, tail double")
    def rating(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            means = np.full(len(b), np.nan)
            for k, t in enumerate(b):
                if t and not t.isspace():
                    means[k] = features(t, known) @ w if len(w) else 0.0
            if len(w):
                tails = 1 - _sigmoid(cuts[:, None] - (means + model.offset)[None, :])
            else:
                tails = np.where(np.isnan(means), np.nan, 1.0)[None, :].repeat(GRADES - 1, 0)
            tails = np.nan_to_num(tails)
            yield pd.DataFrame({"expected": tails.sum(0), "tail": tails[0]})
        known.clear()
        give_back()

    return rating(text_or_empty(text))


def classify(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, expected_grade, p_acceptable, keep), one row per row of ``documents``."""
    rated = documents.select("doc_id", rating_column(model, F.col("text")).alias("r"))
    return rated.select("doc_id", F.col("r.expected").alias("expected_grade"), F.col("r.tail").alias("p_acceptable"),
                        (F.col("r.tail") >= MIN_TAIL).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rated.withColumn("held_out", held_out(F.col("doc_id")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably better than junk, all their columns unchanged."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(rating_column(model, F.col("text"))["tail"] >= MIN_TAIL)
