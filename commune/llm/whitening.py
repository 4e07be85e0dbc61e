"""Embedding whitening: PCA whitening with eigenpairs by spectrum slicing.

Vectors become integers (``floor(SCALE * c) + SHIFT``), so their count and sums per dimension are
exact. The covariance is centred before multiplying and summed over tasks of Spark; only the sums
and one matrix of ``dims`` x ``dims`` reach the driver, however many vectors there are.

Spectrum slicing finds the leading eigenpairs of that matrix one by one:

* The inertia of V - s I, read from the signs of a pivoted LDL' factorisation, tells how many
  eigenvalues lie above a shift s (Sylvester's law). Bisection on those counts encloses eigenvalue k
  alone, or with others that no shift tells apart.
* From a vector of the enclosed invariant subspace, Rayleigh quotient iteration converges
  cubically to the eigenvalue.
* The counts just above and just below the result certify its number: exactly k - 1 eigenvalues
  above, at least k above the lower side. A pair that fails is iterated again from another start.
* Vectors of eigenvalues that counts can't tell apart are made orthogonal to those found before,
  so a multiple eigenvalue gets a basis of its space.

Components stop at ``components``, at the number of dimensions, or where an eigenvalue is zero next
to the first (whitening would divide by it).

Defined results: a null vector, or one with a null, NaN or infinite entry, is dropped. Vectors of
another length than the commonest (the longest of these) are dropped too. One vector, equal
vectors or vectors without entries have no component and so no rows. Rows that repeat count each
and get equal rows. An empty table gives no rows. A deviation beyond BIGINT raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: An eigenvalue below this share of the first is zero to the precision of the covariance.
ZERO = 1e-12
#: Pivot ratio of the factorisation (Bunch and Kaufman).
_ALPHA = (1 + 17 ** 0.5) / 8
_LONG = 2 ** 63


# --- eigenpairs of a symmetric matrix ------------------------------------------------------

def inertia(a: np.ndarray) -> int:
    """Positive eigenvalues of symmetric ``a``, from a symmetrically pivoted LDL' factorisation."""
    a = a.copy()
    n, k, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        size = 1
        if k + 1 < n:
            r = k + 1 + int(np.abs(a[k + 1:, k]).argmax())
            below = abs(a[r, k])
            if below > 0 and abs(a[k, k]) < _ALPHA * below:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                most = row.max()
                if abs(a[k, k]) * most >= _ALPHA * below * below:
                    pass
                elif abs(a[r, r]) >= _ALPHA * most:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        d = a[k:k + size, k:k + size].copy()
        if size == 1:
            positive += bool(d[0, 0] > 0)
            if d[0, 0] != 0:
                left = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(left, left / d[0, 0])
        else:
            # A 2 x 2 pivot chosen this way is indefinite: one eigenvalue of either sign.
            positive += 1
            left = a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= left @ np.linalg.solve(d, left.T)
        k += size
    return positive


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` exceed ``shift``."""
    return inertia(v - shift * np.eye(len(v)))


@dataclass(frozen=True)
class EigenPair:
    value: float
    vector: np.ndarray
    low: float   # at least `number` eigenvalues lie above this
    high: float  # exactly `number` - 1 above this, unless the value is multiple


def _without(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``x`` made orthogonal to ``found`` (twice, for rounding) and of length one."""
    for _ in range(2):
        for q in found:
            x = x - (q @ x) * q
    size = np.linalg.norm(x)
    return x / size if size > 0 else x


def _rayleigh(v: np.ndarray, x: np.ndarray, found: list[np.ndarray], steps: int = 40) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from ``x`` within the complement of ``found``."""
    eye, scale = np.eye(len(v)), max(np.abs(v).max(), 1e-300)
    value = x @ v @ x
    for _ in range(steps):
        rest = v @ x - value * x
        if np.linalg.norm(rest) <= 1e-14 * scale * len(v):
            break
        try:
            y = np.linalg.solve(v - value * eye, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (value + 1e-15 * scale) * eye, x)
        if not np.isfinite(y).all():
            break
        x = _without(y / np.linalg.norm(y), found)
        value = x @ v @ x
    return float(value), x


def leading_pairs(v: np.ndarray, components: int = COMPONENTS) -> list[EigenPair]:
    """The leading eigenpairs of symmetric ``v``, numbered by certified inertia counts."""
    n = len(v)
    pairs: list[EigenPair] = []
    if not n:
        return pairs
    bound = float(np.abs(v).sum(1).max())  # every eigenvalue is within it, by Gershgorin's discs
    if bound == 0:
        return pairs
    tiny, top = 64 * n * np.finfo(float).eps * bound, bound * (1 + 1e-9)
    counts: dict[float, int] = {top: 0}
    rng = np.random.default_rng(0)

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    for number in range(1, min(components, n) + 1):
        found = [p.vector for p in pairs]
        # The closest shifts known on either side of eigenvalue ``number``.
        high = min(s for s, c in counts.items() if c < number)
        low = max((s for s, c in counts.items() if c >= number), default=-top)
        for attempt in range(8):
            width = (0.05 * max(abs(high), abs(low)) if attempt == 0 else tiny * 4 ** (8 - attempt))
            while high - low > max(width, tiny):
                middle = 0.5 * (low + high)
                if count(middle) >= number:
                    low = middle
                else:
                    high = middle
                if count(high) == number - 1 and count(low) == number and high - low < 0.25 * abs(high):
                    break
            # Inverse iteration at the middle turns any start towards the enclosed eigenvectors.
            x = _without(rng.standard_normal(n), found)
            shifted = v - 0.5 * (low + high) * np.eye(n)
            for _ in range(3):
                try:
                    x = _without(np.linalg.solve(shifted, x), found)
                except np.linalg.LinAlgError:
                    break
            value, x = _rayleigh(v, x, found)
            if low - tiny <= value <= high + tiny and count(value + tiny) < number <= count(value - tiny):
                break
        else:
            raise ArithmeticError(f"eigenvalue {number} could not be certified")
        if value <= ZERO * (pairs[0].value if pairs else bound):
            break
        pairs.append(EigenPair(value, x, value - tiny, value + tiny))
    return pairs


# --- sums over all vectors -----------------------------------------------------------------

def integers(vector: Column) -> Column:
    """The vector's entries as array<bigint>."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite entries only."""
    def finite(c: Column) -> Column:
        d = c.cast("double")
        return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors of the commonest length."""
    rows = embeddings.where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("x"))
    commonest = (rows.groupBy(F.size("x").alias("dims")).count()
                 .orderBy(F.desc("count"), F.desc("dims")).limit(1).collect())
    return rows.where(F.size("x") == (commonest[0].dims if commonest else 0))


def _matrix(batch: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate([np.asarray(x, np.int64) for x in batch]).reshape(len(batch), dims)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Count, and the sum of each dimension, exact; each task sends one row per dimension."""
    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, []
        for b in batches:
            if len(b):
                part = _matrix(b["x"], len(b["x"].iloc[0])).sum(0).tolist()
                n, total = n + len(b), [s + t for s, t in zip(total or [0] * len(part), part)]
        if total:
            yield pd.DataFrame({"k": range(len(total)), "n": n, "s": [str(t) for t in total]})

    rows = vectors.select("x").mapInPandas(added, "k int, n bigint, s string")
    found = (rows.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
             .orderBy("k").collect())
    return (int(found[0].n), [int(r.s) for r in found]) if found else (0, [])


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n, rounded once per entry: the integer part of S/n is taken off exactly."""
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - whole).astype(float) - rest


def covariance(vectors: DataFrame, n: int, total: list[int], projection: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors, or of their projection; each task sends one matrix."""
    dims = len(total)
    size = dims if projection is None else projection.shape[1]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summed, seen = np.zeros((size, size)), False
        for b in batches:
            if len(b):
                c = _centred(_matrix(b["x"], dims), n, total)
                if projection is not None:
                    c = c @ projection
                summed += c.T @ c
                seen = True
        if seen:
            yield pd.DataFrame({"i": np.arange(size), "row": list(summed)})

    rows = vectors.select("x").mapInPandas(products, "i int, row array<double>")
    cells = (rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
             .collect())
    out = np.zeros((size, size))
    for r in cells:
        out[r.i, r.j] = r.v
    return (out + out.T) / (2 * n)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    n, total = sums(vectors)
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    v = covariance(vectors, n, total) if n else np.zeros((0, 0))
    pairs = leading_pairs(v, components)
    if not pairs:
        return spark.createDataFrame([], schema)
    projection = np.stack([p.vector / np.sqrt(p.value) for p in pairs], axis=1)
    explained = np.array([p.value for p in pairs]) / np.trace(v)
    error = float(np.abs(covariance(vectors, n, total, projection) - np.eye(len(pairs))).max())
    dims = len(total)
    large = np.array(total, dtype=object)

    # One row per vector leaves Python; its components are told apart afterwards. The id passes as
    # text, since pandas would turn ids beside a null into floating point.
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["x"], dims)
            c = _centred(x, n, total)
            # n * x - S in 64 bits where every square and their sum fit, else in Python's integers.
            if (np.abs(c).max() + 1) ** 2 * float(n) ** 2 * dims < _LONG / 4 and max(map(abs, total)) < _LONG / 4:
                off = x * n - np.array(total, np.int64)
                deviation = (off * off).sum(1)
            else:
                off = x.astype(object) * n - large
                deviation = (off * off).sum(1)
                if max(deviation) >= _LONG:
                    raise OverflowError("a deviation doesn't fit BIGINT")
                deviation = deviation.astype(np.int64)
            yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": deviation, "w": list(c @ projection)})

    made = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(
        rows, "vec_id string, deviation bigint, w array<double>")
    share = F.array(*[F.lit(float(e)) for e in explained])
    return made.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.posexplode("w").alias("k", "whitened"),
                       "deviation").select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
