"""CEIL community score and move gains as native column expressions.

For a community with n (original) vertices, internal weight a and total weight t
(internal plus boundary), in a graph of N level-0 vertices:

    S(n, a, t) = 0                          if n <= 1 or t == 0
               = 2 a^2 / ((n - 1) t N)      otherwise

Every factor is cast to DOUBLE before multiplying, in a fixed left-to-right order, so
equal inputs give bit-equal gains (the argmax compares gains exactly) and no 64-bit
product can overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def ceil_score(n: Column, a: Column, t: Column, total_vertices: int) -> Column:
    """S(n, a, t): the score used by move gains (denominator t)."""
    return F.when((n <= 1) | (t == 0), F.lit(0.0)).otherwise(
        (F.lit(2.0) * _d(a) * _d(a)) / ((_d(n) - F.lit(1.0)) * _d(t) * F.lit(float(total_vertices)))
    )


def reported_score(n: Column, a: Column, t: Column, total_vertices: int) -> Column:
    """The per-community score summed into a level's reported score (denominator a + t)."""
    return F.when((n <= 1) | ((a + t) == 0), F.lit(0.0)).otherwise(
        (F.lit(2.0) * _d(a) * _d(a)) / ((_d(n) - F.lit(1.0)) * _d(a + t) * F.lit(float(total_vertices)))
    )


# Move gains as SQL text with the same operation order: one ``F.expr`` call instead of dozens of
# Column calls. Joining: change of S when a vertex (out_w, int_n, int_w) with incident weight inc
# joins (n, a, t). Staying: S of the own community minus S of it without the vertex.


def score_sql(n: str, a: str, t: str, total_vertices: int) -> str:
    d = lambda x: f"CAST(({x}) AS DOUBLE)"
    return (f"(CASE WHEN ({n}) <= 1 OR ({t}) = 0 THEN 0.0D ELSE "
            f"(2.0D * {d(a)} * {d(a)}) / (({d(n)} - 1.0D) * {d(t)} * {float(total_vertices)!r}D) END)")


def join_gain_sql(n: str, a: str, t: str, inc: str, out_w: str, int_n: str, int_w: str, total_vertices: int) -> str:
    after = score_sql(f"{n} + {int_n}", f"{a} + {inc} + {int_w}", f"{t} + {out_w} - {inc} + {int_w}", total_vertices)
    return f"({after} - {score_sql(n, a, t, total_vertices)})"


def stay_gain_sql(n: str, a: str, t: str, inc_own: str, out_w: str, int_n: str, int_w: str,
                  total_vertices: int) -> str:
    without = score_sql(f"{n} - {int_n}", f"{a} - {int_w} - {inc_own}", f"{t} - {out_w} - {int_w} + {inc_own}",
                        total_vertices)
    return f"({score_sql(n, a, t, total_vertices)} - {without})"


# Sums of doubles that don't depend on the order of the rows: three integer limbs of 30 bits per
# term below ``2 ** power``, summed as BIGINT (up to 2^33 rows).


def exponent(largest: float) -> int:
    """The smallest power of two above ``largest``."""
    return math.frexp(largest)[1]


def limb_sums(term: Column, power: int) -> list[Column]:
    """Aggregates: the sums of the limbs of ``term``, highest first."""
    rest, sums = term, []
    for k in (1, 2, 3):
        unit = math.ldexp(1.0, power - 30 * k)
        limb = F.floor(rest / F.lit(unit))
        rest = rest - limb.cast("double") * F.lit(unit)
        sums.append(F.sum(limb))
    return sums


def limbs_total(limbs: list[int | None], power: int) -> float:
    """The sum that ``limb_sums`` stand for, rounded once."""
    high, middle, low = (int(x or 0) for x in limbs)
    return math.ldexp(float((high << 60) + (middle << 30) + low), power - 90)
