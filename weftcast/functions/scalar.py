"""Scalar column expressions (#58-#62)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def r6(c) -> Column:
    """Engine-stable rounding of a computed double for the oracle comparison.

    Rounds to 9 significant digits (never finer than 1e-9 absolute) after a relative nudge of 1e-13 away from
    zero, and folds -0.0 into 0.0.  Averages of 2-decimal inputs are often
    exact decimals ending in 5, where a fixed-dp rounding flips on the last
    ulp; the nudge moves every such value off the rounding boundary in both
    engines alike.  The DuckDB side uses the same formula (``sqlparts.r6``).
    """
    c = F.col(c) if isinstance(c, str) else c
    x = c.cast("double")
    p = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.abs(x))), F.lit(-1)))
    y = F.round(x * F.lit(1.0 + 1e-13) / p, 8) * p
    return F.when((x == 0) | F.isnan(x) | ~F.abs(x).between(1e-300, 1e300), x + F.lit(0.0)) \
        .otherwise(y + F.lit(0.0))


def finite_or_null(c) -> Column:
    """NaN -> NULL: pandas has one 'missing', Spark two; normalise at ingest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def log1p_target(c, method: str = "log1p") -> Column:
    """Forward target transform (#59)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.log1p(c.cast("double")) if method == "log1p" else c.cast("double")


def expm1_clip(c, method: str = "log1p") -> Column:
    """Inverse transform then clip at 0 (#60); NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    inv = F.expm1(c) if method == "log1p" else c.cast("double")
    return F.when(inv.isNotNull(), F.greatest(inv, F.lit(0.0)))


def rint_long(c) -> Column:
    """Half-to-even rounding to an integer count (#61)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c).cast("long")


def seasonality_columns(period_col: str, weekofyear_col: str | None = None) -> list[Column]:
    """Cyclic week-of-year (period 52) and month (period 12) encodings (#58).

    Week 53 exists and simply wraps past 52, as in the reference.
    """
    p = F.col(period_col)
    woy = (F.col(weekofyear_col) if weekofyear_col else F.weekofyear(p)).cast("double")
    month = F.month(p).cast("double")
    two_pi = 2.0 * math.pi
    return [
        F.sin(F.lit(two_pi) * woy / 52.0).alias("woy_sin"),
        F.cos(F.lit(two_pi) * woy / 52.0).alias("woy_cos"),
        F.sin(F.lit(two_pi) * month / 12.0).alias("month_sin"),
        F.cos(F.lit(two_pi) * month / 12.0).alias("month_cos"),
    ]


def harmonic(m, exact_upto: int = 64) -> Column:
    """Harmonic number H(m) = sum_{i<=m} 1/i as a Column.

    Exact summation for small m, the asymptotic series beyond (error < 1e-13
    for m > 64), so the cost per row is bounded.
    """
    m = F.col(m) if isinstance(m, str) else m
    md = m.cast("double")
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(m.cast("int"), F.lit(1))),
                        F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i)
    asym = (F.log(md) + F.lit(EULER_GAMMA) + F.lit(1.0) / (2.0 * md)
            - F.lit(1.0) / (12.0 * md * md) + F.lit(1.0) / (120.0 * F.pow(md, 4)))
    return (F.when(m <= 0, F.lit(0.0))
             .when(m <= exact_upto, exact)
             .otherwise(asym))
