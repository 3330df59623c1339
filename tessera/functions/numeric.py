"""Scalar helpers as column expressions: rounding, tails, hashing, small linear algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Chebyshev coefficients of the complementary error function,
# fractional error below 1.2e-7 everywhere (a published rational fit)
ERFC_COEFFICIENTS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                     0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def as_col(value: Column | str | float | int) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(value)


def r6(value: Column | str) -> Column:
    """Round to 6 digits and drop the sign of zero, for results compared across engines."""
    return F.round(as_col(value).cast("double"), 6) + F.lit(0.0)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(as_col(top), as_col(bottom))


def norm_sf(z: Column | str) -> Column:
    """Upper tail of the standard normal distribution."""
    z = as_col(z)
    a = F.abs(z) / (2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.5 * a)
    poly = reduce(lambda acc, c: acc * t + F.lit(c), reversed(ERFC_COEFFICIENTS[:-1]),
                  F.lit(ERFC_COEFFICIENTS[-1]))
    half = 0.5 * t * F.exp(-a * a + poly)
    return F.when(z >= 0, half).otherwise(1.0 - half)


def chi2_sf(x: Column | str, df: Column | float) -> Column:
    """Chi-square upper tail by the cube-root normal approximation; `df` may be fractional."""
    df = as_col(df)
    spread = F.lit(2.0) / (9.0 * df)
    root = F.cbrt(F.greatest(ratio(as_col(x), df), F.lit(0.0)))
    return norm_sf((root - (1.0 - spread)) / F.sqrt(spread))


def hash_uniform(seed: Column | int | str, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) from md5 of seed and keys: the same on every engine and every retry."""
    text = F.concat_ws("|", F.lit(seed) if not isinstance(seed, Column) else seed.cast("string"),
                       *[as_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2 ** 52))


def hash_order(seed: Column | int | str, *keys: Column | str) -> Column:
    text = F.concat_ws("|", F.lit(seed) if not isinstance(seed, Column) else seed.cast("string"),
                       *[as_col(k).cast("string") for k in keys])
    return F.md5(text)


def solve3(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Cramer's rule for a symmetric or general 3x3 system held in columns; NULL if singular."""
    def det(m: list[list[Column]]) -> Column:
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
                - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    whole = det(a)
    swapped = [[[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)] for k in range(3)]
    return [ratio(det(m), F.when(F.abs(whole) > 1e-12, whole)) for m in swapped]


def sq_dist(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two array columns."""
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0),
                       lambda acc, v: acc + v)


def mean_of_present(*values: Column) -> Column:
    """Mean of the non-NULL values; NULL if there is none."""
    present = reduce(lambda p, q: p + q, [v.isNotNull().cast("int") for v in values])
    total = reduce(lambda p, q: p + q, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(present > 0, ratio(total, present))


def mean_if_complete(*values: Column) -> Column:
    """Mean of all values; NULL if any is missing."""
    return reduce(lambda p, q: p + q, values) / len(values)
