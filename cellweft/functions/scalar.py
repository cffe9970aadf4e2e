"""Column expressions on arrays and numbers: normalisation, transforms, kernels, bins, distribution functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column, by: Column | None = None) -> Column:
    """The array divided by the sum of `by` (itself by default); unchanged where that sum is 0."""
    s = total(v if by is None else by)
    return F.when(s == 0, v).otherwise(F.transform(v, lambda x: x / s))


def log_normalise(v: Column, scale: float = 1e4, guard: bool = False) -> Column:
    """log(1 + scale * share); without `guard` an all-zero row gives NaN, with it zeros."""
    s = total(v)
    share = lambda x: F.when(s == 0, x if guard else F.lit(float("nan"))).otherwise(x / s)
    return F.transform(v, lambda x: F.log1p(F.lit(scale) * share(x)))


def arcsinh(x: Column, cofactor: float = 5.0) -> Column:
    return F.asinh(x / F.lit(cofactor))


def l2_normalise(v: Column) -> Column:
    """Scaled to length one; a row of length 0 becomes zeros."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def standardise(v: Column) -> Column:
    """Centred, with unit sample variance (n - 1); a constant row becomes NaN."""
    m = total(v) / F.size(v)
    sd = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(v) - 1))
    return F.transform(v, lambda x: F.when(sd > 0, (x - m) / sd).otherwise(F.lit(float("nan"))))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), 0 where high equals low."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))


def bins(x: Column, low: Column, high: Column, n: int = 100) -> Column:
    """1..n, right-closed bins of equal width over [low, high]; all in one middle bin where high equals low."""
    return F.when(high > low, F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(F.round((x - low) / (high - low) * F.lit(n), 9))))).otherwise(F.lit((n + 1) // 2)).cast("int")


def distance_weight(d: Column, c: float) -> Column:
    return F.exp(-d / F.lit(c))


def anchor_kernel(w: Column, sd: float = 1.0) -> Column:
    return F.lit(1.0) - F.exp(-w / F.lit((2.0 / sd) ** 2))


def rescale_clamped(s: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - low) / (high - low)))).otherwise(F.lit(0.0))


def q_strength(q: Column, scaling: float = 1e-10) -> Column:
    return -F.log10(q + F.lit(scaling))


#: Coefficients of a published rational approximation of the error function (error under 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    z = (x - mean) / sd / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(z))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    tail = poly * F.exp(-z * z)
    return F.when(z >= 0, F.lit(1.0) - tail / 2).otherwise(tail / 2)


def normal_cdf_sql(x: str, mean: str = "0.0", sd: str = "1.0") -> str:
    """The same formula as SQL text."""
    z = f"((({x}) - ({mean})) / ({sd}) / 1.4142135623730951)"
    t = f"(1.0 / (1.0 + {ERF_P} * abs({z})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})) * {t})"
    tail = f"({poly} * exp(-{z} * {z}) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"
