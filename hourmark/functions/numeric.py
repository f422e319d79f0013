"""Numeric column expressions: sentinels, quantile inversion, draws, recursions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the integer mixing used for reproducible draws.
DRAW_PRIME = 2147483647
DRAW_STEP = 1013904223
DRAW_FACTORS = (7919, 104729, 1299709)


def ratio_or_sentinel(num: Column, den: Column, sentinel: float = -99.0, tol: float = 1e-8) -> Column:
    return F.when(F.abs(den) <= tol, sentinel).otherwise(F.try_divide(num, den))


def percentage_or_null(num: Column, den: Column, tol: float = 1e-12) -> Column:
    return F.when(F.abs(den) > tol, F.lit(100.0) * num / den)


def clip(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return out


def blend_at_lead(baseline: Column, challenger: Column, weight: float | Column, lead: Column, at: int = 1) -> Column:
    """Move the baseline towards the challenger only at one lead."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.when(lead == at, baseline + w * (challenger - baseline)).otherwise(baseline)


def clear_sky_index(irradiance: Column, ghi: Column, minimum: float, sentinel: float = -999.0) -> Column:
    return F.when(ghi >= minimum, irradiance / ghi).otherwise(sentinel)


def sorted_quantiles(columns: Sequence[str]) -> Column:
    """Quantile columns as one increasing array (repairs crossings)."""
    return F.array_sort(F.array(*[F.col(c) for c in columns]))


def inverse_marginal(rank: Column, values: Column, levels: Sequence[float]) -> Column:
    """Linear interpolation of ``values`` (array on ``levels``) at ``rank``, clamped."""
    u = clip(rank, levels[0], levels[-1])
    out = values[len(levels) - 1]
    for i in range(len(levels) - 2, -1, -1):
        lo, hi = levels[i], levels[i + 1]
        segment = values[i] + (u - lo) * ((values[i + 1] - values[i]) / F.lit(hi - lo))
        out = F.when(u < hi, segment).otherwise(out)
    return out


def draw(scenario: Column, ordinal: Column, seed: int, rounds: int = 3) -> Column:
    """Deterministic pseudo-random integer in ``[0, DRAW_PRIME)``.

    Squaring modulo a prime below 2^31 stays inside 64 bits, needs no state and
    gives the same value under any partitioning, unlike ``rand(seed)``.
    """
    a, b, c = DRAW_FACTORS
    x = (scenario.cast("bigint") * a + ordinal.cast("bigint") * b + F.lit(c * seed)) % DRAW_PRIME
    for _ in range(rounds):
        x = (x * x + DRAW_STEP) % DRAW_PRIME
    return x


def draw_index(scenario: Column, ordinal: Column, seed: int, n: Column) -> Column:
    """Index in ``[0, n)``; null when there is nothing to draw from."""
    return draw(scenario, ordinal, seed) % F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))


def draw_uniform(scenario: Column, ordinal: Column, seed: int) -> Column:
    """Fraction in ``[0, 1)``."""
    return draw(scenario, ordinal, seed) / F.lit(float(DRAW_PRIME))


def slope(values: Column) -> Column:
    """Least-squares slope of an ordered array against its index; 0 for fewer than two."""
    n = F.size(values).cast("double")
    weighted = F.aggregate(
        F.transform(values, lambda v, i: v * (i.cast("double") - (n - 1.0) / 2.0)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return F.when(n >= 2, weighted / (n * (n * n - 1.0) / 12.0)).otherwise(0.0)


def ar1_forecast(values: Column, steps: Column, limit: float = 0.98, tol: float = 1e-8) -> Column:
    """AR(1) fitted to a short ordered array, iterated ``steps`` times in closed form.

    The coefficient is clipped to +-limit; a constant history returns its mean.
    """
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    n = F.size(values)
    x = F.slice(values, F.lit(1), n - 1)
    y = F.slice(values, F.lit(2), n - 1)
    pairs = (n - 1).cast("double")
    mean_x, mean_y = total(x) / pairs, total(y) / pairs
    sxx = total(F.transform(x, lambda v: (v - mean_x) * (v - mean_x)))
    sxy = total(F.zip_with(x, y, lambda a, b: (a - mean_x) * (b - mean_y)))
    phi = clip(sxy / sxx, -limit, limit)
    intercept = mean_y - phi * mean_x
    power = F.pow(phi, steps.cast("double"))
    forecast = intercept * (F.lit(1.0) - power) / (F.lit(1.0) - phi) + power * F.element_at(values, -1)
    return F.when(sxx <= tol, total(values) / n).otherwise(forecast)
