"""Rounding, ratios and tail probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column, digits: int = 2) -> Column:
    """Scale, round half to even, scale back: the rule numeric Python libraries use."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def percentage(part: Column, whole: Column) -> Column:
    """Percentage rounded to two digits; null when the whole is zero."""
    return round_half_even(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0))


def kolmogorov_tail(statistic: Column, n: Column, m: Column, series_terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value for distance `statistic`."""
    effective = n.cast("double") * m.cast("double") / (n + m).cast("double")
    scaled = F.sqrt(effective) * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(series_terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * scaled * scaled),
    )
    # Below 0.2 the tail differs from 1 by less than 1e-12 and the series converges slowly.
    return F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
