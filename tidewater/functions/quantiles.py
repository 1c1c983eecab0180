"""Exact quantiles by narrowing ranks; no task ever holds a whole column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the quantile sketch of a pass; it looks twice the error to either side of a rank.
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, nulls left out.

    A pass asks a mergeable sketch for values near each wanted rank and counts exactly how many values lie below them.
    Either one of them has the rank, or two of them enclose it with a few of the sketch's errors between. Ranks shrink,
    not values, so the number of passes is about log(rows) / log(accuracy) for any values, and a task hands on a few
    numbers and a sketch. Infinities are values like any other; between a finite value and an infinity the
    interpolation gives that infinity.
    """
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    counts = df.agg(*[F.count(v).alias(f"n_{i}") for i, v in enumerate(values)]).first() if columns else []
    wanted: dict[tuple[int, int], Open] = {}
    for i, n in enumerate(counts):
        for p in probabilities if n else ():
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                wanted[i, rank] = Open(None, None, 0, n)
    found: dict[tuple[int, int], float] = {}
    while wanted:
        candidates = _candidates(df, values, wanted, accuracy)
        below = _counts_below(df, values, candidates)
        for (i, rank), inside in list(wanted.items()):
            answer = inside.narrow(rank, [(v, *below[i, v]) for v in candidates[i, rank]])
            if answer is not None:
                found[i, rank] = answer
                del wanted[i, rank]
    out: dict[str, list[float | None]] = {}
    for i, column in enumerate(columns):
        out[column] = []
        for p in probabilities:
            if not counts[i]:
                out[column].append(None)
                continue
            position = p * (counts[i] - 1)
            low, high = found[i, math.floor(position)], found[i, math.ceil(position)]
            share = position - math.floor(position)
            if low == high or not share:
                out[column].append(low)
            elif math.isinf(low) or math.isinf(high):
                out[column].append(low * (1 - share) + high * share)
            else:
                out[column].append(low + (high - low) * share)
    return out


class Open:
    """Values strictly between `low` and `high` (None: no limit), with `before` values below and `count` inside."""

    def __init__(self, low: float | None, high: float | None, before: int, count: int) -> None:
        self.low, self.high, self.before, self.count = low, high, before, count

    def condition(self, value: Column) -> Column:
        inside = value.isNotNull()
        if self.low is not None:
            inside = inside & (value > self.low)
        return inside if self.high is None else inside & (value < self.high)

    def shares(self, rank: int, margin: float) -> list[float]:
        middle = (rank - self.before + 0.5) / self.count
        return [min(1.0, max(0.0, middle + step * margin)) for step in (-1.0, 0.0, 1.0)]

    def narrow(self, rank: int, counted: list[tuple[float, int, int]]) -> float | None:
        """Take in values with how many of the column are smaller, and smaller or equal; the value of the rank, if known."""
        end = self.before + self.count
        for value, smaller, up_to in counted:
            if smaller <= rank < up_to:
                return value
            if up_to <= rank and (self.low is None or value > self.low):
                self.low, self.before = value, up_to
            elif smaller > rank and (self.high is None or value < self.high):
                self.high, end = value, smaller
        self.count = end - self.before
        return None


def _candidates(df: DataFrame, values: list[Column], wanted: dict, accuracy: int) -> dict[tuple[int, int], list[float]]:
    """Values near each rank; ranks that look into the same interval share one sketch and its values."""
    shared: dict[tuple, list[float]] = {}
    for (i, rank), inside in wanted.items():
        shared.setdefault((i, inside.low, inside.high), []).extend(inside.shares(rank, 2.0 / accuracy))
    asked, first = [], {(i, inside.low, inside.high): inside for (i, _), inside in wanted.items()}
    for k, (key, shares) in enumerate(shared.items()):
        value = F.when(first[key].condition(values[key[0]]), values[key[0]])
        asked.append(F.percentile_approx(value, sorted(set(shares)), accuracy).alias(f"c{k}"))
    row = df.agg(*asked).first()
    found = {key: sorted(set(row[f"c{k}"])) for k, key in enumerate(shared)}
    return {(i, rank): found[i, inside.low, inside.high] for (i, rank), inside in wanted.items()}


def _counts_below(df: DataFrame, values: list[Column], candidates: dict) -> dict[tuple[int, float], tuple[int, int]]:
    asked = sorted({(i, v) for (i, _), found in candidates.items() for v in found})
    cells = []
    for k, (i, v) in enumerate(asked):
        cells += [F.count_if(values[i] < v).alias(f"s{k}"), F.count_if(values[i] <= v).alias(f"u{k}")]
    row = df.agg(*cells).first()
    return {key: (row[f"s{k}"], row[f"u{k}"]) for k, key in enumerate(asked)}
