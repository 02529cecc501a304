"""Exact percentiles of a column of any length by refined range counts.

Each round counts the values per bucket of the ranges that hold a wanted rank and keeps the bucket
the rank falls in, from its smallest to its largest value.  A round is one grouped count, whose
result has at most ``BUCKETS`` rows per range, so no task and no driver step holds the values;
only the last ``FEW`` of them are fetched.  The ends of a range fall in different buckets, so every
round narrows it, and a range of one value, tied or not, is done.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import expr as E
from cargoscope.session import stored

BUCKETS, FEW = 1024, 4096


class Range(NamedTuple):
    """Values from ``low`` to ``high``, how many there are, and how many lie below."""

    low: float
    high: float
    count: int
    below: int

    def holds(self) -> Column:
        return (F.col("v") >= self.low) & (F.col("v") <= self.high)

    def bucket(self) -> Column:
        v, width = F.col("v"), self.high / 2 - self.low / 2  # halves: the difference itself may overflow
        inner = F.floor((v / 2 - self.low / 2) / F.lit(width) * BUCKETS) if width > 0 else F.lit(1)
        inner = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), inner))
        return F.when(v == self.low, 0).when(v == self.high, BUCKETS - 1).otherwise(inner).cast("int")


def percentiles(df: DataFrame, value, probabilities: Iterable[float]) -> list[float] | None:
    """Interpolated percentiles as ``percentile`` gives them; None where there is no value.

    Nulls, NaN and infinities are no values.
    """
    values = stored(df.select((E.finite(value) + 0.0).alias("v")).where("v is not null"), "values")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    places = [p * (n - 1) for p in probabilities]
    wanted = {end(x) for x in places for end in (math.floor, math.ceil)}
    at = values_at(values, wanted, Range(low, high, n, 0))

    def between(x):
        a, b = math.floor(x), math.ceil(x)
        return at[a] if at[a] == at[b] else (b - x) * at[a] + (x - a) * at[b]

    return [between(x) for x in places]


def values_at(values: DataFrame, ranks: Iterable[int], whole: Range) -> dict[int, float]:
    """Values of column ``v`` at zero-based ranks of its order."""
    found: dict[int, float] = {}
    sought = {whole: sorted(ranks)}
    while True:
        for r in [r for r in sought if r.low == r.high]:
            found.update(dict.fromkeys(sought.pop(r), r.low))
        if not sought:
            return found
        ranges = list(sought)
        if sum(r.count for r in ranges) <= FEW:
            rest = sorted(row.v for row in values.where(_any(ranges)).collect())
            for r in ranges:
                own = [x for x in rest if r.low <= x <= r.high]
                found.update({rank: own[rank - r.below] for rank in sought[r]})
            return found
        sought = _narrowed(values, sought)


def _any(ranges: list[Range]) -> Column:
    out = F.lit(False)
    for r in ranges:
        out = out | r.holds()
    return out


def _narrowed(values: DataFrame, sought: dict[Range, list[int]]) -> dict[Range, list[int]]:
    ranges = list(sought)
    # Ranges are disjoint, so a value counts in one at most.
    place = F.coalesce(*[F.when(r.holds(), F.struct(F.lit(i).alias("i"), r.bucket().alias("b"))) for i, r in enumerate(ranges)])
    counts = values.select("v", place.alias("p")).where("p is not null").groupBy("p.i", "p.b").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    out: dict[Range, list[int]] = {}
    for i, r in enumerate(ranges):
        below = r.below
        for row in sorted((c for c in counts if c.i == i), key=lambda c: c.b):
            mine = [rank for rank in sought[r] if below <= rank < below + row.n]
            if mine:
                out[Range(row.low, row.high, row.n, below)] = mine
            below += row.n
    return out


def literal(found: list[float] | None) -> Column:
    """The percentiles as an array column; NULL where there are none."""
    return F.lit(None).cast("array<double>") if found is None else F.array(*[F.lit(float(x)) for x in found])
