import math
import random

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import quantiles as qu

PROBS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


def same(spark, values, few, monkeypatch):
    """The rounds and Spark's own percentile agree, whatever part of the work the rounds do."""
    monkeypatch.setattr(qu, "FEW", few)
    df = spark.createDataFrame([(x,) for x in values], "x double")
    want = df.select(qu.E.finite("x").alias("x")).agg(F.percentile("x", F.array(*map(F.lit, PROBS)))).first()[0]
    got = qu.percentiles(df, "x", PROBS)
    assert got == want
    return got


@pytest.mark.parametrize("few", [0, 50, 4096])
def test_equal_to_percentile(spark, monkeypatch, few):
    rng = random.Random(3)
    odd = [None, math.nan, math.inf, -math.inf]
    same(spark, [rng.choice([-1.5, 0.0, 2.0, 2.0, 7.25]) for _ in range(300)] + odd, few, monkeypatch)  # ties
    same(spark, [rng.lognormvariate(0, 9) * rng.choice([-1, 1]) for _ in range(500)] + odd, few, monkeypatch)  # heavy tails
    same(spark, [1.7e308, -1.7e308, 5e-324, 0.0, -5e-324, 1.0], few, monkeypatch)  # a difference that overflows
    same(spark, [1.0, math.nextafter(1.0, 2.0), math.nextafter(1.0, 0.0)], few, monkeypatch)


def test_no_values_and_one(spark, monkeypatch):
    assert same(spark, [None, math.nan], 0, monkeypatch) is None
    assert same(spark, [], 0, monkeypatch) is None
    assert same(spark, [4.0], 0, monkeypatch) == [4.0] * len(PROBS)


def test_rounds_are_few_and_small(spark, monkeypatch):
    """A hundred thousand distinct values: two or three grouped counts, a bounded number of rows fetched."""
    rounds = []
    plain = qu._narrowed
    monkeypatch.setattr(qu, "_narrowed", lambda values, sought: rounds.append(len(sought)) or plain(values, sought))
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    want = df.agg(F.percentile("x", F.array(*map(F.lit, PROBS)))).first()[0]
    assert qu.percentiles(df, "x", PROBS) == want
    assert len(rounds) <= 3
