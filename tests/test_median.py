"""Medians by counting in ranges: those of Spark's own aggregate, to the last bit."""

import random

from pyspark.sql import functions as F

from waystone.operators import journey
from waystone.operators.median import exact_medians


def values(spark):
    r, rows = random.Random(9), []
    for key, n in ((1, 1), (2, 2), (3, 3001), (4, 4000), (5, 500), (6, 40), (7, 5)):
        draw = {3: lambda: r.lognormvariate(0, 3), 4: lambda: r.choice([1.0, 1.0 + 2**-52, 2.0]), 5: lambda: 7.25, 6: lambda: r.choice([-1e300, 0.0, 5e-324, 1e300]), 7: lambda: -r.random()}.get(key, r.random)
        rows += [(key, draw()) for _ in range(n)]
    return spark.createDataFrame([*rows, (None, 1.0), (8, None), (4, None)], "k long, v double")


def test_medians_to_the_last_bit(spark):
    d = values(spark)
    want = {r.k: r.m for r in d.where("k IS NOT NULL AND v IS NOT NULL").groupBy("k").agg(F.median("v").alias("m")).collect()}
    for ranges, passes in ((4096, 2), (3, 2), (16, 0)):
        assert {r.k: r.m for r in exact_medians(d, "k", "v", "m", ranges, passes).collect()} == want
    assert exact_medians(d.limit(0), "k", "v").count() == 0


def test_thresholds_of_hot_travellers_are_the_same(spark):
    h = values(spark).where("k IS NOT NULL").select(F.col("k").alias("traveler_id"), F.abs("v").alias("hop_km"))
    assert sorted(map(tuple, journey.thresholds(h, hot=True).collect())) == sorted(map(tuple, journey.thresholds(h).collect()))
