"""Steps that many outputs share stand in a plan once."""

from pyspark.sql import functions as F

from waystone.functions import text
from waystone.operators import journey


def test_a_link_is_taken_apart_once(spark):
    d = spark.createDataFrame([("https://e.org/m/?preset=oaQB#x",), ("https://e.org/?preset=a&preset=b",), ("e?preset=!",), (None,)], "link string")
    d = d.select(text.decode_preset(text.preset_link_token(F.col("link"))).alias("p")).select("p.*")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64(") == 1
    got = [tuple(r) for r in d.collect()]
    assert got[0] == ("ok", "fixed", "portrait", "sensitive", "close", "balanced") and got[1:] == [("invalid", *[None] * 5)] * 3


def test_samples_share_what_their_hop_has(spark):
    points = spark.createDataFrame([(1, i, i * 1000, 10.0 * i, 20.0 * i) for i in range(3)], "traveler_id long, seq long, t_ms long, lat double, lon double")
    d = journey.densify(journey.hops(points))
    above = d._jdf.queryExecution().optimizedPlan().toString().split("explode(sequence(")[0].lower()
    assert "sin(" in above and "acos(" not in above and "lambda" not in above
    assert d.columns[:5] == points.columns and d.where("seq = 2").count() == d.where("seq = 2").agg(F.max("k")).first()[0] > 30
