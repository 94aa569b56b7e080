"""Running values and as-of joins of keys that are dealt out over slices: the rows of the plain forms, hot keys in many tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waystone.operators import journey, lookup, pacing
from waystone.operators.scan import scan

HOUR = 3_600_000


@pytest.fixture(scope="module")
def track(spark):
    """Three travellers with gaps, stays, flights, the date line and equal times; one of them is null."""
    r, rows = random.Random(3), []
    for key, n in ((1, 400), (2, 3), (None, 60)):
        t, lat, lon = 0, 10.0, 170.0
        for i in range(n):
            t += r.choice([0, 1, 60_000, HOUR, 9 * HOUR, 40 * HOUR])
            lat, lon = max(-80, min(80, lat + r.uniform(-1, 1) * r.choice([0, 0.01, 5]))), lon + r.uniform(-1, 1) * r.choice([0, 0.01, 30])
            rows.append((key, i, t, lat, (lon + 180) % 360 - 180))
    return spark.createDataFrame(rows, "traveler_id long, seq long, t_ms long, lat double, lon double").cache()


def same(a, b):
    def rows(d):
        return sorted((tuple(d.columns[i] if v is None else v for i, v in enumerate(r)) for r in d.select(*sorted(d.columns)).collect()), key=str)

    x, y = rows(a), rows(b.select(*a.columns))
    assert len(x) == len(y)
    for p, q in zip(x, y, strict=True):
        assert p == pytest.approx(q, rel=1e-9, abs=1e-9) if all(isinstance(v, (int, float)) for v in p) else all(u == v or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) for u, v in zip(p, q, strict=True))


@pytest.mark.parametrize("slice_ms", [1, 7 * HOUR, 10**12])
def test_scans_equal_plain_windows(track, slice_ms):
    v = F.when(F.col("seq") % 3 == 0, F.col("seq"))
    args = {"sums": {"s": v}, "lasts": {"l": v}, "maxima": {"m": -F.col("lat")}, "lags": {"g": F.struct("lat", "seq"), "h": v}}
    same(scan(track, "traveler_id", ["t_ms", "seq"], **args).select("traveler_id", "seq", "s", "l", "m", "h", "g.lat"), scan(track, "traveler_id", ["t_ms", "seq"], F.floor(F.col("t_ms") / slice_ms), **args).select("traveler_id", "seq", "s", "l", "m", "h", "g.lat"))


def whole(track, path, slice_ms=None, width=None, share=None):
    def kept(d, name):
        d.write.parquet(f"{path}/{name}")
        return d.sparkSession.read.parquet(f"{path}/{name}")

    h = journey.hops(track, slice_ms=slice_ms)
    h = scan(h, "traveler_id", ["t_ms", "seq"], None, sums={"i": F.lit(1).cast("long")}).withColumn("i", F.col("i") - 1)
    h = kept(h, "hops")
    limits, totals = kept(journey.thresholds(h), "limits"), kept(journey.totals(h), "totals")
    legs = kept(journey.legs(h, limits, slice_ms=slice_ms), "legs")
    knots = kept(pacing.pacing_knots(h, limits, slice_ms=slice_ms), "knots")
    probes = totals.select("traveler_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("n"), "total_km").select("traveler_id", "n", (F.col("n") / 40).alias("p"), (F.col("total_km") * F.col("n") / 40).alias("d"))
    return {
        "hops": h, "unwrapped": journey.unwrapped(track, slice_ms=slice_ms), "legs": legs, "knots": knots,
        "positions": lookup.positions_at(probes, h, width=width), "leg_at": lookup.legs_at(probes, legs, width=width), "index": lookup.point_index_at(probes, h, width=width),
        "distance": pacing.distance_at(probes.drop("d"), pacing.pacing_curve(knots), totals, width=share),
    }


def test_slices_change_no_result(track, tmp_path):
    some = track.where("traveler_id IS NOT NULL")
    plain, sliced = whole(some, tmp_path / "plain"), whole(some, tmp_path / "sliced", 11 * HOUR, 777.0, 0.09)
    for name, rows in plain.items():
        same(rows, sliced[name])


def test_a_hot_traveller_is_many_tasks(spark):
    """Five million points of one traveller: no task of the scan has more than a slice or two."""
    n, slices = 5_000_000, 100
    p = spark.range(0, n, 1, 16).selectExpr("1L AS traveler_id", "id AS seq", "id * 1000 AS t_ms", "30 + sin(id / 50000.0) AS lat", "id / 50000.0 - 50 AS lon")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        h = journey.hops(p, slice_ms=n * 1000 // slices)
        most, points, km = h.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("cum_km").alias("km")).agg(F.max("n"), F.sum("n"), F.max("km")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert points == n and most <= 8 * n // slices and km > 1000


def test_folds_parted_at_gaps_keep_the_same_rows(spark):
    """Single travellers with stays, spikes and gaps around the rules' reach, against the folds that don't part them."""
    from waystone.operators import clean

    r, rows = random.Random(8), []
    for key in (1, 2):
        t, lat = 0, 10.0
        for i in range(1500):
            t += r.choice([0, 1, 1000, 60_000, 599_999, 600_000, 600_001, 1_199_999, 1_200_000, 1_200_001, HOUR])
            lat += r.choice([0, 0, 0.0001, 0.02])
            rows.append((key, i, t, lat + (1.0 if r.random() < 0.1 else 0), 5.0, r.choice([3.0, 10.0, 80.0, 900.0])))
    raw = spark.createDataFrame(rows, "traveler_id long, seq long, t_ms long, lat double, lon double, accuracy_m double")
    for f in (clean.spike_fold, clean.stationary_collapse):
        want = sorted(map(tuple, f(raw).collect()))
        for slice_ms in (5 * HOUR, 10**12):
            assert sorted(map(tuple, f(raw, slice_ms=slice_ms).collect())) == want
        assert 0 < len(want) < 3000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would end in one task all the same
    try:
        parts = clean.stationary_collapse(raw.where("traveler_id = 1"), slice_ms=5 * HOUR)
        assert parts.select(F.spark_partition_id()).distinct().count() > 1  # one traveller, many tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_virtual_samples_are_those_of_the_densified_journey(track, tmp_path):
    from pyspark.sql import Window

    h = journey.hops(track.where("traveler_id IS NOT NULL"))
    w = Window.partitionBy("traveler_id").orderBy("t_ms", "seq", "k")
    want = {(r.traveler_id, r.n): (r.lat, r.lon, r.at_km) for r in journey.densify(h).withColumn("n", F.row_number().over(w)).collect()}
    asked = track.sparkSession.createDataFrame([(*k, "x") for k in want if k[1] % 7 == 1] + [(1, 0, "x"), (1, 10**9, "x"), (1, None, "x"), (9, 1, "x")], "traveler_id long, n long, lat0 string")
    for slices in ({}, {"slice_ms": 30 * HOUR, "width": 100.0}):
        rows = lookup.samples_at(asked, h, **slices).collect()
        assert len(rows) == asked.count()
        for r in rows:
            assert (r.lat, r.lon, r.at_km) == pytest.approx(want.get((r.traveler_id, r.n), (None, None, None)), abs=1e-9)


@pytest.mark.parametrize("count", [2, 7, 50, 5000])
def test_even_samples_are_those_of_the_densified_journey(track, count):
    from pyspark.sql import Window

    one = track.sparkSession.createDataFrame([(77, 0, 5, 10.0, 20.0)], "traveler_id long, seq long, t_ms long, lat double, lon double")
    h = journey.hops(track.where("traveler_id IS NOT NULL").select(*one.columns).unionByName(one))
    w = Window.partitionBy("traveler_id").orderBy("t_ms", "seq", "k")
    want = {(r.traveler_id, r.n): (r.lat, r.lon, r.at_km) for r in journey.densify(h).withColumn("n", F.row_number().over(w)).collect()}
    size = {k: max(n for q, n in want if q == k) for k, _ in want}
    asked = {(k, 1 + (m - 1) * j // (count - 1)) for k, m in size.items() for j in range(count)}
    rows = lookup.even_samples(h, count).collect()
    assert sorted((r.traveler_id, r.n) for r in rows) == sorted(asked) and (77, 1) in asked
    for r in rows:
        assert (r.lat, r.lon, r.at_km) == pytest.approx(want[r.traveler_id, r.n], abs=1e-9)


def test_virtual_samples_sort_a_journey_once(spark, sf_dir):
    """Each sort of a journey's rows is a task's memory; a union with probes sorted the wider rows again."""
    from waystone.plans.queries import QUERIES

    plan = QUERIES["w3_virtual_samples"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1 and "Union" not in plan


def test_trail_points_are_those_between_the_ends(track):
    from waystone.operators import frames

    h = scan(journey.hops(track.where("traveler_id IS NOT NULL")), "traveler_id", ["t_ms", "seq"], None, sums={"i": F.lit(1).cast("long")}).withColumn("i", F.col("i") - 1)
    t = journey.totals(h)
    at = t.select("traveler_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("frame"), "total_km").select("traveler_id", "frame", (F.col("total_km") * F.col("frame") / 20).alias("d"))
    bands = frames.trail_bands(at, t, 10)
    got = sorted((r.traveler_id, r.frame, r.band, r.i) for r in frames.trail_points(bands, h, width=500.0).collect())
    points, mm = h.select("traveler_id", "i", "cum_km").collect(), lambda x: round(x, 6)
    want = sorted((b.traveler_id, b.frame, b.band, p.i) for b in bands.collect() for p in points if p.traveler_id == b.traveler_id and mm(b.from_km) <= mm(p.cum_km) and (mm(p.cum_km) < mm(b.to_km) or (b.band == 1 and mm(p.cum_km) == mm(b.to_km))))
    assert got == want and want
