"""Cleaning, journeys, pacing, camera, streaming: FIXTURES §4 and §5 and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions import geo
from waystone.operators import camera, clean, frames, journey, lookup, pacing, tiles
from waystone.sources import catalog
from waystone.streaming import sessions

HOUR = 3_600_000


def track(spark, *rows):
    """(hours, lat, lon)."""
    return spark.createDataFrame([(1, i, int(h * HOUR), float(a), float(o)) for i, (h, a, o) in enumerate(rows)], "traveler_id long, seq long, t_ms long, lat double, lon double")


def removed(spark, *rows):
    kept = {r.seq for r in clean.outlier_filter(track(spark, *rows)).collect()}
    return [i for i in range(len(rows)) if i not in kept]


SEOUL, FAR = (37.56, 126.97), (0.0, -50.0)


def test_outlier_runs(spark):
    assert removed(spark, (0, *SEOUL), (1, *FAR), (2, 37.57, 126.98)) == [1]
    assert removed(spark, (0, *SEOUL), (1, *FAR), (1.17, 0.2, -50.1), (2, 37.57, 126.98)) == [1, 2]
    assert removed(spark, (0, *SEOUL), *[(1 + i / 10, 0.1 * i, -50) for i in range(3)], (2, *SEOUL)) == [1, 2, 3]
    assert removed(spark, (0, *SEOUL), *[(1 + i / 10, 0.1 * i, -50) for i in range(4)], (2, *SEOUL)) == []
    assert removed(spark, (0, *SEOUL), (14, *FAR), (28, *SEOUL)) == [] and removed(spark, (0, *SEOUL), (1, *FAR)) == []


def test_outlier_limits(spark):
    assert removed(spark, (0, 0, 0), (1, 0, 60), (2, 0, 1.3)) == [1] and removed(spark, (0, 0, 0), (1, 0, 60), (2, 0, 2.5)) == []
    assert removed(spark, (0, 0, 0), (4, 0, 120), (12, 0, 0)) == [1] and removed(spark, (0, 0, 0), (4, 0, 120), (12 + 1 / HOUR, 0, 0)) == []
    assert removed(spark, (0, 0, 0), (0, 0, 60), (0, 0, 0)) == [1]


def greedy(t, lat, lon):
    """The rule as a loop against the last kept row."""
    km = lambda i, j: clean.km_between(lat[i], lon[i], lat[j], lon[j])
    fast = lambda i, j: clean._kmh(km(i, j), t[j] - t[i]) > K.EXCURSION_KMH
    kept, i, n = [0], 1, len(t)
    while i < n:
        b = kept[-1]
        for run in (3, 2, 1):
            a = i + run
            if a > n - 1:
                continue
            r = range(i, a)
            if 0 <= t[a] - t[b] <= K.EXCURSION_MS and km(b, a) <= 200 and km(b, i) >= 500 and km(a - 1, a) >= 500 and fast(b, i) and fast(a - 1, a) and all(km(i, x) <= 200 and km(b, x) >= 500 and km(x, a) >= 500 for x in r):
                i = a
                break
        else:
            kept.append(i)
            i += 1
    return kept


def test_outliers_match_the_greedy_loop(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(60):
        n = int(rng.integers(3, 40))
        t = np.cumsum(rng.integers(0, 2 * HOUR, n))
        far = rng.random(n) < 0.35
        lat, lon = np.where(far, 0.0, 40.0) + rng.normal(size=n), np.where(far, rng.choice([-50.0, 60.0], n), 5.0) + rng.normal(size=n)
        rows += [(k, i, int(t[i]), float(lat[i]), float(lon[i])) for i in range(n)]
        want[k] = greedy(t, lat, lon)
    d = spark.createDataFrame(rows, "traveler_id long, seq long, t_ms long, lat double, lon double")
    got = {}
    for r in clean.outlier_filter(d).orderBy("seq").collect():
        got.setdefault(r.traveler_id, []).append(r.seq)
    assert got == want and sum(map(len, want.values())) < len(rows)


def raw(spark, *rows):
    """(minutes, lat, accuracy)."""
    return spark.createDataFrame([(1, i, int(m * 60_000), float(a), 127.0, float(c)) for i, (m, a, c) in enumerate(rows)], "traveler_id long, seq long, t_ms long, lat double, lon double, accuracy_m double")


def test_raw_cleaning(spark):
    d = raw(spark, (0, 37, 20), (2, 37.0001, 15), (4, 37, 150), (12, 37.1, 20))
    assert [r.lat for r in clean.clean_raw(d).orderBy("t_ms").collect()] == [37.0001, 37.1]
    q = clean.raw_quality(d).first()
    assert (q.n_input, q.accuracy_rejected, q.noise_rejected, q.n_kept) == (4, 1, 1, 2)
    assert clean.raw_quality(raw(spark, (0, 37, 5), (60, 37.2, 5))).first().discontinuities == 1
    assert clean.raw_quality(raw(spark, (0, 37, 5), (1, 38, 5), (2, 37.0001, 5), (60, 37.1, 5))).first().noise_rejected == 2
    with pytest.raises(ValueError, match="accuracy"):
        clean.filter_accuracy(d, -1)


def test_spike_forms_agree_and_folds_cross_batches(spark):
    rng = np.random.default_rng(6)
    d = raw(spark, *[(i * 2, 37 + 0.001 * i + (1 if rng.random() < 0.2 else 0), rng.uniform(1, 90)) for i in range(300)])
    a, b = clean.spike_filter(d), clean.spike_fold(d)
    assert a.count() < 300 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = sorted(r.seq for r in clean.stationary_collapse(a).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(r.seq for r in clean.stationary_collapse(a).collect()) == whole
        assert sorted(r.seq for r in clean.spike_fold(d).collect()) == sorted(r.seq for r in a.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def numbered(points):
    return journey.hops(points).withColumn("i", F.col("seq"))


def test_geometry(spark):
    r = spark.range(1).select(geo.world_x(0.0).alias("x"), geo.world_y(0.0).alias("y"), geo.haversine_km(37.5665, 126.978, 35.1796, 129.0756).alias("km"), geo.haversine_km(F.lit(None).cast("double"), 1.0, 2.0, 3.0).alias("none"), geo.mercator_inverse(F.col("id") + 1e6, 2e6).alias("inv")).first()
    assert (r.x, r.y) == (0.5, pytest.approx(0.5)) and 320 < r.km < 340 and r.none is None
    back = spark.createDataFrame([(r.inv.lat, r.inv.lon)], "a double, b double").select(geo.mercator_m("a", "b").alias("m")).first().m
    assert (back.x, back.y) == (pytest.approx(1e6), pytest.approx(2e6))
    u = [p.x for p in journey.unwrapped(track(spark, (0, 10, 179), (1, 10, -179), (2, 10, 179))).orderBy("seq").collect()]
    assert abs(u[1] - u[0]) < 0.01 and u[2] == pytest.approx(u[0])


def test_overview_split_at_the_edge(spark):
    d = spark.createDataFrame([(1, i, i, x, 0.5) for i, x in enumerate((0.2, 0.5, 0.9, 1.3, 1.6))], "traveler_id long, seq long, t_ms long, x double, y double")
    got = journey.overview_split(d).orderBy("part", "part_no").collect()
    assert [(r.part, round(r.x, 9)) for r in got] == [(0, 1.2), (0, 1.5), (0, 1.9), (0, 2.1), (1, 1.1), (1, 1.3), (1, 1.6)]


def test_journey_lookup_and_densify(spark):
    h = numbered(track(spark, (0, 37.5, 127), (6, 9.6, 123.8)))
    total = journey.totals(h).first().total_km
    p = spark.createDataFrame([(1, 0.0), (1, total / 2), (1, total), (1, total * 9)], "traveler_id long, d double")
    got = lookup.positions_at(p, h).orderBy("fraction").collect()
    assert [r.fraction for r in got] == [0, pytest.approx(0.5), 1, 1] and [r["index"] for r in got] == [1, 1, 1, 1]
    dense = journey.densify(h).orderBy("at_km").collect()
    assert len(dense) > 20 and max(b.at_km - a.at_km for a, b in zip(dense, dense[1:], strict=False)) <= 75.1


def test_thresholds_and_legs(spark):
    local = [(i, 37 + 0.01 * i, 127) for i in range(20)]
    h = numbered(track(spark, *local, (20, 37.19 + 0.76, 127)))
    t = journey.thresholds(h)
    assert t.first().threshold_km < 80 and [r.is_transfer for r in journey.legs(h, t).orderBy("leg_no").collect()] == [False, True]
    h = numbered(track(spark, *[(i, 0.81 * i, 127) for i in range(12)]))
    assert journey.thresholds(h).first().threshold_km == 120 and [r.is_transfer for r in journey.legs(h, journey.thresholds(h)).collect()] == [False]


def route(spark):
    rows = [(i, 37 + 0.01 * i, 127) for i in range(20)] + [(24, 48.8, 2.3)] + [(25 + i, 48.8 + 0.01 * i, 2.3) for i in range(20)]
    h = numbered(track(spark, *rows))
    return h, journey.thresholds(h), journey.totals(h)


def test_pacing(spark):
    h, lim, t = route(spark)
    total = t.first().total_km
    c = pacing.pacing_curve(pacing.pacing_knots(h, lim))
    p = spark.createDataFrame([(1, i / 50) for i in range(51)], "traveler_id long, p double")
    d = [r.d for r in pacing.distance_at(p, c, t).orderBy("p").collect()]
    assert d[0] == pytest.approx(0, abs=1e-6) and d[-1] == pytest.approx(total, rel=1e-9) and all(b >= a - 1e-6 for a, b in zip(d, d[1:], strict=False))
    off = [r.d for r in pacing.distance_at(p, c, t, linear=True).orderBy("p").collect()]
    assert off == pytest.approx([total * i / 50 for i in range(51)])
    knots = pacing.pacing_knots(h, lim).orderBy("k").collect()
    longest = max(range(1, len(knots)), key=lambda i: knots[i].y - knots[i - 1].y)
    assert knots[longest].x - knots[longest - 1].x < (knots[longest].y - knots[longest - 1].y) / total


@pytest.mark.parametrize(("name", "framing"), [("fixed", None), ("close_up", 0.78)])
def test_camera_keeps_the_marker_in_view(spark, name, framing):
    h, lim, t = route(spark)
    m, lg = K.MOVEMENTS[name], journey.legs(h, lim)
    at = pacing.distance_at(camera.samples(t), pacing.pacing_curve(pacing.pacing_knots(h, lim)), t)
    raw_views = camera.raw_viewports(camera.context_windows(at, lg, t, m, framing), h, m)
    track_rows = camera.camera_track(raw_views, m, framing=framing).orderBy("sample").collect()
    marker = {r["sample"]: (r.marker_x, r.marker_y) for r in raw_views.collect()}
    assert [r["sample"] for r in track_rows] == list(range(481))
    for a, b in zip(track_rows, track_rows[1:], strict=False):
        assert abs(a.zoom - b.zoom) <= (13 if name == "fixed" else 6) and 2 <= b.zoom <= 15
    for r in track_rows[1:]:
        dx = camera._near(marker[r["sample"]][0], r.center_x) - r.center_x
        assert abs(dx) <= r.span_y * 0.2001 and abs(marker[r["sample"]][1] - r.center_y) <= r.span_y * 0.5001
    if name == "fixed":
        assert len({round(r.span_y, 12) for r in track_rows}) == 1


def test_zoom_hysteresis():
    assert camera.next_zoom(5, 6.1) == 5 and camera.next_zoom(5, 6.2) == 6 and camera.next_zoom(5, 4.9) == 5 and camera.next_zoom(5, 4.8) == 4 and camera.next_zoom(3, 99) == 15


def test_frames_and_tiles(spark):
    f = frames.frame_table(spark, 10, 24).collect()
    assert len(f) == 276 and f[0].journey_progress == 0 and f[239].journey_progress == 1 and f[-1].outro_progress == 1
    v = spark.createDataFrame([(1, -0.1, 0.1, 0.4, 0.6, 3)], "traveler_id long, min_x double, max_x double, min_y double, max_y double, zoom int")
    got = {(r.x, r.y) for r in tiles.required_tiles(v, "traveler_id").collect()}
    assert got == {(x, y) for x in (7, 0) for y in (3, 4)}
    assert all(0 <= x < 8 and 0 <= y < 8 for x, y in got)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "points")
    d = raw(spark, *[(m, 37 + m * 0.0001, 5) for m in (0, 10, 20, 60, 70, 200)]).withColumn("ts", F.timestamp_millis("t_ms"))
    d.write.parquet(src)
    stream = spark.readStream.schema(d.schema).parquet(src)
    q = sessions.stream_sessions(stream).writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT * FROM runs").collect()) == [2, 3]
    raw_src = str(tmp_path / "raw")
    raw(spark, (0, 37, 5), (1, 38, 5), (2, 37.0001, 5), (60, 37.1, 5)).write.parquet(raw_src)
    s = spark.readStream.schema(raw(spark, (0, 1, 1)).schema).parquet(raw_src)
    q = sessions.stream_spike_filter(s, late="0 seconds").writeStream.format("memory").queryName("calm").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert sorted(r.seq for r in spark.sql("SELECT * FROM calm").collect()) == [0, 2]


def test_empty_tables(spark):
    h = numbered(track(spark, (0, 1, 1)).limit(0))
    lim, t = journey.thresholds(h), journey.totals(h)
    assert journey.legs(h, lim).count() == 0 == camera.journey_camera(h, journey.legs(h, lim), t, None, K.MOVEMENTS["steady"]).count()
    one = numbered(track(spark, (0, 1, 1)))
    assert journey.totals(one).first().available is False and journey.thresholds(one).first().threshold_km == 120
    assert math.isclose(one.first().cum_km, 0)


def test_dense_route_costs_few_rows(spark):
    p = spark.range(20_000).select(F.lit(1).alias("traveler_id"), "id", (F.col("id") * 5000).alias("t_ms"), (F.lit(52.1) + (F.col("id") % 7) * 1e-5).alias("lat"), (F.lit(4.3) + F.col("id") * 2e-6).alias("lon"))
    h = journey.hops(p.withColumnRenamed("id", "seq").withColumn("i", F.col("seq")))
    t = journey.totals(h)
    at = camera.samples(t).withColumn("d", F.col("p") * 30).drop("p")
    w = at.withColumns({"tail": F.greatest(F.lit(0.0), F.col("d") - 9), "look": F.col("d") + 9})
    r = w.join(h.select("i", "cum_km"), F.col("cum_km").between(F.col("tail"), F.col("look"))).groupBy("sample").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"), F.count("*").alias("n"))
    nodes = camera.window_nodes(r).where("level >= 0").groupBy("sample", "n").agg(F.count("*").alias("rows"), F.sum(F.pow(F.lit(K.NODE_FAN), "level")).alias("held")).collect()
    assert len(nodes) == 481 and all(x.n == x.held for x in nodes) and sum(x.rows for x in nodes) + camera.bounds_tree(h).count() < 50_000
    assert max(x.rows for x in nodes) < 2 * K.NODE_FAN * K.NODE_LEVELS


def test_windows_over_the_edge_of_the_world(spark):
    rows = [(1, i, i * 60_000, 10.0 + i % 5, ((i * 37) % 360) - 180.0) for i in range(300)]
    h = journey.hops(spark.createDataFrame(rows, "traveler_id int, seq long, t_ms long, lat double, lon double")).withColumn("i", F.col("seq"))
    m = spark.createDataFrame([(1, k, float(k * 9000), float(k * 9000 + 400_000), (k % 10) / 10 + 0.03) for k in range(60)], "traveler_id int, sample int, tail double, look double, marker_x double")
    inside = m.join(h.select("i", "cum_km"), F.col("cum_km").between(F.col("tail"), F.col("look")), "left")
    ranges = inside.groupBy(*m.columns).agg(F.coalesce(F.min("i"), F.lit(0)).alias("lo"), F.coalesce(F.max("i") + 1, F.lit(0)).alias("hi"))
    got = {r["sample"]: (r.sx0, r.sx1) for r in camera.seen_bounds(ranges, h, "traveler_id", ("sample",), "i").where("sx0 IS NOT NULL").collect()}
    x = geo.unwrap_near(geo.world_x("lon"), F.col("marker_x"))
    want = m.join(h, (m["traveler_id"] == h["traveler_id"]) & (h["cum_km"] >= m["tail"]) & (h["cum_km"] <= m["look"])).groupBy("sample").agg(F.min(x).alias("x0"), F.max(x).alias("x1")).collect()
    assert set(got) == {r["sample"] for r in want} and all(got[r["sample"]] == pytest.approx((r.x0, r.x1), abs=1e-9) for r in want)


def test_export_requests_are_replaced(spark, tmp_path):
    q = spark.createDataFrame([(1, 8, 2020, 1, 2021, 2, "dynamic", "strong", "balanced", "close", True, 0.5, 10)], "id int, version int, start_year int, start_month int, end_year int, end_month int, movement string, pacing string, detection string, framing string, framing_on boolean, scale double, points int")
    for _ in range(2):
        catalog.write_export_requests(q.drop("version"), str(tmp_path / "requests"))
    assert [r.framing for r in catalog.stored_export_requests(spark, str(tmp_path / "requests")).collect()] == ["close"]
