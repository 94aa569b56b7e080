"""Samples of journeys made in the journey's task: the same as window by window, with no row of them sorted or shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.operators import camera, journey, pacing
from waystone.plans.queries import QUERIES


def routes(spark):
    """Two routes over the edge of the world with stops and long hops, one at a place, one of one point."""
    rows = [(1, i, i * 60_000, 37 + 0.01 * (i % 9), 127 + (90.0 if i > 30 else 0.0) + 0.02 * i) for i in range(80)]
    rows += [(2, i, i * 60_000, 10.0 + i // 3 % 5, ((i // 3 * 37) % 360) - 180.0) for i in range(60)]
    rows += [(3, i, i * 60_000, 5.0, 5.0) for i in range(4)] + [(4, 0, 0, 1.0, 1.0)]
    p = spark.createDataFrame(rows, "traveler_id int, seq long, t_ms long, lat double, lon double")
    h = journey.hops(p).withColumn("i", F.col("seq"))
    lim = journey.thresholds(h)
    return h, journey.legs(h, lim), journey.totals(h), pacing.pacing_curve(pacing.pacing_knots(h, lim))


@pytest.mark.parametrize(("name", "framing", "paced"), [("fixed", None, True), ("steady", None, False), ("dynamic", 1.0, True), ("close_up", None, False)])
def test_journeys_are_as_window_by_window(spark, name, framing, paced):
    h, lg, t, curve = routes(spark)
    m = K.MOVEMENTS[name]
    at = pacing.distance_at(camera.samples(t), curve if paced else h, t, linear=not paced)
    raw = camera.raw_viewports(camera.context_windows(at, lg, t, m, framing), h, m).localCheckpoint()
    new = camera.journey_viewports(h, lg, t, curve if paced else None, m, framing)
    tracks = camera.camera_track(raw, m, framing=framing), camera.journey_camera(h, lg, t, curve if paced else None, m, framing)
    for a, b, columns in ((raw, new, ["marker_x", "marker_y", "center_x", "center_y", "span_x", "span_y", "arrival", "alignment"]), (*tracks, ["center_x", "center_y", "span_y", "zoom"])):
        a, b = (d.orderBy("traveler_id", "sample").select("traveler_id", "sample", *columns).toPandas().to_numpy(float) for d in (a, b))
        assert a.shape == b.shape == (2 * 481, len(columns) + 2) and np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_no_sample_is_exploded_and_a_track_is_read_once(spark, sf_dir):
    for name in ("a6_fixed_zoom", "w16_raw_viewports", "w17_camera_steady", "w18_camera_dynamic_framed", "t5_lightweight_viewport", "t7_blended_views", "j4_camera_at"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "0, 480" not in plan, name


def test_columns_beyond_memory_are_in_files(monkeypatch):
    monkeypatch.setattr(K, "JOURNEY_HELD", 16)
    v, held = np.random.default_rng(1).normal(size=(3, 100)), camera.Held(3)
    for a in range(0, 100, 7):
        held.add(list(v[:, a : a + 7]))
    assert held.files and all((x == y).all() for x, y in zip(held.columns(), v, strict=True))
    lo, hi = np.arange(40), np.arange(40) * 2 + 3
    low, high = camera.range_bounds(held.columns()[0], lo, hi)
    assert (low == [v[0, a:b].min() for a, b in zip(lo, hi)]).all() and (high == [v[0, a:b].max() for a, b in zip(lo, hi)]).all()
