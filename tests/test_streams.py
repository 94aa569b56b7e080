"""Streams give what the batch operators give, in whatever order files and rows come."""

import random
import time

import pytest
from pyspark.sql import functions as F

from waystone.operators import clean, reconcile
from waystone.plans.adapters import export_segments, points
from waystone.sources import exports
from waystone.streaming import reconciled, sessions

RAW = "traveler_id long, seq long, t_ms long, lat double, lon double, accuracy_m double"
HOUR = 3_600_000


def run(stream, name):
    """The rows of a finite stream and how many came too late."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    late = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    return stream.sparkSession.table(name), late


def files(spark, folder, batches, schema):
    """A stream of files, one a micro-batch, in this order."""
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def shuffled(rows, rng, most_ms):
    """Micro-batches of rows, each moved by less than most_ms against its time, and a closing row without a key."""
    rows = sorted(rows, key=lambda r: r[2] + rng.uniform(0, most_ms))
    cut = sorted(rng.sample(range(1, len(rows)), 5))
    end = (None, 0, rows[-1][2] + 100 * HOUR, 0.0, 0.0, 0.0)
    return [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)], strict=True)] + [[end]]


def noisy(rng, n, step_ms, jump):
    """Tracks that stand, walk and jump away for up to four rows, with repeated times."""
    out = []
    for k in (1, 2):
        t, lat, away = 10 * HOUR, 37.0, 0
        for i in range(n):
            t += rng.choice([0, step_ms // 4, step_ms, 3 * step_ms])
            away = max(0, away - 1) or (rng.choice([1, 2, 3, 4]) if rng.random() < 0.15 else 0)
            lat += rng.choice([0, 0, 0.0001, 0.01])
            out.append((k, i, t, lat + (jump if away else 0), 127.0, rng.choice([3.0, 10.0, 60.0, 150.0])))
    return out


@pytest.mark.parametrize(("name", "step", "jump"), [("spikes", 240_000, 1.0), ("stationary", 120_000, 1.0), ("outliers", HOUR, 30.0), ("clean", 120_000, 1.0)])
def test_folds_equal_batch(spark, tmp_path, name, step, jump):
    stream, batch = {
        "spikes": (sessions.stream_spike_filter, clean.spike_fold),
        "stationary": (sessions.stream_stationary_collapse, clean.stationary_collapse),
        "outliers": (sessions.stream_outlier_filter, clean.outlier_filter),
        "clean": (sessions.stream_clean_raw, clean.clean_raw),
    }[name]
    rng = random.Random(name)
    rows = noisy(rng, 120, step, jump)
    want = sorted(map(tuple, batch(spark.createDataFrame(rows, RAW)).collect()))
    assert len(want) < len(rows)
    got, late = run(stream(files(spark, str(tmp_path / "in"), shuffled(rows, rng, 6 * step), RAW), late=f"{6 * step} milliseconds"), f"fold_{name}")
    assert sorted(map(tuple, got.collect())) == want and late == 0


def test_what_is_too_late_is_counted(spark, tmp_path):
    row = lambda i, h: (1, i, int(h * HOUR), 37 + i / 10, 127.0, 5.0)
    batches = [[row(0, 1), row(1, 10)], [row(3, 9.5)], [row(2, 5), row(4, 11)], [(None, 0, 99 * HOUR, 0.0, 0.0, 0.0)]]
    got, late = run(sessions.stream_spike_filter(files(spark, str(tmp_path / "in"), batches, RAW)), "too_late")
    assert sorted(r.seq for r in got.collect()) == [0, 1, 3, 4] and late == 1


def test_reconciled_files_equal_batch(spark, sf_dir, tmp_path):
    few = export_segments(spark, sf_dir).where("source % 9 = 0").union(spark.createDataFrame([("0", 1 << 40, "broken"), ("0", 1 << 41, "{}")], "source string, idx long, text string"))
    rows = [tuple(r) for r in few.collect()]
    rng = random.Random(1)
    rng.shuffle(rows)
    long = ("9", 1 << 42, '{"startTime":"2024-01-03T00:00:00Z","endTime":"2024-01-20T00:00:00Z","visit":{"topCandidate":{"placeLocation":"1,2"}}}')
    zoneless = [("9", (1 << 43) + i, '{"startTime":"2024-01-05T00:00:00","endTime":"2024-01-05T01:00:00","timelinePath":[{"point":"3,4","time":"2024-01-05T00:30:00"}]}') for i in (0, 1)]
    batches = [rows[i::4] for i in range(4)] + [[long], [*zoneless, long, rows[0]]]
    parse = lambda d: exports.flatten_segments(exports.parse_elements(d))
    changes, _ = run(reconciled.stream_reconciled(parse(files(spark, str(tmp_path / "in"), batches, few.schema)), 5 * 86_400_000), "changes")
    want = reconcile.reconcile(parse(spark.createDataFrame([r for b in batches for r in b], few.schema)))
    columns = ["source", "ts", "lat", "lon", "tz_missing", "recorded"]
    assert sorted(map(str, reconciled.settled(changes).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert changes.where("op = -1").count() > 0


def test_reconciled_replaces_duplicates(spark, tmp_path):
    seg = lambda at, body: '{"startTime":"%s","endTime":"%s",%s}' % (at, at, body)
    path = '"timelinePath":[{"point":"3,4","time":"2024-01-05T00:30:00.000%sZ"}]'
    visit = '"visit":{"topCandidate":{"placeLocation":"3,4"}}'
    at = "2024-01-05T00:30:00.000500Z"
    batches = [[("a", 5, seg(at, path % 900))], [("a", 3, seg(at, path % 700))], [("a", 9, seg(at, visit)), (None, 1, seg(at, visit))]]
    schema = "source string, idx long, text string"
    parse = lambda d: exports.flatten_segments(exports.parse_elements(d))
    changes, _ = run(reconciled.stream_reconciled(parse(files(spark, str(tmp_path / "in"), batches, schema))), "replaced")
    assert [r.ts.microsecond for r in reconciled.settled(changes).collect()] == [500]
    assert sorted((r.op, r.ts.microsecond) for r in changes.collect()) == [(-1, 700), (-1, 900), (1, 500), (1, 700), (1, 900)]


def test_empty_and_off(spark, sf_dir, tmp_path):
    got, late = run(sessions.stream_clean_raw(files(spark, str(tmp_path / "in"), [[(None, 0, HOUR, 0.0, 0.0, 0.0), (1, 0, None, 0.0, 0.0, 0.0)]], RAW)), "none")
    assert got.count() == 0 == late
    p = points(spark, sf_dir)
    assert sessions.stream_outlier_filter(p, "off") is p
    with pytest.raises(ValueError):
        reconciled.stream_reconciled(p, 0)
