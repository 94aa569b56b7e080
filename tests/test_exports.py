"""Export documents: leaf forms, order, coverage, duplicates, reasons (FIXTURES §3)."""

import json

import pytest
from pyspark.sql import functions as F

from waystone.functions import coords
from waystone.operators import reconcile
from waystone.sources import cache, catalog, exports


def parsed(spark, *docs):
    rows = [(str(i), d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return exports.parse_documents(spark.createDataFrame(rows, exports.DOC))


def points(spark, *docs, strict=False):
    seg = exports.flatten_segments(parsed(spark, *docs))
    return reconcile.reconcile(seg, strict).orderBy("source", "seq").collect()


def visit(start, end, at):
    return {"startTime": start, "endTime": end, "visit": {"topCandidate": {"placeLocation": at}}}


@pytest.mark.parametrize("at", ["37.5°, 127.0°", "geo:37.5,127?z=12", {"latLng": "37.5,127"}, {"point": "geo:37.5,127"}, "375000000,1270000000"])
def test_coordinate_forms(spark, at):
    (p,) = points(spark, [visit("2024-05-11T00:00:00Z", "2024-05-11T01:00:00Z", at)])
    assert (p.lat, p.lon) == (37.5, 127.0)


@pytest.mark.parametrize("at", ["-90.5,12", "by the river", "geo:12,181", None, "12,", 7, []])
def test_bad_coordinates(spark, at):
    assert points(spark, [visit("2024-05-11T00:00:00Z", "2024-05-11T01:00:00Z", at)]) == []


def test_paths_inside_merged_coverage_go(spark):
    stays = [("06:15", "09:40", "41.1,2.1"), ("09:40", "11:05", "41.2,2.2"), ("18:20", "19:30", "41.3,2.3")]
    path = {"06:10": 1, "07:02": 2, "09:40": 3, "10:59": 4, "11:30": 5, "18:45": 6, "19:31": 7}
    doc = [visit(f"2023-10-03T{a}:00Z", f"2023-10-03T{b}:00Z", at) for a, b, at in stays]
    doc.insert(1, {"startTime": "2023-10-03T00:00:00Z", "endTime": "2023-10-04T00:00:00Z", "timelinePath": [{"point": f"{lat},5", "time": f"2023-10-03T{t}:00Z"} for t, lat in path.items()]})
    assert [p.lat for p in points(spark, doc)] == [1, 41.1, 41.2, 5, 41.3, 7]


def test_path_inside_its_own_segment_stays(spark):
    doc = [{"startTime": "2024-05-11T00:00:00Z", "endTime": "2024-05-11T02:00:00Z", "activity": {"start": "10,1", "end": "20,1"}, "timelinePath": [{"point": "15,1", "durationMinutesOffsetFromStartTime": "60"}]}]
    assert [p.lat for p in points(spark, doc)] == [10, 15, 20]


def test_offsets(spark):
    def one(offset, **more):
        doc = [{"startTime": "2024-05-11T00:00:00Z", "endTime": "2024-05-11T01:00:00Z", "timelinePath": [{"point": "15,1", "durationMinutesOffsetFromStartTime": offset, **more}]}]
        return [f"{p.ts:%H:%M}" for p in points(spark, doc)]

    assert one("15") == one(15) == ["00:15"] and one("60") == ["01:00"] and one("61") == ["01:01"]
    assert one("-1") == one("unknown") == one(120) == one(None) == []
    assert one("15", time="2024-05-11T00:40:00Z") == ["00:40"] and one("15", time="nonsense") == ["00:15"]


def test_duplicates_within_a_millisecond(spark):
    path = [("01.000500", 37.1), ("02.000000", 37.2), ("01.000100", 37.3), ("01.000700", 37.1), ("01.000500", 37.4), ("01.000900", 37.3)]
    doc = [{"startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T01:00:00Z", "timelinePath": [{"point": f"{lat},1", "time": f"2024-01-01T00:00:{s}Z"} for s, lat in path]}]
    assert [(p.ts.microsecond, p.lat) for p in points(spark, doc)] == [(100, 37.3), (500, 37.1), (500, 37.4), (0, 37.2)]


def test_visit_and_path_at_one_place_are_one(spark):
    doc = [visit("2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z", "375000000,1270000000") | {"timelinePath": [{"point": "37.5,127", "time": "2024-01-01T00:00:00Z"}]}]
    assert len(points(spark, doc)) == 1


def test_zone_less_points_keep_source_order(spark):
    doc = [visit("2026-01-02T10:00:00", "2026-01-02T11:00:00", "10,179"), visit("2026-01-01T15:00:00", "2026-01-01T16:00:00", "10,-179")]
    got = points(spark, doc)
    assert [p.lon for p in got] == [179, -179] and [str(p.recorded) for p in got] == ["2026-01-02", "2026-01-01"]
    assert points(spark, doc, strict=True) == []


@pytest.mark.parametrize("days", [["2024-01-03T00:00:00", "2024-01-02T00:00:00", "2024-01-01T00:00:00"], ["2024-03-10T00:00:00Z", "2024-02-10T00:00:00", "2024-01-10T00:00:00Z"]])
def test_reversed_exports_are_turned_round(spark, days):
    got = points(spark, [visit(t, t, f"{i},1") for i, t in enumerate(days)])
    assert [p.lat for p in got] == [2, 1, 0]


def test_reasons(spark):
    docs = ['{"timelineObjects":[]}', '{"rawSignals":[]}', '{"semanticSegments":[]}', "", "  ", '{"semanticSegments":[', None, [visit("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "1,1")], "[]", "7"]
    got = {int(r.source): r.reason for r in exports.classify_exports(parsed(spark, *docs)).collect()}
    assert got == {0: "LEGACY", 1: "RAW_ONLY", 2: "NO_USABLE", 3: "EMPTY", 4: "EMPTY", 5: "MALFORMED", 6: "EMPTY", 7: "OK", 8: "NO_USABLE", 9: "UNSUPPORTED"}


def test_raw_signals(spark):
    def signal(acc, at="37.5,127", t="2024-01-01T00:00:00Z", key="LatLng"):
        return {"position": {key: at, "timestamp": t, "accuracyMeters": acc}}

    doc = {"rawSignals": [signal(20), signal("10", key="latLng"), signal(-1), signal("x"), {"wifi": {}}, signal(5, t="2024-01-01T00:00:00"), signal(7, at="99,1")]}
    raw = exports.raw_signals(parsed(spark, doc))
    assert sorted(r.accuracy_m for r in raw.collect()) == [10, 20]
    one = reconcile.dedupe_raw(raw.withColumn("t_ms", F.unix_millis("ts")), ["ord"], key="source").collect()
    assert [r.accuracy_m for r in one] == [10]


@pytest.mark.parametrize("form", ["object", "raw", "cut", "one"])
def test_exports_beyond_a_variant(spark, tmp_path, form):
    """56 MiB of segments, of signals, or in one segment, over 128 MiB as a VARIANT: nothing goes missing unsaid."""
    note = "[" + "1," * (1 << 19) + "1]"
    seg = json.dumps(visit("2024-05-11T00:00:00Z", "2024-05-11T01:00:00Z", "37.5,127"))[:-1] + f',"note":{note}}}'
    signal = json.dumps({"position": {"LatLng": "37.5,127", "timestamp": "2024-01-01T00:00:00Z", "accuracyMeters": 5}})[:-1] + f',"note":{note}}}'
    segments = ",".join([seg] * 56)
    text, *want = {
        "object": (f'{{"semanticSegments":[{segments}]}}', "OK", 56, 0), "cut": (f'{{"semanticSegments":[{segments},', "MALFORMED", 0, 0),
        "raw": (f'{{"rawSignals":[{",".join([signal] * 56)}]}}', "RAW_ONLY", 0, 56), "one": (f"[{seg.replace(note, '[' + '1,' * (56 << 19) + '1]')},{seg}]", "TOO_LARGE", 1, 0),
    }[form]
    (tmp_path / "a.json").write_text(text)
    p = exports.parse_documents(exports.read_exports(spark, str(tmp_path)).select("source", "text"))
    (row,) = exports.classify_exports(p).collect()
    assert [row.reason, row.n_points, exports.raw_signals(p).count()] == want


def test_long_documents_say_what_short_ones_say(spark):
    docs = ['{"timelineObjects":[]}', '{"rawSignals":[]}', '{"semanticSegments":[]}', "", "  ", '{"semanticSegments":[', None, [visit("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "1,1"), None, 7, "x"], "[]", "{}", "[1", "no"]
    rows = [(str(i), d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    d = spark.createDataFrame(rows, exports.DOC)
    whole, split = (exports.classify_exports(exports.parse_documents(d, n)).collect() for n in (exports.WHOLE_BYTES, 0))
    assert sorted(whole) == sorted(split)


def test_elements_a_line(spark, tmp_path):
    seg = [json.dumps(visit(f"2024-05-11T{i % 24:02}:00:00", f"2024-05-11T{i % 24:02}:30:00", f"{i / 100},127")) for i in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(seg[:200]) + "\n\n{broken\n")
    (tmp_path / "b.jsonl").write_text("\n".join(seg[200:]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        e = exports.read_elements(spark, str(tmp_path))
        assert e.rdd.getNumPartitions() > 3
        got = exports.segment_points(exports.flatten_segments(exports.parse_elements(e))).orderBy("source", "seg_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [p.lat for p in got] == [i / 100 for i in range(300)] and len({p.source for p in got}) == 2
    signal = [("s", i, json.dumps({"position": {"LatLng": "37.5,127", "timestamp": "2024-01-01T00:00:00Z", "accuracyMeters": i}})) for i in range(5)]
    raw = exports.raw_signals(exports.parse_elements(spark.createDataFrame(signal, "source string, idx long, text string")))
    assert sorted((r.ord, r.accuracy_m) for r in raw.collect()) == [(i, i) for i in range(5)]


def test_instants_need_date_and_time(spark):
    d = spark.createDataFrame([("2026",), ("2026-01-01",), ("2026-01-01T00:00:00+0900",), ("2026-01-01T00:00",)], "s string")
    assert [r.ok for r in d.select(coords.parse_instant(F.col("s")).isNotNull().alias("ok")).collect()] == [False, False, True, True]
    assert [r.ok for r in d.select(coords.parse_instant(F.col("s"), strict=True).isNotNull().alias("ok")).collect()] == [False, False, True, False]


def test_files_and_cache(spark, tmp_path):
    f = tmp_path / "in" / "a.json"
    f.parent.mkdir()
    f.write_text(json.dumps([visit("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "1,2")]))
    path, root, calls = str(f.parent), str(tmp_path / "cache"), []

    def parse():
        calls.append(1)
        return reconcile.reconcile(exports.flatten_segments(exports.parse_documents(exports.read_exports(spark, path))))

    columns = ["source", "seq", "ts", "lat", "lon"]
    for n in (1, 1):
        assert [(r.lat, r.lon) for r in cache.load(spark, path, root, parse, columns).collect()] == [(1, 2)] and len(calls) == n
    cache.load(spark, path, root, parse, columns, use_cache=False)
    assert len(calls) == 2
    f.write_text(json.dumps([visit("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "3,4"), {}]))
    assert [r.lat for r in cache.load(spark, path, root, parse, columns).collect()] == [3] and len(calls) == 3
    assert cache.read_cache(spark, root, "none", columns) is None


def test_presets_and_settings(spark):
    text = json.dumps([{"id": "1", "name": " My  view "}, {"id": "2", "name": "my view"}, {"name": "no id"}, {"id": "3", "name": "x" * 41}, 7, {"id": "4", "name": "B", "movement": "steady"}])
    d = spark.createDataFrame([(text,), ("broken",), (None,)], "text string")
    assert [(r.id, r.name) for r in catalog.read_presets(d).collect()] == [("1", "My view"), ("4", "B")]


def test_plans_hold_few_parsers(spark):
    """However often points are used, neither the parse nor what comes of it is copied into filters."""
    e = spark.createDataFrame([("s", 0, "{}")], "source string, idx long, text string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    elements = plan(reconcile.reconcile(exports.flatten_segments(exports.parse_elements(e))))
    documents = plan(reconcile.reconcile(exports.flatten_segments(exports.parse_documents(e.select("source", "text")))))
    assert 0 < elements.count("parseJson") <= 4 and len(elements) < 100_000
    assert 0 < documents.count("parseJson") <= 16 and len(documents) < 200_000
