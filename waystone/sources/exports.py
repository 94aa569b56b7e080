"""Location exports: nested JSON documents into typed points, raw signals, intervals and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone.functions.coords import offset_instant, parse_coordinate, parse_instant, parse_number, parse_offset_minutes, tz_missing
from waystone.functions.geo import held, in_domain, let

DOC = "source string, text string"


#: Texts up to so many bytes are parsed as one VARIANT, longer ones an element at a time: a VARIANT may have 128 MiB (16 MiB
#: under SPARK_TESTING), which short numbers reach from a few times less text.
WHOLE_BYTES = 2 << 20


def read_exports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, text, size, modified), a whole file a row, so of 2 GB at most (more is an error); nothing is parsed yet."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, idx, text) of files with a segment or raw signal a line: files are split, so of any size; idx rises in a file.

    parse_elements makes them fit for flatten_segments and raw_signals.
    """
    d = spark.read.text(path).where("trim(value) <> ''")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of a partition; a block's rows are in one
    idx = F.col("_metadata.file_block_start").cast("decimal(19,0)") * F.lit(1 << 33).cast("decimal(10,0)") + row.cast("decimal(10,0)")
    return d.select(F.col("_metadata.file_path").alias("source"), idx.alias("idx"), F.col("value").alias("text"))


def parse_elements(elements: DataFrame) -> DataFrame:
    """Elements (source, idx, text: a segment or a raw signal) with element (VARIANT, null if malformed)."""
    return held(elements, element=F.try_parse_json("text"))


def parse_documents(docs: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """docs (source, text) with doc (VARIANT, null if malformed or long), root, segments and signals, per root form.

    S3: an array root is the segments; an object root has them under semanticSegments, raw signals under rawSignals. Both
    are arrays of (v: VARIANT) or, where text has over whole_bytes, of (t: JSON text), which is parsed a row each;
    oversized tells of one too large even so. legacy: an older form.
    """
    long = F.octet_length("text") > whole_bytes
    first = F.when(long, F.substr(F.ltrim(F.regexp_replace(F.substr("text", F.lit(1), F.lit(1000)), "[\\s\uFEFF]+", " ")), F.lit(1), F.lit(1)))
    array = F.when(first == "[", F.from_json("text", "array<string>"))
    of = lambda k: F.when(first == "{", F.from_json("text", f"{k} array<string>")[k])
    strings = {"segments": F.coalesce(array, of("semanticSegments")), "signals": of("rawSignals")}
    doc = F.when(~long, F.try_parse_json("text"))
    get = lambda v, path, kind="array<variant>": F.try_variant_get(v, path, kind)
    whole = lambda f: let(F.struct(doc.alias("d")), lambda x: f(x["d"]))  # noqa: E731  inlined: no row holds text and what comes of it
    variants = {"segments": whole(lambda v: F.coalesce(get(v, "$.semanticSegments"), get(v, "$"))), "signals": get(doc, "$.rawSignals")}
    d = {"doc": doc}
    for k in strings:
        t = F.transform(strings[k], lambda x: F.struct(F.lit(None).cast("variant").alias("v"), x.alias("t")))
        v = F.transform(variants[k], lambda x: F.struct(x.alias("v"), F.lit(None).cast("string").alias("t")))
        d[k] = F.when(long, t).otherwise(v)
    old = F.from_json("text", "timelineObjects string, locations string, bad string", {"columnNameOfCorruptRecord": "bad"})
    old = F.when(first == "{", let(old, lambda o: F.struct(o["bad"].isNull().alias("intact"), (o["timelineObjects"].isNotNull() | o["locations"].isNotNull()).alias("legacy"))))
    split = F.when(first == "[", F.when(array.isNotNull(), "array").otherwise("malformed")).otherwise(F.when(old["intact"], "object").otherwise("malformed"))
    form = lambda v: F.when(v.isNull(), "malformed").when(F.schema_of_variant(v).startswith("ARRAY"), "array").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("other")
    legacy = whole(lambda v: get(v, "$.timelineObjects", "variant").isNotNull() | get(v, "$.locations", "variant").isNotNull())
    lost = [F.coalesce(F.exists(x, lambda e: (F.octet_length(e) > WHOLE_BYTES) & F.try_parse_json(e).isNull()), F.lit(False)) for x in strings.values()]
    d |= {"root": F.when(long, split).otherwise(whole(form)), "legacy": F.when(long, old["legacy"]).otherwise(legacy), "oversized": F.when(long, lost[0] | lost[1]).otherwise(F.lit(False))}
    return docs.withColumns(d)


def _elements(parsed: DataFrame, array: str, idx: str, name: str) -> DataFrame:
    """source, idx and name (VARIANT) of parse_documents or of parse_elements."""
    if "element" in parsed.columns:
        return parsed.select("source", F.col("idx").alias(idx), F.col("element").alias(name))
    e = parsed.select("source", F.posexplode(array).alias(idx, "e"))
    return held(e, **{name: F.coalesce("e.v", F.try_parse_json("e.t"))}).select("source", idx, name)


def _text(v: Column | str, path: str) -> Column:
    """A string or number leaf as text, or null."""
    return F.try_variant_get(v, path, "string")


def _coordinate(v: Column | str, path: str) -> Column:
    """A coordinate that is text, or an object holding latLng or point."""
    return parse_coordinate(F.coalesce(_text(v, f"{path}.latLng"), _text(v, f"{path}.point"), _text(v, path)))


def flatten_segments(parsed: DataFrame) -> DataFrame:
    """A row per segment: source, seg_idx, st, en, zoned, points (ord, kind, ts, tz_missing, recorded, lat, lon).

    Inside a segment the path comes first, then the visit at the start, the activity's start and its end. P8: points
    need a time and a coordinate. P10: standalone tells a path without any usable semantic point.
    """
    s = _elements(parsed, "segments", "seg_idx", "s")
    s = s.select("source", "seg_idx", "s", _text("s", "$.startTime").alias("t0"), _text("s", "$.endTime").alias("t1"), F.try_variant_get("s", "$.timelinePath", "array<variant>").alias("path"))
    zoned = F.coalesce(~tz_missing(F.col("t0")) & ~tz_missing(F.col("t1")), F.lit(False))
    s = held(s, st=parse_instant(F.col("t0")), en=parse_instant(F.col("t1")), zoned=zoned)

    def point(order: Column, kind: str, ts: Column, raw: Column, at: Column) -> Column:
        def shape(v: Column) -> Column:
            date = F.when(v["missing"], F.to_date(F.substr(F.trim(v["raw"]), F.lit(1), F.lit(10))))
            return F.struct(v["ord"].alias("ord"), F.lit(kind).alias("kind"), v["ts"].alias("ts"), v["missing"].alias("tz_missing"), date.alias("recorded"), v["at"]["lat"].alias("lat"), v["at"]["lon"].alias("lon"))

        return let(F.struct(order.cast("long").alias("ord"), ts.alias("ts"), raw.alias("raw"), F.coalesce(tz_missing(raw), F.lit(False)).alias("missing"), at.alias("at")), shape)

    def on_path(p: Column, i: Column) -> Column:
        absolute = parse_instant(_text(p, "$.time"))
        by_offset = offset_instant(F.col("st"), F.col("en"), parse_offset_minutes(_text(p, "$.durationMinutesOffsetFromStartTime")), F.col("zoned"))

        def use(v: Column) -> Column:
            raw = F.when(v["t"].isNotNull(), _text(p, "$.time")).otherwise(F.col("t0"))
            return point(i, "path", F.coalesce(v["t"], by_offset), raw, _coordinate(p, "$.point"))

        return let(F.struct(absolute.alias("t")), use)

    last = F.lit(1 << 40)
    points = F.concat(
        F.coalesce(F.transform("path", on_path), F.array().cast("array<struct<ord:bigint,kind:string,ts:timestamp,tz_missing:boolean,recorded:date,lat:double,lon:double>>")),
        F.array(
            point(last, "visit", F.col("st"), F.col("t0"), _coordinate("s", "$.visit.topCandidate.placeLocation")),
            point(last + 1, "start", F.col("st"), F.col("t0"), _coordinate("s", "$.activity.start")),
            point(last + 2, "end", F.col("en"), F.col("t1"), _coordinate("s", "$.activity.end")),
        ),
    )
    s = held(s, points=F.filter(points, lambda p: p["ts"].isNotNull() & p["lat"].isNotNull() & in_domain(p["lat"], p["lon"])))
    semantic = F.exists("points", lambda p: p["kind"] != "path")
    return s.select("source", "seg_idx", "st", "en", "zoned", semantic.alias("semantic"), (F.col("path").isNotNull() & ~semantic).alias("standalone"), "points")


def segment_points(segments: DataFrame) -> DataFrame:
    """source, seg_idx, ord, kind, ts, tz_missing, recorded, lat, lon, standalone: a row per point."""
    return segments.select("source", "seg_idx", "standalone", F.explode("points").alias("p")).select("source", "seg_idx", "p.*", "standalone")


def semantic_intervals(segments: DataFrame) -> DataFrame:
    """source, st, en of segments that hold a semantic point and whose ends are zoned and in order."""
    return segments.where("semantic AND zoned AND en >= st").select("source", "st", "en")


def raw_signals(parsed: DataFrame) -> DataFrame:
    """Source, ord, ts, lat, lon, accuracy_m of raw position signals; other kinds and bad values are left out."""
    r = _elements(parsed, "signals", "ord", "r")
    at = parse_coordinate(F.coalesce(_text("r", "$.position.LatLng"), _text("r", "$.position.latLng")))
    r = held(r, ts=parse_instant(_text("r", "$.position.timestamp"), strict=True), at=at, accuracy_m=parse_number(_text("r", "$.position.accuracyMeters")))
    r = r.where("ts IS NOT NULL AND at IS NOT NULL AND accuracy_m >= 0")
    return r.select("source", "ord", "ts", "at.lat", "at.lon", "accuracy_m")


def classify_exports(parsed: DataFrame) -> DataFrame:
    """Source and reason: OK, EMPTY, MALFORMED, TOO_LARGE, RAW_ONLY, LEGACY, UNSUPPORTED or NO_USABLE.

    TOO_LARGE: one segment or signal is beyond a VARIANT, so it is missing, whatever else the export holds.
    """
    n = segment_points(flatten_segments(parsed)).groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("n"))
    empty = (F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty")
    d = parsed.select("source", "root", empty, "oversized", "legacy", F.col("segments").isNotNull().alias("segments"), F.col("signals").isNotNull().alias("signals"))
    d = d.join(n, F.col("source") == F.col("__s"), "left")
    reason = (
        F.when(F.col("empty"), "EMPTY")
        .when(F.col("root") == "malformed", "MALFORMED")
        .when(F.col("oversized"), "TOO_LARGE")
        .when(F.col("n") > 0, "OK")
        .when(F.col("signals"), "RAW_ONLY")
        .when(F.col("legacy"), "LEGACY")
        .when((F.col("root") == "other") | ~F.col("segments"), "UNSUPPORTED")
        .otherwise("NO_USABLE")
    )
    return d.select("source", "root", F.coalesce("n", F.lit(0)).cast("long").alias("n_points"), reason.alias("reason"))
