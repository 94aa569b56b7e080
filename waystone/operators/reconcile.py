"""Overlapping histories into one: interval merging, range anti-join, dedupe, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.sources import exports


def merge_intervals(iv: DataFrame, key: str = "traveler_id", st: str = "st", en: str = "en") -> DataFrame:
    """The disjoint unions (key, st, en) of closed intervals; touching ones merge. Gaps and islands by windows."""
    w = Window.partitionBy(key).orderBy(st, en)
    before = F.max(en).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = iv.select(key, st, en).withColumn("new", F.when(before.isNull() | (F.col(st) > before), 1).otherwise(0))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "island").agg(F.min(st).alias(st), F.max(en).alias(en)).drop("island")


def uncovered(points: DataFrame, merged: DataFrame, key: str = "traveler_id", ts: str = "ts", checked: str = "true") -> DataFrame:
    """Points in no merged interval, both ends included, and those that aren't to be checked. The intervals are
    disjoint, so the last one that starts no later than a point decides: one union and one running window, no range
    join whatever the sizes."""
    cols = points.columns
    iv = merged.select(key, F.col("st").cast(points.schema[ts].dataType).alias(ts), F.col("en").alias("__en"), F.lit(0).alias("__o"))
    d = points.withColumn("__o", F.lit(1)).unionByName(iv, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "__o").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__last", F.max("__en").over(w))
    free = F.col("__last").isNull() | (F.col("__last") < F.col(ts)) | ~F.expr(checked)
    return d.where((F.col("__o") == 1) & free).select(*cols)


def dedupe_points(points: DataFrame, order: list[str | Column], key: str = "traveler_id", ms: str | Column = "ts_ms") -> DataFrame:
    """Of points equal in key, millisecond and coordinate the first in source order."""
    w = Window.partitionBy(key, ms, "lat", "lon").orderBy(*order)
    return points.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedupe_raw(raw: DataFrame, order: list[str], key: str = "traveler_id", ms: str | Column = "t_ms") -> DataFrame:
    """Of raw signals equal in key, millisecond and coordinate the most accurate, then the first."""
    w = Window.partitionBy(key, ms, "lat", "lon").orderBy("accuracy_m", *order)
    return raw.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def direction_vote(points: DataFrame, order: list[str], key: str = "traveler_id", ms: str = "t_ms") -> DataFrame:
    """Key, asc_votes, desc_votes, reversed: whether a source lists its anchors newest first.

    Neighbouring jumps of 36 hours or more vote once, one between the first and the last twice.
    """
    d = _steps(points, order, key, ms)
    g = d.groupBy(key).agg(*[c.alias(n) for n, c in _jumps(ms).items()])
    asc, desc = _votes()
    return g.select(key, asc.cast("long").alias("asc_votes"), desc.cast("long").alias("desc_votes"), (desc > asc).alias("reversed"))


def _steps(points: DataFrame, order: list[str], key: str, ms: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return points.withColumn("step", F.col(ms) - F.lag(ms).over(w)).withColumn("o", F.struct(*order))


def _jumps(ms: str) -> dict[str, Column]:
    """Aggregates over rows of _steps that decide a source's direction."""
    up, down = (F.count_if(F.col("step") >= K.DIRECTION_MS), F.count_if(F.col("step") <= -K.DIRECTION_MS))
    return {"up": up, "down": down, "ends": F.max_by(ms, "o") - F.min_by(ms, "o")}


def _votes() -> tuple[Column, Column]:
    return F.col("up") + F.when(F.col("ends") >= K.DIRECTION_MS, 2).otherwise(0), F.col("down") + F.when(F.col("ends") <= -K.DIRECTION_MS, 2).otherwise(0)


def reconcile(segments: DataFrame, strict: bool = False) -> DataFrame:
    """U1 and all of the above on flattened segments: source, seq, ts, lat, lon, tz_missing, recorded.

    Canonical points, then standalone path points outside every merged semantic interval of their source (zone-less
    ones are never covered); first duplicate kept; in order of time, or of the source, turned round where it runs
    backwards, if any of its points has no zone. strict drops zone-less points.
    """
    p = exports.segment_points(segments)
    if strict:
        p = p.where(~F.col("tz_missing"))
    merged = merge_intervals(exports.semantic_intervals(segments), "source")
    p = uncovered(p, merged, "source", checked="standalone AND NOT tz_missing").withColumn("late", F.col("standalone").cast("int"))
    p = p.withColumn("ts_ms", F.unix_millis("ts")).withColumn("after", F.when(F.col("late") == 1, F.unix_micros("ts")).otherwise(0))
    place = ["late", "after", "seg_idx", "ord"]
    p = dedupe_points(p, place, "source")
    whole = Window.partitionBy("source")
    p = _steps(p, ["seg_idx", "ord"], "source", "ts_ms").withColumn("loose", F.max(F.col("tz_missing").cast("int")).over(whole) == 1)
    for name, jump in _jumps("ts_ms").items():
        p = p.withColumn(name, jump.over(whole) if name != "ends" else F.max_by("ts_ms", "o").over(whole) - F.min_by("ts_ms", "o").over(whole))
    asc, desc = _votes()
    p = p.withColumn("reversed", desc > asc)
    segment = F.when(F.col("loose"), F.when(F.col("reversed"), -F.col("seg_idx")).otherwise(F.col("seg_idx")))
    w = Window.partitionBy("source").orderBy(F.when(~F.col("loose"), F.col("ts")), segment, F.when(F.col("loose"), F.col("ord")), *place)
    return p.select("source", (F.row_number().over(w) - 1).cast("long").alias("seq"), "ts", "lat", "lon", "tz_missing", "recorded")
