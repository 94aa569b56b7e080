"""As-of joins along a journey: positions, legs and knots at a distance or progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions.geo import great_circle
from waystone.operators.journey import sample_steps
from waystone.operators.scan import place_slice, scan, time_slice


def as_of(probes: DataFrame, knots: DataFrame, key: str, probe_at: str, knot_at: str, tie: str, payload: list[str], later: bool, width: float | None = None) -> DataFrame:
    """probes with, as struct knot, the payload of the first knot at or after probe_at (later) or the last at or before.

    tie is a number. Both sides meet in one union, sorted once per key; a running last() carries the knot to its probes. Of knots at the
    same place the one of least tie is found when looking later, of greatest when looking back. No range join. With
    width, knots and probes of a key are cut alike into slices of places, and one knot a slice is carried on to the
    next: for keys with very many knots or probes.
    """
    cols = probes.columns
    k = knots.select(key, F.col(knot_at).cast("double").alias("__at"), F.col(tie).alias("__tie"), F.struct(*payload).alias("knot"), F.lit(0).alias("__probe"))
    p = probes.withColumn("__at", F.col(probe_at).cast("double")).withColumn("__probe", F.lit(1))
    order = [-F.col("__at"), "__probe", -F.col("__tie")] if later else ["__at", "__probe", "__tie"]
    d = p.unionByName(k, allowMissingColumns=True).withColumn("__knot", F.col("knot")).drop("knot")
    d = scan(d, key, order, place_slice(width, "__at", later), lasts={"knot": F.col("__knot")})
    return d.where("__probe = 1").select(*cols, "knot")


def positions_at(probes: DataFrame, h: DataFrame, at: str = "d", key: str = "traveler_id", tie: str = "i", also: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """Probes with d clamped to the journey and lat, lon, at_ms, index, fraction there, along great circles.

    h are hop rows (see journey.hops) with tie, their index in the journey. A probe falls on the first point at or
    beyond it (the second point at least); hops without length count as their start. Times are whole milliseconds. also: further columns of that
    point, null for a journey of one point. width: see as_of, here as below.
    """
    total = h.groupBy(key).agg(F.max("cum_km").alias("total_km"), F.max_by(F.struct("lat", "lon", "t_ms"), tie).alias("only"))
    p = probes.join(total, key).withColumn(at, F.greatest(F.lit(0.0), F.least(F.col("total_km"), F.col(at))))
    moving = h.where("lat0 IS NOT NULL")
    d = as_of(p, moving, key, at, "cum_km", tie, ["lat0", "lon0", "t0_ms", "lat", "lon", "t_ms", "cum0_km", "hop_km", tie, *[c for c in also if c != tie]], later=True, width=width)
    f = F.when(F.col("knot.hop_km") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(at) - F.col("knot.cum0_km")) / F.col("knot.hop_km")))).otherwise(0.0)
    d = d.withColumn("fraction", F.coalesce(f, F.lit(0.0)))
    pos = great_circle(F.col("knot.lat0"), F.col("knot.lon0"), F.col("knot.lat"), F.col("knot.lon"), F.col("fraction"))
    ms = F.col("knot.t0_ms") + ((F.col("knot.t_ms") - F.col("knot.t0_ms")) * F.col("fraction")).cast("long")
    d = d.withColumn("__p", pos)
    return d.select(*probes.columns, F.coalesce("__p.lat", "only.lat").alias("lat"), F.coalesce("__p.lon", "only.lon").alias("lon"), F.coalesce(ms, F.col("only.t_ms")).alias("at_ms"), F.coalesce(F.col(f"knot.{tie}"), F.lit(0)).cast("long").alias("index"), "fraction", *[f"knot.{c}" for c in also])


def legs_at(probes: DataFrame, legs: DataFrame, at: str = "d", key: str = "traveler_id", width: float | None = None) -> DataFrame:
    """Probes with leg_no, start_km, end_km, is_transfer of the last leg that starts at or before d; before the
    first leg that one; null without legs."""
    first = legs.where("leg_no = 1").select(F.col(key).alias("__k"), F.struct("leg_no", "start_km", "end_km", "is_transfer").alias("__first"))
    d = as_of(probes, legs, key, at, "start_km", "leg_no", ["leg_no", "start_km", "end_km", "is_transfer"], later=False, width=width)
    d = d.join(first, F.col(key) == F.col("__k"), "left").withColumn("knot", F.coalesce("knot", "__first"))
    return d.select(*probes.columns, "knot.leg_no", "knot.start_km", "knot.end_km", "knot.is_transfer")


def point_index_at(probes: DataFrame, h: DataFrame, at: str = "d", key: str = "traveler_id", tie: str = "i", width: float | None = None) -> DataFrame:
    """Probes with index, the last point reached by d."""
    d = as_of(probes, h, key, at, "cum_km", tie, [tie], later=False, width=width)
    return d.select(*probes.columns, F.col(f"knot.{tie}").cast("long").alias("index"))


def samples_at(probes: DataFrame, h: DataFrame, number: str = "n", key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), slice_ms: int | None = None, width: float | None = None) -> DataFrame:
    """Probes with lat, lon and at_km of the sample of that number (from 1) of the densified journey.

    densify's samples before a hop are a running sum of steps, so a sample is found by an as-of on that sum and none is
    made but those asked for. Numbers that the journey doesn't have give nulls. slice_ms and width: see scan and as_of.
    """
    s = scan(h.withColumn("steps", sample_steps()), key, list(order), time_slice(slice_ms), sums={"upto": F.col("steps").cast("long")})
    s = s.select(key, "upto", "steps", "lat0", "lon0", "lat", "lon", "cum0_km", "hop_km")
    payload = ["upto", "steps", "lat0", "lon0", "lat", "lon", "cum0_km", "hop_km"]
    d = as_of(probes.where(F.col(number) >= 1), s, key, number, "upto", "upto", payload, later=True, width=width)
    f = (F.col(number) - (F.col("knot.upto") - F.col("knot.steps"))) / F.col("knot.steps")
    at = great_circle(F.coalesce("knot.lat0", "knot.lat"), F.coalesce("knot.lon0", "knot.lon"), F.col("knot.lat"), F.col("knot.lon"), f)
    d = d.withColumn("__p", at).select(*probes.columns, "__p.lat", "__p.lon", (F.col("knot.cum0_km") + F.col("knot.hop_km") * f).alias("at_km"))
    rest = probes.where(F.coalesce(F.col(number) < 1, F.lit(True)))
    return d.unionByName(rest.select(*probes.columns, *[F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "at_km")]))


def even_samples(h: DataFrame, count: int, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq")) -> DataFrame:
    """Key, n, lat, lon, at_km: count (2 or more) samples of each densified journey, evenly apart by number, the first and last among them.

    Of all samples numbers 1 + floor((all - 1) * j / (count - 1)) for j from 0, each once. A hop knows its samples' numbers from
    running sums and so which of them are asked for: journeys are sorted once and meet no probes.
    """
    if count < 2:
        raise ValueError("samples are two at least")
    s = scan(h.withColumn("steps", sample_steps()), key, list(order), sums={"upto": F.col("steps").cast("long")})
    s = s.withColumns({"all": F.max("upto").over(Window.partitionBy(key)), "gaps": F.lit(count - 1).cast("long")})
    s = s.selectExpr(f"`{key}`", "upto - steps AS past", "upto", "steps", "all - 1 AS span", "gaps", "lat0", "lon0", "lat", "lon", "cum0_km", "hop_km")
    first = lambda c: F.expr(f"(gaps * ({c}) + greatest(span, 1) - 1) div greatest(span, 1)")  # noqa: E731  the least j whose number is beyond c
    s = s.withColumns({"j0": first("past"), "j1": F.least(F.col("gaps"), first("upto") - 1)}).where("j0 <= j1")
    s = s.withColumn("n", F.explode(F.expr("array_distinct(transform(sequence(j0, j1), j -> 1 + span * j div gaps))")))
    f = (F.col("n") - F.col("past")) / F.col("steps")
    at = great_circle(F.coalesce("lat0", "lat"), F.coalesce("lon0", "lon"), F.col("lat"), F.col("lon"), f)
    return s.select(key, "n", at.alias("__p"), (F.col("cum0_km") + F.col("hop_km") * f).alias("at_km")).select(key, "n", "__p.lat", "__p.lon", "at_km")


def ranked(h: DataFrame, key: str = "traveler_id") -> DataFrame:
    """h with below and upto, how many points of the journey lie before a point's place and how many not behind it."""
    w = Window.partitionBy(key).orderBy("cum_km")
    return h.withColumns({"below": (F.rank().over(w) - 1).cast("long"), "upto": F.count("*").over(w)})


def progress(n: str | Column = "n", i: str | Column = "frame") -> Column:
    """I / (n - 1), 1 for a single frame."""
    n, i = (F.col(x) if isinstance(x, str) else x for x in (n, i))
    return F.when(n <= 1, F.lit(1.0)).otherwise(i / (n - 1))
