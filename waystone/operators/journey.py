"""From points to journeys: periods, distances, thresholds, legs, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions.geo import great_circle, great_way, haversine_km, held, unwrap_near, way_place, way_weights, world_x, world_y, wrap_near
from waystone.operators.median import exact_medians
from waystone.operators.scan import scan, time_slice

KEY, ORDER = "traveler_id", ("t_ms", "seq")


def ordered(key: str = KEY, order: tuple[str, ...] = ORDER):
    return Window.partitionBy(key).orderBy(*order)


# --- periods -----------------------------------------------------------------------------------------------------


def local_date(ts: str | Column = "ts", zone: str = "UTC", recorded: str | None = None) -> Column:
    """The recorded date of a zone-less point, else the date in the zone."""
    d = F.to_date(F.from_utc_timestamp(ts, zone))
    return F.coalesce(F.col(recorded), d) if recorded else d


def filter_year(points: DataFrame, year: int, **at: str) -> DataFrame:
    """P12."""
    return points.where(F.year(local_date(**at)) == year)


def filter_months(points: DataFrame, start: str, end: str, **at: str) -> DataFrame:
    """From month start to month end (yyyy-MM), both included, across years."""
    for m in (start, end):
        if not (len(m) == 7 and m[4] == "-" and 1 <= int(m[5:]) <= 12):
            raise ValueError("months are yyyy-MM")
    if end < start:
        raise ValueError("a period ends no earlier than it starts")
    d = local_date(**at)
    return points.where((d >= F.lit(f"{start}-01").cast("date")) & (d <= F.last_day(F.lit(f"{end}-01").cast("date"))))


def filter_dates(points: DataFrame, start: str, end: str, **at: str) -> DataFrame:
    """Inclusive; an end before the start counts as the start."""
    return points.where(local_date(**at).between(F.lit(start).cast("date"), F.lit(max(start, end)).cast("date")))


# --- distances -----------------------------------------------------------------------------------------------------


def hops(points: DataFrame, key: str = KEY, order: tuple[str, ...] = ORDER, slice_ms: int | None = None) -> DataFrame:
    """Points with lat0, lon0, t0_ms (the point before; null for a key's first), hop_km, cum0_km and cum_km.

    With slice_ms, here as below, a key's points are dealt out by slices of time as well, so that no task holds a key
    with very many points: see scan.
    """
    at = time_slice(slice_ms)
    d = scan(points, key, list(order), at, lags={"lat0": F.col("lat"), "lon0": F.col("lon"), "t0_ms": F.col("t_ms")})
    d = d.withColumn("hop_km", F.coalesce(haversine_km("lat0", "lon0", "lat", "lon"), F.lit(0.0)))
    d = scan(d, key, list(order), at, sums={"cum_km": F.col("hop_km")})
    if at is None:
        return d.withColumn("cum0_km", F.coalesce(F.lag("cum_km").over(ordered(key, order)), F.lit(0.0)))
    return d.withColumn("cum0_km", F.greatest(F.lit(0.0), F.col("cum_km") - F.col("hop_km")))


def totals(h: DataFrame, key: str = KEY) -> DataFrame:
    """A10, P20: key, n_points, total_km, available (two points and some distance)."""
    return h.groupBy(key).agg(F.count("*").alias("n_points"), F.max("cum_km").alias("total_km")).withColumn("available", (F.col("n_points") >= 2) & (F.col("total_km") > 0))


def thresholds(h: DataFrame, key: str = KEY, hot: bool = False) -> DataFrame:
    """A3–A5: key, median_hop, mad_hop, threshold_km of hops between 0 and 120 km; keys without any get 120.

    hot takes the medians by counting in ranges (see exact_medians), for keys whose hops are too many for one task.
    """
    c = h.where((F.col("hop_km") > 0) & (F.col("hop_km") < K.LOCAL_HOP_KM)).select(key, "hop_km")
    if hot:
        med = exact_medians(c, key, "hop_km", "median_hop")
        off = c.join(med, key).select(key, F.abs(F.col("hop_km") - F.col("median_hop")).alias("off"))
        mad = med.join(exact_medians(off, key, "off", "mad_hop"), key)
    else:
        med = c.groupBy(key).agg(F.median("hop_km").alias("median_hop"))
        mad = c.join(med, key).groupBy(key).agg(F.first("median_hop").alias("median_hop"), F.median(F.abs(F.col("hop_km") - F.col("median_hop"))).alias("mad_hop"))
    t = F.least(F.lit(K.THRESHOLD_HIGH_KM), F.greatest(F.lit(K.THRESHOLD_LOW_KM), F.col("median_hop") * 3, F.col("median_hop") + F.col("mad_hop") * 6))
    return h.select(key).distinct().join(mad, key, "left").withColumn("threshold_km", F.when(F.col("median_hop").isNull(), K.THRESHOLD_HIGH_KM).otherwise(t))


def legs(h: DataFrame, limits: DataFrame, multiplier: float = 1.0, key: str = KEY, order: tuple[str, ...] = ORDER, slice_ms: int | None = None) -> DataFrame:
    """Key, leg_no, start_km, end_km, is_transfer: hops of the threshold or more are legs of their own, what lies
    between is local; local legs without length are left out, and so are journeys without any."""
    d = h.where("lat0 IS NOT NULL").join(limits.select(key, "threshold_km"), key)
    d = d.withColumn("far", F.col("hop_km") >= F.greatest(F.lit(1.0), F.col("threshold_km") * multiplier))
    d = scan(d, key, list(order), time_slice(slice_ms), sums={"island": F.col("far").cast("int")})
    far = d.where("far").select(key, F.col("cum0_km").alias("start_km"), F.col("cum_km").alias("end_km"), F.lit(True).alias("is_transfer"))
    near = d.where(~F.col("far")).groupBy(key, "island").agg(F.min("cum0_km").alias("start_km"), F.max("cum_km").alias("end_km"))
    near = near.where("end_km > start_km").select(key, "start_km", "end_km", F.lit(False).alias("is_transfer"))
    out = far.unionByName(near)
    return out.withColumn("leg_no", F.row_number().over(Window.partitionBy(key).orderBy("start_km", "end_km"))).select(key, "leg_no", "start_km", "end_km", "is_transfer")


def sample_steps() -> Column:
    """How many samples a hop row has."""
    steps = F.greatest(F.lit(1), F.least(F.lit(int(K.DENSIFY_MOST)), F.ceil(F.col("hop_km") / K.DENSIFY_KM).cast("int")))
    return F.when(F.col("lat0").isNull(), 1).otherwise(steps)


def densify(h: DataFrame) -> DataFrame:
    """Hop rows as samples at most 75 km apart (320 a hop at most): k, steps, at_km, lat, lon; a first point once."""
    names = [c for c in h.columns if c not in ("lat", "lon", "steps", "k", "at_km")]
    lat0, lon0 = (F.coalesce(f"{c}0", c) for c in ("lat", "lon"))
    d = held(h.withColumn("steps", sample_steps()), __way=great_way(lat0, lon0, F.col("lat"), F.col("lon")))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    d = d.withColumn("__f", F.col("k") / F.col("steps"))
    d = held(d, __ab=way_weights(F.col("__way"), F.col("__f")))
    d = d.withColumn("__p", way_place(F.col("__way"), F.col("__ab"), lat0, lon0, F.col("lat"), F.col("lon"), F.col("__f")))
    at_km = (F.col("cum0_km") + F.col("hop_km") * F.col("__f")).alias("at_km")
    d = d.select(*names, F.col("__p.lat").alias("lat"), F.col("__p.lon").alias("lon"), "steps", "k", at_km)
    return d.select(*[c for c in h.columns if c in d.columns and c not in ("steps", "k", "at_km")], "steps", "k", "at_km")


def unwrapped(points: DataFrame, key: str = KEY, order: tuple[str, ...] = ORDER, slice_ms: int | None = None) -> DataFrame:
    """Points with x (unwrapped over the date line) and y of the unit world, as a running sum of corrections."""
    at = time_slice(slice_ms)
    d = points.withColumn("__x", world_x("lon")).withColumn("y", world_y("lat"))
    d = scan(d, key, list(order), at, lags={"__x0": F.col("__x")})
    step = F.col("__x") - F.col("__x0")
    turn = F.when(step > 0.5, -1).when(step < -0.5, 1).otherwise(0)
    return scan(d, key, list(order), at, sums={"__turns": turn}).withColumn("x", F.col("__x") + F.col("__turns")).drop("__x", "__x0", "__turns")


def polar_unwrapped(points: DataFrame, key: str = KEY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Points with x and y as by unwrapped, but for flights over a pole.

    A corridor is a longest run of latitudes of 50 degrees or more, first and last point aside, with one of 70 or more
    in it. Where the points around it would end on another copy of the world than the shorter way leads to, its own
    points follow the great circle between them, and all later points move over by the whole worlds that differ. Such
    moves don't change what the next corridor finds, so a running sum of them does.
    """
    w, all_rows = ordered(key, order), Window.partitionBy(key)
    d = unwrapped(points, key, order).withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(all_rows)})
    d = d.withColumn("__p", (F.abs("lat") >= K.POLAR_CORRIDOR) & (F.col("__i") > 1) & (F.col("__i") < F.col("__n")))
    fresh = F.col("__p") & ~F.coalesce(F.lag("__p").over(w), F.lit(False))
    here = F.struct("lat", "lon", "x", "__i")
    d = d.withColumns({"__run": F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__before": F.lag(here).over(w), "__after": F.lead(here).over(w)})
    runs = d.where("__p").groupBy(F.col(key).alias("__k"), F.col("__run").alias("__r")).agg(F.max(F.abs("lat")).alias("top"), F.min_by("__before", "__i").alias("a"), F.max_by("__after", "__i").alias("b"))
    end = wrap_near(world_x("b.lon"), "a.x")
    runs = runs.where(F.col("top") >= K.POLAR_CORE).withColumns({"end": end, "move": end - F.col("b.x")}).where(F.abs("move") >= 0.5)
    moved = d.join(runs, (F.col(key) == F.col("__k")) & (F.col("__run") == F.col("__r")), "left").withColumn("__in", F.col("__p") & F.col("a").isNotNull())
    f = (F.col("__i") - F.col("a.__i")) / (F.col("b.__i") - F.col("a.__i"))
    way = great_circle(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), f)["lon"]
    along = wrap_near(world_x(way), F.col("a.x") + (F.col("end") - F.col("a.x")) * f)
    first = F.coalesce(F.when((F.col("__i") == F.col("b.__i")), F.col("move")), F.lit(0.0))  # the point after a corridor carries its move
    moved = moved.withColumn("__x", F.when(F.col("__in"), along).otherwise(F.col("x"))).withColumn("__m", first)
    return moved.withColumn("x", F.col("__x") + F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*points.columns, "x", "y")


def world_bounds(u: DataFrame, key: str = KEY) -> DataFrame:
    """A1: key, min_x, max_x, min_y, max_y."""
    return u.groupBy(key).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def block_bounds(u: DataFrame, key: str = KEY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """A2: key, block, n, bounds and cum_km range of every 256 rows, to be put together again by world_bounds' aggregate."""
    d = u.withColumn("block", F.floor((F.row_number().over(ordered(key, order)) - 1) / K.BLOCK_ROWS).cast("long"))
    return d.groupBy(key, "block").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def shortest_wrapped(u: DataFrame, key: str = KEY) -> DataFrame:
    """Key, min_x, max_x of raw x, or of x with its western half moved a world east where that is narrower."""
    x = F.col("x") - F.floor("x")
    moved = F.when(x < 0.5, x + 1).otherwise(x)
    g = u.groupBy(key).agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(moved).alias("c"), F.max(moved).alias("d"))
    less = F.col("d") - F.col("c") < F.col("b") - F.col("a")
    return g.select(key, F.when(less, F.col("c")).otherwise(F.col("a")).alias("min_x"), F.when(less, F.col("d")).otherwise(F.col("b")).alias("max_x"))


def overview_split(u: DataFrame, key: str = KEY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Key, part, part_no, x, y: the route inside one world around its reference, cut where it leaves an edge.

    The reference is the middle of the bounds if they span less than a world, else the last x. A jump of over half a
    world ends a part at the edge and starts the next at the other, at the y where the straight line crosses.
    """
    b = u.groupBy(key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max_by("x", F.struct(*order)).alias("last"))
    b = b.select(F.col(key).alias("__k"), F.when(F.col("hi") - F.col("lo") < 1, (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("last")).alias("ref"))
    w = ordered(key, order)
    d = u.join(b, F.col(key) == F.col("__k")).withColumn("wx", F.col("x") - F.floor(F.col("x") - F.col("ref") + 0.5))
    d = d.withColumn("px", F.lag("wx").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("jump", F.col("wx") - F.col("px"))
    side = F.when(F.col("jump") > 0.5, -0.5).when(F.col("jump") < -0.5, 0.5)
    d = d.withColumn("side", side).withColumn("edge", F.col("ref") + F.col("side"))
    near = F.col("wx") + F.when(F.col("side") > 0, 1.0).otherwise(-1.0)
    y = F.col("py") + (F.col("y") - F.col("py")) * (F.col("edge") - F.col("px")) / F.when(near == F.col("px"), F.lit(1.0)).otherwise(near - F.col("px"))
    d = d.withColumn("part", F.sum(F.when(F.col("side").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = F.array(F.struct((F.col("part") - 1).alias("part"), F.lit(0).alias("o"), F.col("edge").alias("x"), y.alias("y")), F.struct("part", F.lit(1).alias("o"), (F.col("edge") - F.col("side") * 2).alias("x"), y.alias("y")), F.struct("part", F.lit(2).alias("o"), F.col("wx").alias("x"), F.col("y").alias("y")))
    one = F.array(F.struct("part", F.lit(2).alias("o"), F.col("wx").alias("x"), F.col("y").alias("y")))
    d = d.select(key, *order, F.explode(F.when(F.col("side").isNotNull(), cut).otherwise(one)).alias("p"))
    n = F.row_number().over(Window.partitionBy(key, "p.part").orderBy(*order, "p.o"))
    return d.select(key, "p.part", n.alias("part_no"), "p.x", "p.y")


def chronological(points: DataFrame, key: str = KEY, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Key, chronological: whether times never fall in source order."""
    w = ordered(key, order)
    d = points.withColumn("ok", F.coalesce(F.lag("t_ms").over(w) <= F.col("t_ms"), F.lit(True)))
    return d.groupBy(key).agg(F.bool_and("ok").alias("chronological"))


# --- summaries -----------------------------------------------------------------------------------------------------


def date_extent(points: DataFrame, key: str = KEY, **at: str) -> DataFrame:
    """Key, first_date, last_date, first_month, last_month."""
    d = local_date(**at)
    return points.groupBy(key).agg(F.min(d).alias("first_date"), F.max(d).alias("last_date")).select(key, "first_date", "last_date", F.date_format("first_date", "yyyy-MM").alias("first_month"), F.date_format("last_date", "yyyy-MM").alias("last_month"))


def available_months(points: DataFrame, key: str = KEY, **at: str) -> DataFrame:
    """Key, month, label of the months that have points."""
    d = points.select(key, F.trunc(local_date(**at), "MM").alias("m")).distinct()
    return d.select(key, F.date_format("m", "yyyy-MM").alias("month"), F.date_format("m", "MMMM yyyy").alias("label"))


def selection_summary(selected: DataFrame, kept: DataFrame, unit: str = "km", key: str = KEY) -> DataFrame:
    """Key, n_points, ignored, distance (unit, whole), state of a selection before and after filtering."""
    h = totals(hops(kept, key), key)
    d = selected.groupBy(key).agg(F.count("*").alias("n_selected")).join(h, key, "left")
    n, km = F.coalesce("n_points", F.lit(0)), F.coalesce("total_km", F.lit(0.0))
    state = F.when(n == 0, "empty").when(n == 1, "one point").when(km <= 0, "no movement").otherwise("normal")
    return d.select(key, n.cast("long").alias("n_points"), F.greatest(F.lit(0), F.col("n_selected") - n).cast("long").alias("ignored"), F.round(km * (K.MILE if unit == "mi" else 1.0), 0).alias("distance"), state.alias("state"))


def tz_missing_any(points: DataFrame, column: str = "tz_missing", key: str = KEY) -> DataFrame:
    """Key, tz_missing: whether any of its points came without a zone."""
    return points.groupBy(key).agg(F.coalesce(F.bool_or(column), F.lit(False)).alias("tz_missing"))


def select_source(semantic: DataFrame, raw: DataFrame, mode: str, start: str, end: str, **at: str) -> DataFrame:
    """The points to show: cleaned raw signals whatever the period, or the semantic points of the dates."""
    if mode not in ("semantic", "raw"):
        raise ValueError("a source is semantic or raw")
    return raw if mode == "raw" else filter_dates(semantic, start, end, **at)


def near_marker(x: str, marker: str) -> Column:
    return unwrap_near(F.col(x), F.col(marker))
