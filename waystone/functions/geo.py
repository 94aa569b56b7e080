"""Column functions on coordinates: distances, interpolation, projection, wrapping, tiles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone import constants as K

Num = Column | float


def _c(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x written and evaluated once however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that stand behind a generator: each is written once in the plan, and no filter that Catalyst
    infers or pushes down takes a copy of it along, however often it is used afterwards."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def clamp(x: Num, low: Num, high: Num) -> Column:
    """x kept between low and high; null stays null, which greatest and least alone would skip."""
    return F.when(_c(x).isNotNull(), F.greatest(_c(low), F.least(_c(high), _c(x))))


def lerp(a: Num, b: Num, t: Num) -> Column:
    """A + (b - a) t."""
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def log_lerp(a: Num, b: Num, t: Num) -> Column:
    """Interpolation of logarithms."""
    return F.exp(lerp(F.ln(_c(a)), F.ln(_c(b)), t))


def smoothstep(t: Num) -> Column:
    """0 to 1 with flat ends."""
    c = clamp(t, 0.0, 1.0)
    return c * c * (F.lit(3.0) - F.lit(2.0) * c)


def ease_out_cubic(t: Num) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - _c(t), F.lit(3.0))


def ease_in_out_cubic(t: Num) -> Column:
    t = _c(t)
    return F.when(t < 0.5, F.lit(4.0) * t * t * t).otherwise(F.lit(1.0) - F.pow(F.lit(-2.0) * t + 2.0, F.lit(3.0)) / 2.0)


def haversine_km(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance on a sphere of mean radius."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.sin((p2 - p1) / 2)
    b = F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2)
    h = F.sqrt(a * a + F.cos(p1) * F.cos(p2) * b * b)
    return F.lit(2 * K.EARTH_KM) * F.nanvl(F.asin(h), F.lit(math.pi / 2))  # antipodes may come out a little over 1


def great_way(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(x0, y0, z0, x1, y1, z1, w), both ends on the unit sphere and the angle between them: what all
    fractions of a way share."""
    p = [F.radians(x) for x in (lat1, lon1, lat2, lon2)]
    unit = {f"{n}{k}": c for k, i in ((0, 0), (1, 2)) for n, c in (("x", F.cos(p[i]) * F.cos(p[i + 1])), ("y", F.cos(p[i]) * F.sin(p[i + 1])), ("z", F.sin(p[i])))}

    def angle(v: Column) -> Column:
        dot = clamp(v["x0"] * v["x1"] + v["y0"] * v["y1"] + v["z0"] * v["z1"], -1.0, 1.0)
        return F.struct(*[v[n].alias(n) for n in unit], F.acos(dot).alias("w"))

    return let(F.struct(*[c.alias(n) for n, c in unit.items()]), angle)


def way_weights(way: Column, f: Column) -> Column:
    """struct(a, b): how much either end counts at fraction f of a way; linear for tiny angles."""
    w, tiny = way["w"], F.sin(way["w"]) < 1e-8
    part = lambda t: F.when(tiny, t).otherwise(F.sin(t * w) / F.sin(w))
    return F.struct(part(F.lit(1.0) - f).alias("a"), part(f).alias("b"))


def way_place(way: Column, q: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, f: Column) -> Column:
    """struct(lat, lon) at fraction f of a way of these ends, given its weights; outside 0..1 the ends themselves."""
    x, y, z = (q["a"] * way[f"{n}0"] + q["b"] * way[f"{n}1"] for n in "xyz")
    at = lambda n, first, last, c: F.when(f <= 0, first).when(f >= 1, last).otherwise(F.degrees(c)).alias(n)
    return F.struct(at("lat", lat1, lat2, F.atan2(z, F.sqrt(x * x + y * y))), at("lon", lon1, lon2, F.atan2(y, x)))


def great_circle(lat1: Num, lon1: Num, lat2: Num, lon2: Num, f: Num) -> Column:
    """struct(lat, lon) at fraction f of the way; outside 0..1 the ends themselves; linear for tiny angles."""
    ends, f = [_c(x) for x in (lat1, lon1, lat2, lon2)], _c(f)
    v = F.struct(great_way(*ends).alias("way"), f.alias("f"), *[c.alias(n) for n, c in zip(("lat1", "lon1", "lat2", "lon2"), ends, strict=True)])
    both = lambda v: F.struct(v.alias("v"), way_weights(v["way"], v["f"]).alias("q"))
    place = lambda s: way_place(s["v"]["way"], s["q"], *[s["v"][n] for n in ("lat1", "lon1", "lat2", "lon2")], s["v"]["f"])
    return let(let(v, both), place)


def mercator_m(lat: Num, lon: Num) -> Column:
    """struct(x, y) in Mercator metres."""
    y = F.lit(K.MERCATOR_R) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2))
    return F.struct((F.lit(K.MERCATOR_R) * F.radians(_c(lon))).alias("x"), y.alias("y"))


def mercator_inverse(x: Num, y: Num) -> Column:
    """struct(lat, lon) of Mercator metres."""
    lat = F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / K.MERCATOR_R)) - math.pi / 2)
    return F.struct(lat.alias("lat"), F.degrees(_c(x) / K.MERCATOR_R).alias("lon"))


def world_x(lon: Num) -> Column:
    """X of the unit world."""
    return (_c(lon) + 180.0) / 360.0


def world_y(lat: Num) -> Column:
    """Y of the unit world, 0 at the top."""
    s = F.sin(F.radians(clamp(lat, -K.MAX_LAT, K.MAX_LAT)))
    return F.lit(0.5) - F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) / (4 * math.pi)


def speed_kmh(km: Num, dt_ms: Num) -> Column:
    """Infinite when no time passes or it runs backwards."""
    return F.when(_c(dt_ms) <= 0, F.lit(float("inf"))).otherwise(_c(km) / (_c(dt_ms) / 3_600_000.0))


def unwrap_near(v: Num, ref: Num) -> Column:
    """The copy of v at most half a world from ref; v itself at exactly half."""
    v, d = _c(v), _c(v) - _c(ref)
    return F.when(d > 0.5, v - F.ceil(d - 0.5)).when(d < -0.5, v + F.ceil(-d - 0.5)).otherwise(v)


def wrap_near(v: Num, ref: Num) -> Column:
    """V moved by whole worlds into [ref - 0.5, ref + 0.5)."""
    return _c(v) - F.floor(_c(v) - _c(ref) + 0.5)


def hermite(x: Num, x0: Num, x1: Num, y0: Num, y1: Num, m0: Num, m1: Num) -> Column:
    """Cubic Hermite between two knots."""
    h = _c(x1) - _c(x0)
    t = (_c(x) - _c(x0)) / h
    t2, t3 = t * t, t * t * t
    return (t3 * 2 - t2 * 3 + 1) * _c(y0) + (t3 - t2 * 2 + t) * h * _c(m0) + (t2 * 3 - t3 * 2) * _c(y1) + (t3 - t2) * h * _c(m1)


def tile_zoom(span_x: Num, width_px: Num) -> Column:
    """Zoom level at which span_x of the world fills the width."""
    return clamp(F.floor(F.log2(_c(width_px) / (_c(span_x) * K.TILE_PX))), K.ZOOM_LOW, K.ZOOM_HIGH).cast("int")


def clamp_center_y(y: Num, span_y: Num) -> Column:
    """The centre that keeps the view inside the world; the middle when it is taller than that."""
    half = _c(span_y) / 2
    return F.when(_c(span_y) >= 1, F.lit(0.5)).otherwise(clamp(y, half, F.lit(1.0) - half))


def meters_to_tile(x: Num, y: Num, zoom: Num) -> Column:
    """struct(tx, ty) of Mercator metres, truncated toward zero."""
    n = F.pow(F.lit(2.0), _c(zoom))
    tx = ((_c(x) + K.MERCATOR_E) / (2 * K.MERCATOR_E) * n).cast("int")
    ty = ((F.lit(K.MERCATOR_E) - _c(y)) / (2 * K.MERCATOR_E) * n).cast("int")
    return F.struct(tx.alias("tx"), ty.alias("ty"))


def tile_bounds_m(tx: Num, ty: Num, zoom: Num) -> Column:
    """struct(min_x, min_y, max_x, max_y) of a tile in Mercator metres."""
    size = F.lit(2 * K.MERCATOR_E) / F.pow(F.lit(2.0), _c(zoom))
    x, y = _c(tx) * size - K.MERCATOR_E, F.lit(K.MERCATOR_E) - _c(ty) * size
    return F.struct(x.alias("min_x"), (y - size).alias("min_y"), (x + size).alias("max_x"), y.alias("max_y"))


def in_domain(lat: Num, lon: Num) -> Column:
    """Inside the Mercator bounds."""
    return _c(lat).between(-K.MAX_LAT, K.MAX_LAT) & _c(lon).between(-K.MAX_LON, K.MAX_LON)
