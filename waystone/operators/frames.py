"""Frame tables of an animation and what is drawn on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions.geo import clamp, unwrap_near, world_x, world_y
from waystone.operators import lookup, pacing
from waystone.operators.folds import Fold, fold_sorted


def frame_counts(duration_s: float, fps: int) -> tuple[int, int]:
    """(journey frames, outro frames)."""
    return max(1, int(duration_s * fps)), int(K.OUTRO_S * fps)


def frame_table(spark: SparkSession, duration_s: float, fps: int) -> DataFrame:
    """Frame, journey_progress, outro_progress: the journey's frames, then the outro's, whose move takes a second."""
    n, m = frame_counts(duration_s, fps)
    d = spark.range(n + m).select(F.col("id").cast("int").alias("frame"))
    journey = F.when(F.col("frame") < n, lookup.progress(F.lit(n), F.col("frame"))).otherwise(1.0)
    outro = F.when(F.col("frame") < n, 0.0).otherwise(clamp((F.col("frame") - n + 1) / (K.OUTRO_TRANSITION_S * fps), 0.0, 1.0))
    return d.select("frame", journey.alias("journey_progress"), outro.alias("outro_progress"))


def frame_positions(frames: DataFrame, h: DataFrame, totals: DataFrame, curve: DataFrame | None, key: str = "traveler_id") -> DataFrame:
    """Key, frame, d, lat, lon, x, y, at_ms, index: where every journey's marker stands on each frame.

    A frame table doesn't grow with the data, so it is what is broadcast.
    """
    p = totals.where("available").select(key).join(F.broadcast(frames.select("frame", F.col("journey_progress").alias("p"))))
    d = pacing.distance_at(p, curve if curve is not None else h, totals, linear=curve is None, key=key)
    d = lookup.positions_at(d, h, "d", key)
    return d.select(key, "frame", "d", "lat", "lon", world_x("lon").alias("x"), world_y("lat").alias("y"), "at_ms", "index")


def trail_km(total: Column, duration_s: float) -> Column:
    """Length of the trail: what 2.5 seconds cover, 80 to 2,000 km, no longer than the journey."""
    return F.least(total, clamp(total * (K.TRAIL_S / duration_s), K.TRAIL_LOW_KM, K.TRAIL_HIGH_KM))


def trail_bands(positions: DataFrame, totals: DataFrame, duration_s: float, key: str = "traveler_id") -> DataFrame:
    """Positions (d) with band 1..3, from_km, to_km of the trail behind each: its last 45 %, to 75 %, the rest."""
    d = positions.join(totals.select(key, "total_km"), key).withColumn("__t", trail_km(F.col("total_km"), duration_s))
    cut = [(1, 0.0, 0.45), (2, 0.45, 0.75), (3, 0.75, 1.0)]
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.greatest(F.lit(0.0), F.col("d") - F.col("__t") * hi).alias("from_km"), F.greatest(F.lit(0.0), F.col("d") - F.col("__t") * lo).alias("to_km")) for b, lo, hi in cut])
    return d.select(*positions.columns, F.explode(bands).alias("b")).select(*positions.columns, "b.band", "b.from_km", "b.to_km")


def trail_points(bands: DataFrame, h: DataFrame, key: str = "traveler_id", tie: str = "i", width: float | None = None) -> DataFrame:
    """A row for each point that a band of trail_bands holds: its columns and the point's number i, from 0.

    A band has the points from from_km up to, but without, to_km; the first one, at whose end the marker stands, that
    place too; places count in whole millimetres, lest the last digit of a sum decide. Both ends are found by as-of joins
    on how many points lie before a place, so points are never compared with bands; rows are as many as the points drawn.
    """
    mm = lambda c: F.round(c, 6)
    r = lookup.ranked(h.withColumn("cum_km", mm("cum_km")), key).select(key, "cum_km", tie, "below", "upto")
    n = r.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    at = lambda d, place, name, later: lookup.as_of(d, r, key, place, "cum_km", tie, ["below", "upto"], later, width).withColumn(name, F.col("knot.below" if later else "knot.upto")).drop("knot")
    d = bands.withColumn("__from", mm("from_km")).withColumn("__to", mm("to_km"))
    d = at(at(d, "__from", "__lo", True), "__to", "__hi", True)
    d = at(d, "__to", "__in", False).join(n, F.col(key) == F.col("__k"))
    low = F.coalesce("__lo", "__n")
    high = F.when(F.col("band") == 1, F.coalesce("__in", F.lit(0))).otherwise(F.coalesce("__hi", "__n"))
    some = F.when(high > low, F.sequence(low, high - 1))
    return d.select(*bands.columns, F.explode(some).alias(tie))


def world_to_screen(x: Column, y: Column, min_x: Column, max_x: Column, min_y: Column, max_y: Column, width: int, height: int) -> Column:
    """struct(sx, sy): pixels of a world point on the copy of the world nearest to the view's middle."""
    near = unwrap_near(x, (min_x + max_x) / 2)
    return F.struct(((near - min_x) / (max_x - min_x) * width).alias("sx"), ((y - min_y) / (max_y - min_y) * height).alias("sy"))


def video_formats(spark: SparkSession) -> DataFrame:
    """Aspect, resolution, width, height, fps, bit_rate, with T16's overlay scale."""
    d = spark.createDataFrame(list(K.FORMATS), "aspect string, resolution string, width int, height int, fps int, bit_rate int")
    return d.withColumn("overlay_scale", overlay_scale(F.col("width"), F.col("height")))


def overlay_scale(width: Column, height: Column) -> Column:
    """Pixels of one unit of the overlay's grid."""
    return F.least(width, height) / float(K.OVERLAY_EDGE)


def overlay_card(width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom, width, center_x): where the overlay's card stands on a picture, in pixels.

    It is centred and as wide as the grid's edge allows, also on a picture wider than it is high.
    """
    unit = overlay_scale(width, height)
    half = (F.least(width, unit * K.OVERLAY_EDGE) - unit * 2 * K.CARD_INSET) / 2
    mid = width / 2
    return F.struct((mid - half).alias("left"), (unit * K.CARD_TOP).alias("top"), (mid + half).alias("right"), (unit * K.CARD_BOTTOM).alias("bottom"), (half * 2).alias("width"), mid.alias("center_x"))


def export_fraction(phase: Column, done: Column) -> Column:
    """Overall progress of a phase's own: a tenth for the map, eight for the journey, one for finishing."""
    return F.when(phase == "map", clamp(done, 0.0, 1.0) * 0.1).when(phase == "journey", clamp(done, 0.0, 1.0) * 0.8 + 0.1).otherwise(clamp(done, 0.0, 1.0) * 0.1 + 0.9)


def preview_size(width: Column, height: Column, aspect: Column) -> Column:
    """struct(width, height): the largest of the aspect that fits; a bad aspect counts as 1, sides are at least 1."""
    w, h = (F.greatest(F.lit(1), x) for x in (width, height))
    a = F.when((aspect > 0) & (aspect < float("inf")), aspect).otherwise(1.0)
    tall = F.greatest(F.lit(1), F.floor(w / a + 0.5).cast("int"))
    wide = F.greatest(F.lit(1), F.least(w, F.floor(h * a + 0.5).cast("int")))
    return F.struct(F.when(tall > h, wide).otherwise(w).alias("width"), F.least(tall, h).alias("height"))


def preview_canvas_size(width: Column, height: Column, css_width: Column, ratio: Column) -> Column:
    """struct(width, height) of a canvas for a device, no larger than the format, its short edge 240 at least."""
    device = F.when((css_width > 0) & (css_width < float("inf")), css_width * F.when((ratio > 0) & (ratio < float("inf")), ratio).otherwise(1.0)).otherwise(width)
    scale = F.least(F.lit(1.0), F.greatest(F.least(F.lit(1.0), K.PREVIEW_EDGE / F.least(width, height)), device / width))
    return F.struct(F.floor(width * scale + 0.5).cast("int").alias("width"), F.floor(height * scale + 0.5).cast("int").alias("height"))


def overview_size(width: Column, height: Column) -> Column:
    """struct(width, height) of an overview picture: 1080 on the longer side, the other one even."""
    side = lambda a, b: F.floor(K.OVERVIEW_EDGE * a / b).cast("int")
    even = lambda n: F.greatest(F.lit(1), n) + F.greatest(F.lit(1), n) % 2
    return F.struct(F.when(width >= height, K.OVERVIEW_EDGE).otherwise(even(side(width, height))).alias("width"), F.when(height >= width, K.OVERVIEW_EDGE).otherwise(even(side(height, width))).alias("height"))


class _Drawn(Fold):
    """The last point drawn; arrays, one take for each run of rows."""

    def __init__(self) -> None:
        self.last: tuple[float, float] | None = None

    def feed(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        keep, last = [], self.last
        for i, (x, y) in enumerate(zip(rows["sx"].to_numpy(), rows["sy"].to_numpy(), strict=True)):
            if last is None or (x - last[0]) ** 2 + (y - last[1]) ** 2 >= K.DRAWN_PX**2:
                last = x, y
                keep.append(i)
        self.last = last
        return [rows.take(keep)] if keep else []


def pixel_decimate(screen: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("i",)) -> DataFrame:
    """The rows (sx, sy) that lie 1.35 pixels or more from the last one kept; a key's first stays."""
    return fold_sorted(screen, key, list(order), _Drawn, screen.schema)
