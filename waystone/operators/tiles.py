"""Map-tile sets of viewports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions.geo import clamp


def required_tiles(views: DataFrame, *keep: str) -> DataFrame:
    """Keep, zoom, x, y, world_x of every tile under views (min_x, max_x, min_y, max_y, zoom).

    x wraps round the world, world_x doesn't; y is cut to it.
    """
    n = F.pow(F.lit(2.0), F.col("zoom"))
    floor = lambda c: F.floor(F.col(c) * n).cast("long")
    y = lambda c: clamp(F.floor(F.col(c) * n), 0.0, n - 1).cast("long")
    d = views.select(*keep, "zoom", n.cast("long").alias("n"), F.explode(F.sequence(floor("min_x"), floor("max_x"))).alias("world_x"), y("min_y").alias("y0"), y("max_y").alias("y1"))
    d = d.select(*keep, "zoom", "n", "world_x", F.explode(F.sequence("y0", "y1")).alias("y"))
    return d.select(*keep, "zoom", F.pmod("world_x", "n").alias("x"), "y", "world_x")


def tiles_for_export(frames: DataFrame, overview: DataFrame, key: str = "traveler_id") -> DataFrame:
    """Key, zoom, x, y of all tiles that any frame or the overview needs, each once."""
    t = required_tiles(frames, key).unionByName(required_tiles(overview, key))
    return t.select(key, "zoom", "x", "y").distinct()


def missing_tiles(required: DataFrame, available: DataFrame) -> DataFrame:
    """Required tiles that aren't available; none means that an export may start."""
    return required.join(available.select("zoom", "x", "y"), ["zoom", "x", "y"], "left_anti")


def map_plan(views: DataFrame, px: int, *keep: str) -> DataFrame:
    """Keep, zoom and tile range of views (cx, cy, span in Mercator metres): the level that fits px, stepped down
    while it takes more than 25 tiles."""
    level = clamp(F.floor(F.log2(F.lit(2 * K.MERCATOR_E * px) / (F.greatest(F.lit(1.0), F.col("span")) * K.TILE_PX))), K.ZOOM_LOW, K.ZOOM_HIGH).cast("int")

    def at(z: Column) -> tuple[Column, ...]:
        n = F.pow(F.lit(2.0), z)
        half = F.col("span") / 2
        x = lambda m: ((m + K.MERCATOR_E) / (2 * K.MERCATOR_E) * n).cast("int")
        y = lambda m: ((F.lit(K.MERCATOR_E) - m) / (2 * K.MERCATOR_E) * n).cast("int")
        return x(F.col("cx") - half), x(F.col("cx") + half), y(F.col("cy") + half), y(F.col("cy") - half)

    def count(z: Column) -> Column:
        x0, x1, y0, y1 = at(z)
        return (x1 - x0 + 1) * (y1 - y0 + 1)

    fits = F.filter(F.sequence(F.lit(K.ZOOM_LOW), level), lambda z: count(z) <= K.TILES_MOST)
    d = views.withColumn("zoom", F.coalesce(F.array_max(fits), F.lit(K.ZOOM_LOW)))
    x0, x1, y0, y1 = at(F.col("zoom"))
    return d.select(*keep, "zoom", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


def tile_key(zoom: str = "zoom", x: str = "x", y: str = "y") -> Column:
    """X20."""
    return F.concat_ws("/", zoom, x, y)


def tile_url(template: str, zoom: Column, x: Column, y: Column) -> Column:
    """The address of a tile from a template with {z}, {x} and {y}."""
    out = F.lit(template)
    for name, value in (("{z}", zoom), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def tiles_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: the distinct tiles (zoom, x, y) of both."""
    return a.select("zoom", "x", "y").intersect(b.select("zoom", "x", "y"))
