"""Long-trip pacing: transfer runs, a monotone curve from progress to distance, its lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions.geo import hermite
from waystone.operators.lookup import as_of
from waystone.operators.scan import scan, time_slice


def pacing_knots(h: DataFrame, limits: DataFrame, exponent: float = K.PACING["balanced"], multiplier: float = 1.0, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), slice_ms: int | None = None) -> DataFrame:
    """Key, k, x (share of effective distance), y (km) at (0, 0) and after every hop with length.

    Neighbouring hops of the cutoff or more are one run whose weight, its km to the exponent, is shared by km; local
    hops weigh their km. A hop without length has no knot, but parts runs. With slice_ms no task holds a key: see scan;
    sums over a run and a key are aggregates joined back then.
    """
    at, by = time_slice(slice_ms), list(order)
    d = h.where("lat0 IS NOT NULL").join(limits.select(key, "threshold_km"), key)
    d = d.withColumn("far", (F.col("hop_km") >= F.greatest(F.lit(1.0), F.col("threshold_km") * multiplier)).cast("int"))
    d = scan(d, key, by, at, lags={"far0": F.col("far")})
    d = scan(d, key, by, at, sums={"run": F.when(F.col("far") == F.coalesce("far0", F.lit(0)), 0).otherwise(1)})
    d = _with_sum(d, [key, "run"], "hop_km", "run_km", at is not None)
    d = d.withColumn("weight", F.when(F.col("far") == 1, F.pow("run_km", F.lit(exponent)) * F.col("hop_km") / F.col("run_km")).otherwise(F.col("hop_km"))).where("hop_km > 0")
    d = _with_sum(scan(d, key, by, at, sums={"sum": F.col("weight"), "k": F.lit(1).cast("long")}), [key], "weight", "all", at is not None)
    k = d.select(key, "k", (F.col("sum") / F.col("all")).alias("x"), F.col("cum_km").alias("y"))
    zero = k.where("k = 1").select(key, F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return zero.unionByName(k)


def _with_sum(d: DataFrame, by: list[str], value: str, name: str, joined: bool) -> DataFrame:
    """d with the sum of value over by, by a window or, so that no task holds a group, by an aggregate joined back."""
    if not joined:
        return d.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))
    return d.join(d.groupBy(*by).agg(F.sum(value).alias(name)), by)


def pacing_curve(knots: DataFrame, key: str = "traveler_id") -> DataFrame:
    """Knots with m, monotone slopes: weighted harmonic means inside, limited three-point ones at the ends."""
    w = Window.partitionBy(key).orderBy("k")
    d = knots.withColumn("h1", F.lead("x").over(w) - F.col("x")).withColumn("d1", F.when(F.col("h1") > 0, (F.lead("y").over(w) - F.col("y")) / F.col("h1")))
    d = d.withColumn("h0", F.lag("h1").over(w)).withColumn("d0", F.lag("d1").over(w))
    d = d.withColumns({"h2": F.lead("h1").over(w), "d2": F.lead("d1").over(w), "hh": F.lag("h1", 2).over(w), "dd": F.lag("d1", 2).over(w)})
    w1, w2 = F.col("h1") * 2 + F.col("h0"), F.col("h1") + F.col("h0") * 2
    inner = F.when((F.col("d0") <= 0) | (F.col("d1") <= 0), 0.0).otherwise((w1 + w2) / (w1 / F.nullif(F.col("d0"), F.lit(0.0)) + w2 / F.nullif(F.col("d1"), F.lit(0.0))))

    def end(ha: str, hb: str, da: str, db: str):
        s = ((F.col(ha) * 2 + F.col(hb)) * F.col(da) - F.col(ha) * F.col(db)) / (F.col(ha) + F.col(hb))
        return F.when(F.col(db).isNull(), F.col(da)).otherwise(F.greatest(F.lit(0.0), F.least(F.col(da) * 3, s)))

    m = F.when(F.col("d0").isNull(), end("h1", "h2", "d1", "d2")).when(F.col("d1").isNull(), end("h0", "hh", "d0", "dd")).otherwise(inner)
    return d.select(key, "k", "x", "y", m.alias("m"))


def distance_at(probes: DataFrame, curve: DataFrame, totals: DataFrame, at: str = "p", out: str = "d", linear: bool = False, key: str = "traveler_id", width: float | None = None) -> DataFrame:
    """Probes with d, km at progress p: cubic Hermite between the knots around it, a knot's own y upon it.

    linear, or without knots, the total times p. width, a share of the progress: see as_of.
    """
    p = probes.join(totals.select(key, "total_km"), key).withColumn("__p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(at))))
    straight = F.col("total_km") * F.col("__p")
    if linear:
        return p.withColumn(out, straight).drop("__p", "total_km")
    w = Window.partitionBy(key).orderBy("k")
    c = curve.withColumns({f"{n}1": F.lead(n).over(w) for n in ("x", "y", "m")})
    d = as_of(p, c, key, "__p", "x", "k", ["x", "y", "m", "x1", "y1", "m1"], later=False, width=width)
    n = {x: F.col(f"knot.{x}") for x in ("x", "y", "m", "x1", "y1", "m1")}
    value = F.when(F.col("knot").isNull(), straight).when(n["x1"].isNull() | (F.col("__p") == n["x"]), n["y"]).otherwise(hermite(F.col("__p"), n["x"], n["x1"], n["y"], n["y1"], n["m"], n["m1"]))
    return d.withColumn(out, F.greatest(F.lit(0.0), F.least(F.col("total_km"), value))).drop("__p", "total_km", "knot")
