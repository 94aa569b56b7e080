"""Remaining time of an export from its progress log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, LEAST, OBSERVED_MS, STABLE = 6, 5, 8_000, 0.15


def eta_remaining(log: DataFrame, key: str = "job") -> DataFrame:
    """Log (key, n, elapsed_ms, completed, total) with remaining_s.

    A phase starts anew when the total changes, time or progress falls back, or progress is none or all; a repeated
    count keeps the last estimate. Six samples at most, five at least, over eight seconds or more, all rates within
    15 % of the (upper) median.
    """
    w = Window.partitionBy(key).orderBy("n")
    live = (F.col("total") > 0) & (F.col("completed") > 0) & (F.col("completed") < F.col("total"))
    prev = lambda c: F.lag(c).over(w)
    d = log.withColumn("live", live)
    fresh = ~prev("live") | prev("live").isNull() | (prev("total") != F.col("total")) | (F.col("elapsed_ms") < prev("elapsed_ms")) | (F.col("completed") < prev("completed"))
    d = d.withColumn("fresh", F.col("live") & fresh).withColumn("phase", F.sum(F.when(F.col("fresh") | ~F.col("live"), 1).otherwise(0)).over(w))
    in_phase = Window.partitionBy(key, "phase").orderBy("n")
    d = d.withColumn("repeat", F.col("live") & ~F.col("fresh") & (F.lag("completed").over(in_phase) == F.col("completed")))
    s = d.where("live AND NOT repeat")
    s = s.withColumn("began", F.min("elapsed_ms").over(in_phase)).withColumn("last", F.collect_list(F.struct("elapsed_ms", "completed")).over(in_phase.rowsBetween(1 - WINDOW, 0)))
    pairs = F.zip_with(F.slice("last", 1, F.size("last") - 1), F.slice("last", 2, F.size("last")), lambda a, b: F.when((b["elapsed_ms"] > a["elapsed_ms"]) & (b["completed"] > a["completed"]), (b["completed"] - a["completed"]) / (b["elapsed_ms"] - a["elapsed_ms"])))
    s = s.withColumn("rates", F.when(F.size("last") >= LEAST, pairs))
    median = F.get(F.array_sort("rates"), F.floor(F.size("rates") / 2).cast("int"))
    steady = F.forall("rates", lambda r: r.isNotNull()) & F.forall("rates", lambda r: F.abs(r - median) / median <= STABLE)
    first, final = F.get("last", F.lit(0)), F.element_at("last", -1)
    rate = (final["completed"] - first["completed"]) / F.nullif(final["elapsed_ms"] - first["elapsed_ms"], F.lit(0))
    left = F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("completed")) / F.nullif(rate, F.lit(0.0)) / 1000.0))
    s = s.select(key, "n", F.when((F.size("last") >= LEAST) & (F.col("elapsed_ms") - F.col("began") >= OBSERVED_MS) & steady, left).cast("long").alias("estimate"))
    d = d.join(s, [key, "n"], "left").withColumn("said", F.when(F.col("live") & ~F.col("repeat"), F.struct("estimate")))
    carried = F.last("said", ignorenulls=True).over(in_phase.rowsBetween(Window.unboundedPreceding, 0))["estimate"]
    return d.select(*log.columns, F.when(F.col("live"), carried).alias("remaining_s"))
