"""Exact medians of keys with any number of values, by counting in ranges instead of holding a key's values (A3, A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a pass cuts a key's values into, and passes; what is left then is counted value by value.
RANGES, PASSES = 4096, 2


def exact_medians(values: DataFrame, key: str, value: str, name: str = "median", ranges: int = RANGES, passes: int = PASSES) -> DataFrame:
    """key, name of values (key, value: double): F.median's result to the last bit; nulls don't count.

    A pass counts a key's values in equal ranges between two bounds and keeps, for each of the two middle ranks, the
    range that holds it, with its least and greatest value as the next bounds. Counts are summed before they are
    shuffled, at most ranges rows a key and task. After the passes only values of one narrow range a rank are left,
    which are counted by value. So no task holds a key's values; each pass reads values once more. The join that brings
    bounds to values has a large side that adaptive execution may split where a key is hot.
    """
    v = values.select(F.col(key).alias("__k"), F.col(value).cast("double").alias("__v")).where("__k IS NOT NULL AND __v IS NOT NULL")
    n = v.groupBy("__k").agg(F.count("*").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    middle = F.array(F.floor((F.col("__n") - 1) / 2), F.ceil((F.col("__n") - 1) / 2))
    at = n.select("__k", "lo", "hi", F.posexplode(middle).alias("which", "rank"))
    for _ in range(passes):
        wide = F.col("hi") - F.col("lo")
        part = F.when((wide > 0) & (wide < float("inf")), F.floor((F.col("__v") - F.col("lo")) / wide * ranges)).otherwise(0)
        at = _narrowed(v, at, part)
    found = _narrowed(v, at, F.col("__v")).groupBy("__k").agg(F.min("lo").alias("a"), F.max("lo").alias("b"))
    both = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(0.5) * F.col("a") + F.lit(0.5) * F.col("b"))
    return found.select(F.col("__k").alias(key), both.alias(name))


def _narrowed(v: DataFrame, at: DataFrame, part: Column) -> DataFrame:
    """at (__k, which, rank, lo, hi) with the bounds of the part that holds the rank, and the rank in it."""
    d = v.join(at, "__k").where(F.col("__v").between(F.col("lo"), F.col("hi")))
    g = d.groupBy("__k", "which", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__k", "which").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    return g.select("__k", "which", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi")
