"""Running values of a key whose rows are dealt out over slices: windows inside a slice, one carried row a slice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NO: Mapping[str, Column] = {}


def scan(
    df: DataFrame,
    key: str,
    order: list[str | Column],
    slice: Column | None = None,
    *,
    sums: Mapping[str, Column] = _NO,
    lasts: Mapping[str, Column] = _NO,
    maxima: Mapping[str, Column] = _NO,
    lags: Mapping[str, Column] = _NO,
) -> DataFrame:
    """df with running values of each key in order: sums, last values that aren't null and maxima up to a row, it
    included, and lags, the values of the row before.

    Without slice these are plain windows, and a key is one task's. With slice (a value that doesn't fall in that
    order, whose columns are plain, without desc) windows run inside a slice of a key, each slice gives one row of totals, a window over those alone gives
    what comes before a slice, and the two are put together: no task holds more of a key than a slice. Rows of a null
    key are one key's; ties in order fall as they may, as in any window. Sums of doubles may differ in the last digits.
    A sliced scan reads df twice: write or checkpoint what is dear before several of them follow one another.
    """
    columns = {**sums, **lasts, **maxima, **lags}
    if slice is None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumns(_local(w, sums, lasts, maxima, lags))
    d = df.withColumn("__slice", slice)
    w = Window.partitionBy(key, "__slice").orderBy(*order)
    d = d.withColumn("__first", F.row_number().over(w) == 1) if lags else d
    local = d.withColumns({f"__l_{n}": c for n, c in _local(w, sums, lasts, maxima, lags).items()})
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    totals = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max(c).alias(n) for n, c in maxima.items()]
    totals += [F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in lasts.items()] + [F.max_by(c, place).alias(n) for n, c in lags.items()]
    g = d.groupBy(F.col(key).alias("__k"), F.col("__slice").alias("__s")).agg(*totals)
    across = Window.partitionBy("__k").orderBy("__s")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(n).over(before).alias(f"__c_{n}") for n in sums] + [F.max(n).over(before).alias(f"__c_{n}") for n in maxima]
    carried += [F.last(n, ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts] + [F.lag(n).over(across).alias(f"__c_{n}") for n in lags]
    g = g.select("__k", "__s", *carried)
    d = local.join(g, F.col(key).eqNullSafe(F.col("__k")) & F.col("__slice").eqNullSafe(F.col("__s")))
    both = lambda n: (F.col(f"__l_{n}"), F.col(f"__c_{n}"))
    out = {}
    for n in columns:
        here, carry = both(n)
        if n in sums:
            out[n] = F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
        elif n in maxima:
            out[n] = F.greatest(here, carry)
        elif n in lasts:
            out[n] = F.coalesce(here, carry)
        else:
            out[n] = F.when(F.col("__first"), carry).otherwise(here)
    return d.withColumns(out).drop("__slice", "__k", "__s", "__first", *[f"__{s}_{n}" for s in "lc" for n in columns])


def _local(w, sums: Mapping[str, Column], lasts: Mapping[str, Column], maxima: Mapping[str, Column], lags: Mapping[str, Column]) -> dict[str, Column]:
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.sum(c).over(upto) for n, c in sums.items()} | {n: F.max(c).over(upto) for n, c in maxima.items()}
    return out | {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()} | {n: F.lag(c).over(w) for n, c in lags.items()}


def time_slice(slice_ms: int | None, ms: str = "t_ms") -> Column | None:
    """Slices of so many milliseconds, for scan; None for none."""
    return None if slice_ms is None else F.floor(F.col(ms) / slice_ms)


def place_slice(width: float | None, at: str, down: bool = False) -> Column | None:
    """Slices of a width along a place, for scan; down where rows go from high places to low ones."""
    if width is None:
        return None
    s = F.floor(F.col(at) / width)
    return -s if down else s
