"""A Parquet cache of normalised points, keyed by what the source looked like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone.functions.geo import in_domain
from waystone.functions.text import uri_key
from waystone.sources import commit

#: Versions of an entry's columns and of the parser that made them; entries of others are made anew.
FORMAT, PARSER = 2, 1


def fingerprint(spark: SparkSession, path: str) -> str:
    """One key for the files of path: their names, sizes and times of change; their contents are not read."""
    f = spark.read.format("binaryFile").load(path).select(F.concat_ws("|", "path", "length", "modificationTime").alias("f"))
    return f.agg(F.bit_xor(F.xxhash64("f")).alias("a"), F.sum(F.xxhash64(F.lit(1), "f").cast("decimal(38,0)")).alias("b")).select(uri_key(F.concat_ws("|", F.lit(path), "a", "b")).alias("k")).first()["k"]


def write_cache(points: DataFrame, root: str, key: str, parser: int = PARSER) -> None:
    """K2: in place of an older entry, which stays readable until the new one is whole and if the write fails."""
    commit.publish(points, f"{root}/{key}", FORMAT, parser)


def read_cache(spark: SparkSession, root: str, key: str, columns: list[str], parser: int = PARSER) -> DataFrame | None:
    """The entry, or None where there is none, another version made it, its rows aren't those that were written,
    or it lacks columns or holds points outside the domain; what is broken is removed."""
    d = commit.current(spark, f"{root}/{key}", FORMAT, parser)
    if d is None:
        return None
    if not set(columns) <= set(d.columns) or d.where(~in_domain("lat", "lon") | F.col("lat").isNull() | F.col("lon").isNull()).limit(1).count():
        commit.forget(spark, f"{root}/{key}")
        return None
    return d.select(*columns)


def load(spark: SparkSession, path: str, root: str, parse: Callable[[], DataFrame], columns: list[str], use_cache: bool = True) -> DataFrame:
    """The cached points of path if they may be used and are there, else parsed afresh and cached."""
    key = fingerprint(spark, path)
    found = read_cache(spark, root, key, columns) if use_cache else None
    if found is None:
        write_cache(parse().select(*columns), root, key)
        found = read_cache(spark, root, key, columns)
    if found is None:
        raise ValueError(f"no usable points in {path}")
    return found
