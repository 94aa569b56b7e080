"""Column functions that read the loosely typed leaves of exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions.geo import let

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})?$"
ZONE = r"([Zz]|[+-]\d{2}:?\d{2})$"


def parse_number(s: Column) -> Column:
    """A finite decimal number, or null."""
    return let(F.trim(s.cast("string")), lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))


def parse_coordinate(s: Column) -> Column:
    """struct(lat, lon) of "lat, lon", "geo:lat,lon?…", degree signs or E7 integers; null if it is none or outside."""

    def scaled(c: Column) -> Column:
        by = F.when((F.abs(c["lat"]) > 1e6) | (F.abs(c["lon"]) > 1e6), F.lit(1e7)).otherwise(F.lit(1.0))
        return F.struct((c["lat"] / by).alias("lat"), (c["lon"] / by).alias("lon"))

    def inside(c: Column) -> Column:
        return F.when(c["lat"].between(-K.MAX_LAT, K.MAX_LAT) & c["lon"].between(-K.MAX_LON, K.MAX_LON), c)

    parts = F.split(F.translate(F.substring_index(F.regexp_replace(F.trim(s), "^geo:", ""), "?", 1), "° ", ""), ",")
    both = let(parts, lambda p: F.struct(parse_number(F.get(p, F.lit(0))).alias("lat"), parse_number(F.get(p, F.lit(1))).alias("lon")))
    return let(let(both, scaled), inside)


def tz_missing(s: Column) -> Column:
    """A date and time that names no zone."""
    return ~F.trim(s).rlike(ZONE)


def parse_instant(s: Column, strict: bool = False) -> Column:
    """TIMESTAMP of an ISO date and time; without a zone UTC, or null if strict. Bare dates and years are null."""

    def read(t: Column) -> Column:
        zoned = F.when(tz_missing(t), F.concat(t, F.lit("Z"))).otherwise(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"))
        zoned = F.regexp_replace(F.upper(F.translate(zoned, ",", ".")), r"T(\d{2}:\d{2})(?!:)", "T$1:00")
        ok = t.rlike(INSTANT) if not strict else t.rlike(INSTANT) & ~tz_missing(t)
        return F.when(ok, zoned.try_cast("timestamp"))

    return let(F.trim(s), read)


def parse_offset_minutes(s: Column) -> Column:
    """P5: a whole number of minutes, not negative."""
    return let(F.trim(s.cast("string")), lambda t: F.when(t.rlike(r"^\d+(\.0+)?$"), F.substring_index(t, ".", 1).try_cast("bigint")))


def offset_instant(start: Column, end: Column, offset: Column, zoned: Column | None = None) -> Column:
    """Start plus offset minutes; null when that is more than a minute past the end and both ends are zoned."""
    at = F.try_add(F.unix_millis(start), F.try_multiply(offset, F.lit(60_000).cast("bigint")))

    def kept(ms: Column) -> Column:
        late = (ms > F.unix_millis(end) + K.OFFSET_SLACK_MS) & (F.lit(True) if zoned is None else zoned)
        return F.when(ms.isNotNull() & (ms <= 253_402_300_799_000) & ~F.coalesce(late, F.lit(False)), F.timestamp_millis(ms))

    return let(at, kept)


def path_instant(time: Column, start: Column, end: Column, offset: Column, zoned: Column | None = None) -> Column:
    """The absolute time if it parses, else the offset's."""
    return F.coalesce(parse_instant(time), offset_instant(start, end, parse_offset_minutes(offset), zoned))
