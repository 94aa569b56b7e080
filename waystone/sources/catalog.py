"""Small catalog tables: video records, presets, settings, export requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions.text import normalise_preset_name
from waystone.sources import commit

RECORD = "uri string, title string, fileName string, createdAtMillis bigint, durationSeconds int, year int, startYear int, startMonth int, endYear int, endMonth int"
PRESET = "id string, name string, movement string, aspect string, detection string, framing string, pacing string"


def read_records(texts: DataFrame, column: str = "text") -> DataFrame:
    """Video records of JSON arrays: without uri they are dropped, titles fall back to the file's stem, years to
    the single year of old records. Bad JSON holds none."""
    items = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    d = texts.select(F.explode(items).alias("v"))
    d = d.select(F.from_json(F.to_json("v"), RECORD).alias("r")).select("r.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    year = lambda *c: F.coalesce(*[F.when(F.col(x) > 0, F.col(x)) for x in c])
    name = F.coalesce(blank("fileName"), F.lit("video.mp4"))
    return d.where(blank("uri").isNotNull()).select(
        "uri", F.coalesce(blank("title"), F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), name.alias("file_name"), F.coalesce("createdAtMillis", F.lit(0)).alias("created_ms"),
        F.greatest(F.lit(0), F.coalesce("durationSeconds", F.lit(0))).alias("duration_s"), year("startYear", "year").alias("start_year"), year("startMonth").alias("start_month"),
        year("endYear", "startYear", "year").alias("end_year"), year("endMonth").alias("end_month"),
    )


def upsert(catalog: DataFrame, new: DataFrame, key: str = "uri") -> DataFrame:
    """K4: new rows in place of those of the same key."""
    return catalog.join(new.select(key), key, "left_anti").unionByName(new)


def remove(catalog: DataFrame, gone: DataFrame, key: str = "uri") -> DataFrame:
    """Without the rows of these keys."""
    return catalog.join(gone.select(key), key, "left_anti")


def newest_first(catalog: DataFrame) -> DataFrame:
    """O6."""
    return catalog.orderBy(F.desc("created_ms"), "uri")


def available_names(names: DataFrame, column: str = "name", order: str = "n") -> DataFrame:
    """K6: names with file, where the second of a name gets (2), the third (3) and so on."""
    k = F.row_number().over(Window.partitionBy(column).orderBy(order))
    return names.withColumn("file", F.concat(F.col(column), F.when(k == 1, "").otherwise(F.concat(F.lit(" ("), k, F.lit(")"))), F.lit(".mp4")))


def read_presets(texts: DataFrame, column: str = "text", most: int = 50) -> DataFrame:
    """Presets of JSON arrays of up to 64 KiB; invalid rows are skipped, names unique in any case, 50 at most."""
    items = F.try_variant_get(F.try_parse_json(F.when(F.octet_length(column) <= 65_536, F.col(column))), "$", "array<variant>")
    d = texts.select(F.posexplode(items).alias("i", "v")).select("i", F.from_json(F.to_json("v"), PRESET).alias("p")).select("i", "p.*")
    d = d.withColumn("name", normalise_preset_name(F.col("name"))).where("id IS NOT NULL AND name IS NOT NULL")
    d = d.withColumn("k", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("i"))).where("k = 1")
    return d.orderBy("i").limit(most).drop("k", "i")


def settings(stored: DataFrame, allowed: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Key, value: what is stored (key, value) if allowed, else the default."""
    spark = stored.sparkSession
    base = spark.createDataFrame([(k, d, v) for k, (v, d) in allowed.items()], "key string, fallback string, allowed array<string>")
    s = stored.groupBy("key").agg(F.max("value").alias("value"))
    value: Column = F.when(F.array_contains("allowed", F.col("value")), F.col("value")).otherwise(F.col("fallback"))
    return base.join(s, "key", "left").select("key", value.alias("value"))


def add_preset(presets: DataFrame, new: DataFrame, most: int = 50) -> DataFrame:
    """K7: presets (id, name, …) with new ones whose names are valid and not taken in any case, up to so many in all.

    Of new rows with one name the least id is taken; new rows come in the order of their ids.
    """
    n = new.withColumn("name", normalise_preset_name(F.col("name"))).where("name IS NOT NULL").withColumn("__low", F.lower("name"))
    n = n.withColumn("__k", F.row_number().over(Window.partitionBy("__low").orderBy("id"))).where("__k = 1")
    n = n.join(presets.select(F.lower("name").alias("__low")), "__low", "left_anti").drop("__low", "__k")
    room = presets.agg(F.greatest(F.lit(0), most - F.count("*")).alias("__room"))
    n = n.withColumn("__k", F.row_number().over(Window.orderBy("id"))).where(f"__k <= {most}").join(F.broadcast(room), F.col("__k") <= F.col("__room"))
    return presets.unionByName(n.select(*presets.columns))


def rename_preset(presets: DataFrame, renames: DataFrame) -> DataFrame:
    """K7: presets with the names of renames (id, name) that are valid and not another preset's in any case."""
    r = renames.groupBy("id").agg(F.max("name").alias("name")).select("id", normalise_preset_name(F.col("name")).alias("__new")).where("__new IS NOT NULL")
    taken = presets.select(F.lower("name").alias("__low"), F.col("id").alias("__id"))
    r = r.join(taken, (F.lower("__new") == F.col("__low")) & (F.col("id") != F.col("__id")), "left_anti")
    return presets.join(r, "id", "left").withColumn("name", F.coalesce("__new", "name")).select(*presets.columns)


def default_preset(presets: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored default (id) while a preset of that id is left; else no row."""
    return stored.join(presets.select("id"), "id", "left_semi")


def stale_files(files: DataFrame, now_ms: int, age_ms: int = K.STALE_MS) -> DataFrame:
    """K8: the files (path, modified_ms) of an overview cache that are older than seven days, to be deleted."""
    return files.where(F.col("modified_ms") < now_ms - age_ms)


def current_source(log: DataFrame, key: str = "user_id", order: str = "n") -> DataFrame:
    """Key, uri, interrupted of a log (key, order, event begin or complete, uri) of imports.

    The last completed import is the source; one that began later and never ended is interrupted and is forgotten.
    """
    at = lambda event: F.max(F.when(F.col("event") == event, F.col(order)))
    uri = F.max_by("uri", F.when(F.col("event") == "complete", F.col(order)))
    d = log.groupBy(key).agg(at("begin").alias("__b"), at("complete").alias("__c"), uri.alias("__uri"))
    return d.select(key, F.when(F.col("__c").isNotNull(), F.col("__uri")).alias("uri"), F.coalesce(F.col("__b") > F.coalesce("__c", F.lit(-1)), F.lit(False)).alias("interrupted"))


def read_export_requests(stored: DataFrame) -> DataFrame:
    """Export requests of file versions 1 to 8 as today's settings; others are dropped.

    stored has id, version, start_year, start_month, end_year, end_month, movement, pacing, detection, framing,
    framing_on, scale and points. Version 1 ends in the year it starts, distance scales come with version 5, camera
    settings with 4 (pacing alone with 3), detection and framing with 7, where framing had a switch. Names that are
    unknown fall back to the defaults; at most 2,000,000 points count.
    """
    v = F.col("version")
    known = lambda c, names, fallback, since: F.when((v >= since) & F.col(c).isin(*names), F.col(c)).otherwise(fallback)
    framing = F.when((v >= 8) | ((v == 7) & F.coalesce("framing_on", F.lit(False))), known("framing", K.FRAMING, "balanced", 7)).otherwise("off")
    return stored.where(v.between(1, K.REQUEST_VERSION)).select(
        "id", "start_year", "start_month", F.when(v == 1, F.col("start_year")).otherwise(F.col("end_year")).alias("end_year"), "end_month",
        known("movement", K.MOVEMENTS, "steady", 4).alias("movement"), known("pacing", K.PACING, "balanced", 3).alias("pacing"), known("detection", K.DETECTION, "balanced", 7).alias("detection"),
        framing.alias("framing"), F.when(v >= 5, F.col("scale")).otherwise(1.0).alias("scale"), F.greatest(F.lit(0), F.least(F.lit(K.REQUEST_POINTS), F.col("points"))).alias("points"),
    )


def write_export_requests(requests: DataFrame, path: str) -> None:
    """K3: requests as today's version, in place of what is there; a write that fails leaves the old ones."""
    commit.publish(requests.withColumn("version", F.lit(K.REQUEST_VERSION)), path)


def stored_export_requests(spark: SparkSession, path: str) -> DataFrame | None:
    """The requests that were written last, as read_export_requests gives them; None where there are none."""
    d = commit.current(spark, path)
    return None if d is None else read_export_requests(d)


#: Keys of settings that are read once more and then removed.
OBSOLETE = ("zoom_in_travel_slowdown", "zoom_in_movement_reduction", "episode_framing_enabled", "route_context", "local_framing", "zoom_in", "long_hop")


def migrate_framing(stored: DataFrame, user: str = "user_id") -> DataFrame:
    """User, framing of settings (user, key, value): an old switch decides first, then the stored name; without
    either, off for those with camera settings from before framing, else balanced."""
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    d = stored.groupBy(user).agg(of("episode_framing_enabled").alias("switch"), of("framing").alias("name"), F.bool_or(F.col("key").isin("movement", "pacing", "quality")).alias("older"))
    switched = F.when(F.col("switch") != "true", "off").otherwise(F.when(F.col("name") == "close", "close").otherwise("balanced"))
    plain = F.when(F.col("name").isin(*K.FRAMING), F.col("name")).when(F.col("older"), "off").otherwise("balanced")
    return d.select(user, F.when(F.col("switch").isNotNull(), switched).otherwise(plain).alias("framing"))


def write_settings(stored: DataFrame, new: DataFrame, user: str = "user_id") -> DataFrame:
    """K9: settings (user, key, value) with new ones in place of old, obsolete keys removed. A reset is no row at all."""
    old = stored.join(new.select(user, "key"), [user, "key"], "left_anti")
    return old.unionByName(new).where(~F.col("key").isin(*OBSOLETE))
