"""Structured Streaming forms of the trajectory operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.operators.clean import _Excursions, _Spikes, _Stationary, filter_accuracy
from waystone.sources.exports import flatten_segments, parse_documents, segment_points
from waystone.streaming.ordered import stream_fold


def stream_exports(spark: SparkSession, path: str) -> DataFrame:
    """Points of exports as their files arrive in a folder, a whole document a row."""
    d = spark.readStream.option("wholetext", True).text(path)
    d = d.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return segment_points(flatten_segments(parse_documents(d)))


def stream_sessions(points: DataFrame, key: str = "traveler_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Key, st, en, n of runs of points without a gap of over 30 minutes; points later than that are dropped."""
    d = points.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s"))
    return d.agg(F.min(ts).alias("st"), F.max(ts).alias("en"), F.count("*").alias("n")).select(key, "st", "en", "n")


def stream_days(points: DataFrame, key: str = "traveler_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Points per traveller and day as they come."""
    return points.withWatermark(ts, late).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("day"), "n")


def stream_spike_filter(raw: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), late: str = "1 hour") -> DataFrame:
    """W10 over a stream in any order; see stream_fold for lateness and state, here as below."""
    return stream_fold(raw, [_Spikes], key, list(order), late)


def stream_outlier_filter(points: DataFrame, mode: str = "conservative", key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), late: str = "1 hour") -> DataFrame:
    """W9 over a stream in any order; mode off changes nothing."""
    return points if mode == "off" else stream_fold(points, [_Excursions], key, list(order), late)


def stream_stationary_collapse(raw: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), late: str = "1 hour") -> DataFrame:
    """W11 over a stream in any order."""
    return stream_fold(raw, [_Stationary], key, list(order), late)


def stream_clean_raw(raw: DataFrame, most: float | None = K.ACCURACY_M, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), late: str = "1 hour") -> DataFrame:
    """clean_raw over a stream in any order: the accuracy limit, then spikes and stationary noise in one state."""
    return stream_fold(filter_accuracy(raw, most), [_Spikes, _Stationary], key, list(order), late)
