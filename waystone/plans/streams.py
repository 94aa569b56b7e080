"""Queries that replay the driver's tables as streams and give what the stream has settled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.plans import sql
from waystone.plans.adapters import export_segments, points, raw_points, shared_folder
from waystone.plans.queries import ORACLES, query
from waystone.sources import exports
from waystone.streaming import sessions
from waystone.streaming.ordered import drained, replay
from waystone.streaming.reconciled import settled, stream_reconciled


@query("z3_stream_outliers", f"{sql.OUTLIERS} SELECT traveler_id, seq FROM nb ANTI JOIN gone USING (traveler_id, i)")
def z3_outliers(s: SparkSession, d: str) -> DataFrame:
    """Z3, Z4 with W9."""
    p = points(s, d).select("traveler_id", "seq", "t_ms", "lat", "lon")
    stream, late = replay(p, shared_folder(s), K.EXCURSION_MS)
    return drained(sessions.stream_outlier_filter(stream, late=late), shared_folder(s)).select("traveler_id", "seq")


@query("z3_stream_clean", f"{sql.STATIONARY} SELECT traveler_id, seq, t_ms, lat, accuracy_m::DOUBLE AS accuracy_m FROM kept")
def z3_clean(s: SparkSession, d: str) -> DataFrame:
    """Z3, Z4 with P16, W10 and W11. The accuracy limit is applied first, so that the row that ends the stream passes."""
    stream, late = replay(raw_points(s, d).where(F.col("accuracy_m") <= K.ACCURACY_M), shared_folder(s), K.SPIKE_MS + K.STATIONARY_MS)
    out = drained(sessions.stream_clean_raw(stream.fillna(0.0, ["accuracy_m"]), late=late), shared_folder(s))
    return out.select("traveler_id", "seq", "t_ms", "lat", "accuracy_m")


@query("z1_stream_reconcile", ORACLES["s1_scan_timeline_json"])
def z1_reconcile(s: SparkSession, d: str) -> DataFrame:
    """Z1 with J1, A9 and A11: every user's export, an element a row, as a stream of files."""
    folder = f"{shared_folder(s)}/elements-{uuid.uuid4().hex}"
    elements = export_segments(s, d)
    elements.write.parquet(folder)
    stream = s.readStream.schema(elements.schema).option("maxBytesPerTrigger", 1 << 30).parquet(folder)
    changes = stream_reconciled(exports.flatten_segments(exports.parse_elements(stream)))
    return settled(drained(changes, shared_folder(s))).select("source", F.unix_millis("ts").alias("t_ms"), "lat", "lon")
