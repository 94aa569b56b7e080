"""Exports that come file by file, reconciled as they come (Z1 with J1, A9 and A11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waystone.streaming.ordered import pack, unpack

#: Length of the pieces of time that a history's state is split in.
BUCKET_MS = 30 * 86_400_000
#: States that the pieces of all histories are dealt to; a stream that goes on from a checkpoint needs the same number.
GROUPS = 512
_ITEM = "struct<bucket:bigint,a:bigint,b:bigint,ord:bigint,lat:double,lon:double,tz_missing:boolean,recorded:int,standalone:boolean>"
_NO_DATE = -(1 << 31)
_OUT = ["source", "ts", "lat", "lon", "tz_missing", "recorded"]


def _items(segments: DataFrame, bucket_ms: int) -> DataFrame:
    """A row for each point (b < a), in the piece of its time a, and for each interval a to b and piece that it touches."""
    wide = F.lit(bucket_ms * 1000)
    piece = lambda us: ((us - F.pmod(us, wide)) / wide).cast("long")

    def point(p: Column) -> Column:
        us = F.unix_micros(p["ts"])
        day = F.coalesce(F.unix_date(p["recorded"]), F.lit(_NO_DATE))
        return F.struct(piece(us), us, us - 1, p["ord"], p["lat"], p["lon"], p["tz_missing"], day, F.col("standalone")).cast(_ITEM)

    st, en = F.unix_micros("st"), F.unix_micros("en")
    interval = F.transform(F.sequence(piece(st), piece(en)), lambda k: F.struct(k, st, en, F.lit(0), F.lit(0), F.lit(0), F.lit(False), F.lit(0), F.lit(False)).cast(_ITEM))
    intervals = F.when(F.expr("semantic AND zoned AND en >= st"), interval).otherwise(F.array().cast(f"array<{_ITEM}>"))
    return segments.select("source", "seg_idx", F.explode(F.concat(F.transform("points", point), intervals)).alias("e")).select("source", "seg_idx", "e.*")


def _merged(iv: pd.DataFrame) -> pd.DataFrame:
    """Disjoint unions of closed intervals (a, b) of each piece (g)."""
    iv = iv.sort_values(["g", "a", "b"], ignore_index=True)
    past = iv.groupby("g")["b"].cummax().shift(fill_value=0)
    island = ((iv["g"] != iv["g"].shift()) | (iv["a"] > past)).cumsum()
    return iv.groupby(island).agg({"source": "first", "bucket": "first", "g": "first", "a": "min", "b": "max"})


def _kept(p: pd.DataFrame, iv: pd.DataFrame) -> pd.DataFrame:
    """Points with live (some later state can still show them) and wins (they are shown now), each by its piece (g)."""
    times = np.unique(iv["a"].to_numpy())
    at = lambda d: d["g"].to_numpy() * (len(times) + 1) + np.searchsorted(times, d["a"].to_numpy(), side="right")
    i = np.searchsorted(at(iv), at(p), side="right") - 1
    ends, of = np.append(iv["b"].to_numpy(), -(1 << 62)), np.append(iv["g"].to_numpy(), -1)  # the last one stands for no interval
    loose = p["standalone"].astype(bool) & ~p["tz_missing"].astype(bool)
    covered = (of[i] == p["g"].to_numpy()) & (ends[i] >= p["a"].to_numpy())
    p = p.assign(hidden=loose & covered, late=p["standalone"].astype(int), after=np.where(p["standalone"].astype(bool), p["a"], 0), ms=p["a"] // 1000)
    p = p.sort_values(["hidden", "late", "after", "seg_idx", "ord"], kind="stable")
    live = ~p["hidden"] & ~p.duplicated(["g", "a", "lat", "lon", "tz_missing", "standalone"])
    return p.assign(live=live, wins=live & ~p.duplicated(["g", "ms", "lat", "lon"]))


def stream_reconciled(segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Changes (op: 1 or -1, source, ts, lat, lon, tz_missing, recorded) to the points that reconcile keeps.

    segments: a stream of flatten_segments whose source names a history, which many files may add to in any order, and
    seg_idx a segment's place in it. A path point that a later file's interval covers, or a duplicate that a better one
    replaces, is taken back; settled gives what stands. State is kept by history and piece of time (bucket_ms): the
    disjoint unions of its intervals and the points that none covers, each exact copy once, so a long history is in
    many tasks; pieces are dealt to GROUPS states, all of one settled at once, so a micro-batch costs by rows, not by pieces. An interval is in every piece it touches: 121,000 if it goes from year 0 to 9999. Rows
    without a source are left out.
    """
    if bucket_ms <= 0:
        raise ValueError("a piece of time is a positive number of milliseconds")
    d = _items(segments.where("source IS NOT NULL"), bucket_ms)
    columns = d.columns
    stored = [c for c in columns if c != "b"]

    def run(_: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat([b[columns] for b in batches], ignore_index=True).assign(shown=False)
        point = new["b"] < new["a"]
        iv, p = new[~point][["source", "bucket", "a", "b"]], new[point].drop(columns="b")
        if s.exists:
            old_iv, old_p = (unpack(x) for x in s.get)
            iv, p = pd.concat([old_iv, iv]), pd.concat([old_p, p]) if len(old_p) else p
        both = pd.concat([iv[["source", "bucket"]], p[["source", "bucket"]]], ignore_index=True)
        g = pd.factorize(both["source"])[0] * (both["bucket"].nunique() + 1) + pd.factorize(both["bucket"])[0]
        iv, p = iv.assign(g=g[: len(iv)]), p.assign(g=g[len(iv) :])
        iv = _merged(iv)
        p = _kept(p.reset_index(drop=True), iv)
        changed, live = p[p["shown"] != p["wins"]], p[p["live"]]
        s.update((pack(iv.drop(columns="g")), pack(live.assign(shown=live["wins"])[[*stored, "shown"]])))
        if len(changed):
            yield changed.assign(op=np.where(changed["wins"], 1, -1))[["op", "source", "a", "lat", "lon", "tz_missing", "recorded"]]

    out = "op int, source string, a bigint, lat double, lon double, tz_missing boolean, recorded bigint"
    group = F.pmod(F.xxhash64("source", "bucket"), F.lit(GROUPS)).cast("int")
    c = d.withColumn("__group", group).groupBy("__group").applyInPandasWithState(run, out, "intervals binary, points binary", "append", GroupStateTimeout.NoTimeout)
    recorded = F.when(F.col("recorded") != _NO_DATE, F.date_from_unix_date(F.col("recorded").cast("int")))
    return c.select("op", "source", F.timestamp_micros("a").alias("ts"), "lat", "lon", "tz_missing", recorded.alias("recorded"))


def settled(changes: DataFrame) -> DataFrame:
    """The points that stand after all changes: source, ts, lat, lon, tz_missing, recorded."""
    return changes.groupBy(*_OUT).agg(F.sum("op").alias("n")).where("n > 0").select(*_OUT)
