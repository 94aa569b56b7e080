"""Camera tracks: raw viewports along a journey, their smoothing, overview and blends."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.constants import Movement
from waystone.functions.geo import clamp, clamp_center_y, ease_out_cubic, lerp, log_lerp, smoothstep, tile_zoom, unwrap_near, world_x, world_y
from waystone.operators import journey, lookup, pacing


def samples(totals: DataFrame, key: str = "traveler_id", n: int = K.CAMERA_SAMPLES) -> DataFrame:
    """key, sample 0..n, p: evenly spaced progress for every journey with some distance."""
    d = totals.where("available").select(key, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("sample"))
    return d.withColumn("p", F.col("sample") / float(n))


def context_windows(at: DataFrame, legs: DataFrame, totals: DataFrame, movement: Movement, framing: float | None = None, key: str = "traveler_id", n: int = K.CAMERA_SAMPLES) -> DataFrame:
    """At (key, d) with tail, look, pad, alignment: what a viewport must show and how arrivals pull it in."""
    w = Window.partitionBy(key).orderBy("leg_no")
    nxt = lambda c: F.lead(c).over(w).alias(f"next_{c}")
    ext = legs.select(key, "leg_no", "start_km", "end_km", "is_transfer", nxt("end_km"), nxt("start_km"), nxt("is_transfer"), F.lag("is_transfer").over(w).alias("after_transfer"))
    d = at.join(totals.select(key, "total_km"), key)
    if movement.leg_aware:
        payload = ["start_km", "end_km", "is_transfer", "next_start_km", "next_end_km", "next_is_transfer", "after_transfer"]
        d = lookup.as_of(d, ext, key, "d", "start_km", "leg_no", payload, later=False)
    else:
        d = d.withColumn("knot", F.lit(None).cast("struct<start_km:double,end_km:double,is_transfer:boolean,next_start_km:double,next_end_km:double,next_is_transfer:boolean,after_transfer:boolean>"))
    k = {x: F.col(f"knot.{x}") for x in ("start_km", "end_km", "is_transfer", "next_start_km", "next_end_km", "next_is_transfer", "after_transfer")}
    frames, dist, total = framing is not None and movement.leg_aware, F.col("d"), F.col("total_km")
    transfer = F.coalesce(k["is_transfer"], F.lit(False))
    next_local = F.coalesce(~k["next_is_transfer"], F.lit(False))
    length, off = k["end_km"] - k["start_km"], dist - k["start_km"]
    ctx0 = clamp(total * movement.fraction, movement.low_km, movement.high_km)
    ratio = off / F.when(length > 0, length)
    blend = F.when(transfer & next_local, F.coalesce(smoothstep((ratio - 0.75) / 0.25), F.lit(0.0))).otherwise(0.0) if frames else F.lit(0.0)
    near = F.greatest(F.lit(0.001), F.least(ctx0, k["next_end_km"] - k["next_start_km"]))
    ctx = F.when(transfer, F.when(blend > 0, log_lerp(length, near, blend)).otherwise(length)).otherwise(ctx0)
    own = movement.pad * (framing if framing is not None else 1.0)
    pad = F.when(transfer, lerp(K.TRANSFER_PAD, own, blend)).otherwise(own)
    leaving = k["end_km"] - dist <= F.least(F.lit(50.0), length * 0.15)
    ahead = F.when(k["start_km"].isNull(), total).when(transfer, F.when(next_local, k["next_end_km"]).otherwise(k["end_km"]))
    ahead = ahead.when(F.lit(not frames), total).when(leaving & F.coalesce(k["next_is_transfer"], F.lit(False)), k["next_end_km"]).otherwise(k["end_km"])
    hold = F.greatest(F.lit(0.001), F.least(length, total * (2.0 / n)))
    settle = F.least(length, F.greatest(F.lit(25.0), hold))
    landed = F.when(off <= hold, 1.0).when(settle > hold, 1.0 - smoothstep((off - hold) / F.when(settle > hold, settle - hold))).otherwise(0.0)
    arrival = F.when(transfer, blend).when(F.coalesce(k["after_transfer"], F.lit(False)), landed).otherwise(0.0) if frames else F.lit(0.0)
    align = F.when(transfer, arrival).when(k["start_km"].isNotNull(), 1.0).otherwise(0.0) if frames else F.lit(0.0)
    d = d.withColumns({"__ctx": ctx, "__ahead": ahead, "pad": F.coalesce(pad, F.lit(own)), "arrival": F.coalesce(arrival, F.lit(0.0)), "alignment": F.coalesce(align, F.lit(0.0))})
    start = F.coalesce(k["start_km"], F.lit(0.0))
    return d.select(*at.columns, F.greatest(start, dist - F.col("__ctx")).alias("tail"), F.least(F.col("__ahead"), dist + F.col("__ctx")).alias("look"), "pad", "arrival", "alignment")


def bounds_tree(h: DataFrame, key: str = "traveler_id", tie: str = "i") -> DataFrame:
    """A2: key, level, node and the bounds (x0, x1, y0, y1; x unwrapped along the journey) of the points that it holds.

    Level 0 are the points by their index, each next level NODE_FAN nodes of the one below: hardly more rows than points.
    """
    u = journey.unwrapped(h, key, (tie,)).select(key, tie, "x", "y", F.explode(F.array([F.lit(k) for k in range(K.NODE_LEVELS + 1)])).alias("level"))
    node = F.floor(F.col(tie) / F.pow(F.lit(K.NODE_FAN), F.col("level"))).cast("long")
    return u.groupBy(key, "level", node.alias("node")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def window_nodes(ranges: DataFrame) -> DataFrame:
    """ranges (lo, hi and others) with level and node: the few nodes that hold just the points lo <= index < hi.

    Each range has a row more, of level and node -1. A level's nodes are what its inner parents don't hold.
    """
    top = F.floor(F.log2(F.greatest(F.lit(1), F.col("hi") - F.col("lo"))) / math.log2(K.NODE_FAN)).cast("int") + 1
    d = ranges.withColumn("level", F.explode(F.sequence(F.lit(-1), F.coalesce(F.least(F.lit(K.NODE_LEVELS), top), F.lit(-1)))))
    size = F.pow(F.lit(float(K.NODE_FAN)), F.greatest(F.lit(0), F.col("level")))
    d = d.withColumns({"__a": F.ceil(F.col("lo") / size), "__b": F.floor(F.col("hi") / size)})
    d = d.withColumns({"__u": F.ceil(F.col("__a") / K.NODE_FAN) * K.NODE_FAN, "__d": F.floor(F.col("__b") / K.NODE_FAN) * K.NODE_FAN})
    inner, none = (F.col("__u") < F.col("__d")) & (F.col("level") < K.NODE_LEVELS), F.array().cast("array<bigint>")
    d = d.withColumns({"__l": F.when(inner, F.col("__u")).otherwise(F.col("__b")), "__r": F.when(inner, F.col("__d")).otherwise(F.col("__b"))})
    some = lambda start, stop: F.when(F.col(start) < F.col(stop), F.sequence(F.col(start), F.col(stop) - 1)).otherwise(none)
    nodes = F.when(F.col("level") < 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.concat(some("__a", "__l"), some("__r", "__b")))
    return d.select(*ranges.columns, "level", F.explode(nodes).alias("node"))


def seen_bounds(m: DataFrame, h: DataFrame, key: str, ids: tuple[str, ...], tie: str) -> DataFrame:
    """M (key, ids, marker_x, lo, hi and others) with sx0, sx1, sy0, sy1: the bounds of the points lo <= index < hi.

    x is near marker_x. A node of points that reaches over the edge of the world around the marker is replaced by its
    points. Windows without points have null bounds.
    """
    tree, rest = bounds_tree(h, key, tie), [c for c in m.columns if c not in (key, *ids, "marker_x", "lo", "hi")]
    d = window_nodes(m)
    d = d.withColumns({c: F.when(F.col("level") < 0, F.col(c)) for c in rest}).join(tree, [key, "level", "node"], "left")
    near = lambda c: unwrap_near(F.col(c), F.col("marker_x"))
    torn = (F.col("level") > 0) & (F.abs((near("x0") - F.col("x0")) - (near("x1") - F.col("x1"))) > 0.5)
    width = F.pow(F.lit(K.NODE_FAN), F.col("level")).cast("long")
    inside = F.when(torn, F.sequence(F.greatest("lo", F.col("node") * width), F.least(F.col("hi"), (F.col("node") + 1) * width) - 1))
    d = d.withColumn("__i", F.explode_outer(inside)).withColumn("__i", F.coalesce("__i", -2 - F.col("node")))
    p = tree.where("level = 0").select(F.col(key).alias("__k"), F.col("node").alias("__n"), *[F.col(c).alias(f"__{c}") for c in ("x0", "x1", "y0", "y1")])
    d = d.join(p, (F.col(key) == F.col("__k")) & (F.col("__i") == F.col("__n")), "left")
    d = d.withColumns({c: F.coalesce(f"__{c}", c) for c in ("x0", "x1", "y0", "y1")})
    seen = [F.min(near("x0")).alias("sx0"), F.max(near("x1")).alias("sx1"), F.min("y0").alias("sy0"), F.max("y1").alias("sy1")]
    return d.groupBy(key, *ids).agg(F.max("marker_x").alias("marker_x"), *[F.max(c).alias(c) for c in rest], *seen)


def raw_viewports(windows: DataFrame, h: DataFrame, movement: Movement, aspect: float = K.CAMERA_ASPECT, key: str = "traveler_id", ids: tuple[str, ...] = ("sample",), tie: str = "i", points: bool = True) -> DataFrame:
    """T3, J7 (T5 without points): key, ids, marker_x, marker_y, center_x, center_y, span_x, span_y, arrival, alignment.

    The box holds the marker, both ends of the window and every point of the journey inside it, all unwrapped near the
    marker; it is padded and kept between the movement's and the largest span. tie is the points' index, from 0 on.
    One as-of pass places a window's marker and ends and tells which points lie between them. Points come as bounds of
    whole runs of them (see bounds_tree), so a window costs some dozen rows, however many points it covers.
    """
    own = ["pad", "arrival", "alignment"]
    at = lambda what: F.struct(F.lit(what).alias("what"), F.col(what).alias("at"))
    probes = windows.select(key, *ids, *own, F.explode(F.array(at("d"), at("tail"), at("look"))).alias("w")).select(key, *ids, *own, "w.what", "w.at")
    pos = lookup.positions_at(probes, lookup.ranked(h, key), "at", key, tie, ("below", "upto", "cum_km"))
    lo = F.when(F.col("at") > 0, F.col("below")).otherwise(0)
    hi = F.coalesce(F.when(F.col("cum_km") == F.col("at"), F.col("upto")).otherwise(F.col("below")), F.lit(1))
    pos = pos.select(key, *ids, "what", *own, world_x("lon").alias("x"), world_y("lat").alias("y"), F.coalesce(lo, F.lit(0)).cast("long").alias("lo"), hi.cast("long").alias("hi"))
    one = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    ends = [one(what, c).alias(f"{what}_{c}") for what in ("d", "tail", "look") for c in "xy"]
    m = pos.groupBy(key, *ids).agg(*[F.max(c).alias(c) for c in own], *ends, one("tail", "lo").alias("lo"), one("look", "hi").alias("hi"))
    xs = [F.col("d_x"), unwrap_near(F.col("tail_x"), F.col("d_x")), unwrap_near(F.col("look_x"), F.col("d_x"))]
    ys = [F.col(f"{what}_y") for what in ("d", "tail", "look")]
    boxes = {"x0": F.least(*xs), "x1": F.greatest(*xs), "y0": F.least(*ys), "y1": F.greatest(*ys)}
    d = m.select(key, *ids, F.col("d_x").alias("marker_x"), F.col("d_y").alias("marker_y"), *own, "lo", "hi", *[v.alias(f"b{c}") for c, v in boxes.items()])
    if points:
        d = seen_bounds(d, h, key, ids, tie)
        d = d.withColumns({f"b{c}": (F.least if c[1] == "0" else F.greatest)(f"b{c}", f"s{c}") for c in boxes})
    cx, cy = (F.greatest(F.lit(K.CONTENT_FLOOR), F.col(f"b{a}1") - F.col(f"b{a}0")) for a in "xy")
    d = d.withColumn("span_y", clamp(F.greatest(cy * F.col("pad"), cx * F.col("pad") / aspect), movement.min_span, K.SPAN_MAX))
    return d.select(key, *ids, "marker_x", "marker_y", ((F.col("bx0") + F.col("bx1")) / 2).alias("center_x"), ((F.col("by0") + F.col("by1")) / 2).alias("center_y"), (F.col("span_y") * aspect).alias("span_x"), "span_y", "arrival", "alignment")


def fixed_span(raw: DataFrame, key: str = "traveler_id") -> DataFrame:
    """Key, span_y: the 80th percentile of the samples' spans, one of them."""
    return raw.groupBy(key).agg(F.expr(f"percentile_disc({K.FIXED_PERCENTILE}) WITHIN GROUP (ORDER BY span_y)").alias("span_y"))


def next_zoom(before: np.ndarray | int, exact: np.ndarray | float) -> np.ndarray:
    """The zoom level once the exact one is far enough over or under the level before."""
    up, down = np.minimum(K.ZOOM_HIGH, np.floor(exact - K.ZOOM_HYSTERESIS)), np.maximum(K.ZOOM_LOW, np.floor(exact + K.ZOOM_HYSTERESIS))
    return np.where(exact >= before + 1 + K.ZOOM_HYSTERESIS, up, np.where(exact < before - K.ZOOM_HYSTERESIS, down, before))


def _near(v: np.ndarray, ref: np.ndarray) -> np.ndarray:
    d = v - ref
    return np.where(d > 0.5, v - np.ceil(d - 0.5), np.where(d < -0.5, v + np.ceil(-d - 0.5), v))


def _inside(y: np.ndarray, span: np.ndarray) -> np.ndarray:
    return np.where(span >= 1, 0.5, np.minimum(1 - span / 2, np.maximum(span / 2, y)))


def _exact_zoom(width: int, span_x: np.ndarray) -> np.ndarray:
    return np.log2(width / (K.TILE_PX * span_x))


def smooth_tracks(v: dict[str, np.ndarray], movement: Movement, aspect: float, width: int, fixed: np.ndarray | None, framing: bool = False) -> np.ndarray:
    """(journey, sample, center_x center_y span_y zoom): samples smoothed against the frame before, then centred
    again, all journeys at once. v holds a row for each journey, samples in order.

    Spans follow in logarithms, faster out than in; the centre moves only as far as keeps the marker in the dead zone.
    The second pass may draw the span in toward the raw one on local legs and arrivals.
    """
    mx, my, cx, cy, span, arrival, align = (v[c] for c in ("marker_x", "marker_y", "center_x", "center_y", "span_y", "arrival", "alignment"))
    n, out = span.shape[1], np.empty((*span.shape, 4))

    def keep(x: np.ndarray, y: np.ndarray, s: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        half_x, half_y, m = s * aspect * K.DEAD_ZONE, s * K.DEAD_ZONE, _near(mx[:, i], x)
        x = x + np.maximum(0.0, m - (x + half_x)) + np.minimum(0.0, m - (x - half_x))
        y = y + np.maximum(0.0, my[:, i] - (y + half_y)) + np.minimum(0.0, my[:, i] - (y - half_y))
        return x, _inside(y, s)

    def first_zoom(s: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(_exact_zoom(width, s * aspect)), K.ZOOM_LOW, K.ZOOM_HIGH)

    for i in range(n):
        target = fixed if fixed is not None else np.maximum(span[:, i], movement.min_span)
        if i == 0:
            s = target if fixed is not None else span[:, 0]
            x, y, zoom = cx[:, 0], _inside(cy[:, 0], s), first_zoom(s)
        else:
            if fixed is not None:
                s = target
            else:
                alpha = np.where(target > s, movement.zoom_out, movement.zoom_in + (1 - movement.zoom_in) * arrival[:, i])
                s = np.minimum(K.SPAN_MAX, np.maximum(movement.min_span, np.exp(np.log(s) + (np.log(target) - np.log(s)) * alpha)))
            x, y = keep(x, y, s, i)
            zoom = next_zoom(zoom, _exact_zoom(width, s * aspect))
        out[:, i, 0], out[:, i, 1], out[:, i, 2], out[:, i, 3] = x, y, s, zoom
    if framing:
        for i in range(n):
            s = out[:, i, 2]
            s = np.where((align[:, i] > 0) & (span[:, i] < s), np.exp(np.log(s) + (np.log(span[:, i]) - np.log(s)) * align[:, i]), s)
            x, y = (mx[:, 0], _inside(my[:, 0], s)) if i == 0 else keep(x, y, s, i)
            zoom = first_zoom(s) if i == 0 else next_zoom(zoom, _exact_zoom(width, s * aspect))
            out[:, i, 0], out[:, i, 1], out[:, i, 2], out[:, i, 3] = x, y, s, zoom
    return out


def camera_track(raw: DataFrame, movement: Movement, aspect: float = K.CAMERA_ASPECT, width: int = 480, framing: float | None = None, key: str = "traveler_id") -> DataFrame:
    """Key, sample, center_x, center_y, span_y, zoom. Journeys have CAMERA_SAMPLES + 1 rows, whatever their
    points; a task takes those of a batch through all samples at once. Rows of null key are no journey."""
    frames = framing is not None and movement.leg_aware
    d = raw.join(fixed_span(raw, key).select(F.col(key).alias("__k"), F.col("span_y").alias("fixed")), F.col(key) == F.col("__k")).drop("__k") if movement.fixed else raw.withColumn("fixed", F.lit(None).cast("double"))
    names = ["marker_x", "marker_y", "center_x", "center_y", "span_y", "arrival", "alignment", "fixed"]

    def smooth(t: pd.DataFrame) -> pd.DataFrame:
        ids = t[key].to_numpy()
        start = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        size, done = np.diff(np.append(start, len(t))), np.empty((len(t), 4))
        v = {c: t[c].to_numpy(float) for c in names}
        for n in np.unique(size):
            at = start[size == n][:, None] + np.arange(n)
            done[at] = smooth_tracks({c: v[c][at] for c in names}, movement, aspect, width, v["fixed"][at[:, 0]] if movement.fixed else None, frames)
        return pd.DataFrame({key: ids, "sample": t["sample"].to_numpy(), "center_x": done[:, 0], "center_y": done[:, 1], "span_y": done[:, 2], "zoom": done[:, 3].astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            t = b if held is None else pd.concat([held, b], ignore_index=True)
            cut = int(np.argmax((t[key] == t[key].iloc[-1]).to_numpy())) if len(t) else 0  # the last journey may go on
            held = t.iloc[cut:]
            if cut:
                yield smooth(t.iloc[:cut])
        if held is not None and len(held):
            yield smooth(held)

    d = d.where(F.col(key).isNotNull()).select(key, "sample", *names).repartition(key).sortWithinPartitions(key, "sample")
    return d.mapInPandas(run, f"{key} {dict(raw.dtypes)[key]}, sample int, center_x double, center_y double, span_y double, zoom int")


class Held:
    """Columns of numbers that come in pieces: in memory, beyond JOURNEY_HELD rows in the task's temporary files, mapped."""

    def __init__(self, width: int) -> None:
        self.width, self.n, self.parts, self.files = width, 0, [], None

    def add(self, piece: list[np.ndarray]) -> None:
        self.parts.append(piece)
        self.n += len(piece[0])
        if self.n > K.JOURNEY_HELD:
            self.files = self.files or [tempfile.TemporaryFile() for _ in range(self.width)]
            self.n = 0
            self._flush()

    def _flush(self) -> None:
        for f, *c in zip(self.files, *self.parts):
            f.writelines(x.tobytes() for x in c)
            f.flush()
        self.parts = []

    def columns(self) -> list[np.ndarray]:
        if self.files is None:
            return [np.concatenate(c) for c in zip(*self.parts)] if self.parts else [np.zeros(0)] * self.width
        self._flush()
        return [np.memmap(f, np.float64, "r") for f in self.files]


def _smoothstep(t: np.ndarray) -> np.ndarray:
    c = np.clip(t, 0.0, 1.0)
    return c * c * (3.0 - 2.0 * c)


def _log_lerp(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.exp(np.log(a) + (np.log(b) - np.log(a)) * t)


def sample_distances(p: np.ndarray, total: float, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """J5 of one journey's samples, see pacing.distance_at; no knots for linear progress."""
    straight = total * p
    if not len(x):
        return straight
    j = np.searchsorted(x, p, "right") - 1
    a, b = np.maximum(j, 0), np.minimum(np.maximum(j, 0) + 1, len(x) - 1)
    x0, y0 = x[a], y[a]
    last, h = (b == a) | (p == x0), np.where(b == a, 1.0, x[b] - x0)
    t = (p - x0) / h
    t2, t3 = t * t, t * t * t
    d = (t3 * 2 - t2 * 3 + 1) * y0 + (t3 - t2 * 2 + t) * h * m[a] + (t2 * 3 - t3 * 2) * y[b] + (t3 - t2) * h * m[b]
    return np.maximum(0.0, np.minimum(total, np.where(j < 0, straight, np.where(last, y0, d))))


def sample_windows(d: np.ndarray, total: float, legs: list[np.ndarray], movement: Movement, framing: float | None) -> dict[str, np.ndarray]:
    """T3, T4 of one journey's samples, see context_windows: tail, look, pad, arrival, alignment."""
    n, start_km, end_km, far = len(d) - 1, *legs
    own = movement.pad * (framing if framing is not None else 1.0)
    ctx0 = max(movement.low_km, min(movement.high_km, total * movement.fraction))
    j = np.searchsorted(start_km, d, "right") - 1 if movement.leg_aware else np.full(len(d), -1)
    if not len(start_km) or not movement.leg_aware:
        return {"tail": np.maximum(0.0, d - ctx0), "look": np.minimum(total, d + ctx0), "pad": np.full(len(d), own), "arrival": np.zeros(len(d)), "alignment": np.zeros(len(d))}
    on, at, frames = j >= 0, np.maximum(j, 0), framing is not None
    nxt, more = np.minimum(at + 1, len(start_km) - 1), on & (at + 1 < len(start_km))
    s, e, transfer = start_km[at], end_km[at], on & (far[at] > 0)
    next_far, next_local, after = more & (far[nxt] > 0), more & (far[nxt] == 0), on & (at > 0) & (far[np.maximum(at - 1, 0)] > 0)
    length, off = e - s, d - s
    real = np.where(length > 0, length, 1.0)
    blend = np.where(transfer & next_local & (length > 0), _smoothstep((off / real - 0.75) / 0.25), 0.0) if frames else np.zeros(len(d))
    near = np.maximum(0.001, np.minimum(ctx0, np.where(more, end_km[nxt] - start_km[nxt], np.inf)))
    ctx = np.where(transfer, np.where(blend > 0, _log_lerp(real, near, blend), length), ctx0)
    pad = np.where(transfer, K.TRANSFER_PAD + (own - K.TRANSFER_PAD) * blend, own)
    leaving = on & (e - d <= np.minimum(50.0, length * 0.15))
    ahead = np.where(~on, total, np.where(transfer, np.where(next_local, end_km[nxt], e), total if not frames else np.where(leaving & next_far, end_km[nxt], e)))
    hold = np.maximum(0.001, np.minimum(length, total * (2.0 / n)))
    settle = np.minimum(length, np.maximum(25.0, hold))
    landed = np.where(off <= hold, 1.0, np.where(settle > hold, 1.0 - _smoothstep((off - hold) / np.where(settle > hold, settle - hold, 1.0)), 0.0))
    arrival = np.where(transfer, blend, np.where(after, landed, 0.0)) if frames else np.zeros(len(d))
    align = np.where(transfer, arrival, on.astype(float)) if frames else np.zeros(len(d))
    return {"tail": np.maximum(np.where(on, s, 0.0), d - ctx), "look": np.minimum(ahead, d + ctx), "pad": pad, "arrival": arrival, "alignment": align}


def _along(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X2, see geo.great_circle."""
    a, b, c, d = (np.radians(v) for v in (lat1, lon1, lat2, lon2))
    u = (np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a))
    v = (np.cos(c) * np.cos(d), np.cos(c) * np.sin(d), np.sin(c))
    w = np.arccos(np.clip(u[0] * v[0] + u[1] * v[1] + u[2] * v[2], -1.0, 1.0))
    tiny, sin = np.sin(w) < 1e-8, np.where(np.sin(w) < 1e-8, 1.0, np.sin(w))
    p, q = (np.where(tiny, t, np.sin(t * w) / sin) for t in (1.0 - f, f))
    x, y, z = (p * i + q * j for i, j in zip(u, v))
    at = lambda one, two, mid: np.where(f <= 0, one, np.where(f >= 1, two, np.degrees(mid)))
    return at(lat1, lat2, np.arctan2(z, np.sqrt(x * x + y * y))), at(lon1, lon2, np.arctan2(y, x))


def range_bounds(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) of v[lo:hi] for each lo < hi: bounds between all the cuts, then two runs of cells a range."""
    cuts = np.unique(np.concatenate([lo, hi]))
    a, b = np.searchsorted(cuts, lo), np.searchsorted(cuts, hi)
    k, out = np.log2(b - a).astype(int), []
    for least in (np.fmin, np.fmax):
        table = [least.reduceat(v[cuts[0] : cuts[-1]], cuts[:-1] - cuts[0])]
        for i in range(int(k.max())):
            t = table[-1].copy()
            t[: len(t) - (1 << i)] = least(t[: len(t) - (1 << i)], table[-1][1 << i :])
            table.append(t)
        table = np.stack(table)
        out.append(least(table[k, a], table[k, b - (1 << k)]))
    return out[0], out[1]


def sample_viewports(d: np.ndarray, w: dict[str, np.ndarray], points: list[np.ndarray], movement: Movement, aspect: float, seen: bool) -> dict[str, np.ndarray]:
    """T3, J7 (T5 unless seen) of one journey's samples, see raw_viewports; points in order, x unwrapped along them."""
    cum, cum0, hop, lat, lon, x, y = points
    moving = None if not np.isnan(lat[:-1]).any() else np.flatnonzero(~np.isnan(lat[:-1])) + 1
    at = {n: np.maximum(0.0, np.minimum(cum[-1], v)) for n, v in (("d", d), ("tail", w["tail"]), ("look", w["look"]))}
    q = np.concatenate(list(at.values()))
    i = np.searchsorted(cum[1:], q) + 1 if moving is None else moving[np.searchsorted(cum[moving], q)]
    f = np.where(hop[i] > 0, np.clip((q - cum0[i]) / np.where(hop[i] > 0, hop[i], 1.0), 0.0, 1.0), 0.0)
    place_lat, place_lon = _along(lat[i - 1], lon[i - 1], lat[i], lon[i], f)
    sin = np.sin(np.radians(np.clip(place_lat, -K.MAX_LAT, K.MAX_LAT)))
    px, py = ((place_lon + 180.0) / 360.0).reshape(3, -1), (0.5 - np.log((1.0 + sin) / (1.0 - sin)) / (4 * math.pi)).reshape(3, -1)
    px = np.stack([px[0], _near(px[1], px[0]), _near(px[2], px[0])])
    x0, x1, y0, y1 = px.min(0), px.max(0), py.min(0), py.max(0)
    if seen:
        lo, hi = np.searchsorted(cum, at["tail"]), np.searchsorted(cum, at["look"], "right")
        some = np.flatnonzero(lo < hi)
        if len(some):
            lo, hi, mark = lo[some], hi[some], px[0][some]
            (sx0, sx1), (sy0, sy1) = range_bounds(x, lo, hi), range_bounds(y, lo, hi)
            nx0, nx1 = _near(sx0, mark), _near(sx1, mark)
            for t in np.flatnonzero(np.abs((nx0 - sx0) - (nx1 - sx1)) > 0.5):  # the edge of the world around the marker lies between them
                lows, highs = zip(*((np.nanmin(v), np.nanmax(v)) for a in range(lo[t], hi[t], K.JOURNEY_HELD) for v in [_near(x[a : min(hi[t], a + K.JOURNEY_HELD)], mark[t])] if not np.isnan(v).all()))
                nx0[t], nx1[t] = min(lows), max(highs)
            x0[some], x1[some], y0[some], y1[some] = np.fmin(x0[some], nx0), np.fmax(x1[some], nx1), np.fmin(y0[some], sy0), np.fmax(y1[some], sy1)
    cx, cy = np.maximum(K.CONTENT_FLOOR, x1 - x0), np.maximum(K.CONTENT_FLOOR, y1 - y0)
    span = np.maximum(movement.min_span, np.minimum(K.SPAN_MAX, np.maximum(cy * w["pad"], cx * w["pad"] / aspect)))
    return {"marker_x": px[0], "marker_y": py[0], "center_x": (x0 + x1) / 2, "center_y": (y0 + y1) / 2, "span_x": span * aspect, "span_y": span, "arrival": w["arrival"], "alignment": w["alignment"]}


_HEAD, _KNOT, _LEG, _POINT = range(4)
_WIDTHS = (1, 3, 3, 7)


def _journeys(h: DataFrame, legs: DataFrame | None, totals: DataFrame, curve: DataFrame | None, movement: Movement, framing: float | None, aspect: float, width: int, key: str, tie: str, points: bool, tracks: bool, n: int = K.CAMERA_SAMPLES) -> DataFrame:
    """Samples of all available journeys as raw viewports or as tracks.

    What a journey's samples are made of meets in the task of the journey, sorted: its total, knots, legs and points.
    Samples are made there and never shuffled, so what is shuffled grows with the points alone.
    """
    part = lambda d, kind, order, *c: d.select(key, F.lit(kind).alias("__kind"), F.col(order).cast("double").alias("__order") if order else F.lit(0.0).alias("__order"), *[(F.col(c[i]).cast("double") if i < len(c) else F.lit(None).cast("double")).alias(f"__c{i}") for i in range(max(_WIDTHS))])
    rows = part(totals.where("available"), _HEAD, None, "total_km").unionByName(part(journey.unwrapped(h, key, (tie,)), _POINT, tie, "cum_km", "cum0_km", "hop_km", "lat", "lon", "x", "y"))
    if curve is not None:
        rows = rows.unionByName(part(curve, _KNOT, "k", "x", "y", "m"))
    if legs is not None and movement.leg_aware:
        rows = rows.unionByName(part(legs, _LEG, "leg_no", "start_km", "end_km", "is_transfer"))
    names = ["center_x", "center_y", "span_y", "zoom"] if tracks else ["marker_x", "marker_y", "center_x", "center_y", "span_x", "span_y", "arrival", "alignment"]
    p = np.arange(n + 1) / float(n)

    def view(held: list[Held]) -> dict[str, np.ndarray] | None:
        (total,), knots, own = (held[k].columns() for k in (_HEAD, _KNOT, _LEG))
        if not len(total):
            return None
        d = sample_distances(p, total[0], *knots)
        return sample_viewports(d, sample_windows(d, total[0], own, movement, framing), held[_POINT].columns(), movement, aspect, points)

    def out(keys: list, views: list[dict[str, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
        v = {c: np.stack([x[c] for x in views]) for c in views[0]}
        if tracks:
            fixed = np.sort(v["span_y"], axis=1)[:, math.ceil(K.FIXED_PERCENTILE * (n + 1)) - 1] if movement.fixed else None
            t = smooth_tracks(v, movement, aspect, width, fixed, framing is not None and movement.leg_aware)
            v = {c: t[:, :, i].astype(np.int32) if c == "zoom" else t[:, :, i] for i, c in enumerate(names)}
        ids = pa.array(keys, kind).take(pa.array(np.repeat(np.arange(len(keys)), n + 1)))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(n + 1, dtype=np.int32), len(keys))), *[pa.array(v[c].ravel()) for c in names]], [key, "sample", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, views = None, None, [], []

        def done() -> None:
            x = view(held)
            if x is not None:
                keys.append(now)
                views.append(x)

        for b in batches:
            if not len(b):
                continue
            ids, kinds = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            values = [b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(max(_WIDTHS))]
            cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(ids)]])
            for a, z in zip(cuts[:-1], cuts[1:]):
                if held is None or ids[a] != now:
                    if held is not None:
                        done()
                    now, held = b.column(0)[int(a)].as_py(), [Held(k) for k in _WIDTHS]
                    if len(keys) == K.JOURNEY_BATCH:
                        yield out(keys, views, b.column(0).type)
                        keys, views = [], []
                held[kinds[a]].add([c[a:z].astype(float) for c in values[: _WIDTHS[kinds[a]]]])
            kind = b.column(0).type
        if held is not None:
            done()
        if keys:
            yield out(keys, views, kind)

    d = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "__kind", "__order")
    types = ", ".join(f"{c} {'int' if c == 'zoom' else 'double'}" for c in names)
    return d.mapInArrow(run, f"`{key}` {dict(h.dtypes)[key]}, sample int, {types}")


def journey_viewports(h: DataFrame, legs: DataFrame | None, totals: DataFrame, curve: DataFrame | None, movement: Movement, framing: float | None = None, aspect: float = K.CAMERA_ASPECT, key: str = "traveler_id", tie: str = "i", points: bool = True) -> DataFrame:
    """What raw_viewports gives for the samples of all journeys, without a row of them shuffled."""
    return _journeys(h, legs, totals, curve, movement, framing, aspect, 0, key, tie, points, False)


def journey_camera(h: DataFrame, legs: DataFrame | None, totals: DataFrame, curve: DataFrame | None, movement: Movement, framing: float | None = None, aspect: float = K.CAMERA_ASPECT, width: int = 480, key: str = "traveler_id", tie: str = "i") -> DataFrame:
    """The whole way from hop rows to a camera track; without a pacing curve progress is linear."""
    return _journeys(h, legs, totals, curve, movement, framing, aspect, width, key, tie, True, True)


def camera_at(probes: DataFrame, track: DataFrame, p: str = "p", key: str = "traveler_id", n: int = K.CAMERA_SAMPLES) -> DataFrame:
    """Probes with center_x, center_y, span_y, zoom between the two samples around p.

    Samples and probes meet once, by key: a sample carries the one after it on to its probes, and the track is read once.
    """
    pos = clamp(F.col(p), 0.0, 1.0) * n
    names = ["center_x", "center_y", "span_y", "zoom"]
    d = probes.where(F.col(key).isNotNull()).withColumn("__i", F.least(F.lit(n - 1), F.floor(pos)).cast("int")).withColumn("__f", pos - F.col("__i")).withColumn("__probe", F.lit(1))
    t = track.select(key, F.col("sample").alias("__i"), F.struct(*names).alias("__a"), F.lit(0).alias("__probe"))
    u = d.unionByName(t, allowMissingColumns=True).repartition(key)
    after = Window.partitionBy(key, "__probe").orderBy("__i")
    b = F.when((F.col("__probe") == 0) & (F.lead("__i").over(after) == F.col("__i") + 1), F.lead("__a").over(after))
    u = u.withColumn("__at", F.when(F.col("__probe") == 0, F.struct(F.col("__i").alias("i"), F.col("__a").alias("a"), b.alias("b"))))
    w = Window.partitionBy(key).orderBy("__i", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("__at", F.last("__at", ignorenulls=True).over(w)).where("__probe = 1 AND __at.i = __i AND __at.b IS NOT NULL")
    a, b, f = (lambda c: F.col(f"__at.a.{c}")), (lambda c: F.col(f"__at.b.{c}")), F.col("__f")
    x = lerp(a("center_x"), unwrap_near(b("center_x"), a("center_x")), f)
    return u.select(*probes.columns, x.alias("center_x"), lerp(a("center_y"), b("center_y"), f).alias("center_y"), log_lerp(a("span_y"), b("span_y"), f).alias("span_y"), F.when(f < 0.5, a("zoom")).otherwise(b("zoom")).alias("zoom"))


def viewport(center_x: Column, center_y: Column, span_x: Column, span_y: Column, width: int) -> list[Column]:
    """min_x, max_x, min_y, max_y (cut to the world) and zoom of a view."""
    return [(center_x - span_x / 2).alias("min_x"), (center_x + span_x / 2).alias("max_x"), F.greatest(F.lit(0.0), center_y - span_y / 2).alias("min_y"), F.least(F.lit(1.0), center_y + span_y / 2).alias("max_y"), tile_zoom(span_x, width).alias("zoom")]


def overview_viewport(bounds: DataFrame, width: int, height: int, key: str = "traveler_id") -> DataFrame:
    """Key and the view of bounds (min_x, …) inside the area that the overlay leaves free on a 720 grid."""
    s = min(width, height) / 720.0
    left, top, right, bottom = 34 * s, (132 + 20) * s, width - 34 * s, height - 34 * s
    wpp = F.greatest((F.col("max_x") - F.col("min_x")) / (right - left), (F.col("max_y") - F.col("min_y")) / (bottom - top)) * K.OVERVIEW_PAD
    span_x, span_y = F.greatest(F.lit(K.SPAN_FLOOR), wpp * width), clamp(wpp * height, K.SPAN_FLOOR, K.OVERVIEW_SPAN_MAX)
    d = bounds.withColumns({"__wpp": F.greatest(wpp, F.lit(K.SPAN_FLOOR) / width), "__sx": span_x, "__sy": span_y})
    x0 = (F.col("min_x") + F.col("max_x")) / 2 - F.lit((left + right) / 2) * F.col("__wpp")
    y0 = (F.col("min_y") + F.col("max_y")) / 2 - F.lit((top + bottom) / 2) * F.col("__wpp")
    y0 = F.when(F.col("__sy") <= 1, F.greatest(F.lit(0.0), F.least(1 - F.col("__sy"), y0))).otherwise(y0)
    return d.select(key, x0.alias("min_x"), (x0 + F.col("__sx")).alias("max_x"), y0.alias("min_y"), (y0 + F.col("__sy")).alias("max_y"), tile_zoom(F.col("__sx"), width).alias("zoom"))


def square_viewport(bounds: DataFrame, key: str = "traveler_id") -> DataFrame:
    """Key and the square view that fits bounds with padding 1.28 and a floor of 0.002."""
    span = F.greatest(F.lit(0.002), F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) * 1.28)
    d = bounds.withColumn("__s", span)
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, clamp_center_y((F.col("min_y") + F.col("max_y")) / 2, F.col("__s"))
    return d.select(key, (cx - F.col("__s") / 2).alias("min_x"), (cx + F.col("__s") / 2).alias("max_x"), (cy - F.col("__s") / 2).alias("min_y"), (cy + F.col("__s") / 2).alias("max_y"))


def blend_viewports(frames: DataFrame, overview: DataFrame, aspect: float = K.CAMERA_ASPECT, key: str = "traveler_id") -> DataFrame:
    """Frames (center_x, center_y, span_y, outro) drawn out toward the overview (min_x, …): centres linear on the
    nearest copy of the world, spans in logarithms, easing out."""
    o = overview.select(F.col(key).alias("__k"), ((F.col("min_x") + F.col("max_x")) / 2).alias("ox"), ((F.col("min_y") + F.col("max_y")) / 2).alias("oy"), (F.col("max_y") - F.col("min_y")).alias("os"))
    d, t = frames.join(o, F.col(key) == F.col("__k")), ease_out_cubic(clamp(F.col("outro"), 0.0, 1.0))
    span = clamp(log_lerp(F.col("span_y"), F.col("os"), t), K.SPAN_FLOOR, K.OVERVIEW_SPAN_MAX)
    new = {"center_x": lerp(F.col("center_x"), unwrap_near(F.col("ox"), F.col("center_x")), t), "center_y": lerp(F.col("center_y"), F.col("oy"), t), "span_y": span}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in frames.columns], (span * aspect).alias("span_x"))
