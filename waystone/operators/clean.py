"""Implausible points and raw-signal noise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions.geo import haversine_km, speed_kmh
from waystone.operators.folds import Fold, fold_sorted
from waystone.operators.scan import scan, time_slice


def _at(name: str, k: int, w) -> Column:
    return F.lag(name, -k).over(w) if k < 0 else F.lead(name, k).over(w) if k else F.col(name)


class _Taken(Fold):
    """Candidates (s, e) from left to right; free is where the next may start, each keeping the row after it."""

    def __init__(self) -> None:
        self.free = -1

    def feed(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        keep = []
        for i, (s, e) in enumerate(zip(rows["s"].to_numpy(), rows["e"].to_numpy(), strict=True)):
            if s >= self.free:
                keep.append(i)
                self.free = e + 2
        return [rows.take(keep)]


def _resolve(candidates: DataFrame, key: str) -> DataFrame:
    """key, i of removed rows: of candidates (s, e), those that _Taken takes, as a fold that holds one number a key."""
    c = candidates.select(key, "s", "e")
    return fold_sorted(c, key, ["s"], _Taken, c.schema).select(key, F.explode(F.sequence("s", "e")).alias("i"))


def _numbered(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return points.withColumn("i", (F.row_number().over(w) - 1).cast("long"))


def outlier_candidates(points: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq")) -> DataFrame:
    """Runs (s, e) of up to three rows that jump away and back faster than anything flies, by lag and lead only."""
    w = Window.partitionBy(key).orderBy(*order)
    d = _numbered(points, key, list(order))
    lat, lon, t = (lambda k: _at("lat", k, w)), (lambda k: _at("lon", k, w)), (lambda k: _at("t_ms", k, w))
    names = {}
    for k in range(-1, 4):
        for n, f in (("lat", lat), ("lon", lon), ("t_ms", t)):
            names[f"{n}{k + 1}"] = f(k)
    d = d.withColumns(names)
    d = d.withColumns({f"km{a}{b}": haversine_km(f"lat{a}", f"lon{a}", f"lat{b}", f"lon{b}") for a in range(5) for b in range(a + 1, 5)})

    def km(a: int, b: int) -> Column:
        return F.col(f"km{a}{b}")

    def far_run(n: int) -> Column:
        after, dt = n + 1, F.col(f"t_ms{n + 1}") - F.col("t_ms0")
        ok = (dt >= 0) & (dt <= K.EXCURSION_MS) & (km(0, after) <= K.REJOIN_KM)
        for a, b in ((0, 1), (n, after)):
            ok = ok & (km(a, b) >= K.EXCURSION_KM) & (speed_kmh(km(a, b), F.col(f"t_ms{b}") - F.col(f"t_ms{a}")) > K.EXCURSION_KMH)
        for i in range(2, n + 1):
            ok = ok & (km(1, i) <= K.REJOIN_KM)
        for i in range(1, n + 1):
            ok = ok & (km(0, i) >= K.EXCURSION_KM) & (km(i, after) >= K.EXCURSION_KM)
        return F.coalesce(ok, F.lit(False))

    run = F.when(far_run(3), 3).when(far_run(2), 2).when(far_run(1), 1)
    d = d.withColumn("run", run).where("run IS NOT NULL")
    return d.select(key, F.col("i").alias("s"), (F.col("i") + F.col("run") - 1).cast("long").alias("e"))


def outlier_filter(points: DataFrame, mode: str = "conservative", key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq")) -> DataFrame:
    """Points without implausible excursions; first and last stay. Mode off changes nothing.

    A row after a removed run is always kept, being near the row before it, so the run's left neighbour is the last
    kept row: candidates need neighbours only, and a fold settles the few that overlap.
    """
    if mode == "off":
        return points
    gone = _resolve(outlier_candidates(points, key, order), key)
    return _numbered(points, key, list(order)).join(gone, [key, "i"], "left_anti").select(*points.columns)


def filter_accuracy(raw: DataFrame, most: float | None = K.ACCURACY_M) -> DataFrame:
    """Signals of at most so many metres; None keeps all."""
    if most is not None and not (math.isfinite(most) and most >= 0):
        raise ValueError("an accuracy limit is a finite number of metres, not negative")
    return raw if most is None else raw.where(F.col("accuracy_m") <= most)


def spike_filter(raw: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq")) -> DataFrame:
    """Raw signals without single jumps away and back; first and last stay. For accuracies of up to 100 m.

    Beyond those a kept neighbour may itself be within a spike's reach: see spike_fold.
    """
    w = Window.partitionBy(key).orderBy(*order)
    d = _numbered(raw, key, list(order))
    d = d.withColumns({f"{n}{k + 1}": _at(n, k, w) for k in (-1, 0, 1) for n in ("lat", "lon", "t_ms", "accuracy_m")})
    d = d.withColumns({f"km{a}{b}": haversine_km(f"lat{a}", f"lon{a}", f"lat{b}", f"lon{b}") for a, b in ((0, 1), (1, 2), (0, 2))})
    km = lambda a, b: F.col(f"km{a}{b}")
    dt = F.col("t_ms2") - F.col("t_ms0")
    far = F.greatest(F.lit(K.SPIKE_KM), F.col("accuracy_m1") * 5 / 1000)
    ok = (dt >= 0) & (dt <= K.SPIKE_MS) & (km(0, 2) <= F.greatest(F.lit(K.SPIKE_REJOIN_KM), (F.col("accuracy_m0") + F.col("accuracy_m2")) * 2 / 1000))
    for a, b in ((0, 1), (1, 2)):
        ok = ok & (km(a, b) >= far) & (speed_kmh(km(a, b), F.col(f"t_ms{b}") - F.col(f"t_ms{a}")) > K.SPIKE_KMH)
    c = d.where(F.coalesce(ok, F.lit(False))).select(key, F.col("i").alias("s"), F.col("i").alias("e"))
    return d.join(_resolve(c, key), [key, "i"], "left_anti").select(*raw.columns)


def km_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """haversine_km for the folds' scalars."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a, b = math.sin((p2 - p1) / 2), math.sin((math.radians(lon2) - math.radians(lon1)) / 2)
    return 2 * K.EARTH_KM * math.asin(min(1.0, math.sqrt(a * a + math.cos(p1) * math.cos(p2) * b * b)))


def _kmh(km: float, ms: float) -> float:
    return math.inf if ms <= 0 else km / (ms / 3_600_000)


_VALUES = ["lat", "lon", "t_ms", "accuracy_m"]
#: By how much whole columns' distances may differ from km_between's, relative; what is nearer to a limit is asked one by one.
_SLACK = 1e-9


def _hops(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(about the km, about the km/h) from each row of (lat, lon, t_ms, …) to the next; the last row's are NaN."""
    r, dt = np.radians(v[:, :2]), np.diff(v[:, 2], append=np.nan)
    p, d = r[:, 0], np.diff(r, axis=0, append=np.full((min(1, len(r)), 2), np.nan)) / 2
    s = np.sin(d[:, 0]) ** 2 + np.cos(p) * np.cos(np.append(p[1:], np.nan)[: len(p)]) * np.sin(d[:, 1]) ** 2
    km = 2 * K.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(s)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return km, np.where(dt <= 0, np.inf, km / (dt / 3_600_000))


def _taken(held: pd.DataFrame | None, rows: pd.DataFrame, keep: list[int]) -> list[pd.DataFrame]:
    """Rows of a batch by number; -1 is the row held over from earlier ones."""
    out = [held] if keep and keep[0] < 0 else []
    own = [i for i in keep if i >= 0]
    return out + ([rows.take(own)] if own else [])


class _Spikes(Fold):
    """The last kept row's values and the row in question; a row is settled by the one after it."""

    reach = K.SPIKE_MS

    def __init__(self) -> None:
        self.before: tuple | None = None
        self.pending: pd.DataFrame | None = None

    def feed(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        keep, at = [], -1
        now = None if self.pending is None else tuple(self.pending[_VALUES].to_numpy(float)[0])
        for i, after in enumerate(rows[_VALUES].to_numpy(float)):
            if now is not None and (self.before is None or not self._spike(self.before, now, after)):
                keep.append(at)
                self.before = now
            now, at = tuple(after), i
        out = _taken(self.pending, rows, keep)
        self.pending = rows.take([len(rows) - 1]) if len(rows) else self.pending
        return out

    def end(self) -> list[pd.DataFrame]:
        return [] if self.pending is None else [self.pending]

    @classmethod
    def settle(cls, rows: pd.DataFrame, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, end = rows[_VALUES].to_numpy(float), np.append(first[1:], True)
        km, kmh = _hops(v)
        far = np.fmax(K.SPIKE_KM, 5 * v[:, 3] / 1000)
        ask = ~first & ~end & ~(km < far * (1 - _SLACK)) & ~(kmh <= K.SPIKE_KMH * (1 - _SLACK))
        kept, before = np.ones(len(v), bool), {}  # the row kept before a spike
        for i in np.flatnonzero(ask).tolist():
            b = before.get(i - 1, i - 1)
            if cls._spike(tuple(v[b]), tuple(v[i]), tuple(v[i + 1])):
                kept[i], before[i] = False, b
        hold = end.copy()
        ends = np.flatnonzero(end & ~first)
        hold[[before.get(i - 1, i - 1) for i in ends.tolist()]] = True
        return kept & ~end, hold

    @classmethod
    def finish(cls, rows: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        return np.append(first[1:], True)[: len(first)]

    @staticmethod
    def _spike(b: tuple, c: tuple, a: tuple) -> bool:
        if not 0 <= a[2] - b[2] <= K.SPIKE_MS or km_between(*b[:2], *a[:2]) > max(K.SPIKE_REJOIN_KM, 2 * (b[3] + a[3]) / 1000):
            return False
        far, into, back = max(K.SPIKE_KM, 5 * c[3] / 1000), km_between(*b[:2], *c[:2]), km_between(*c[:2], *a[:2])
        return into >= far and back >= far and _kmh(into, c[2] - b[2]) > K.SPIKE_KMH and _kmh(back, a[2] - c[2]) > K.SPIKE_KMH


def _runs(raw: DataFrame, key: str, order: tuple[str, ...], gap_ms: int, slice_ms: int) -> DataFrame:
    """raw with __run, the time at which a run of rows without a gap of over gap_ms begins; see scan for the slices."""
    at = time_slice(slice_ms)
    d = scan(raw, key, list(order), at, lags={"__t0": F.col("t_ms")})
    fresh = F.col("__t0").isNull() | (F.col("t_ms") - F.col("__t0") > gap_ms)
    return scan(d, key, list(order), at, lasts={"__run": F.when(fresh, F.col("t_ms"))}).drop("__t0")


def spike_fold(raw: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), slice_ms: int | None = None) -> DataFrame:
    """W10 for any accuracies, as a fold against the last kept row.

    With slice_ms, here as below, a traveller is parted where a gap longer than the rule's reach forgets all that came
    before, so that one with very many signals is folded by many tasks; only a run without such a gap stays in one.
    """
    if slice_ms is None:
        return fold_sorted(raw, key, list(order), _Spikes, raw.schema)
    return fold_sorted(_runs(raw, key, order, K.SPIKE_MS, slice_ms), key, list(order), _Spikes, raw.schema, "__run")


class _Stationary(Fold):
    """The last kept row, which waits until a row is kept that doesn't merge with it."""

    reach = K.STATIONARY_MS

    def __init__(self) -> None:
        self.kept: pd.DataFrame | None = None

    def feed(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        keep, at = [], -1
        last = None if self.kept is None else self.kept[_VALUES].to_numpy(float)[0]
        for i, p in enumerate(rows[_VALUES].to_numpy(float)):
            if last is not None and self._near(last, p):
                if p[3] < last[3]:
                    last, at = p, i
                continue
            if last is not None:
                keep.append(at)
            last, at = p, i
        out = _taken(self.kept, rows, keep)
        self.kept = rows.take([at]) if at >= 0 else self.kept
        return out

    def end(self) -> list[pd.DataFrame]:
        return [] if self.kept is None else [self.kept]

    @classmethod
    def settle(cls, rows: pd.DataFrame, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = rows[_VALUES].to_numpy(float)
        km, most, dt = _hops(v)[0], np.fmax(K.STATIONARY_KM, (v[:, 3] + np.append(v[1:, 3], np.nan)) / 1000), np.diff(v[:, 2], append=np.nan)
        sure = np.where(km <= most * (1 - _SLACK), 1, np.where(km > most * (1 + _SLACK), 0, 2))
        near = np.where((dt >= 0) & (dt <= K.STATIONARY_MS), sure, 0).tolist()  # of a row and the next
        acc, kept, hold, last = v[:, 3].tolist(), np.zeros(len(v), bool), np.zeros(len(v), bool), -1
        for i, fresh in enumerate(first.tolist()):
            if fresh or not (near[last] == 1 or cls._near(v[last], v[i]) if near[last] and last == i - 1 else last < i - 1 and cls._near(v[last], v[i])):
                if last >= 0:
                    (hold if fresh else kept)[last] = True
                last = i
            elif acc[i] < acc[last]:
                last = i
        hold[last] = True
        return kept, hold

    @classmethod
    def finish(cls, rows: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        return np.ones(len(rows), bool)

    @staticmethod
    def _near(last: np.ndarray, p: np.ndarray) -> bool:
        return 0 <= p[2] - last[2] <= K.STATIONARY_MS and km_between(*last[:2], *p[:2]) <= max(K.STATIONARY_KM, (last[3] + p[3]) / 1000)


class _Excursions(Fold):
    """W9 for streams: the last kept row and the up to four after it; a run is settled once the fourth is known."""

    reach = K.EXCURSION_MS

    @classmethod
    def settle(cls, rows: pd.DataFrame, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, at = cls._walk(rows, first, K.LONGEST_RUN + 1)
        n = np.arange(len(kept))
        return kept & (n <= at), n >= at

    @classmethod
    def finish(cls, rows: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        return cls._walk(rows, first, 1)[0]

    @classmethod
    def _walk(cls, rows: pd.DataFrame, first: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows in no excursion, for each row the place up to which its key is decided); a run begins only where so many
        rows stand after the one before it. Runs are looked for where a row is far from the next alone."""
        v, n = rows[["lat", "lon", "t_ms"]].to_numpy(float), len(rows)
        begin = np.flatnonzero(first)
        stop = np.append(begin[1:], n)
        size = stop - begin
        end = np.repeat(stop, size)
        km, kmh = _hops(v)
        ask = (np.arange(n) + ahead < end) & ~(km < K.EXCURSION_KM * (1 - _SLACK)) & ~(kmh <= K.EXCURSION_KMH * (1 - _SLACK))
        kept, free = np.ones(n, bool), 0
        for i in np.flatnonzero(ask).tolist():
            if i >= free:
                run = next((r for r in range(K.LONGEST_RUN, 0, -1) if i + r + 1 < end[i] and cls._away(v[i : i + r + 2])), 0)
                kept[i + 1 : i + run + 1], free = False, i + run + 1
        after = np.minimum.accumulate(np.where(kept, np.arange(n), n)[::-1])[::-1]
        return kept, np.repeat(after[np.maximum(begin, stop - ahead)], size)

    @staticmethod
    def _away(v) -> bool:
        """Whether all rows but the first and the last of v are one excursion."""
        km = lambda a, b: km_between(*v[a][:2], *v[b][:2])
        n, after = len(v) - 2, len(v) - 1
        if not 0 <= v[after][2] - v[0][2] <= K.EXCURSION_MS or not km(0, after) <= K.REJOIN_KM:
            return False
        fast = all(_kmh(km(a, b), v[b][2] - v[a][2]) > K.EXCURSION_KMH for a, b in ((0, 1), (n, after)))
        far = all(km(0, i) >= K.EXCURSION_KM and km(i, after) >= K.EXCURSION_KM for i in range(1, after))
        return fast and far and all(km(1, i) <= K.REJOIN_KM for i in range(2, after))


def stationary_collapse(raw: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq"), slice_ms: int | None = None) -> DataFrame:
    """Signals within ten minutes and reach of the last kept one become one, the strictly more accurate."""
    if slice_ms is None:
        return fold_sorted(raw, key, list(order), _Stationary, raw.schema)
    return fold_sorted(_runs(raw, key, order, K.STATIONARY_MS, slice_ms), key, list(order), _Stationary, raw.schema, "__run")


def discontinuities(points: DataFrame, key: str = "traveler_id", order: tuple[str, ...] = ("t_ms", "seq")) -> DataFrame:
    """Key, discontinuities: gaps of over 30 minutes between neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    d = points.withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(w))
    return d.groupBy(key).agg(F.count_if(F.col("gap") > K.GAP_MS).cast("long").alias("discontinuities"))


def clean_raw(raw: DataFrame, most: float | None = K.ACCURACY_M, key: str = "traveler_id") -> DataFrame:
    """Raw signals after the accuracy limit, spikes and stationary noise."""
    good = filter_accuracy(raw, most)
    spikes = spike_filter if most is not None and most <= K.ACCURACY_M else spike_fold
    return stationary_collapse(spikes(good, key), key)


def raw_quality(raw: DataFrame, most: float | None = K.ACCURACY_M, key: str = "traveler_id") -> DataFrame:
    """Key, n_input, accuracy_rejected, noise_rejected, n_kept, discontinuities."""
    n = raw.groupBy(key).agg(F.count("*").alias("n_input"), F.count_if(F.lit(False) if most is None else ~(F.col("accuracy_m") <= most)).cast("long").alias("accuracy_rejected"))
    w = Window.partitionBy(key).orderBy("t_ms", "seq")
    kept = clean_raw(raw, most, key).withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(w))
    k = kept.groupBy(key).agg(F.count("*").alias("n_kept"), F.count_if(F.col("gap") > K.GAP_MS).cast("long").alias("discontinuities"))
    d = n.join(k, key, "left").fillna(0, ["n_kept", "discontinuities"])
    return d.select(key, "n_input", "accuracy_rejected", (F.col("n_input") - F.col("accuracy_rejected") - F.col("n_kept")).alias("noise_rejected"), "n_kept", "discontinuities")
