"""The registered queries of the trajectory operators over the driver's tables, with SQL that says the same.

Names are SURVEY ids with a word or two. Every query runs over its whole tables; those of text forms write each event in one
of many ways, bad ones among them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions import coords, geo, text
from waystone.operators import camera, clean, frames, journey, lookup, pacing, progress, reconcile, tiles
from waystone.plans import sql
from waystone.plans.adapters import export_documents, export_files, export_segments, points, raw_points, table
from waystone.sources import blocks, catalog, exports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def r(c: str, n: int = 3):
    return F.round(c, n).alias(c)


def hops(s: SparkSession, d: str) -> DataFrame:
    h = journey.hops(points(s, d))
    return h.withColumn("i", (F.row_number().over(journey.ordered()) - 1).cast("long"))


def limits_of(h: DataFrame) -> DataFrame:
    return journey.thresholds(h)


def values(forms: list[str | None]) -> str:
    """SQL: a table v(i, k, s): every event's number, which of the forms it takes, and that form with its own two digits for ~."""
    quoted = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in forms)
    n = len(forms)
    return f"(SELECT event_id AS i, event_id % {n} AS k, replace([{quoted}][(event_id % {n} + 1)::INT], '~', lpad((event_id // {n} % 60)::VARCHAR, 2, '0')) AS s FROM events) v"


def written(s: SparkSession, d: str, forms: list[str | None]) -> DataFrame:
    """i, k, s as in values: a text for every event, in one of many ways of writing it."""
    i, n = F.col("event_id"), len(forms)
    form = F.element_at(F.array(*map(F.lit, forms)), (i % n + 1).cast("int"))
    return table(s, d, "events").select(i.alias("i"), (i % n).alias("k"), F.replace(form, F.lit("~"), F.lpad((F.floor(i / n) % 60).cast("string"), 2, "0")).alias("s"))


# --- leaves of exports ---------------------------------------------------------------------------------------------

COORDINATES = ["37.~°, 127.~°", "geo:~.5,1~?z=12", "3750~0000,12700~0000", "~1,127", "not a coordinate ~", "geo:91,1~", None, ",127", " -33.~ , 151.2 ", "1,2,~", "~e1,2E1", "nan,1", ""]
_CLEAN = "replace(replace(split_part(regexp_replace(trim(s), '^geo:', ''), '?', 1), '°', ''), ' ', '')"
_NUM = lambda k: f"CASE WHEN regexp_full_match(split_part(c, ',', {k}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(split_part(c, ',', {k}) AS DOUBLE) END"


@query("p1_parse_coordinate", f"""WITH a AS (SELECT i, {_CLEAN} AS c FROM {values(COORDINATES)}), b AS (SELECT i, {_NUM(1)} AS la, {_NUM(2)} AS lo FROM a),
e AS (SELECT i, CASE WHEN abs(la) > 1e6 OR abs(lo) > 1e6 THEN la/1e7 ELSE la END AS la, CASE WHEN abs(la) > 1e6 OR abs(lo) > 1e6 THEN lo/1e7 ELSE lo END AS lo FROM b)
SELECT i, CASE WHEN ok THEN la END AS lat, CASE WHEN ok THEN lo END AS lon FROM (SELECT *, abs(la) <= 85.05112878 AND abs(lo) <= 180 AS ok FROM e)""")
def p1(s: SparkSession, d: str) -> DataFrame:
    v = written(s, d, COORDINATES).withColumn("p", coords.parse_coordinate(F.col("s")))
    return v.select("i", "p.lat", "p.lon")


INSTANTS = ["2024-05-11T08:~:00Z", "2024-05-11T08:00:~.123456Z", "2024-05-11T08:~:00+09:00", "2024-05-11T08:00:~-0330", "2024-05-11T08:00:~", "2024-05-~", "20~", "noon", None, "2024-13-01T00:00:00Z", "2024-05-11T08:00Z"]


@query("p3_parse_instant", f"""SELECT i, epoch_ms(try_cast(CASE WHEN regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}') THEN
 CASE WHEN regexp_matches(s, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN regexp_replace(s, '([+-][0-9]{{2}})([0-9]{{2}})$', '\\1:\\2') ELSE s || 'Z' END END AS TIMESTAMPTZ)) AS ms,
 NOT regexp_matches(s, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') AS tz_missing FROM {values(INSTANTS)}""")
def p3(s: SparkSession, d: str) -> DataFrame:
    """P3, P4."""
    return written(s, d, INSTANTS).select("i", F.unix_millis(coords.parse_instant(F.col("s"))).alias("ms"), coords.tz_missing(F.col("s")).alias("tz_missing"))


OFFSETS = ["~", "60", "-~", "unknown", "1~.0", "~.5", "", None, "99999999999999999999", "0"]


@query("p5_parse_offset_minutes", f"SELECT i, try_cast(CASE WHEN regexp_full_match(s, '[0-9]+([.]0+)?') THEN split_part(s, '.', 1) END AS BIGINT) AS minutes FROM {values(OFFSETS)}")
def p5(s: SparkSession, d: str) -> DataFrame:
    return written(s, d, OFFSETS).select("i", coords.parse_offset_minutes(F.col("s")).alias("minutes"))


@query("p6_offset_instant", """SELECT event_id, CASE WHEN t + 60000 * m <= t + 3600000 + 60000 THEN t + 60000 * m END AS at_ms
FROM (SELECT event_id, (epoch_us(ts) // 1000) AS t, event_id % 90 AS m FROM events)""")
def p6(s: SparkSession, d: str) -> DataFrame:
    """An offset into an hour's segment, dropped a minute past its end."""
    e = table(s, d, "events").withColumn("st", F.date_trunc("millisecond", F.col("ts").cast("timestamp")))
    at = coords.offset_instant(F.col("st"), F.timestamp_millis(F.unix_millis("st") + 3_600_000), F.col("event_id") % 90)
    return e.select("event_id", F.unix_millis(at).alias("at_ms"))


@query("p11_domain_filter", f"WITH {sql.PTS} SELECT traveler_id, seq FROM pts WHERE abs(lat * 2) <= 85.05112878 AND abs(lon) <= 180")
def p11(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).where(geo.in_domain(F.col("lat") * 2, "lon")).select("traveler_id", "seq")


@query("p12_filter_year", f"WITH {sql.PTS} SELECT traveler_id, count(*) AS n FROM pts WHERE year(ts) = 2024 GROUP BY 1")
def p12(s: SparkSession, d: str) -> DataFrame:
    """P12, A7."""
    return journey.filter_year(points(s, d), 2024).groupBy("traveler_id").agg(F.count("*").alias("n"))


@query("p13_filter_months", f"WITH {sql.PTS} SELECT traveler_id, seq FROM pts WHERE strftime(ts + INTERVAL 9 HOUR, '%Y-%m') BETWEEN '2024-01' AND '2024-01'")
def p13(s: SparkSession, d: str) -> DataFrame:
    return journey.filter_months(points(s, d), "2024-01", "2024-01", zone="+09:00").select("traveler_id", "seq")


@query("p14_filter_dates", f"WITH {sql.PTS} SELECT traveler_id, seq FROM pts WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'")
def p14(s: SparkSession, d: str) -> DataFrame:
    return journey.filter_dates(points(s, d), "2024-01-05", "2024-01-11").select("traveler_id", "seq")


@query("p15_date_keys", f"WITH {sql.PTS} SELECT traveler_id, seq, strftime(ts, '%Y-%m-%d') AS date_key, strftime(ts, '%Y-%m') AS month_key FROM pts")
def p15(s: SparkSession, d: str) -> DataFrame:
    key = journey.local_date()
    return points(s, d).select("traveler_id", "seq", F.date_format(key, "yyyy-MM-dd").alias("date_key"), F.date_format(key, "yyyy-MM").alias("month_key"))


@query("p16_filter_accuracy", f"WITH {sql.RAW} SELECT traveler_id, seq, accuracy_m::DOUBLE AS accuracy_m FROM raw WHERE accuracy_m <= 100")
def p16(s: SparkSession, d: str) -> DataFrame:
    return clean.filter_accuracy(raw_points(s, d)).select("traveler_id", "seq", "accuracy_m")


@query("p20_journey_available", f"WITH {sql.TOTALS} SELECT traveler_id, n_points >= 2 AND total_km > 0 AS available FROM totals")
def p20(s: SparkSession, d: str) -> DataFrame:
    return journey.totals(hops(s, d)).select("traveler_id", "available")


# --- documents -----------------------------------------------------------------------------------------------------


@query("s1_scan_timeline_json", f"""WITH {sql.PTS}, visits AS (SELECT * FROM pts WHERE seq % 3 <> 0), paths AS (SELECT traveler_id, seq, t_ms + 120000 AS t_ms, lat, lon FROM pts WHERE seq % 3 = 0),
kept AS (SELECT * FROM paths p WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.traveler_id = p.traveler_id AND p.t_ms BETWEEN v.t_ms AND v.t_ms + 300000)),
u AS (SELECT traveler_id, t_ms, lat, lon FROM visits UNION ALL SELECT traveler_id, t_ms, lat, lon FROM kept)
SELECT DISTINCT CAST(traveler_id AS VARCHAR) AS source, t_ms, lat, lon FROM u""")
def s1(s: SparkSession, d: str) -> DataFrame:
    """Every user's export, parsed a segment a row and reconciled."""
    seg = exports.flatten_segments(exports.parse_elements(export_segments(s, d)))
    return reconcile.reconcile(seg).select("source", F.unix_millis("ts").alias("t_ms"), "lat", "lon")


@query("s4_scan_raw_signals", f"WITH {sql.RAW} SELECT CAST(traveler_id AS VARCHAR) AS source, t_ms, lat, lon, accuracy_m::DOUBLE AS accuracy_m FROM raw")
def s4(s: SparkSession, d: str) -> DataFrame:
    p = raw_points(s, d)
    at = F.concat(F.format_string("%.6f", "lat"), F.lit(","), F.format_string("%.6f", "lon"))
    iso = F.concat(F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    signal = F.struct(F.struct(at.alias("LatLng"), iso.alias("timestamp"), F.when(F.col("seq") % 2 == 0, F.col("accuracy_m").cast("string")).otherwise(F.format_string("%.1f", "accuracy_m")).alias("accuracyMeters")).alias("position"))
    signals = p.select(F.col("traveler_id").cast("string").alias("source"), F.col("seq").alias("idx"), F.to_json(signal).alias("text"))
    return exports.raw_signals(exports.parse_elements(signals)).select("source", F.unix_millis("ts").alias("t_ms"), "lat", "lon", "accuracy_m")


_SCANNED = f"""{sql.PTS}, visits AS (SELECT * FROM pts WHERE seq % 3 <> 0), paths AS (SELECT traveler_id, seq, t_ms + 120000 AS t_ms, lat, lon FROM pts WHERE seq % 3 = 0),
kept AS (SELECT * FROM paths p WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.traveler_id = p.traveler_id AND p.t_ms BETWEEN v.t_ms AND v.t_ms + 300000)),
u AS (SELECT traveler_id, t_ms, lat, lon FROM visits UNION ALL SELECT traveler_id, t_ms, lat, lon FROM kept)"""


@query("s3_scan_documents", f"WITH {_SCANNED} SELECT DISTINCT CAST(traveler_id AS VARCHAR) AS source, t_ms, lat, lon FROM u WHERE traveler_id % 10 > 5")
def s3(s: SparkSession, d: str) -> DataFrame:
    """Every user's export as one document, the root told apart, parsed and reconciled; four of ten hold points."""
    seg = exports.flatten_segments(exports.parse_documents(export_documents(s, d)))
    return reconcile.reconcile(seg).select("source", F.unix_millis("ts").alias("t_ms"), "lat", "lon")


@query("s2_scan_nested_files", f"WITH {_SCANNED} SELECT DISTINCT CAST(traveler_id AS VARCHAR) AS source, t_ms, lat, lon FROM u WHERE traveler_id % 10 > 5 OR traveler_id % 10 = 1")
def s2(s: SparkSession, d: str) -> DataFrame:
    """Every user's export, nested, written into files of many and read by blocks; of a cut one what stands before the break."""
    e = blocks.read_export_blocks(s, export_files(s, d), bundled=True).where("kind = 'segment'").withColumn("source", F.substring_index("source", "#", -1))
    return reconcile.reconcile(exports.flatten_segments(exports.parse_elements(e))).select("source", F.unix_millis("ts").alias("t_ms"), "lat", "lon")


@query("s5_classify_export", f"""WITH {sql.PTS} SELECT CAST(traveler_id AS VARCHAR) AS source, ['EMPTY', 'MALFORMED', 'LEGACY', 'RAW_ONLY', 'UNSUPPORTED', 'NO_USABLE', 'OK', 'OK', 'OK', 'OK'][(traveler_id % 10 + 1)::INT] AS reason,
 CASE WHEN traveler_id % 10 > 5 THEN count(*) ELSE 0 END AS n_points FROM pts GROUP BY traveler_id""")
def s5(s: SparkSession, d: str) -> DataFrame:
    return exports.classify_exports(exports.parse_documents(export_documents(s, d))).select("source", "reason", "n_points")


_RECORDS = ['[{"uri":"a~","title":"","fileName":"trip.~.mp4","createdAtMillis":5~,"year":20~},{"title":"lost"},{"uri":"b~","title":"B ~","createdAtMillis":9,"startYear":2024,"startMonth":2,"durationSeconds":-~}]', "broken", None]


@query("s12_catalog_scan", f"""WITH r AS (SELECT lpad((i // 3 % 60)::VARCHAR, 2, '0') AS n FROM {values(_RECORDS)} WHERE k = 0)
SELECT 'a' || n AS uri, 'trip.' || n AS title, ('5' || n)::BIGINT AS created_ms, 0 AS duration_s, 2000 + n::INT AS start_year, 2000 + n::INT AS end_year FROM r
UNION ALL SELECT 'b' || n, 'B ' || n, 9::BIGINT, 0, 2024, 2024 FROM r""")
def s12(s: SparkSession, d: str) -> DataFrame:
    """The lists of records of many devices, some broken."""
    # JSON has no numbers with leading zeros
    v = written(s, d, _RECORDS).select(F.regexp_replace("s", "-0([0-9])", "-$1").alias("text"))
    return catalog.newest_first(catalog.read_records(v)).select("uri", "title", "created_ms", "duration_s", "start_year", "end_year")


# --- reconciling ---------------------------------------------------------------------------------------------------

_IV = """iv AS (SELECT user_id AS traveler_id, (epoch_us(ts) // 1000) AS st, (epoch_us(ts) // 1000) + 1000 * (300 + event_id % 5000) AS en FROM events),
fl AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY traveler_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
il AS (SELECT *, sum(new) OVER (PARTITION BY traveler_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM fl),
merged AS (SELECT traveler_id, min(st) AS st, max(en) AS en FROM il GROUP BY traveler_id, island)"""


def intervals(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    st = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("traveler_id"), st.alias("st"), (st + (F.col("event_id") % 5000 + 300) * 1000).alias("en"))


@query("a9_merge_intervals", f"WITH {_IV} SELECT * FROM merged")
def a9(s: SparkSession, d: str) -> DataFrame:
    return reconcile.merge_intervals(intervals(s, d))


@query("j1_reconcile_standalone", f"WITH {_IV}, probe AS (SELECT user_id AS traveler_id, event_id AS seq, (epoch_us(ts) // 1000) + 3000000 AS t_ms FROM events) SELECT traveler_id, seq, t_ms FROM probe p WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.traveler_id = p.traveler_id AND p.t_ms BETWEEN m.st AND m.en)")
def j1(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("traveler_id", "seq", (F.col("t_ms") + 3_000_000).alias("t_ms"))
    return reconcile.uncovered(p, reconcile.merge_intervals(intervals(s, d)), ts="t_ms")


@query("a11_dedupe_points", f"WITH {sql.PTS}, t AS (SELECT traveler_id, seq, t_ms // 86400000 AS day, round(lat, 1) AS lat, round(lon, 1) AS lon FROM pts) SELECT traveler_id, day, lat, lon, min(seq) AS seq FROM t GROUP BY 1, 2, 3, 4")
def a11(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("traveler_id", "seq", F.floor(F.col("t_ms") / 86_400_000).alias("day"), F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon"))
    return reconcile.dedupe_points(p, ["seq"], ms="day").select("traveler_id", "day", "lat", "lon", "seq")


@query("a12_dedupe_raw", f"WITH {sql.RAW}, t AS (SELECT traveler_id, seq, t_ms // 3600000 AS hour, round(lat, 1) AS lat, lon, accuracy_m::DOUBLE AS accuracy_m FROM raw) SELECT traveler_id, hour, lat, lon, accuracy_m, seq FROM t QUALIFY row_number() OVER (PARTITION BY traveler_id, hour, lat, lon ORDER BY accuracy_m, seq) = 1")
def a12(s: SparkSession, d: str) -> DataFrame:
    p = raw_points(s, d).select("traveler_id", "seq", F.floor(F.col("t_ms") / 3_600_000).alias("hour"), F.round("lat", 1).alias("lat"), "lon", "accuracy_m")
    return reconcile.dedupe_raw(p, ["seq"], ms="hour").select("traveler_id", "hour", "lat", "lon", "accuracy_m", "seq")


@query("a15_direction_vote", f"""WITH {sql.PTS}, t AS (SELECT traveler_id, CASE WHEN traveler_id % 2 = 0 THEN -seq ELSE seq END AS o, t_ms FROM pts),
st AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY traveler_id ORDER BY o) AS step FROM t),
g AS (SELECT traveler_id, count(*) FILTER (step >= 129600000) AS up, count(*) FILTER (step <= -129600000) AS down, arg_max(t_ms, o) - arg_min(t_ms, o) AS ends FROM st GROUP BY 1)
SELECT traveler_id, up + CASE WHEN ends >= 129600000 THEN 2 ELSE 0 END AS asc_votes, down + CASE WHEN ends <= -129600000 THEN 2 ELSE 0 END AS desc_votes,
 down + CASE WHEN ends <= -129600000 THEN 2 ELSE 0 END > up + CASE WHEN ends >= 129600000 THEN 2 ELSE 0 END AS reversed FROM g""")
def a15(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).withColumn("o", F.when(F.col("traveler_id") % 2 == 0, -F.col("seq")).otherwise(F.col("seq")))
    return reconcile.direction_vote(p, ["o"])


@query("u1_union_points", f"WITH {sql.PTS} SELECT traveler_id, seq, 'semantic' AS origin FROM pts WHERE seq % 3 <> 0 UNION ALL SELECT traveler_id, seq, 'path' FROM pts WHERE seq % 3 = 0")
def u1(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("traveler_id", "seq")
    return p.where("seq % 3 <> 0").withColumn("origin", F.lit("semantic")).unionByName(p.where("seq % 3 = 0").withColumn("origin", F.lit("path")))


# --- cleaning ------------------------------------------------------------------------------------------------------


@query("w9_outlier_filter", f"{sql.OUTLIERS} SELECT traveler_id, seq FROM nb ANTI JOIN gone USING (traveler_id, i)")
def w9(s: SparkSession, d: str) -> DataFrame:
    """W9, P21."""
    return clean.outlier_filter(points(s, d)).select("traveler_id", "seq")


@query("w10_raw_spike_filter", f"{sql.SPIKES} SELECT traveler_id, seq FROM clean")
def w10(s: SparkSession, d: str) -> DataFrame:
    return clean.spike_filter(clean.filter_accuracy(raw_points(s, d))).select("traveler_id", "seq")


@query("w11_stationary_collapse", f"{sql.STATIONARY} SELECT traveler_id, seq, t_ms, lat, accuracy_m::DOUBLE AS accuracy_m FROM kept")
def w11(s: SparkSession, d: str) -> DataFrame:
    return clean.clean_raw(raw_points(s, d)).select("traveler_id", "seq", "t_ms", "lat", "accuracy_m")


@query("w12_discontinuities", f"WITH {sql.RAW}, g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq) AS gap FROM raw WHERE accuracy_m <= 30) SELECT traveler_id, count(*) FILTER (gap > 1800000) AS discontinuities FROM g GROUP BY 1")
def w12(s: SparkSession, d: str) -> DataFrame:
    return clean.discontinuities(clean.filter_accuracy(raw_points(s, d), 30))


@query("a13_raw_quality_stats", f"""{sql.STATIONARY}, g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq) AS gap FROM kept),
k AS (SELECT traveler_id, count(*) AS n_kept, count(*) FILTER (gap > 1800000) AS discontinuities FROM g GROUP BY 1),
n AS (SELECT traveler_id, count(*) AS n_input, count(*) FILTER (NOT accuracy_m <= 100) AS accuracy_rejected FROM raw GROUP BY 1)
SELECT traveler_id, n_input, accuracy_rejected, n_input - accuracy_rejected - n_kept AS noise_rejected, n_kept, discontinuities FROM n JOIN k USING (traveler_id)""")
def a13(s: SparkSession, d: str) -> DataFrame:
    return clean.raw_quality(raw_points(s, d))


@query("a14_selection_summary", f"""{sql.OUTLIERS}, kept AS (SELECT traveler_id, seq, t_ms, lat, lon FROM nb ANTI JOIN gone USING (traveler_id, i)),
l AS (SELECT *, lag(lat) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq) AS pa, lag(lon) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq) AS po FROM kept),
k AS (SELECT traveler_id, count(*) AS n_points, sum(coalesce({sql.hav('pa', 'po', 'lat', 'lon')}, 0.0)) AS km FROM l GROUP BY 1), n AS (SELECT traveler_id, count(*) AS n FROM pts GROUP BY 1)
SELECT traveler_id, n_points, n - n_points AS ignored, round(km * 0.621371192237334, 0) AS distance, CASE WHEN n_points = 1 THEN 'one point' WHEN km <= 0 THEN 'no movement' ELSE 'normal' END AS state FROM n JOIN k USING (traveler_id)""")
def a14(s: SparkSession, d: str) -> DataFrame:
    """A14, A20."""
    p = points(s, d)
    return journey.selection_summary(p, clean.outlier_filter(p), "mi")


# --- distances -----------------------------------------------------------------------------------------------------


@query("w1_hop_distance", f"WITH {sql.HOPS} SELECT traveler_id, seq, round(hop_km, 3) AS hop_km FROM hops")
def w1(s: SparkSession, d: str) -> DataFrame:
    return journey.hops(points(s, d)).select("traveler_id", "seq", r("hop_km"))


@query("w2_cumulative_distance", f"WITH {sql.HOPS} SELECT traveler_id, seq, round(cum_km, 3) AS cum_km FROM hops")
def w2(s: SparkSession, d: str) -> DataFrame:
    """W2 by slices of time, as for a traveller with very many points."""
    return journey.hops(points(s, d), slice_ms=7 * 86_400_000).select("traveler_id", "seq", r("cum_km"))


@query("a10_total_distance", f"WITH {sql.TOTALS} SELECT traveler_id, n_points, round(total_km, 3) AS total_km FROM totals")
def a10(s: SparkSession, d: str) -> DataFrame:
    return journey.totals(journey.hops(points(s, d))).select("traveler_id", "n_points", r("total_km"))


@query("a5_transfer_threshold", f"WITH {sql.LIMITS} SELECT traveler_id, round(median_hop, 6) AS median_hop, round(mad_hop, 6) AS mad_hop, round(threshold_km, 6) AS threshold_km FROM limits")
def a5(s: SparkSession, d: str) -> DataFrame:
    """A3–A5."""
    return limits_of(hops(s, d)).select("traveler_id", r("median_hop", 6), r("mad_hop", 6), r("threshold_km", 6))


@query("w8_build_legs", f"WITH {sql.LEGS} SELECT traveler_id, leg_no, round(start_km, 3) AS start_km, round(end_km, 3) AS end_km, is_transfer FROM legs")
def w8(s: SparkSession, d: str) -> DataFrame:
    h = hops(s, d)
    return journey.legs(h, limits_of(h)).select("traveler_id", F.col("leg_no").cast("long").alias("leg_no"), r("start_km"), r("end_km"), "is_transfer")


_DENSE = sql.great("coalesce(lat0, lat)", "coalesce(lon0, lon)", "lat", "lon", "f")


@query("w3_densify", f"""WITH {sql.HOPS}, st AS (SELECT *, CASE WHEN lat0 IS NULL THEN 1 ELSE greatest(1, least(320, ceil(hop_km / 75.0)::INT)) END AS steps FROM hops),
ex AS (SELECT *, unnest(generate_series(1, steps)) AS k FROM st), fx AS (SELECT *, k::DOUBLE / steps AS f FROM ex)
SELECT traveler_id, seq, CAST(k AS INT) AS k, round({_DENSE[0]}, 6) AS lat, round({_DENSE[1]}, 6) AS lon, round(cum0_km + hop_km * f, 3) AS at_km FROM fx""")
def w3(s: SparkSession, d: str) -> DataFrame:
    return journey.densify(hops(s, d)).select("traveler_id", "seq", "k", r("lat", 6), r("lon", 6), r("at_km"))


@query("w3_virtual_samples", f"""WITH {sql.HOPS}, st AS (SELECT *, CASE WHEN lat0 IS NULL THEN 1 ELSE greatest(1, least(320, ceil(hop_km / 75.0)::INT)) END AS steps FROM hops),
ex AS (SELECT *, unnest(generate_series(1, steps)) AS k FROM st), fx AS (SELECT *, k::DOUBLE / steps AS f, row_number() OVER (PARTITION BY traveler_id ORDER BY t_ms, seq, k) AS n, count(*) OVER (PARTITION BY traveler_id) AS n_all FROM ex),
asked AS (SELECT DISTINCT traveler_id, 1 + (n_all - 1) * j // 49 AS n FROM (SELECT DISTINCT traveler_id, n_all FROM fx), generate_series(0, 49) g(j))
SELECT traveler_id, n, round({_DENSE[0]}, 6) AS lat, round({_DENSE[1]}, 6) AS lon, round(cum0_km + hop_km * f, 3) AS at_km FROM fx JOIN asked USING (traveler_id, n)""")
def w3_virtual(s: SparkSession, d: str) -> DataFrame:
    """Fifty samples of every densified journey, found without making the others."""
    return lookup.even_samples(hops(s, d), 50).select("traveler_id", "n", r("lat", 6), r("lon", 6), r("at_km"))


@query("w4_unwrap_dateline", f"WITH {sql.UNWRAPPED} SELECT traveler_id, seq, round(x, 9) AS x, round(y, 9) AS y FROM un")
def w4(s: SparkSession, d: str) -> DataFrame:
    """W4, X4."""
    return journey.unwrapped(points(s, d)).select("traveler_id", "seq", r("x", 9), r("y", 9))


@query("w5_unwrap_near", f"WITH {sql.UNWRAPPED} SELECT traveler_id, seq, round(CASE WHEN d > 0.5 THEN v - ceil(d - 0.5) WHEN d < -0.5 THEN v + ceil(-d - 0.5) ELSE v END, 9) AS near, round(v - floor(d + 0.5), 9) AS wrapped FROM (SELECT traveler_id, seq, x * 3 AS v, x * 3 - 0.77 AS d FROM un)")
def w5(s: SparkSession, d: str) -> DataFrame:
    u = journey.unwrapped(points(s, d))
    return u.select("traveler_id", "seq", F.round(geo.unwrap_near(F.col("x") * 3, 0.77), 9).alias("near"), F.round(geo.wrap_near(F.col("x") * 3, 0.77), 9).alias("wrapped"))


_BOUNDS = "bounds AS (SELECT traveler_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM un GROUP BY 1)"


@query("a1_world_bounds", f"WITH {sql.UNWRAPPED}, {_BOUNDS} SELECT traveler_id, round(min_x, 9) AS min_x, round(max_x, 9) AS max_x, round(min_y, 9) AS min_y, round(max_y, 9) AS max_y FROM bounds")
def a1(s: SparkSession, d: str) -> DataFrame:
    """A1 by way of A2's blocks."""
    b = journey.block_bounds(journey.unwrapped(points(s, d)))
    return b.groupBy("traveler_id").agg(*[F.round((F.min if c[:3] == "min" else F.max)(c), 9).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("a2_block_bounds", f"WITH {sql.UNWRAPPED}, b AS (SELECT *, (row_number() OVER (PARTITION BY traveler_id ORDER BY t_ms, seq) - 1) // 256 AS block FROM un) SELECT traveler_id, block, count(*) AS n, round(min(x), 9) AS min_x, round(max(x), 9) AS max_x, round(min(y), 9) AS min_y, round(max(y), 9) AS max_y FROM b GROUP BY 1, 2")
def a2(s: SparkSession, d: str) -> DataFrame:
    return journey.block_bounds(journey.unwrapped(points(s, d))).select("traveler_id", "block", "n", *[r(c, 9) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("w6_shortest_wrapped_x", f"""WITH {sql.UNWRAPPED}, m AS (SELECT traveler_id, x - floor(x) AS x FROM un), g AS (SELECT traveler_id, min(x) AS a, max(x) AS b, min(CASE WHEN x < 0.5 THEN x + 1 ELSE x END) AS c, max(CASE WHEN x < 0.5 THEN x + 1 ELSE x END) AS d FROM m GROUP BY 1)
SELECT traveler_id, round(CASE WHEN d - c < b - a THEN c ELSE a END, 6) AS min_x, round(CASE WHEN d - c < b - a THEN d ELSE b END, 6) AS max_x FROM g""")
def w6(s: SparkSession, d: str) -> DataFrame:
    return journey.shortest_wrapped(journey.unwrapped(points(s, d))).select("traveler_id", r("min_x", 6), r("max_x", 6))


@query("w21_chronological_check", f"WITH {sql.PTS}, t AS (SELECT traveler_id, coalesce(lag(t_ms) OVER (PARTITION BY traveler_id ORDER BY seq) <= t_ms, true) AS ok FROM pts) SELECT traveler_id, bool_and(ok) AS chronological FROM t GROUP BY 1")
def w21(s: SparkSession, d: str) -> DataFrame:
    return journey.chronological(points(s, d))


@query("w20_overview_split")
def w20(s: SparkSession, d: str) -> DataFrame:
    return journey.overview_split(journey.unwrapped(points(s, d))).select("traveler_id", "part", "part_no", r("x", 9), r("y", 9))


@query("a8_available_months", f"WITH {sql.PTS} SELECT DISTINCT traveler_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%B %Y') AS label FROM pts")
def a8(s: SparkSession, d: str) -> DataFrame:
    """A8, X10."""
    return journey.available_months(points(s, d))


@query("a16_date_extent", f"WITH {sql.PTS} SELECT traveler_id, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, strftime(min(ts), '%Y-%m') AS first_month, strftime(max(ts), '%Y-%m') AS last_month FROM pts GROUP BY 1")
def a16(s: SparkSession, d: str) -> DataFrame:
    return journey.date_extent(points(s, d))


@query("o1_sort_points", f"WITH {sql.PTS} SELECT traveler_id, seq, row_number() OVER (PARTITION BY traveler_id ORDER BY t_ms, seq) AS n FROM pts")
def o1(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).select("traveler_id", "seq", F.row_number().over(journey.ordered()).cast("long").alias("n"))


@query("o5_years_desc", f"WITH {sql.PTS} SELECT DISTINCT year(ts) AS year FROM pts")
def o5(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).select(F.year("ts").cast("long").alias("year")).distinct().orderBy(F.desc("year"))


@query("o10_last_point", f"WITH {sql.PTS} SELECT traveler_id, arg_max(seq, (t_ms, seq)) AS seq FROM pts GROUP BY 1")
def o10(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).groupBy("traveler_id").agg(F.max_by("seq", F.struct("t_ms", "seq")).alias("seq"))


@query("z2_sessions", f"""WITH {sql.RAW}, f AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER w > 1800000 OR lag(t_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM raw WHERE accuracy_m <= 30 WINDOW w AS (PARTITION BY traveler_id ORDER BY t_ms, seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT traveler_id, min(t_ms) AS st, max(t_ms) AS en, count(*) AS n FROM i GROUP BY traveler_id, island""")
def z2(s: SparkSession, d: str) -> DataFrame:
    """Z2's sessions over a batch."""
    p = clean.filter_accuracy(raw_points(s, d), 30).withColumn("ts", F.timestamp_millis("t_ms"))
    g = p.groupBy("traveler_id", F.session_window("ts", "30 minutes")).agg(F.min("t_ms").alias("st"), F.max("t_ms").alias("en"), F.count("*").alias("n"))
    return g.select("traveler_id", "st", "en", "n")


@query("x_cube_summary", f"WITH {sql.HOPS} SELECT traveler_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(hop_km), 3) AS km FROM hops GROUP BY CUBE (traveler_id, strftime(ts, '%Y-%m-%d'))")
def cube(s: SparkSession, d: str) -> DataFrame:
    """An extension: points and distance by traveller, day, both and neither."""
    h = journey.hops(points(s, d)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return h.cube("traveler_id", "day").agg(F.count("*").alias("n"), F.round(F.sum("hop_km"), 3).alias("km"))


# --- pacing, lookups -----------------------------------------------------------------------------------------------

_PROBE = "probes AS (SELECT t.traveler_id, f AS frame, total_km * f / 40.0 AS d FROM totals t, generate_series(0, 40) g(f) WHERE total_km > 0 AND n_points >= 2)"


def probes(h: DataFrame) -> DataFrame:
    t = journey.totals(h).where("available")
    return t.select("traveler_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))).alias("frame"), "total_km").select("traveler_id", "frame", (F.col("total_km") * F.col("frame") / 40.0).alias("d"))


@query("w14_pacing_curve", f"WITH {sql.CURVE} SELECT traveler_id, k, round(x, 9) AS x, round(y, 3) AS y, round(m / 1000, 3) AS m FROM curve")
def w14(s: SparkSession, d: str) -> DataFrame:
    """W13–W15."""
    h = hops(s, d)
    c = pacing.pacing_curve(pacing.pacing_knots(h, limits_of(h)))
    return c.select("traveler_id", "k", r("x", 9), r("y"), F.round(F.col("m") / 1000, 3).alias("m"))


_POS = sql.great("lat0", "lon0", "lat", "lon", "f")


@query("j2_position_at_distance", f"""WITH {sql.TOTALS}, {_PROBE},
m AS (SELECT p.*, h.lat0, h.lon0, h.lat, h.lon, h.i, h.hop_km, h.cum0_km FROM probes p, LATERAL (SELECT * FROM hops h WHERE h.traveler_id = p.traveler_id AND h.i >= 1 AND h.cum_km >= least(p.d, (SELECT max(cum_km) FROM hops z WHERE z.traveler_id = p.traveler_id)) ORDER BY h.cum_km, h.i LIMIT 1) h),
g AS (SELECT *, CASE WHEN hop_km > 0 THEN greatest(0.0, least(1.0, (d - cum0_km) / hop_km)) ELSE 0.0 END AS f FROM m)
SELECT traveler_id, frame, i AS index, round({_POS[0]}, 6) AS lat, round({_POS[1]}, 6) AS lon, round(f, 6) AS fraction FROM g""")
def j2(s: SparkSession, d: str) -> DataFrame:
    """J2, X2."""
    h = hops(s, d)
    return lookup.positions_at(probes(h), h).select("traveler_id", "frame", "index", r("lat", 6), r("lon", 6), r("fraction", 6))


@query("j3_leg_at", f"""WITH {sql.LEGS}, {_PROBE}
SELECT p.traveler_id, p.frame, l.leg_no, l.is_transfer FROM probes p, LATERAL (SELECT * FROM legs l WHERE l.traveler_id = p.traveler_id AND (l.start_km <= p.d OR l.leg_no = 1) ORDER BY leg_no DESC LIMIT 1) l""")
def j3(s: SparkSession, d: str) -> DataFrame:
    h = hops(s, d)
    return lookup.legs_at(probes(h), journey.legs(h, limits_of(h))).select("traveler_id", "frame", F.col("leg_no").cast("long").alias("leg_no"), "is_transfer")


@query("j5_pacing_lookup", f"""WITH {sql.CURVE}, pr AS (SELECT traveler_id, total_km, f AS frame, f / 40.0 AS p FROM totals, generate_series(0, 40) g(f) WHERE total_km > 0),
nx AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM curve WINDOW w AS (PARTITION BY traveler_id ORDER BY k)),
b AS (SELECT pr.*, c.* EXCLUDE (traveler_id) FROM pr, LATERAL (SELECT * FROM nx c WHERE c.traveler_id = pr.traveler_id AND c.x <= pr.p ORDER BY c.x DESC, c.k DESC LIMIT 1) c),
t AS (SELECT *, (p - x) / (x1 - x) AS t FROM b)
SELECT traveler_id, frame, round(greatest(0.0, least(total_km, CASE WHEN x1 IS NULL OR p = x THEN y ELSE (2*t*t*t - 3*t*t + 1)*y + (t*t*t - 2*t*t + t)*(x1 - x)*m + (3*t*t - 2*t*t*t)*y1 + (t*t*t - t*t)*(x1 - x)*m1 END)), 2) AS d FROM t""")
def j5(s: SparkSession, d: str) -> DataFrame:
    """J5, X7."""
    h = hops(s, d)
    c = pacing.pacing_curve(pacing.pacing_knots(h, limits_of(h)))
    t = journey.totals(h)
    p = t.where("available").select("traveler_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))).alias("frame")).withColumn("p", F.col("frame") / 40.0)
    return pacing.distance_at(p, c, t).select("traveler_id", "frame", r("d", 2))


@query("j6_frame_point_index", f"WITH {sql.TOTALS}, {_PROBE} SELECT p.traveler_id, p.frame, max(h.i) AS index FROM probes p JOIN hops h ON h.traveler_id = p.traveler_id AND h.cum_km <= p.d + 1e-6 GROUP BY 1, 2")
def j6(s: SparkSession, d: str) -> DataFrame:
    h = hops(s, d)
    return lookup.point_index_at(probes(h).withColumn("d", F.col("d") + 1e-6), h).select("traveler_id", "frame", "index")


# --- camera, tiles, frames -----------------------------------------------------------------------------------------


def track_of(s: SparkSession, d: str, name: str, framing: float | None = None) -> DataFrame:
    h = hops(s, d)
    lim, t = limits_of(h), journey.totals(h)
    return camera.journey_camera(h, journey.legs(h, lim), t, pacing.pacing_curve(pacing.pacing_knots(h, lim)), K.MOVEMENTS[name], framing)


def shown(track: DataFrame) -> DataFrame:
    return track.select("traveler_id", "sample", r("center_x", 6), r("center_y", 6), r("span_y", 6), "zoom")


@query("w16_raw_viewports")
def w16(s: SparkSession, d: str) -> DataFrame:
    """Steady windows over a linear journey."""
    h = hops(s, d)
    t, m = journey.totals(h), K.MOVEMENTS["steady"]
    return camera.journey_viewports(h, None, t, None, m).select("traveler_id", "sample", r("center_x", 6), r("center_y", 6), r("span_y", 6))


@query("w17_camera_steady")
def w17(s: SparkSession, d: str) -> DataFrame:
    return shown(track_of(s, d, "steady"))


@query("w18_camera_dynamic_framed")
def w18(s: SparkSession, d: str) -> DataFrame:
    """W18, W19, T4."""
    return shown(track_of(s, d, "dynamic", K.FRAMING["balanced"]))


@query("a6_fixed_zoom")
def a6(s: SparkSession, d: str) -> DataFrame:
    return track_of(s, d, "fixed").groupBy("traveler_id").agg(F.round(F.min("span_y"), 6).alias("span_y"), F.countDistinct("span_y").alias("spans"))


@query("j4_camera_at")
def j4(s: SparkSession, d: str) -> DataFrame:
    t = track_of(s, d, "steady")
    p = journey.totals(hops(s, d)).where("available").select("traveler_id", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("n")).withColumn("p", F.col("n") / 100.0)
    return camera.camera_at(p, t).select("traveler_id", "n", r("center_x", 6), r("center_y", 6), r("span_y", 6), "zoom")


_SAFE = "34.0*2/3 AS l, 152.0*2/3 AS t, 480 - 34.0*2/3 AS r, 480 - 34.0*2/3 AS b"
_OVERVIEW = f"""{_BOUNDS}, ow AS (SELECT *, greatest((max_x - min_x) / (r - l), (max_y - min_y) / (b - t)) * 1.22 AS w FROM bounds, (SELECT {_SAFE})),
os AS (SELECT *, greatest(0.0003, w * 480) AS sx, greatest(0.0003, least(1.25, w * 480)) AS sy, greatest(w, 0.0003 / 480) AS wp FROM ow),
op AS (SELECT *, (min_x + max_x) / 2 - (l + r) / 2 * wp AS x0, (min_y + max_y) / 2 - (t + b) / 2 * wp AS yy FROM os),
overview AS (SELECT traveler_id, x0 AS min_x, x0 + sx AS max_x, CASE WHEN sy <= 1 THEN greatest(0.0, least(1 - sy, yy)) ELSE yy END AS min_y, CASE WHEN sy <= 1 THEN greatest(0.0, least(1 - sy, yy)) ELSE yy END + sy AS max_y,
  CAST(greatest(2, least(15, floor(log2(480 / (sx * 256))))) AS INT) AS zoom FROM op)"""


def overview(s: SparkSession, d: str) -> DataFrame:
    return camera.overview_viewport(journey.world_bounds(journey.unwrapped(points(s, d))), 480, 480)


@query("t6_overview_viewport", f"WITH {sql.UNWRAPPED}, {_OVERVIEW} SELECT traveler_id, round(min_x, 9) AS min_x, round(max_x, 9) AS max_x, round(min_y, 9) AS min_y, round(max_y, 9) AS max_y, zoom FROM overview")
def t6(s: SparkSession, d: str) -> DataFrame:
    """T6, T9."""
    return overview(s, d).select("traveler_id", *[r(c, 9) for c in ("min_x", "max_x", "min_y", "max_y")], "zoom")


@query("t8_square_viewport", f"""WITH {sql.UNWRAPPED}, {_BOUNDS}, q AS (SELECT *, greatest(0.002, greatest(max_x - min_x, max_y - min_y) * 1.28) AS s FROM bounds),
c AS (SELECT *, (min_x + max_x) / 2 AS cx, CASE WHEN s >= 1 THEN 0.5 ELSE greatest(s / 2, least(1 - s / 2, (min_y + max_y) / 2)) END AS cy FROM q)
SELECT traveler_id, round(cx - s/2, 9) AS min_x, round(cx + s/2, 9) AS max_x, round(cy - s/2, 9) AS min_y, round(cy + s/2, 9) AS max_y FROM c""")
def t8(s: SparkSession, d: str) -> DataFrame:
    """T8, T12."""
    v = camera.square_viewport(journey.world_bounds(journey.unwrapped(points(s, d))))
    return v.select("traveler_id", *[r(c, 9) for c in ("min_x", "max_x", "min_y", "max_y")])


_TILES = """tx AS (SELECT traveler_id, zoom, (1 << zoom)::BIGINT AS n, floor(min_x * (1 << zoom))::BIGINT AS x0, floor(max_x * (1 << zoom))::BIGINT AS x1,
  greatest(0, least((1 << zoom) - 1, floor(min_y * (1 << zoom))))::BIGINT AS y0, greatest(0, least((1 << zoom) - 1, floor(max_y * (1 << zoom))))::BIGINT AS y1 FROM {v}),
ty AS (SELECT *, unnest(generate_series(x0, x1)) AS world_x FROM tx), tiles AS (SELECT *, unnest(generate_series(y0, y1)) AS y, ((world_x % n) + n) % n AS x FROM ty)"""


@query("t10_required_tiles", f"WITH {sql.UNWRAPPED}, {_OVERVIEW}, {_TILES.format(v='overview')} SELECT traveler_id, zoom, x, y, world_x FROM tiles")
def t10(s: SparkSession, d: str) -> DataFrame:
    return tiles.required_tiles(overview(s, d), "traveler_id")


_POINT_VIEWS = "pv AS (SELECT traveler_id, x - 0.01 AS min_x, x + 0.01 AS max_x, greatest(0.0, y - 0.01) AS min_y, least(1.0, y + 0.01) AS max_y, 6 AS zoom FROM un)"


def point_views(s: SparkSession, d: str) -> DataFrame:
    u = journey.unwrapped(points(s, d))
    return u.select("traveler_id", (F.col("x") - 0.01).alias("min_x"), (F.col("x") + 0.01).alias("max_x"), F.greatest(F.lit(0.0), F.col("y") - 0.01).alias("min_y"), F.least(F.lit(1.0), F.col("y") + 0.01).alias("max_y"), F.lit(6).alias("zoom"))


@query("t11_tiles_for_export", f"WITH {sql.UNWRAPPED}, {_OVERVIEW}, {_POINT_VIEWS}, av AS (SELECT * FROM pv UNION ALL SELECT * FROM overview), {_TILES.format(v='av')} SELECT DISTINCT traveler_id, zoom, x, y FROM tiles")
def t11(s: SparkSession, d: str) -> DataFrame:
    """T11, U2."""
    return tiles.tiles_for_export(point_views(s, d), overview(s, d))


@query("j8_missing_tiles", f"WITH {sql.UNWRAPPED}, {_POINT_VIEWS}, {_TILES.format(v='pv')} SELECT DISTINCT zoom, x, y FROM tiles WHERE (x + y) % 3 <> 0")
def j8(s: SparkSession, d: str) -> DataFrame:
    need = tiles.required_tiles(point_views(s, d)).select("zoom", "x", "y").distinct()
    return tiles.missing_tiles(need, need.where("(x + y) % 3 = 0"))


@query("t1_meters_to_tile", f"""WITH {sql.PTS}, m AS (SELECT traveler_id, seq, 6378137.0 * radians(lon) AS x, 6378137.0 * ln(tan(pi()/4 + radians(lat)/2)) AS y FROM pts)
SELECT traveler_id, seq, round(x, 3) AS x, round(y, 3) AS y, CAST(trunc((x + 20037508.342789244) / (2*20037508.342789244) * 1024) AS INT) AS tx, CAST(trunc((20037508.342789244 - y) / (2*20037508.342789244) * 1024) AS INT) AS ty FROM m""")
def t1(s: SparkSession, d: str) -> DataFrame:
    """T1, X3."""
    p = points(s, d).select("traveler_id", "seq", geo.mercator_m("lat", "lon").alias("m")).select("traveler_id", "seq", "m.x", "m.y").withColumn("t", geo.meters_to_tile("x", "y", 10))
    return p.select("traveler_id", "seq", r("x"), r("y"), "t.tx", "t.ty")


@query("t2_map_plan")
def t2(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("traveler_id", "seq", geo.mercator_m("lat", "lon").alias("m"))
    v = p.select("traveler_id", "seq", F.col("m.x").alias("cx"), F.col("m.y").alias("cy"), ((F.col("seq") % 50 + 1) * 20000.0).alias("span"))
    return tiles.map_plan(v, 900, "traveler_id", "seq")


@query("t13_frame_table", """SELECT event_id, CAST(f AS INT) AS frame, CASE WHEN f < 240 THEN f / 239.0 ELSE 1.0 END AS journey_progress, CASE WHEN f < 240 THEN 0.0 ELSE least(1.0, (f - 240 + 1) / 24.0) END AS outro_progress
FROM (SELECT event_id, event_id % 300 AS f FROM events) WHERE f < 276""")
def t13(s: SparkSession, d: str) -> DataFrame:
    """Every event as a frame that is asked for; those after the last one aren't there."""
    asked = table(s, d, "events").select("event_id", (F.col("event_id") % 300).cast("int").alias("frame"))
    return asked.join(frames.frame_table(s, 10, 24), "frame").select("event_id", "frame", "journey_progress", "outro_progress")


@query("t14_frame_positions")
def t14(s: SparkSession, d: str) -> DataFrame:
    h = hops(s, d)
    c = pacing.pacing_curve(pacing.pacing_knots(h, limits_of(h)))
    f = frames.frame_positions(frames.frame_table(s, 10, 24), h, journey.totals(h), c)
    return f.select("traveler_id", "frame", r("d"), r("lat", 6), r("lon", 6), r("x", 8), r("y", 8), "index")


@query("t7_blended_views")
def t7(s: SparkSession, d: str) -> DataFrame:
    last = track_of(s, d, "steady").where(f"sample = {K.CAMERA_SAMPLES}")
    f = last.select("traveler_id", "center_x", "center_y", "span_y", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n")).withColumn("outro", F.col("n") / 24.0)
    return camera.blend_viewports(f, overview(s, d)).select("traveler_id", "n", r("center_x", 6), r("center_y", 6), r("span_y", 6))


@query("t15_world_to_screen", f"""WITH {sql.UNWRAPPED}, {_OVERVIEW}, j AS (SELECT u.traveler_id, seq, x, y, o.min_x, o.max_x, o.min_y, o.max_y, x - (o.min_x + o.max_x) / 2 AS d FROM un u JOIN overview o USING (traveler_id)),
n AS (SELECT *, CASE WHEN d > 0.5 THEN x - ceil(d - 0.5) WHEN d < -0.5 THEN x + ceil(-d - 0.5) ELSE x END AS nx FROM j)
SELECT traveler_id, seq, round((nx - min_x) / (max_x - min_x) * 480, 3) AS sx, round((y - min_y) / (max_y - min_y) * 480, 3) AS sy FROM n""")
def t15(s: SparkSession, d: str) -> DataFrame:
    j = journey.unwrapped(points(s, d)).select("traveler_id", "seq", "x", "y").join(overview(s, d), "traveler_id")
    p = frames.world_to_screen(F.col("x"), F.col("y"), F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"), 480, 480)
    return j.withColumn("p", p).select("traveler_id", "seq", F.round("p.sx", 3).alias("sx"), F.round("p.sy", 3).alias("sy"))


@query("w23_trail_window", f"""WITH {sql.TOTALS}, {_PROBE}, b AS (SELECT p.*, least(total_km, greatest(80.0, least(2000.0, total_km * 2.5 / 10))) AS tr FROM probes p JOIN totals USING (traveler_id))
SELECT traveler_id, frame, CAST(band AS INT) AS band, round(greatest(0.0, d - tr * hi), 3) AS from_km, round(greatest(0.0, d - tr * lo), 3) AS to_km FROM b, (VALUES (1, 0.0, 0.45), (2, 0.45, 0.75), (3, 0.75, 1.0)) v(band, lo, hi)""")
def w23(s: SparkSession, d: str) -> DataFrame:
    h = hops(s, d)
    return frames.trail_bands(probes(h), journey.totals(h), 10).select("traveler_id", "frame", "band", r("from_km"), r("to_km"))


@query("w23_trail_points", f"""WITH {sql.TOTALS}, {_PROBE}, b AS (SELECT p.*, least(total_km, greatest(80.0, least(2000.0, total_km * 2.5 / 10))) AS tr FROM probes p JOIN totals USING (traveler_id)),
w AS (SELECT traveler_id, frame, band, greatest(0.0, d - tr * hi) AS from_km, greatest(0.0, d - tr * lo) AS to_km FROM b, (VALUES (1, 0.0, 0.45), (2, 0.45, 0.75), (3, 0.75, 1.0)) v(band, lo, hi))
SELECT w.traveler_id, frame, CAST(band AS INT) AS band, seq FROM w JOIN hops h ON h.traveler_id = w.traveler_id AND round(cum_km, 6) >= round(from_km, 6) AND (round(cum_km, 6) < round(to_km, 6) OR (band = 1 AND round(cum_km, 6) = round(to_km, 6)))""")
def w23_points(s: SparkSession, d: str) -> DataFrame:
    """The points of every band of the trail on every frame."""
    h = hops(s, d)
    p = frames.trail_points(frames.trail_bands(probes(h), journey.totals(h), 10), h)
    return p.join(h.select("traveler_id", "i", "seq"), ["traveler_id", "i"]).select("traveler_id", "frame", "band", "seq")


@query("t18_video_format", "SELECT s_suppkey, v.* FROM (SELECT s_suppkey, ['square', 'portrait', 'landscape'][(s_suppkey % 3 + 1)::INT] AS aspect, ['480', '720', '1080', '2160'][(s_suppkey // 3 % 4 + 1)::INT] AS resolution FROM supplier) JOIN (VALUES " + ", ".join(f"('{a}', '{q}', {w}, {h}, {f}, {b}, {min(w, h)} / 720.0)" for a, q, w, h, f, b in K.FORMATS) + ") v(aspect, resolution, width, height, fps, bit_rate, overlay_scale) USING (aspect, resolution)")
def t18(s: SparkSession, d: str) -> DataFrame:
    """The format that every supplier asks for; there is none of 2160 lines."""
    n = F.col("s_suppkey")
    one = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    asked = table(s, d, "supplier").select("s_suppkey", one(["square", "portrait", "landscape"], n).alias("aspect"), one(["480", "720", "1080", "2160"], F.floor(n / 3)).alias("resolution"))
    return asked.join(frames.video_formats(s), ["aspect", "resolution"]).select("s_suppkey", "aspect", "resolution", "width", "height", "fps", "bit_rate", "overlay_scale")


@query("t16_overlay_card", """SELECT event_id, round((w - least(w - 68 * u, 652 * u)) / 2, 6) AS card_left, round(28 * u, 6) AS card_top, round((w + least(w - 68 * u, 652 * u)) / 2, 6) AS card_right, round(132 * u, 6) AS card_bottom
FROM (SELECT *, least(w, h) / 720.0::DOUBLE AS u FROM (SELECT event_id, 240 + event_id % 1681 AS w, 240 + event_id % 1009 AS h FROM events))""")
def t16(s: SparkSession, d: str) -> DataFrame:
    """T16 on a picture of any size for every event."""
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 1681 + 240).alias("w"), (F.col("event_id") % 1009 + 240).alias("h"))
    c = e.withColumn("card", frames.overlay_card(F.col("w"), F.col("h")))
    return c.select("event_id", *[F.round(f"card.{k}", 6).alias(f"card_{k}") for k in ("left", "top", "right", "bottom")])


@query("t19_progress_weights", "SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN f * 0.1 WHEN 1 THEN f * 0.8 + 0.1 ELSE f * 0.1 + 0.9 END, 6) AS fraction FROM (SELECT event_id, (event_id % 101) / 100.0 AS f FROM events)")
def t19(s: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("event_id") % 3 == 0, "map").when(F.col("event_id") % 3 == 1, "journey").otherwise("finish")
    return table(s, d, "events").select("event_id", F.round(frames.export_fraction(phase, F.col("event_id") % 101 / 100.0), 6).alias("fraction"))


# --- scalars and catalog -------------------------------------------------------------------------------------------


@query("x1_haversine", f"SELECT event_id, round({sql.hav('a', 'b', 'c', 'd')}, 6) AS km FROM (SELECT event_id, event_id % 85 AS a, event_id % 180 AS b, -(event_id % 71) AS c, -(event_id % 179) AS d FROM events)")
def x1(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(s, d, "events").select("event_id", F.round(geo.haversine_km(i % 85, i % 180, -(i % 71), -(i % 179)), 6).alias("km"))


@query("x6_easing", "SELECT event_id, round(t*t*(3-2*t), 9) AS smooth, round(1-pow(1-t,3), 9) AS out_cubic, round(CASE WHEN t < 0.5 THEN 4*t*t*t ELSE 1-pow(-2*t+2,3)/2 END, 9) AS in_out_cubic, round(exp(ln(2)+(ln(9)-ln(2))*t), 9) AS log_lerp FROM (SELECT event_id, (event_id % 1000) / 999.0 AS t FROM events)")
def x6(s: SparkSession, d: str) -> DataFrame:
    t = F.col("event_id") % 1000 / 999.0
    new = {"smooth": geo.smoothstep(t), "out_cubic": geo.ease_out_cubic(t), "in_out_cubic": geo.ease_in_out_cubic(t), "log_lerp": geo.log_lerp(2.0, 9.0, t)}
    return table(s, d, "events").select("event_id", *[F.round(c, 9).alias(n) for n, c in new.items()])


@query("x5_speed", f"WITH {sql.HOPS} SELECT traveler_id, seq, CASE WHEN t_ms - t0_ms <= 0 THEN NULL ELSE round(hop_km / ((t_ms - t0_ms) / 3600000.0), 3) END AS kmh FROM hops WHERE t0_ms IS NOT NULL")
def x5(s: SparkSession, d: str) -> DataFrame:
    h = journey.hops(points(s, d)).where("t0_ms IS NOT NULL")
    v = geo.speed_kmh(F.col("hop_km"), F.col("t_ms") - F.col("t0_ms"))
    return h.select("traveler_id", "seq", F.when(v < float("inf"), F.round(v, 3)).alias("kmh"))


@query("x8_units", f"WITH {sql.TOTALS}, u AS (SELECT *, CASE WHEN traveler_id % 3 = 0 THEN 'mi' ELSE 'km' END AS unit FROM totals) SELECT traveler_id, unit, format('{{:,}}', round(CASE WHEN unit = 'mi' THEN total_km * 0.621371192237334 ELSE total_km END)::BIGINT) || ' ' || unit AS label FROM u")
def x8(s: SparkSession, d: str) -> DataFrame:
    """X8, X9."""
    t = journey.totals(journey.hops(points(s, d)))
    unit = text.unit_of_region(F.when(F.col("traveler_id") % 3 == 0, "US").otherwise("KR"))
    return t.select("traveler_id", unit.alias("unit"), text.format_distance(F.col("total_km"), unit).alias("label"))


TITLES = ["Trip {YEAR} by {name} ~", "{Name}", "  ", None, "no holes ~"]


@query("x12_title_template", f"SELECT i, coalesce(nullif(trim(regexp_replace(regexp_replace(s, '\\{{year\\}}', '2024', 'gi'), '\\{{name\\}}', 'Ana', 'gi')), ''), 'My trip') AS title, CASE WHEN i % 2 = 0 THEN '2024' ELSE '2024–2025' END AS label FROM {values(TITLES)}")
def x12(s: SparkSession, d: str) -> DataFrame:
    """X11, X12."""
    return written(s, d, TITLES).select("i", text.title_from_template(F.col("s"), F.lit(2024), F.lit("Ana"), F.lit("My trip")).alias("title"), text.period_label(F.lit(2024), F.lit(2024) + F.col("i") % 2).alias("label"))


DURATIONS = ["~", "9", "300", "3~", "~s", "", None, " 1~ "]


@query("x14_parse_duration", f"SELECT i, CASE WHEN try_cast(CASE WHEN regexp_full_match(trim(s), '[0-9]{{1,6}}') THEN trim(s) END AS INT) BETWEEN 10 AND 300 THEN trim(s)::INT END AS seconds FROM {values(DURATIONS)}")
def x14(s: SparkSession, d: str) -> DataFrame:
    return written(s, d, DURATIONS).select("i", text.parse_duration(F.col("s")).alias("seconds"))


def _turns() -> dict[str, int]:
    """How many events take a value of a preset's field in a row, so that all combinations come in turn."""
    steps = itertools.accumulate((len(v) for v in text.PRESET_FIELDS.values()), lambda a, b: a * b, initial=1)
    return dict(zip(text.PRESET_FIELDS, steps))  # noqa: B905


_TURN = {n: f"(event_id // {k} % {len(text.PRESET_FIELDS[n])})" for n, k in _turns().items()}
_PICKED = ", ".join(f"{list(text.PRESET_FIELDS[n])}[({k} + 1)::INT] AS {n}, {k} AS i_{n}" for n, k in _TURN.items())


@query("x15_preset_codec", f"""WITH p AS (SELECT event_id, {_PICKED} FROM events)
SELECT event_id, movement, aspect, detection, framing, pacing, replace(replace(rtrim(to_base64(unhex('A1' || printf('%02X', (i_movement | (i_aspect << 2) | (i_detection << 4) | (i_framing << 6))::INT) || printf('%02X', i_pacing::INT))), '='), '+', '-'), '/', '_') AS token, true AS same FROM p""")
def x15(s: SparkSession, d: str) -> DataFrame:
    """Every event's preset as a token, read back."""
    f = list(text.PRESET_FIELDS)
    one = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("event_id") / k) % len(names) + 1).cast("int"))
    p = table(s, d, "events").select("event_id", *[one(text.PRESET_FIELDS[n], k).alias(n) for n, k in _turns().items()])
    p = p.withColumn("token", text.encode_preset(*[F.col(c) for c in f])).withColumn("back", text.decode_preset(F.col("token")))
    same = F.col("back.status") == "ok"
    for c in f:
        same = same & (F.col(f"back.{c}") == F.col(c))
    return p.select("event_id", *f, "token", same.alias("same"))


TOKENS = ["oRUB", "", "!!~!!", "oRUBAAAAAAAAAAAAA", "AAAA", "oQ", None, "of8B", "oRUBAAAAAAAA"]


@query("x16_preset_decode", f"SELECT i, CASE k WHEN 0 THEN 'ok' WHEN 4 THEN 'unsupported' ELSE 'invalid' END AS status FROM {values(TOKENS)}")
def x16(s: SparkSession, d: str) -> DataFrame:
    return written(s, d, TOKENS).select("i", text.decode_preset(F.col("s"))["status"].alias("status"))


LINKS = ["https://a.b/~?preset=o~B", "https://a.b/p?x=~&preset=oRUB#f", "https://a.b/p?preset=a~&preset=b", "https://a.b/p~", None, "https://a.b/?preset="]


@query("x17_preset_link", f"SELECT i, CASE k WHEN 0 THEN regexp_extract(s, 'o[0-9]+B') WHEN 1 THEN 'oRUB' END AS token FROM {values(LINKS)}")
def x17(s: SparkSession, d: str) -> DataFrame:
    return written(s, d, LINKS).select("i", text.preset_link_token(F.col("s")).alias("token"))


NAMES = ["  A   trip ~ ", "a/b:c*?~", "..dots~. ", "x" * 79 + "~", "", "tab\tand\n~line"]


@query("x19_sanitize_filename", f"SELECT i, substr(trim(regexp_replace(regexp_replace(s, '[[:cntrl:]\\\\/:*?\"<>|]+', ' ', 'g'), '\\s+', ' ', 'g'), ' .'), 1, 80) AS file, sha256(s) AS key FROM {values(NAMES)}")
def x19(s: SparkSession, d: str) -> DataFrame:
    """X19, X21."""
    return written(s, d, NAMES).select("i", text.sanitize_filename(F.col("s")).alias("file"), text.uri_key(F.col("s")).alias("key"))


@query("k4_catalog_upsert", "SELECT c_custkey AS uri, c_name AS title, c_custkey % 97 AS created_ms FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'new', 1000 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 = 0")
def k4(s: SparkSession, d: str) -> DataFrame:
    """Every tenth record renewed, every other fifth removed."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("uri"), F.col("c_name").alias("title"), (F.col("c_custkey") % 97).alias("created_ms"))
    new = c.where("uri % 10 = 0").select("uri", F.lit("new").alias("title"), F.lit(1000).cast("long").alias("created_ms"))
    return catalog.newest_first(catalog.remove(catalog.upsert(c, new), c.where("uri % 5 = 0 AND uri % 10 <> 0")))


@query("k6_destination_naming", "SELECT c_custkey AS n, name, name || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.mp4' AS file FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) AS k FROM (SELECT c_custkey, c_mktsegment || '-2024-01_2024-02' AS name FROM customer))")
def k6(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.col("c_custkey").alias("n"), text.file_base_name(F.col("c_mktsegment"), F.lit("2024-01"), F.lit("2024-02")).alias("name"))
    return catalog.available_names(c)


_SETTINGS = {"movement": (list(K.MOVEMENTS), "steady"), "pacing": (list(K.PACING), "balanced"), "framing": (list(K.FRAMING), "balanced")}


@query("s17_settings_scan", "WITH st AS (SELECT ['movement', 'pacing', 'framing'][(event_id % 3 + 1)::INT] AS key, max(['balanced', 'strong'][(event_id % 2 + 1)::INT]) AS value FROM events WHERE event_id % 7 < 4 GROUP BY 1) SELECT v.key, CASE WHEN list_contains(v.allowed, st.value) THEN st.value ELSE v.fallback END AS value FROM (VALUES " + ", ".join(f"('{k}', {a}, '{f}')" for k, (a, f) in _SETTINGS.items()) + ") v(key, allowed, fallback) LEFT JOIN st USING (key)")
def s17(s: SparkSession, d: str) -> DataFrame:
    """Of every setting the greatest value that an event stored, if it is allowed."""
    i = F.col("event_id")
    one = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    stored = table(s, d, "events").where(i % 7 < 4).select(one(["movement", "pacing", "framing"]).alias("key"), one(["balanced", "strong"]).alias("value"))
    return catalog.settings(stored, _SETTINGS)


@query("a18_eta_remaining")
def a18(s: SparkSession, d: str) -> DataFrame:
    """A18 over a log of exports, one per user, at one step an event."""
    w = Window.partitionBy("job").orderBy("n")
    e = table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("n"))
    e = e.withColumn("k", F.row_number().over(w))
    log = e.select("job", "n", (F.col("k") * 2000 + F.col("n") % 3 * 40).alias("elapsed_ms"), (F.col("k") * 24).cast("long").alias("completed"), F.lit(2400).cast("long").alias("total"))
    return progress.eta_remaining(log)


def entry(s: SparkSession, d: str) -> DataFrame:
    """The flagship: every traveller's journey with its distance, threshold and legs."""
    h = hops(s, d)
    lim, t = limits_of(h), journey.totals(h)
    n = journey.legs(h, lim).groupBy("traveler_id").agg(F.count("*").alias("n_legs"), F.count_if("is_transfer").alias("n_transfers"))
    return t.join(lim.select("traveler_id", "threshold_km"), "traveler_id").join(n, "traveler_id", "left").select("traveler_id", "n_points", r("total_km"), r("threshold_km", 6), "n_legs", "n_transfers")


QUERIES["journey_summary"] = entry
ORACLES["journey_summary"] = f"WITH {sql.LEGS}, n AS (SELECT traveler_id, count(*) AS n_legs, count(*) FILTER (is_transfer) AS n_transfers FROM legs GROUP BY 1) SELECT traveler_id, n_points, round(total_km, 3) AS total_km, round(threshold_km, 6) AS threshold_km, n_legs, n_transfers FROM totals JOIN limits USING (traveler_id) LEFT JOIN n USING (traveler_id)"

from waystone.plans import camera_queries, more, streams  # noqa: E402, F401  they register theirs
