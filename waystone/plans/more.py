"""More registered queries, over whole tables: polar routes, drawing, presets, settings, export requests, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone import constants as K
from waystone.functions import text
from waystone.operators import clean, frames, journey, tiles
from waystone.plans import sql
from waystone.plans.adapters import points, raw_points, table
from waystone.plans.queries import _OVERVIEW, _POINT_VIEWS, _TILES, overview, point_views, query, r
from waystone.sources import catalog


def pick(names: list[str], number) -> F.Column:
    """The name of a number, counted round and round."""
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def sql_pick(names: list[str], number: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][(({number}) % {len(names)} + 1)::INT]"


# --- routes --------------------------------------------------------------------------------------------------------

_POLAR = sql.PTS + ", pp AS (SELECT traveler_id, seq, t_ms, least(85.0, round(lat * 1.6, 6)) AS lat, (seq * 77 % 360) - 180.0 AS lon FROM pts), raw_x AS" + sql.UNWRAPPED.split("raw_x AS", 1)[1].replace("FROM pts)", "FROM pp)")
_GREAT_LON = sql.great("alat", "alon", "blat", "blon", "f")[1]


def polar_points(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).select("traveler_id", "seq", "t_ms", F.least(F.lit(85.0), F.round(F.col("lat") * 1.6, 6)).alias("lat"), ((F.col("seq") * 77) % 360 - 180.0).alias("lon"))


@query("w7_polar_unwrap", f"""WITH {_POLAR}, n AS (SELECT *, row_number() OVER {sql._W} AS i, count(*) OVER (PARTITION BY traveler_id) AS n FROM un),
p AS (SELECT *, abs(lat) >= 50 AND i > 1 AND i < n AS p FROM n), q AS (SELECT *, sum((NOT p)::INT) OVER {sql._W} AS run FROM p),
runs AS (SELECT traveler_id, min(i) - 1 AS i0, max(i) + 1 AS i1 FROM q WHERE p GROUP BY traveler_id, run HAVING max(abs(lat)) >= 70),
anchors AS (SELECT c.*, a.lat AS alat, a.lon AS alon, a.x AS ax, b.lat AS blat, b.lon AS blon, b.x AS bx, b.x0 - floor(b.x0 - a.x + 0.5) AS e
  FROM runs c JOIN n a ON a.traveler_id = c.traveler_id AND a.i = c.i0 JOIN n b ON b.traveler_id = c.traveler_id AND b.i = c.i1),
moves AS (SELECT *, e - bx AS move FROM anchors WHERE abs(e - bx) >= 0.5),
along AS (SELECT n.*, c.e, ax, alat, alon, blat, blon, (n.i - i0) / (i1 - i0) AS f FROM n LEFT JOIN moves c ON c.traveler_id = n.traveler_id AND n.i > i0 AND n.i < i1),
gx AS (SELECT *, ({_GREAT_LON} + 180.0) / 360.0 AS g, ax + (e - ax) * f AS want FROM along)
SELECT g.traveler_id, seq, round(CASE WHEN e IS NOT NULL THEN g - floor(g - want + 0.5) ELSE x END + coalesce((SELECT sum(move) FROM moves m WHERE m.traveler_id = g.traveler_id AND m.i1 <= g.i), 0.0), 6) AS x FROM gx g""")
def w7(s: SparkSession, d: str) -> DataFrame:
    return journey.polar_unwrapped(polar_points(s, d)).select("traveler_id", "seq", r("x", 6))


_SCREEN = f"""{sql.UNWRAPPED}, {_OVERVIEW}, sc AS (SELECT u.traveler_id, seq, row_number() OVER (PARTITION BY u.traveler_id ORDER BY t_ms, seq) AS i,
  round((x - min_x) / (max_x - min_x) * 480, 3) AS sx, round((y - min_y) / (max_y - min_y) * 480, 3) AS sy FROM un u JOIN overview USING (traveler_id))"""


@query("w22_pixel_decimate", f"""WITH RECURSIVE {_SCREEN}, go AS (SELECT *, sx AS lx, sy AS ly, true AS keep FROM sc WHERE i = 1
  UNION ALL SELECT n.*, CASE WHEN k THEN n.sx ELSE lx END, CASE WHEN k THEN n.sy ELSE ly END, k FROM go g JOIN sc n ON n.traveler_id = g.traveler_id AND n.i = g.i + 1, LATERAL (SELECT (n.sx - lx) * (n.sx - lx) + (n.sy - ly) * (n.sy - ly) >= 1.35 * 1.35 AS k))
SELECT traveler_id, seq, i, sx, sy FROM go WHERE keep""")
def w22(s: SparkSession, d: str) -> DataFrame:
    u = journey.unwrapped(points(s, d)).withColumn("i", F.row_number().over(journey.ordered())).select("traveler_id", "seq", "i", "x", "y").join(overview(s, d), "traveler_id")
    at = lambda c: F.round((F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}")) * 480, 3).alias(f"s{c}")
    return frames.pixel_decimate(u.select("traveler_id", "seq", "i", at("x"), at("y")))


@query("a17_tz_missing_any", f"WITH {sql.PTS} SELECT traveler_id, bool_or(seq % 50 = 0) AS tz_missing FROM pts GROUP BY 1")
def a17(s: SparkSession, d: str) -> DataFrame:
    return journey.tz_missing_any(points(s, d).withColumn("tz_missing", F.col("seq") % 50 == 0))


@query("p18_source_selection", f"""{sql.STATIONARY.replace('WITH RECURSIVE', 'WITH RECURSIVE ' + sql.PTS + ',', 1)}
SELECT traveler_id, 'raw' AS mode, count(*) AS n FROM kept GROUP BY 1 UNION ALL SELECT traveler_id, 'semantic', count(*) FROM pts WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1""")
def p18(s: SparkSession, d: str) -> DataFrame:
    """P18 in both modes."""
    semantic, raw = points(s, d), clean.clean_raw(raw_points(s, d))
    of = lambda mode: journey.select_source(semantic, raw, mode, "2024-01-05", "2024-01-11").groupBy("traveler_id").agg(F.count("*").alias("n")).select("traveler_id", F.lit(mode).alias("mode"), "n")
    return of("raw").unionByName(of("semantic"))


@query("p19_clamped_dates", f"WITH {sql.PTS} SELECT traveler_id, seq FROM pts WHERE CAST(ts AS DATE) = DATE '2024-01-09'")
def p19(s: SparkSession, d: str) -> DataFrame:
    """An end before the start counts as the start."""
    return journey.filter_dates(points(s, d), "2024-01-09", "2024-01-02").select("traveler_id", "seq")


@query("p17_accuracy_limits", f"WITH {sql.RAW} SELECT traveler_id, count(*) AS n_all, count(*) FILTER (accuracy_m <= 20) AS n_20 FROM raw GROUP BY 1")
def p17(s: SparkSession, d: str) -> DataFrame:
    raw = raw_points(s, d)
    n = lambda most, name: clean.filter_accuracy(raw, most).groupBy("traveler_id").agg(F.count("*").alias(name))
    return n(None, "n_all").join(n(20.0, "n_20"), "traveler_id", "left").fillna(0)


# --- tiles and pictures --------------------------------------------------------------------------------------------


@query("u4_tiles_in_both", f"WITH {sql.UNWRAPPED}, {_POINT_VIEWS}, {_TILES.format(v='pv')} SELECT zoom, x, y FROM tiles WHERE traveler_id % 2 = 0 INTERSECT SELECT zoom, x, y FROM tiles WHERE traveler_id % 2 = 1")
def u4(s: SparkSession, d: str) -> DataFrame:
    t = tiles.required_tiles(point_views(s, d), "traveler_id")
    return tiles.tiles_in_both(t.where("traveler_id % 2 = 0"), t.where("traveler_id % 2 = 1"))


@query("x20_tile_addresses", f"WITH {sql.UNWRAPPED}, {_POINT_VIEWS}, {_TILES.format(v='pv')} SELECT DISTINCT zoom || '/' || x || '/' || y AS key, 'https://tiles.example.org/light/' || zoom || '/' || x || '/' || y || '.png' AS url FROM tiles")
def x20(s: SparkSession, d: str) -> DataFrame:
    t = tiles.required_tiles(point_views(s, d)).select("zoom", "x", "y").distinct()
    return t.select(F.concat_ws("/", "zoom", "x", "y").alias("key"), tiles.tile_url("https://tiles.example.org/light/{z}/{x}/{y}.png", F.col("zoom"), F.col("x"), F.col("y")).alias("url"))


@query("t17_picture_sizes", """WITH c AS (SELECT c_custkey AS k, (c_custkey % 1500 + 1)::INT AS w, (c_custkey * 7 % 900)::INT AS h, (c_custkey % 40 - 2) / 10.0 AS a, (c_custkey % 5) / 2.0 AS d FROM customer),
f AS (SELECT *, greatest(1, h) AS hh, CASE WHEN a > 0 THEN a ELSE 1.0 END AS aa FROM c), g AS (SELECT *, greatest(1, floor(w / aa + 0.5)::INT) AS tall FROM f),
p AS (SELECT *, least(1.0, greatest(least(1.0, 240 / least(w, hh)), (CASE WHEN h > 0 THEN h * (CASE WHEN d > 0 THEN d ELSE 1.0 END) ELSE w END) / w)) AS sc FROM g)
SELECT k, CASE WHEN tall > hh THEN greatest(1, least(w, floor(hh * aa + 0.5)::INT)) ELSE w END AS preview_w, least(tall, hh) AS preview_h, floor(w * sc + 0.5)::INT AS canvas_w, floor(hh * sc + 0.5)::INT AS canvas_h,
  CASE WHEN w >= hh THEN 1080 ELSE greatest(1, floor(1080 * w / hh)::INT) + greatest(1, floor(1080 * w / hh)::INT) % 2 END AS overview_w, CASE WHEN hh >= w THEN 1080 ELSE greatest(1, floor(1080 * hh / w)::INT) + greatest(1, floor(1080 * hh / w)::INT) % 2 END AS overview_h FROM p""")
def t17(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    w, h, a, ratio = (k % 1500 + 1).cast("int"), (k * 7 % 900).cast("int"), (k % 40 - 2) / 10.0, (k % 5) / 2.0
    c = table(s, d, "customer").select(k.alias("k"), frames.preview_size(w, h, a).alias("p"), frames.preview_canvas_size(w, F.greatest(F.lit(1), h), h, ratio).alias("c"), frames.overview_size(w, F.greatest(F.lit(1), h)).alias("o"))
    return c.select("k", *[F.col(f"{x}.{y}").cast("int").alias(f"{n}_{y[0]}") for x, n in (("p", "preview"), ("c", "canvas"), ("o", "overview")) for y in ("width", "height")])


# --- texts ---------------------------------------------------------------------------------------------------------


@query("x13_messages", "SELECT c_custkey, 'Hello {x} ' || c_name || ', ' || c_nationkey || ' of ' || c_name || ' {' || CASE WHEN c_nationkey = 1 THEN 'one trip' ELSE 'trips' END AS message FROM customer")
def x13(s: SparkSession, d: str) -> DataFrame:
    """Messages and plural forms; what is no placeholder stays."""
    forms = F.create_map(F.lit("one"), F.lit("one trip"), F.lit("other"), F.lit("trips"))
    trips = text.plural_form(forms, F.when(F.col("c_nationkey") == 1, "one").otherwise("few"))
    m = text.interpolate_message(F.lit("Hello {x} {name}, {n} of {name} {{trips}"), {"name": F.col("c_name"), "n": F.col("c_nationkey"), "trips": trips})
    return table(s, d, "customer").select("c_custkey", m.alias("message"))


@query("x17_link_round_trip", f"SELECT event_id, 'ok' AS status, {', '.join(f'{sql_pick(v, f"event_id // {i + 1}")} AS {k}' for i, (k, v) in enumerate(text.PRESET_FIELDS.items()))} FROM events")
def x17(s: SparkSession, d: str) -> DataFrame:
    """Presets to links and back."""
    fields = {k: pick(list(v), F.floor(F.col("event_id") / (i + 1))) for i, (k, v) in enumerate(text.PRESET_FIELDS.items())}
    link = text.create_preset_link("https://example.org/map/", text.encode_preset(**fields))
    return table(s, d, "events").select("event_id", text.decode_preset(text.preset_link_token(link)).alias("p")).select("event_id", "p.status", *[f"p.{k}" for k in text.PRESET_FIELDS])


@query("x18_preset_names", "SELECT c_custkey, CASE WHEN length(n) BETWEEN 1 AND 40 THEN n END AS name FROM (SELECT c_custkey, trim(regexp_replace(repeat(' ' || c_name, (c_custkey % 4)::INT), '\\s+', ' ', 'g')) AS n FROM customer)")
def x18(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", text.normalise_preset_name(F.repeat(F.concat(F.lit(" "), "c_name"), (F.col("c_custkey") % 4).cast("int"))).alias("name"))


@query("x26_is_mp4", "SELECT c_custkey, c_custkey % 3 = 0 AS mp4 FROM customer")
def x26(s: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.unhex(F.lit("00000018")), F.when(F.col("c_custkey") % 3 == 0, F.lit("ftyp")).otherwise(F.col("c_name")).cast("binary"), F.lit("isom").cast("binary"))
    return table(s, d, "customer").select("c_custkey", text.is_mp4(content).alias("mp4"))


# --- presets, settings, requests -----------------------------------------------------------------------------------


@query("k7_preset_writes", """WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer), base AS (SELECT k, lower(name) AS name FROM c WHERE k <= 10),
added AS (SELECT k, name FROM c WHERE k > 8 AND lower(name) NOT IN (SELECT lower(name) FROM base) ORDER BY lpad(k::VARCHAR, 8, '0') LIMIT greatest(0, 50 - (SELECT count(*) FROM base))),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM added)
SELECT lpad(k::VARCHAR, 8, '0') AS id, CASE WHEN k = 3 THEN 'My trip' ELSE name END AS name, k = 5 AS chosen FROM everything""")
def k7(s: SparkSession, d: str) -> DataFrame:
    """Presets of some customers, all others added up to 50, two renamed of which one may not, a default."""
    c = table(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    base = c.where("k <= 10").select("id", F.lower("name").alias("name"))
    p = catalog.add_preset(base, c.where("k > 8").select("id", F.concat(F.lit(" "), "name").alias("name")))
    some = c.where("k IN (1, 3)").select("id", F.when(F.col("k") == 3, "My  trip ").otherwise(F.concat(F.substring("name", 1, 17), F.lit("2"))).alias("name"))
    p = catalog.rename_preset(p, some)
    chosen = catalog.default_preset(p, c.where("k = 5").select("id")).withColumn("chosen", F.lit(True))
    return p.join(chosen, "id", "left").select("id", "name", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("k8_stale_overviews", "SELECT event_id AS path, epoch_us(ts) // 1000 AS modified_ms FROM events WHERE ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY")
def k8(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "events").select(F.col("event_id").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("modified_ms"))
    return catalog.stale_files(files, 1_705_752_000_000)


@query("s10_source_pointer", """SELECT user_id, arg_max(uri, n) FILTER (event = 'complete') AS uri, coalesce(max(n) FILTER (event = 'begin') > coalesce(max(n) FILTER (event = 'complete'), -1), false) AS interrupted
FROM (SELECT user_id, event_id AS n, CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'begin' END AS event, 'content://' || event_id AS uri FROM events) GROUP BY user_id""")
def s10(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    log = table(s, d, "events").select("user_id", n.alias("n"), F.when(n % 3 == 0, "complete").otherwise("begin").alias("event"), F.concat(F.lit("content://"), n).alias("uri"))
    return catalog.current_source(log)


_KNOWN = lambda c, names, fallback, since: f"CASE WHEN version >= {since} AND {c} IN ({', '.join(repr(n) for n in names)}) THEN {c} ELSE '{fallback}' END"
_CODES = {"movement": [*K.MOVEMENTS, "orbit"], "pacing": [*K.PACING, "none"], "detection": [*K.DETECTION, ""], "framing": [*K.FRAMING, "wide"]}


@query("s11_export_requests", f"""WITH q AS (SELECT event_id AS id, event_id % 10 AS version, (2000 + event_id % 20)::INT AS start_year, 3 AS start_month, (2020 + event_id % 3)::INT AS end_year, 7 AS end_month,
  {', '.join(f'{sql_pick(v, f"event_id // {i + 2}")} AS {k}' for i, (k, v) in enumerate(_CODES.items()))}, event_id % 2 = 0 AS framing_on, 0.5::DOUBLE AS scale, event_id * 1000 - 50000 AS points FROM events)
SELECT id, start_year, start_month, CASE WHEN version = 1 THEN start_year ELSE end_year END AS end_year, end_month, {_KNOWN('movement', K.MOVEMENTS, 'steady', 4)} AS movement, {_KNOWN('pacing', K.PACING, 'balanced', 3)} AS pacing,
  {_KNOWN('detection', K.DETECTION, 'balanced', 7)} AS detection, CASE WHEN version = 8 OR (version = 7 AND framing_on) THEN {_KNOWN('framing', K.FRAMING, 'balanced', 7)} ELSE 'off' END AS framing,
  CASE WHEN version >= 5 THEN scale ELSE 1.0 END AS scale, greatest(0, least(2000000, points)) AS points FROM q WHERE version BETWEEN 1 AND 8""")
def s11(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    codes = [pick(v, F.floor(n / (i + 2))).alias(k) for i, (k, v) in enumerate(_CODES.items())]
    q = table(s, d, "events").select(n.alias("id"), (n % 10).alias("version"), (2000 + n % 20).cast("int").alias("start_year"), F.lit(3).alias("start_month"), (2020 + n % 3).cast("int").alias("end_year"), F.lit(7).alias("end_month"), *codes, (n % 2 == 0).alias("framing_on"), F.lit(0.5).alias("scale"), (n * 1000 - 50000).alias("points"))
    return catalog.read_export_requests(q)


_STORED = ["movement", "framing", "episode_framing_enabled", "zoom_in", "pacing", "title"]
_STORED_SQL = f"st AS (SELECT user_id, key, max(value) AS value FROM (SELECT user_id, {sql_pick(_STORED, 'event_id % 11')} AS key, {sql_pick(['close', 'balanced', 'true', 'off', 'huge'], 'event_id // 7')} AS value FROM events) GROUP BY ALL)"


def stored_settings(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", pick(_STORED, F.col("event_id") % 11).alias("key"), pick(["close", "balanced", "true", "off", "huge"], F.floor(F.col("event_id") / 7)).alias("value"))
    return e.groupBy("user_id", "key").agg(F.max("value").alias("value"))


@query("s17_legacy_framing", f"""WITH {_STORED_SQL}, m AS (SELECT user_id, max(value) FILTER (key = 'episode_framing_enabled') AS switch, max(value) FILTER (key = 'framing') AS name, bool_or(key IN ('movement', 'pacing', 'quality')) AS older FROM st GROUP BY 1)
SELECT user_id, CASE WHEN switch IS NOT NULL THEN CASE WHEN switch <> 'true' THEN 'off' WHEN name = 'close' THEN 'close' ELSE 'balanced' END WHEN name IN ('off', 'balanced', 'close') THEN name WHEN older THEN 'off' ELSE 'balanced' END AS framing FROM m""")
def s17_legacy(s: SparkSession, d: str) -> DataFrame:
    return catalog.migrate_framing(stored_settings(s, d))


@query("k9_settings_write", f"""WITH {_STORED_SQL} SELECT user_id, key, CASE WHEN key = 'framing' THEN 'off' ELSE value END AS value FROM st WHERE key NOT IN ('episode_framing_enabled', 'zoom_in') AND key <> 'framing'
UNION ALL SELECT DISTINCT user_id, 'framing', 'off' FROM st""")
def k9(s: SparkSession, d: str) -> DataFrame:
    st = stored_settings(s, d)
    return catalog.write_settings(st, st.select("user_id", F.lit("framing").alias("key"), F.lit("off").alias("value")).distinct())
