"""SQL for the camera's queries: windows, viewports, smoothing as recursion over samples, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waystone import constants as K
from waystone.constants import Movement
from waystone.operators import camera, journey
from waystone.plans import sql
from waystone.plans.queries import _OVERVIEW, ORACLES, hops, query, r

_N = K.CAMERA_SAMPLES


def near(x: str, ref: str) -> str:
    return f"(CASE WHEN {x} - {ref} > 0.5 THEN {x} - ceil({x} - {ref} - 0.5) WHEN {x} - {ref} < -0.5 THEN {x} + ceil({ref} - {x} - 0.5) ELSE {x} END)"


def inside(y: str, span: str) -> str:
    return f"(CASE WHEN {span} >= 1 THEN 0.5 ELSE least(1 - {span} / 2, greatest({span} / 2, {y})) END)"


def smooth(t: str) -> str:
    c = f"greatest(0.0, least(1.0, {t}))"
    return f"({c} * {c} * (3 - 2 * {c}))"


def log_mix(a: str, b: str, t: str) -> str:
    return f"exp(ln({a}) + (ln({b}) - ln({a})) * {t})"


def kept(c: str, m: str, half: str) -> str:
    """The centre moved as far as keeps m within half of it."""
    return f"({c} + greatest(0.0, {m} - ({c} + {half})) + least(0.0, {m} - ({c} - {half})))"


#: Distances of probes pr (traveler_id, total_km, sample, p) along the pacing curve.
PACED = """nx AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM curve WINDOW w AS (PARTITION BY traveler_id ORDER BY k)),
kn AS (SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY traveler_id, x ORDER BY k DESC) = 1),
pb AS (SELECT pr.traveler_id, total_km, sample, p, x, y, m, x1, y1, m1, (p - x) / (x1 - x) AS t FROM pr ASOF LEFT JOIN kn ON pr.traveler_id = kn.traveler_id AND pr.p >= kn.x),
ds AS (SELECT traveler_id, total_km, sample, p, greatest(0.0, least(total_km, CASE WHEN x IS NULL THEN total_km * p WHEN x1 IS NULL OR p = x THEN y
  ELSE (2*t*t*t - 3*t*t + 1)*y + (t*t*t - 2*t*t + t)*(x1 - x)*m + (3*t*t - 2*t*t*t)*y1 + (t*t*t - t*t)*(x1 - x)*m1 END)) AS d FROM pb)"""
SAMPLES = f"pr AS (SELECT traveler_id, total_km, s AS sample, s / {_N}.0::DOUBLE AS p FROM totals, generate_series(0, {_N}) g(s) WHERE n_points >= 2 AND total_km > 0)"
LINEAR = "ds AS (SELECT traveler_id, total_km, sample, p, total_km * p AS d FROM pr)"
#: Hops that a distance can fall on; of equal ends the first.
MOVING = "hm AS (SELECT * FROM hops WHERE i >= 1 QUALIFY row_number() OVER (PARTITION BY traveler_id, cum_km ORDER BY i) = 1)"
_POS = sql.great("lat0", "lon0", "lat", "lon", "f")


def positions(probes: str, out: str, keep: str) -> str:
    """out (keep, lat, lon, at_ms, i, f) of probes (traveler_id, keep, km, total_km)."""
    return f"""{out}_h AS (SELECT p.traveler_id, {keep}, least(total_km, greatest(0.0, km)) AS km FROM {probes} p),
{out}_g AS (SELECT p.*, lat0, lon0, lat, lon, t0_ms, t_ms, i, CASE WHEN hop_km > 0 THEN greatest(0.0, least(1.0, (km - cum0_km) / hop_km)) ELSE 0.0 END AS f FROM {out}_h p ASOF JOIN hm ON p.traveler_id = hm.traveler_id AND p.km <= hm.cum_km),
{out} AS (SELECT traveler_id, {keep}, km, {_POS[0]} AS lat, {_POS[1]} AS lon, t0_ms + trunc((t_ms - t0_ms) * f)::BIGINT AS at_ms, i FROM {out}_g)"""


def plain_windows(m: Movement) -> str:
    ctx = f"greatest({m.low_km}, least({m.high_km}, total_km * {m.fraction}))"
    return f"win AS (SELECT *, greatest(0.0, d - {ctx}) AS tail, least(total_km, d + {ctx}) AS look, {m.pad}::DOUBLE AS pad, 0.0::DOUBLE AS arrival, 0.0::DOUBLE AS alignment FROM ds)"


def leg_windows(m: Movement, framing: float) -> str:
    own = m.pad * framing
    return f"""ext AS (SELECT *, lead(end_km) OVER w AS ne, lead(start_km) OVER w AS ns, lead(is_transfer) OVER w AS nt, lag(is_transfer) OVER w AS aft FROM legs WINDOW w AS (PARTITION BY traveler_id ORDER BY leg_no)),
l0 AS (SELECT ds.*, start_km AS s, end_km AS e, is_transfer AS tr, ne, ns, nt, coalesce(aft, false) AS aft, end_km - start_km AS len, d - start_km AS o, greatest({m.low_km}, least({m.high_km}, total_km * {m.fraction})) AS c0,
  coalesce(NOT nt, false) AS nl FROM ds ASOF LEFT JOIN ext ON ds.traveler_id = ext.traveler_id AND ds.d >= ext.start_km),
l1 AS (SELECT *, CASE WHEN coalesce(tr, false) AND nl THEN coalesce({smooth('((o / len) - 0.75) / 0.25')}, 0.0) ELSE 0.0 END AS bl, greatest(0.001, least(len, total_km * (2.0 / {_N}))) AS hold FROM l0),
l2 AS (SELECT *, least(len, greatest(25.0, hold)) AS settle, CASE WHEN coalesce(tr, false) THEN CASE WHEN bl > 0 THEN {log_mix('len', 'greatest(0.001, least(c0, ne - ns))', 'bl')} ELSE len END ELSE c0 END AS ctx FROM l1),
l3 AS (SELECT *, CASE WHEN o <= hold THEN 1.0 WHEN settle > hold THEN 1.0 - {smooth('(o - hold) / (settle - hold)')} ELSE 0.0 END AS landed,
  CASE WHEN s IS NULL THEN total_km WHEN tr THEN CASE WHEN nl THEN ne ELSE e END WHEN e - d <= least(50.0, len * 0.15) AND coalesce(nt, false) THEN ne ELSE e END AS ahead FROM l2),
win AS (SELECT *, greatest(coalesce(s, 0.0), d - ctx) AS tail, least(ahead, d + ctx) AS look, CASE WHEN coalesce(tr, false) THEN {K.TRANSFER_PAD} + ({own} - {K.TRANSFER_PAD}) * bl ELSE {own} END AS pad,
  CASE WHEN coalesce(tr, false) THEN bl WHEN aft THEN coalesce(landed, 0.0) ELSE 0.0 END AS arrival, CASE WHEN coalesce(tr, false) THEN bl WHEN s IS NOT NULL THEN 1.0 ELSE 0.0 END AS alignment FROM l3)"""


def viewports(m: Movement, points: bool = True) -> str:
    """raw (traveler_id, sample, mx, my, cx, cy, span, arrival, alignment) of win."""
    seen = " UNION ALL SELECT w.traveler_id, w.sample, (h.lon + 180.0) / 360.0, " + sql.world_y("h.lat") + " FROM win w JOIN hops h ON h.traveler_id = w.traveler_id AND h.cum_km BETWEEN w.tail AND w.look" if points else ""
    return f"""{MOVING}, three AS (SELECT traveler_id, sample, total_km, unnest(['d', 'tail', 'look']) AS what, unnest([d, tail, look]) AS km FROM win),
{positions('three', 'ps', 'sample, what')}, pw AS (SELECT traveler_id, sample, what, (lon + 180.0) / 360.0 AS x, {sql.world_y('lat')} AS y FROM ps),
mk AS (SELECT traveler_id, sample, x AS mx, y AS my FROM pw WHERE what = 'd'),
seen AS (SELECT traveler_id, sample, x, y FROM pw{seen}),
box AS (SELECT traveler_id, sample, min({near('x', 'mx')}) AS x0, max({near('x', 'mx')}) AS x1, min(y) AS y0, max(y) AS y1 FROM seen JOIN mk USING (traveler_id, sample) GROUP BY ALL),
raw AS (SELECT w.traveler_id, w.sample, mx, my, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest({m.min_span}, least({K.SPAN_MAX}, greatest(greatest({K.CONTENT_FLOOR}, y1 - y0) * pad, greatest({K.CONTENT_FLOOR}, x1 - x0) * pad))) AS span, arrival, alignment
  FROM win w JOIN mk USING (traveler_id, sample) JOIN box USING (traveler_id, sample))"""


def next_zoom(before: str, span: str) -> str:
    e = f"log2(480 / ({K.TILE_PX} * {span}))"
    return f"(CASE WHEN {e} >= {before} + 1 + {K.ZOOM_HYSTERESIS} THEN least({K.ZOOM_HIGH}, floor({e} - {K.ZOOM_HYSTERESIS})) WHEN {e} < {before} - {K.ZOOM_HYSTERESIS} THEN greatest({K.ZOOM_LOW}, floor({e} + {K.ZOOM_HYSTERESIS})) ELSE {before} END)::INT"


def first_zoom(span: str) -> str:
    return f"least({K.ZOOM_HIGH}, greatest({K.ZOOM_LOW}, floor(log2(480 / ({K.TILE_PX} * {span})))))::INT"


def track(m: Movement, out: str = "track") -> str:
    target, move = f"greatest(n.span, {m.min_span})", "FROM {out} g JOIN raw n ON n.traveler_id = g.traveler_id AND n.sample = g.sample + 1".format(out=out)
    s = f"least({K.SPAN_MAX}, greatest({m.min_span}, {log_mix('g.s', target, f'(CASE WHEN {target} > g.s THEN {m.zoom_out} ELSE {m.zoom_in} + (1 - {m.zoom_in}) * n.arrival END)')}))"
    return f"""{out} AS (SELECT traveler_id, sample, cx AS x, {inside('cy', 'span')} AS y, span AS s, {first_zoom('span')} AS zoom FROM raw WHERE sample = 0
  UNION ALL SELECT n.traveler_id, n.sample, {kept('g.x', near('n.mx', 'g.x'), f'q.s * {K.DEAD_ZONE}')}, {inside(kept('g.y', 'n.my', f'q.s * {K.DEAD_ZONE}'), 'q.s')}, q.s, {next_zoom('g.zoom', 'q.s')} {move}, LATERAL (SELECT {s} AS s) q)"""


FRAMED = f"""aim AS (SELECT f.traveler_id, f.sample, mx, my, CASE WHEN alignment > 0 AND span < s THEN {log_mix('s', 'span', 'alignment')} ELSE s END AS s FROM first f JOIN raw USING (traveler_id, sample)),
track AS (SELECT traveler_id, sample, mx AS x, {inside('my', 's')} AS y, s, {first_zoom('s')} AS zoom FROM aim WHERE sample = 0
  UNION ALL SELECT n.traveler_id, n.sample, {kept('g.x', near('n.mx', 'g.x'), f'n.s * {K.DEAD_ZONE}')}, {inside(kept('g.y', 'n.my', f'n.s * {K.DEAD_ZONE}'), 'n.s')}, n.s, {next_zoom('g.zoom', 'n.s')} FROM track g JOIN aim n ON n.traveler_id = g.traveler_id AND n.sample = g.sample + 1)"""

_STEADY, _DYNAMIC, _FIXED = K.MOVEMENTS["steady"], K.MOVEMENTS["dynamic"], K.MOVEMENTS["fixed"]
_PACED = f"WITH RECURSIVE {sql.CURVE}, {SAMPLES}, {PACED}"
_TRACK = f"{_PACED}, {plain_windows(_STEADY)}, {viewports(_STEADY)}, {track(_STEADY)}"
_LEGS = sql.LEGS.split(sql.LIMITS + ",", 1)[1]
_OUT = "SELECT traveler_id, sample::INT AS sample, round(x, 6) AS center_x, round(y, 6) AS center_y, round(s, 6) AS span_y, zoom FROM track"
_RAW = "SELECT traveler_id, sample::INT AS sample, round(cx, 6) AS center_x, round(cy, 6) AS center_y, round(span, 6) AS span_y FROM raw"

ORACLES["w16_raw_viewports"] = f"WITH {sql.TOTALS}, {SAMPLES}, {LINEAR}, {plain_windows(_STEADY)}, {viewports(_STEADY)} {_RAW}"
ORACLES["w17_camera_steady"] = f"{_TRACK} {_OUT}"
ORACLES["w18_camera_dynamic_framed"] = f"{_PACED}, {_LEGS}, {leg_windows(_DYNAMIC, 1.0)}, {viewports(_DYNAMIC)}, {track(_DYNAMIC, 'first')}, {FRAMED} {_OUT}"
ORACLES["a6_fixed_zoom"] = f"{_PACED}, {plain_windows(_FIXED)}, {viewports(_FIXED)} SELECT traveler_id, round(quantile_disc(span, {K.FIXED_PERCENTILE}), 6) AS span_y, 1 AS spans FROM raw GROUP BY 1"
ORACLES["j4_camera_at"] = f"""{_TRACK}, moments AS (SELECT t.traveler_id, n, n / 100.0 AS p, least({_N - 1}, floor(n / 100.0 * {_N}))::INT AS i, n / 100.0 * {_N} - least({_N - 1}, floor(n / 100.0 * {_N})) AS f FROM (SELECT DISTINCT traveler_id FROM track) t, generate_series(0, 100) g(n))
SELECT q.traveler_id, n::INT AS n, round(a.x + ({near('b.x', 'a.x')} - a.x) * f, 6) AS center_x, round(a.y + (b.y - a.y) * f, 6) AS center_y, round({log_mix('a.s', 'b.s', 'f')}, 6) AS span_y, CASE WHEN f < 0.5 THEN a.zoom ELSE b.zoom END AS zoom
FROM moments q JOIN track a ON a.traveler_id = q.traveler_id AND a.sample = i JOIN track b ON b.traveler_id = q.traveler_id AND b.sample = i + 1"""
_UN = sql.UNWRAPPED.split("raw_x AS", 1)[1]
ORACLES["t7_blended_views"] = f"""{_TRACK}, raw_x AS{_UN}, {_OVERVIEW},
outro AS (SELECT traveler_id, x, y, s, n, 1 - pow(1 - n / 24.0, 3) AS t FROM track, generate_series(0, 24) g(n) WHERE sample = {_N}),
o AS (SELECT traveler_id, (min_x + max_x) / 2 AS ox, (min_y + max_y) / 2 AS oy, max_y - min_y AS os FROM overview)
SELECT traveler_id, n::INT AS n, round(x + ({near('ox', 'x')} - x) * t, 6) AS center_x, round(y + (oy - y) * t, 6) AS center_y, round(greatest({K.SPAN_FLOOR}, least({K.OVERVIEW_SPAN_MAX}, {log_mix('s', 'os', 't')})), 6) AS span_y FROM outro JOIN o USING (traveler_id)"""
ORACLES["t14_frame_positions"] = f"""WITH {sql.CURVE}, pr AS (SELECT traveler_id, total_km, f AS sample, CASE WHEN f < 240 THEN f / 239.0 ELSE 1.0 END::DOUBLE AS p FROM totals, generate_series(0, 275) g(f) WHERE n_points >= 2 AND total_km > 0), {PACED}, {MOVING},
dp AS (SELECT *, d AS km FROM ds), {positions('dp', 'ps', 'sample')}
SELECT traveler_id, sample::INT AS frame, round(km, 3) AS d, round(lat, 6) AS lat, round(lon, 6) AS lon, round((lon + 180.0) / 360.0, 8) AS x, round({sql.world_y('lat')}, 8) AS y, i AS index FROM ps"""
_E = f"{K.MERCATOR_E}::DOUBLE"
ORACLES["t2_map_plan"] = f"""WITH {sql.PTS}, m AS (SELECT traveler_id, seq, 6378137.0 * radians(lon) AS cx, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS cy, (seq % 50 + 1) * 20000.0::DOUBLE AS span FROM pts),
z AS (SELECT *, unnest(generate_series(2, greatest(2, least(15, floor(log2(2 * {_E} * 900 / (span * 256)))))::BIGINT)) AS zoom FROM m),
b AS (SELECT *, trunc((cx - span / 2 + {_E}) / (2 * {_E}) * pow(2, zoom))::INT AS x0, trunc((cx + span / 2 + {_E}) / (2 * {_E}) * pow(2, zoom))::INT AS x1,
  trunc(({_E} - cy - span / 2) / (2 * {_E}) * pow(2, zoom))::INT AS y0, trunc(({_E} - cy + span / 2) / (2 * {_E}) * pow(2, zoom))::INT AS y1 FROM z)
SELECT traveler_id, seq, zoom::INT AS zoom, x0, x1, y0, y1 FROM b QUALIFY row_number() OVER (PARTITION BY traveler_id, seq ORDER BY CASE WHEN (x1 - x0 + 1) * (y1 - y0 + 1) <= 25 THEN zoom ELSE 0 END DESC, zoom) = 1"""
ORACLES["w20_overview_split"] = f"""WITH {sql.UNWRAPPED}, lastx AS (SELECT traveler_id, x AS last FROM un QUALIFY row_number() OVER (PARTITION BY traveler_id ORDER BY t_ms DESC, seq DESC) = 1),
ref AS (SELECT traveler_id, CASE WHEN max(x) - min(x) < 1 THEN (min(x) + max(x)) / 2 ELSE any_value(last) END AS ref FROM un JOIN lastx USING (traveler_id) GROUP BY 1),
w1 AS (SELECT u.*, ref, x - floor(x - ref + 0.5) AS wx FROM un u JOIN ref USING (traveler_id)), w2 AS (SELECT *, lag(wx) OVER {sql._W} AS px, lag(y) OVER {sql._W} AS py FROM w1),
w3 AS (SELECT *, CASE WHEN wx - px > 0.5 THEN -0.5 WHEN wx - px < -0.5 THEN 0.5 END AS side FROM w2),
w4 AS (SELECT *, ref + side AS edge, wx + CASE WHEN side > 0 THEN 1.0 ELSE -1.0 END AS goal, sum((side IS NOT NULL)::INT) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS part FROM w3),
w5 AS (SELECT *, py + (y - py) * (edge - px) / CASE WHEN goal = px THEN 1.0 ELSE goal - px END AS cy FROM w4),
w6 AS (SELECT traveler_id, t_ms, seq, part, 2 AS o, wx AS x, y FROM w5 UNION ALL SELECT traveler_id, t_ms, seq, part - 1, 0, edge, cy FROM w5 WHERE side IS NOT NULL UNION ALL SELECT traveler_id, t_ms, seq, part, 1, edge - 2 * side, cy FROM w5 WHERE side IS NOT NULL)
SELECT traveler_id, part::INT AS part, row_number() OVER (PARTITION BY traveler_id, part ORDER BY t_ms, seq, o)::INT AS part_no, round(x, 9) AS x, round(y, 9) AS y FROM w6"""
ORACLES["a18_eta_remaining"] = """WITH l AS (SELECT user_id AS job, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), e AS (SELECT *, k * 2000 + n % 3 * 40 AS elapsed_ms, k * 24 AS completed, 2400 AS total FROM l),
w AS (SELECT *, list(elapsed_ms) OVER (PARTITION BY job ORDER BY n ROWS 5 PRECEDING) AS es, min(elapsed_ms) OVER (PARTITION BY job) AS began FROM e), q AS (SELECT *, [24.0 / (es[i + 1] - es[i]) FOR i IN range(1, len(es))] AS rates FROM w),
m AS (SELECT *, list_sort(rates)[len(rates) // 2 + 1] AS mid FROM q)
SELECT job, n, elapsed_ms, completed, total, CASE WHEN completed < total AND len(es) >= 5 AND elapsed_ms - began >= 8000 AND len([x FOR x IN rates IF abs(x - mid) / mid > 0.15]) = 0
  THEN greatest(1, ceil((total - completed) / (24.0 * (len(es) - 1) / (elapsed_ms - es[1])) / 1000.0))::BIGINT END AS remaining_s FROM m"""


@query("t5_lightweight_viewport", f"WITH {sql.TOTALS}, {SAMPLES}, {LINEAR}, {plain_windows(_STEADY)}, {viewports(_STEADY, False)} {_RAW}")
def t5(s: SparkSession, d: str) -> DataFrame:
    """T5: the ends of the windows alone."""
    h = hops(s, d)
    t = journey.totals(h)
    return camera.journey_viewports(h, None, t, None, _STEADY, points=False).select("traveler_id", "sample", r("center_x", 6), r("center_y", 6), r("span_y", 6))
