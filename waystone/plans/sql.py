"""SQL for DuckDB that says what the registered queries say, put together from common table expressions."""

from __future__ import annotations


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {c} IS NOT NULL THEN 2*6371.0088*asin(least(1.0, sqrt(pow(sin((radians({c})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2)))) END)"


def world_y(lat: str) -> str:
    s = f"sin(radians(greatest(-85.05112878, least(85.05112878, {lat}))))"
    return f"(0.5 - ln((1.0+{s})/(1.0-{s}))/(4*pi()))"


def great(a: str, b: str, c: str, d: str, f: str) -> tuple[str, str]:
    """(lat, lon) of the point at fraction f on the great circle."""
    v = [[f"(cos(radians({p}))*cos(radians({q})))", f"(cos(radians({p}))*sin(radians({q})))", f"sin(radians({p}))"] for p, q in ((a, b), (c, d))]
    w = "acos(greatest(-1.0, least(1.0, " + " + ".join(f"{x}*{y}" for x, y in zip(*v, strict=True)) + ")))"
    wa, wb = (f"(CASE WHEN sin({w}) < 1e-8 THEN {z} ELSE sin({z}*{w})/sin({w}) END)" for z in (f"(1.0-{f})", f"({f})"))
    x, y, z = (f"({wa}*{v[0][i]} + {wb}*{v[1][i]})" for i in range(3))
    lat = f"CASE WHEN {f} <= 0 THEN {a} WHEN {f} >= 1 THEN {c} ELSE degrees(atan2({z}, sqrt({x}*{x}+{y}*{y}))) END"
    return lat, f"CASE WHEN {f} <= 0 THEN {b} WHEN {f} >= 1 THEN {d} ELSE degrees(atan2({y}, {x})) END"


PTS = """base AS (
  SELECT user_id AS traveler_id, event_id AS seq, (epoch_us(ts) // 1000) AS t_ms, ts, CAST(30 + user_id % 20 AS DOUBLE) + value / 1000.0 AS lat0,
    CAST(-180 + (user_id % 40) * 9 AS DOUBLE) + (event_id % 97) / 100.0 - 0.5 + CASE WHEN day(ts) >= 15 THEN 20.0 ELSE 0.0 END
    + CASE WHEN event_id % 13 = 0 THEN 120.0 ELSE 0.0 END AS lon0 FROM events),
pts AS (SELECT traveler_id, seq, t_ms, ts, round(lat0, 6) AS lat,
    round(CASE WHEN lon0 >= 180.0 THEN lon0 - 360.0 WHEN lon0 < -180.0 THEN lon0 + 360.0 ELSE lon0 END, 6) AS lon FROM base)"""
RAW = """raw AS (
  SELECT event_id % 4 AS traveler_id, event_id AS seq, event_id * 60000 AS t_ms,
    round(37 + floor((event_id % 4000) / 40) * 0.01 + (event_id % 7) * 0.0005 + CASE WHEN event_id % 29 = 0 THEN 1.0 ELSE 0.0 END, 6) AS lat,
    127.0::DOUBLE AS lon, 1.5 * CAST(json_extract_string(props, '$.k') AS INT) AS accuracy_m FROM events WHERE event_type <> 'error')"""
_W = "(PARTITION BY traveler_id ORDER BY t_ms, seq)"
HOPS = f"""{PTS},
lagged AS (SELECT *, lag(lat) OVER {_W} AS lat0, lag(lon) OVER {_W} AS lon0, lag(t_ms) OVER {_W} AS t0_ms, row_number() OVER {_W} - 1 AS i FROM pts),
hop AS (SELECT *, coalesce({hav('lat0', 'lon0', 'lat', 'lon')}, 0.0) AS hop_km FROM lagged),
cum AS (SELECT *, sum(hop_km) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS cum_km FROM hop),
hops AS (SELECT *, coalesce(lag(cum_km) OVER {_W}, 0.0) AS cum0_km FROM cum)"""
TOTALS = f"{HOPS}, totals AS (SELECT traveler_id, count(*) AS n_points, max(cum_km) AS total_km FROM hops GROUP BY 1)"
LIMITS = f"""{TOTALS},
near AS (SELECT traveler_id, hop_km FROM hops WHERE hop_km > 0 AND hop_km < 120),
med AS (SELECT traveler_id, median(hop_km) AS median_hop FROM near GROUP BY 1),
mad AS (SELECT traveler_id, any_value(median_hop) AS median_hop, median(abs(hop_km - median_hop)) AS mad_hop FROM near JOIN med USING (traveler_id) GROUP BY 1),
limits AS (SELECT t.traveler_id, median_hop, mad_hop,
   CASE WHEN median_hop IS NULL THEN 120.0 ELSE least(120.0, greatest(60.0, 3*median_hop, median_hop + 6*mad_hop)) END AS threshold_km FROM totals t LEFT JOIN mad USING (traveler_id))"""
LEGS = f"""{LIMITS},
far AS (SELECT h.*, hop_km >= greatest(1.0, threshold_km) AS far FROM hops h JOIN limits USING (traveler_id) WHERE lat0 IS NOT NULL),
isl AS (SELECT *, sum(far::INT) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS island FROM far),
leg0 AS (SELECT traveler_id, cum0_km AS start_km, cum_km AS end_km, true AS is_transfer FROM isl WHERE far
   UNION ALL SELECT traveler_id, min(cum0_km), max(cum_km), false FROM isl WHERE NOT far GROUP BY traveler_id, island HAVING max(cum_km) > min(cum0_km)),
legs AS (SELECT *, row_number() OVER (PARTITION BY traveler_id ORDER BY start_km, end_km) AS leg_no FROM leg0)"""
UNWRAPPED = f"""{PTS},
raw_x AS (SELECT *, (lon + 180.0) / 360.0 AS x0, {world_y('lat')} AS y FROM pts),
corr AS (SELECT *, CASE WHEN x0 - lag(x0) OVER {_W} > 0.5 THEN -1 WHEN x0 - lag(x0) OVER {_W} < -0.5 THEN 1 ELSE 0 END AS c FROM raw_x),
un AS (SELECT *, x0 + sum(c) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS x FROM corr)"""
KNOTS = f"""{LIMITS},
fh AS (SELECT h.*, (hop_km >= greatest(1.0, threshold_km))::INT AS far FROM hops h JOIN limits USING (traveler_id) WHERE lat0 IS NOT NULL),
fr AS (SELECT *, sum(ch) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS run
   FROM (SELECT *, CASE WHEN far = coalesce(lag(far) OVER {_W}, 0) THEN 0 ELSE 1 END AS ch FROM fh)),
rs AS (SELECT *, sum(hop_km) OVER (PARTITION BY traveler_id, run) AS run_km FROM fr),
wt AS (SELECT *, CASE WHEN far = 1 THEN pow(run_km, 0.85) * hop_km / run_km ELSE hop_km END AS weight FROM rs WHERE hop_km > 0),
kx AS (SELECT traveler_id, row_number() OVER {_W} AS k, sum(weight) OVER (PARTITION BY traveler_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY traveler_id) AS x, cum_km AS y FROM wt),
knots AS (SELECT * FROM kx UNION ALL SELECT traveler_id, 0, 0.0, 0.0 FROM kx WHERE k = 1)"""
_K = "(PARTITION BY traveler_id ORDER BY k)"
CURVE = f"""{KNOTS},
c1 AS (SELECT *, lead(x) OVER {_K} - x AS h1, (lead(y) OVER {_K} - y) / (lead(x) OVER {_K} - x) AS d1 FROM knots),
c2 AS (SELECT *, lag(h1) OVER {_K} AS h0, lag(d1) OVER {_K} AS d0, lead(h1) OVER {_K} AS h2, lead(d1) OVER {_K} AS d2, lag(h1, 2) OVER {_K} AS hh, lag(d1, 2) OVER {_K} AS dd FROM c1),
curve AS (SELECT traveler_id, k, x, y, CASE
   WHEN d0 IS NULL THEN CASE WHEN d2 IS NULL THEN d1 ELSE greatest(0.0, least(3*d1, ((2*h1+h2)*d1 - h1*d2)/(h1+h2))) END
   WHEN d1 IS NULL THEN CASE WHEN dd IS NULL THEN d0 ELSE greatest(0.0, least(3*d0, ((2*h0+hh)*d0 - h0*dd)/(h0+hh))) END
   WHEN d0 <= 0 OR d1 <= 0 THEN 0.0 ELSE ((2*h1+h0) + (h1+2*h0)) / ((2*h1+h0)/d0 + (h1+2*h0)/d1) END AS m FROM c2)"""


def candidates_of(run: int) -> str:
    """W9's condition that rows 1..run, between rows 0 and run + 1, are an excursion."""
    a = run + 1
    d = lambda i, j: hav(f"lat{i}", f"lon{i}", f"lat{j}", f"lon{j}")
    fast = lambda i, j: f"(t{j} - t{i} <= 0 OR {d(i, j)} / ((t{j} - t{i}) / 3600000.0) > 1300)"
    parts = [f"t{a} - t0 BETWEEN 0 AND 43200000", f"{d(0, a)} <= 200", f"{d(0, 1)} >= 500", f"{d(run, a)} >= 500", fast(0, 1), fast(run, a)]
    parts += [f"{d(1, i)} <= 200" for i in range(2, run + 1)] + [f"{d(0, i)} >= 500 AND {d(i, a)} >= 500" for i in range(1, run + 1)]
    return " AND ".join(parts)


def neighbours(table: str, low: int, high: int, *columns: str) -> str:
    """table with columns c0.. for the rows from low to high places away."""
    return "SELECT *, row_number() OVER {w} - 1 AS i, ".format(w=_W) + ", ".join(f"lead({c}, {k}) OVER {_W} AS {n}{k - low}" for k in range(low, high + 1) for c, n in (x.split(":") for x in columns)) + f" FROM {table}"


RESOLVE = """taken AS (SELECT traveler_id, s, e FROM cand QUALIFY row_number() OVER (PARTITION BY traveler_id ORDER BY s) = 1
   UNION ALL SELECT c.traveler_id, c.s, c.e FROM taken t JOIN LATERAL (SELECT * FROM cand c WHERE c.traveler_id = t.traveler_id AND c.s >= t.e + 2 ORDER BY c.s LIMIT 1) c ON true),
gone AS (SELECT traveler_id, unnest(generate_series(s, e)) AS i FROM taken)"""
OUTLIERS = f"""WITH RECURSIVE {PTS},
nb AS ({neighbours('pts', -1, 3, 'lat:lat', 'lon:lon', 't_ms:t')}),
cand AS (SELECT traveler_id, i AS s, i + CASE WHEN {candidates_of(3)} THEN 2 WHEN {candidates_of(2)} THEN 1 WHEN {candidates_of(1)} THEN 0 END AS e FROM nb
   WHERE ({candidates_of(3)}) OR ({candidates_of(2)}) OR ({candidates_of(1)})), {RESOLVE}"""
_D = lambda i, j: hav(f"lat{i}", f"lon{i}", f"lat{j}", f"lon{j}")
_FAST = lambda i, j: f"(t{j} - t{i} <= 0 OR {_D(i, j)} / ((t{j} - t{i}) / 3600000.0) > 250)"
SPIKES = f"""WITH RECURSIVE {RAW}, good AS (SELECT * FROM raw WHERE accuracy_m <= 100),
nb AS ({neighbours('good', -1, 1, 'lat:lat', 'lon:lon', 't_ms:t', 'accuracy_m:a')}),
cand AS (SELECT traveler_id, i AS s, i AS e FROM nb WHERE t2 - t0 BETWEEN 0 AND 1200000 AND {_D(0, 2)} <= greatest(0.2, 2*(a0+a2)/1000)
   AND {_D(0, 1)} >= greatest(0.5, 5*a1/1000) AND {_D(1, 2)} >= greatest(0.5, 5*a1/1000) AND {_FAST(0, 1)} AND {_FAST(1, 2)}), {RESOLVE},
clean AS (SELECT traveler_id, seq, t_ms, lat, lon, accuracy_m FROM nb ANTI JOIN gone USING (traveler_id, i))"""
STATIONARY = f"""{SPIKES},
num AS (SELECT *, row_number() OVER {_W} AS r FROM clean),
fold AS (SELECT traveler_id, r, seq, t_ms, lat, lon, accuracy_m, 1 AS run FROM num WHERE r = 1
   UNION ALL SELECT n.traveler_id, n.r, CASE WHEN m AND n.accuracy_m >= f.accuracy_m THEN f.seq ELSE n.seq END, CASE WHEN m AND n.accuracy_m >= f.accuracy_m THEN f.t_ms ELSE n.t_ms END,
     CASE WHEN m AND n.accuracy_m >= f.accuracy_m THEN f.lat ELSE n.lat END, CASE WHEN m AND n.accuracy_m >= f.accuracy_m THEN f.lon ELSE n.lon END,
     CASE WHEN m AND n.accuracy_m >= f.accuracy_m THEN f.accuracy_m ELSE n.accuracy_m END, f.run + CASE WHEN m THEN 0 ELSE 1 END
   FROM fold f JOIN num n ON n.traveler_id = f.traveler_id AND n.r = f.r + 1,
   LATERAL (SELECT n.t_ms - f.t_ms BETWEEN 0 AND 600000 AND {hav('f.lat', 'f.lon', 'n.lat', 'n.lon')} <= greatest(0.025, (f.accuracy_m + n.accuracy_m)/1000) AS m)),
kept AS (SELECT traveler_id, arg_max(seq, r) AS seq, arg_max(t_ms, r) AS t_ms, arg_max(lat, r) AS lat, arg_max(accuracy_m, r) AS accuracy_m FROM fold GROUP BY traveler_id, run)"""
