"""SQL that answers the problem queries independently, for comparison on small tables."""

_FIELD = '("(?:[^"]|"")*"|[^",][^,]*|)'
_CSV = ",".join([_FIELD] * 8)
_LATER = "M?[0-9]{2}/M?[0-9]{2}|[QA][0-9]{4}|NOSIG|BECMG|TEMPO|PROB[0-9]{2}"
_WEATHER = "[-+]?(RE|VC)?(MI|BC|PR|TS|BL|SH|DR|FZ)*(DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|SQ|FC|SS|DS|TS)+"
_CLOUD = "(SKC|FEW|SCT|BKN|OVC|NSC|NCD|CLR)([0-9]{3})?(CB)?"
_RUNWAY = "R[0-9]{2}[LRC]?/.*"


def _full(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, '{pattern}')"


def _first(items: str, test: str) -> str:
    return f"nullif(coalesce(list_position(list_transform({items}, lambda x: {test}), true), 0), 0)"


P2_READ = f"""
z AS (SELECT line_id, coalesce(layout, '') = 'csv' AS csv, line, line IS NULL OR regexp_full_match(line, '\\s*') AS empty FROM zspd),
k AS (SELECT *, empty OR (csv AND NOT {_full("line", _CSV)}) AS bad FROM z),
c AS (SELECT line_id, regexp_extract(line, '^{_CSV}$', 3) AS w, regexp_extract(line, '^{_CSV}$', 4) AS v, regexp_extract(line, '^{_CSV}$', 5) AS s FROM k WHERE csv AND NOT bad),
u AS (SELECT line_id, trim(w, '"') AS w, trim(v, '"') AS v, trim(s, '"') AS s FROM c),
cg AS (SELECT line_id, list_filter(string_split_regex(w, '\\s+'), lambda x: x <> '') AS wind, list_filter(string_split_regex(s, '[\\s,]+'), lambda x: x <> '' AND x <> 'CAVOK') AS sky,
              list_contains(string_split_regex(v || ' ' || s, '[\\s,]+'), 'CAVOK') AS cavok FROM u),
t AS (SELECT line_id, list_filter(string_split_regex(line, '[\\s=]+'), lambda x: x <> '') AS g FROM k WHERE NOT csv AND NOT bad),
h AS (SELECT line_id, g[CASE WHEN {_full("g[1]", "METAR(/SPECI)?")} THEN 4 ELSE 3 END:] AS b FROM t),
e AS (SELECT line_id, b[:coalesce({_first("b", _full("x", _LATER))} - 1, len(b))] AS b FROM h),
p AS (SELECT line_id, b, {_first("b", _full("x", "[0-9]{4}|CAVOK"))} AS sight, {_first("b", f"{_full('x', _CLOUD)} OR {_full('x', _RUNWAY)} OR {_full('x', _WEATHER)}")} AS other FROM e),
pg AS (SELECT line_id, b[:coalesce(sight, other, len(b) + 1) - 1] AS wind,
              list_filter(b[coalesce(sight + 1, other, len(b) + 1):], lambda x: NOT ({_full("x", _RUNWAY)} OR {_full("x", _WEATHER)} OR x = 'CAVOK')) AS sky, list_contains(b, 'CAVOK') AS cavok FROM p),
a AS (SELECT line_id, list_filter(wind, lambda x: NOT {_full("x", "[0-9]{3}V[0-9]{3}")}) AS wind, sky, cavok FROM (FROM cg UNION ALL FROM pg))"""
P2 = f"""
WITH {P2_READ}
SELECT line_id, 'line' AS expr FROM k WHERE bad
UNION ALL SELECT line_id, 'WindExpr' FROM a WHERE len(wind) <> 1 OR NOT {_full("wind[1]", "([0-9]{3}|VRB)[0-9]{2}(G[0-9]{2})?(MPS|KT|KMH)")} OR coalesce(try_cast(wind[1][:3] AS INT) > 360, false)
UNION ALL SELECT line_id, 'CloudExpr' FROM a WHERE (len(sky) = 0 AND NOT cavok) OR len(list_filter(sky, lambda x: NOT {_full("x", _CLOUD)})) > 0
"""

P2_LOADED = f"""
WITH {P2_READ}
SELECT line_id, regexp_extract(wind[1], '^(...)(..)', 1) AS direction, regexp_extract(wind[1], '^(...)(..)', 2) AS speed, regexp_extract(wind[1], '(MPS|KT|KMH)$') AS unit,
       nullif(regexp_extract(wind[1], 'G([0-9]{{2}})', 1), '') AS g,
       array_to_string(list_transform(sky, lambda x: regexp_extract(x, '^{_CLOUD}$', 1) || '/' || regexp_extract(x, '^{_CLOUD}$', 2) || '/' || regexp_extract(x, '^{_CLOUD}$', 3)), ' ') AS clouds
FROM a WHERE len(wind) = 1 AND {_full("wind[1]", "([0-9]{3}|VRB)[0-9]{2}(G[0-9]{2})?(MPS|KT|KMH)")} AND coalesce(try_cast(wind[1][:3] AS INT) <= 360, true)
  AND (len(sky) > 0 OR cavok) AND len(list_filter(sky, lambda x: NOT {_full("x", _CLOUD)})) = 0
"""


def _wind(x: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({x}), '\\bkts?\\b|\\bkn\\b|knot|节|海里') THEN 1852 / 3600.0 WHEN regexp_matches(lower({x}), 'km/?h|kph|kilomet|公里') THEN 1 / 3.6
        WHEN regexp_matches(lower({x}), 'm/s|mps|met(er|re)s? p|米每秒') THEN 1.0 END"""


def _pressure(x: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({x}), 'mm ?hg|of mercury|毫米汞柱') AND NOT regexp_matches(lower({x}), 'inches') THEN 1.33322387415
        WHEN regexp_matches(lower({x}), 'inhg|inches|zoll|英寸|^\\s*a$|^ins?$') THEN 33.86388640341 WHEN regexp_matches(lower({x}), 'kpa|千帕|kilopascal') THEN 10.0
        WHEN regexp_matches(lower({x}), 'tenths') THEN 0.1 WHEN regexp_matches(lower({x}), 'hpa|mb|^\\s*q|he[ck]topascal|百帕') THEN 1.0 END"""


_NUMBER = "try_cast(nullif(regexp_extract({x}, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)"
_REST = "trim(regexp_replace({x}, '[0-9.]+', ''))"
READ = f"""
q AS (SELECT w.report_id, w.station, w.date_expr, w.received_at, w.temperature_expr,
        {_NUMBER.format(x="wind_expr.speed")} AS wind,
        coalesce({_wind(_REST.format(x="wind_expr.speed"))}, {_wind("wind_expr.unit")}, {_wind("remark")}, {_wind("s.note")}, 1.0) AS wind_scale,
        {_NUMBER.format(x="pressure_expr.num")} AS press,
        coalesce({_pressure(_REST.format(x="pressure_expr.num"))}, {_pressure("pressure_expr.unit")}, {_pressure("remark")}, {_pressure("s.note")}, 1.0) AS press_scale
      FROM weather_report w LEFT JOIN station s ON s.icao = w.station),
l AS (SELECT station, coalesce(median(CASE WHEN press * press_scale BETWEEN 450 AND 1100 THEN press * press_scale WHEN press * press_scale / 100 BETWEEN 450 AND 1100 THEN press * press_scale / 100
        WHEN press * press_scale / 10 BETWEEN 450 AND 1100 THEN press * press_scale / 10 END), 1013.25) AS level FROM q GROUP BY 1)"""
P4 = f"""
WITH {READ},
n AS (SELECT report_id, arg_min(k, abs(press * k - level)) AS k FROM q JOIN l ON q.station IS NOT DISTINCT FROM l.station,
      (SELECT unnest([1.0, 0.1, 10.0, 1.33322387415, 0.133322387415, 33.86388640341, 0.3386388640341]) AS k) WHERE press IS NOT NULL GROUP BY 1)
SELECT report_id, 'wind' AS quantity FROM q WHERE wind IS NOT NULL AND abs(wind_scale - 1) > 1e-9
UNION ALL SELECT report_id, 'pressure' FROM n WHERE abs(k - 1) > 1e-9
"""
P4_CANONICAL = f"""
WITH {READ},
n AS (SELECT q.report_id, q.station, wind, wind_scale, press, press_scale, arg_min(k, abs(press * k - level)) AS k, min(abs(press * k - level)) <= 0.12 * max(level) AS near FROM q JOIN l ON q.station IS NOT DISTINCT FROM l.station,
      (SELECT unnest([1.0, 0.1, 10.0, 1.33322387415, 0.133322387415, 33.86388640341, 0.3386388640341]) AS k) GROUP BY ALL)
SELECT report_id, station, round(wind * wind_scale, 6) AS wind_mps, round(CASE WHEN near THEN k ELSE press_scale END * press, 4) AS pressure_hpa FROM n
"""
TIMES = """
d AS (SELECT *, date_trunc('month', received_at) AS m, date_expr.day AS dd, date_expr.time AS tt FROM q
      WHERE regexp_full_match(date_expr.day, '0[1-9]|[12][0-9]|3[01]') AND regexp_full_match(date_expr.time, '([01][0-9]|2[0-3])[0-5][0-9]') AND station IS NOT NULL),
x AS (SELECT *, m - to_months(b::INT) AS f FROM d, (SELECT unnest([0, 1, 2, 3]) AS b)),
y AS (SELECT report_id, f + to_days(dd::INT - 1) AS day, f, tt, received_at FROM x),
o AS (SELECT report_id, max(day + to_minutes(tt[:2]::INT * 60 + tt[3:]::INT)) AS seen FROM y
      WHERE month(day) = month(f) AND day + to_minutes(tt[:2]::INT * 60 + tt[3:]::INT) <= received_at GROUP BY 1),
r AS (SELECT q.report_id, station, epoch(seen)::BIGINT AS t,
        CASE WHEN regexp_full_match(temperature_expr.temperature, 'M?[0-9]+') THEN replace(temperature_expr.temperature, 'M', '-')::DOUBLE END AS temperature,
        CASE WHEN regexp_full_match(temperature_expr.dew, 'M?[0-9]+') THEN replace(temperature_expr.dew, 'M', '-')::DOUBLE END AS dew, round(wind * wind_scale, 6) AS speed
      FROM q JOIN o USING (report_id))"""
P5_CASES = f"""
WITH {READ}, {TIMES},
v AS (SELECT station, t, 'temperature' AS field, arg_min(temperature, report_id) AS value FROM r WHERE temperature IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT station, t, 'dew', arg_min(dew, report_id) FROM r WHERE dew IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT station, t, 'speed', arg_min(speed, report_id) FROM r WHERE speed IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, round(abs(value - lag(value) OVER w), 6) AS step, t - lag(t) OVER w AS pause, count(*) OVER (PARTITION BY station, field ORDER BY t) AS n,
        lag(value, 1) OVER w AS a1, lag(value, 2) OVER w AS a2, lag(value, 3) OVER w AS a3, lead(value, 1) OVER w AS b1, lead(value, 2) OVER w AS b2, lead(value, 3) OVER w AS b3
      FROM v WINDOW w AS (PARTITION BY station, field ORDER BY t)),
u AS (SELECT station, field, greatest(CASE field WHEN 'speed' THEN 9 ELSE 6 END, 2.5 * coalesce(quantile_disc(step, 0.9), 0)) - 1e-9 AS least FROM s GROUP BY 1, 2),
j AS (SELECT s.*, abs(value - a1) >= least AS pa1, abs(value - a2) >= least AS pa2, abs(value - a3) >= least AS pa3, abs(value - b1) >= least AS pb1, abs(value - b2) >= least AS pb2, abs(value - b3) >= least AS pb3,
        abs(b1 - a1) >= least AND abs(b1 - a2) >= least AND abs(b1 - b2) >= least AND abs(b1 - b3) >= least AS next_ok,
        abs(a1 - a2) >= least AND abs(a1 - a3) >= least AND abs(a1 - b1) >= least AND abs(a1 - b2) >= least AS prev_ok FROM s JOIN u USING (station, field)),
g AS (SELECT *, sum(CASE WHEN step < 1e-6 AND pause < 2592000 THEN 0 ELSE 1 END) OVER (PARTITION BY station, field ORDER BY t) AS run FROM s),
h AS (SELECT *, count(*) OVER p AS size, max(t) OVER p - min(t) OVER p AS long FROM g WINDOW p AS (PARTITION BY station, field, run)),
c AS (SELECT station, t, field, 'spike' AS kind FROM j WHERE (pa1 AND pa2 AND pb1 AND pb2) OR (pa1 AND pa2 AND pb2 AND pb3 AND next_ok) OR (pa2 AND pa3 AND pb1 AND pb2 AND prev_ok)
      UNION SELECT station, t, field, 'stuck' FROM h WHERE size >= 6 AND long >= 43200
      UNION SELECT station, t, field, 'impossible' FROM v WHERE CASE field WHEN 'speed' THEN value > 75 ELSE abs(value) > 60 END),
k AS (FROM c UNION SELECT x.station, x.t, 'dew', 'impossible' FROM (FROM v WHERE field = 'dew') x JOIN (FROM v WHERE field = 'temperature') y USING (station, t) ANTI JOIN (FROM c WHERE field = 'temperature') z USING (station, t) WHERE x.value > y.value)
SELECT r.report_id, k.field, k.kind FROM r JOIN k USING (station, t) WHERE CASE k.field WHEN 'temperature' THEN temperature WHEN 'dew' THEN dew ELSE speed END IS NOT NULL
"""
P5 = f"SELECT DISTINCT report_id, field FROM ({P5_CASES})"
P6_OBSERVED = f"""
WITH {READ}, {TIMES}
SELECT station, strftime(make_timestamp(((t // 86400) * 86400 + (t % 86400) // 60 // s.report_every * s.report_every * 60)::BIGINT * 1000000), '%Y-%m-%d %H:%M') AS slot, round(avg(temperature), 6) AS value
FROM r JOIN station s ON s.icao = r.station WHERE temperature IS NOT NULL AND s.report_every >= 1 GROUP BY 1, 2
"""
P6 = f"""
WITH {READ}, {TIMES},
a AS (SELECT station, t, s.report_every AS every FROM r JOIN station s ON s.icao = r.station WHERE temperature IS NOT NULL AND s.report_every >= 1 GROUP BY ALL),
b AS (SELECT *, lead(t) OVER (PARTITION BY station ORDER BY t) AS n FROM a),
i AS (SELECT station, every, t // 86400 AS d, (t % 86400) // 60 // every AS k, n // 86400 AS nd, (n % 86400) // 60 // every AS nk FROM b WHERE n - t < 2592000),
m AS (SELECT station, every, d, k, nd, nk, unnest(range(d, nd + 1)) AS day FROM i),
f AS (SELECT station, every, day, unnest(range(CASE WHEN day = d THEN k + 1 ELSE 0 END, CASE WHEN day = nd THEN nk ELSE (1439 // every) + 1 END)) AS slot FROM m)
SELECT station, strftime(make_timestamp((day * 86400 + slot * every * 60)::BIGINT * 1000000), '%Y-%m-%d %H:%M') AS slot FROM f
"""
