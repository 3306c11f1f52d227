"""SQL, run by another engine, that the queries are held against.

Containment is exact integer edge parity, intersections are closed forms over
disjoint rectangles and the diamond, the projection is its formula. None of it
shares code with the operators. Values are rounded as decimals, as the queries
round them, so that a half is one in both engines.
"""

from __future__ import annotations

from ..functions.albers import C, E, E2, LON0, N, RHO0
from ..operators import insight
from ..functions.legend import DROUGHT_LABELS, GROUPS, LEGEND, NOT_FARMED
from ..functions.links import ALPHABET
from .fixtures import SQL, X0, Y0

ACRE = 4046.8564224


def _case(column: str, table: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


_NAME, _AG = _case("crop_code", LEGEND), f"crop_code NOT IN ({', '.join(map(str, NOT_FARMED))})"
_LABEL = _case("drought_class", DROUGHT_LABELS, "'Unknown'")
_GROUP = _case("crop_code", {c: g for g, _, codes in GROUPS for c in codes}, "'other'")


def _r(x: str, places: int) -> str:
    return f"cast(round(cast({x} AS DECIMAL(28,9)), {places}) AS DOUBLE)"


def _diamond(x: str, y: str, r: float = 210) -> str:
    """Area of the diamond |u| + |v| <= r left of x and below y, both taken from its centre."""

    def left(size: str) -> str:  # of all v, for the diamond of that size, halved
        return f"(CASE WHEN {size} <= 0 OR {x} <= -({size}) THEN 0.0 WHEN {x} >= {size} THEN 1.0*({size})*({size}) WHEN {x} <= 0 THEN ({size}+{x})*({size}+{x})/2.0 ELSE 1.0*({size})*({size}) - ({size}-{x})*({size}-{x})/2.0 END)"

    below, above = left(f"({r}+({y}))"), left(f"({r}-({y}))")
    return f"(CASE WHEN {y} >= 0 THEN 2*{left(str(r))} - {above} ELSE {below} END)"


def _hits(points: str, out: str) -> str:
    return f"""
{out}_cand AS (SELECT p.*, s.polygon_id, s.mukey, s.musym, s.areasymbol, s.x0, s.y0, s.shape FROM (SELECT row_number() OVER () AS pid, * FROM {points}) p
  JOIN fx_soil s ON p.x >= s.x0 - 60 AND p.x <= s.x0 + 360 AND p.y >= s.y0 - 60 AND p.y <= s.y0 + 360),
{out}_turn AS (SELECT c.pid, c.polygon_id, c.x - c.x0 AS px, c.y - c.y0 AS py, e.*, (e.ex2-e.ex1)*(c.y-c.y0-e.ey1) - (c.x-c.x0-e.ex1)*(e.ey2-e.ey1) AS t FROM {out}_cand c JOIN fx_shape_edges e ON e.shape = c.shape),
{out}_in AS (SELECT pid, polygon_id FROM {out}_turn GROUP BY pid, polygon_id
  HAVING sum(CASE WHEN (ey1 > py) <> (ey2 > py) AND (t > 0) = (ey2 > ey1) THEN 1 ELSE 0 END) % 2 = 1
  AND max(CASE WHEN t = 0 AND px BETWEEN least(ex1,ex2) AND greatest(ex1,ex2) AND py BETWEEN least(ey1,ey2) AND greatest(ey1,ey2) THEN 1 ELSE 0 END) = 0),
{out} AS (SELECT c.* FROM {out}_cand c JOIN {out}_in i ON i.pid = c.pid AND i.polygon_id = c.polygon_id)"""


# a rectangle and a shape of edges parallel to the axes touch if the rectangle touches one of its parts; the diamond by its own formula
_SOIL_DROUGHT = """
touch AS (
  SELECT s.polygon_id, d.drought_class FROM fx_soil s JOIN fx_shape_rects r ON r.shape = s.shape JOIN fx_drought d
    ON s.x0+r.rx1 <= d.maxx AND s.x0+r.rx2 >= d.minx AND s.y0+r.ry1 <= d.maxy AND s.y0+r.ry2 >= d.miny WHERE s.shape < 4
  UNION SELECT s.polygon_id, d.drought_class FROM fx_soil s JOIN fx_drought d
    ON greatest(d.minx-(s.x0+150), 0, (s.x0+150)-d.maxx) + greatest(d.miny-(s.y0+150), 0, (s.y0+150)-d.maxy) <= 210 WHERE s.shape = 4),
soil_dry AS (SELECT s.*, coalesce(m.d, -1) AS drought_class FROM fx_soil s LEFT JOIN (SELECT polygon_id, max(drought_class) AS d FROM touch GROUP BY polygon_id) m ON m.polygon_id = s.polygon_id)"""

_AREA = "CASE shape WHEN 0 THEN 90000.0 WHEN 1 THEN 57600.0 WHEN 2 THEN 75600.0 WHEN 3 THEN 72000.0 ELSE 88200.0 END"
_BOX = (X0 + 450, Y0 + 130, X0 + 3010, Y0 + 2345)


def _inside_box(box: tuple, soil: str = "fx_soil", more: str = "") -> str:
    """SQL for polygon_id and m2 of each soil polygon inside a box."""
    a, b, c, d = box
    keep = f", {more}" if more else ""
    cut = f"greatest(0, least({c}, x0+rx2)-greatest({a}, x0+rx1)) * greatest(0, least({d}, y0+ry2)-greatest({b}, y0+ry1))"
    u = [f"({v}-({o}+150))" for v, o in ((a, "x0"), (b, "y0"), (c, "x0"), (d, "y0"))]
    diamond = f"{_diamond(u[2], u[3])} - {_diamond(u[0], u[3])} - {_diamond(u[2], u[1])} + {_diamond(u[0], u[1])}"
    return f"SELECT polygon_id{keep}, sum(1.0*{cut}) AS m2 FROM {soil}, fx_shape_rects r WHERE r.shape = fx_soil.shape GROUP BY ALL UNION ALL SELECT polygon_id{keep}, {diamond} AS m2 FROM {soil} WHERE shape = 4"


# a field and a dented square: the square is a rectangle, the dent the lower half of a diamond 300 wide and o deep each way
_TRI = "150.0*o*({} - {} - {} + {})".format(*(_diamond(x, y, 1) for y, xs in (("w2", ("u2", "u1")), ("w1", ("u2", "u1"))) for x in xs))
_DENTED_HITS = f"""SELECT field_id, o, sq, {_TRI} AS tri FROM (SELECT f.field_id, o, 1.0*greatest(0, least(maxx, x0+300)-greatest(minx, x0))*greatest(0, least(maxy, y0+300)-greatest(miny, y0)) AS sq,
  (minx-(x0+150))/150.0 AS u1, (maxx-(x0+150))/150.0 AS u2, 1.0*least(miny-y0, 0)/o AS w1, 1.0*least(maxy-y0, 0)/o AS w2
  FROM fx_fields f JOIN (SELECT *, CASE WHEN polygon_id % 2 = 0 THEN 10 ELSE 50 END AS o FROM fx_soil) s ON minx <= x0+300 AND maxx >= x0 AND miny <= y0+300 AND maxy >= y0-o)"""

_KEY = "mukey, musym, areasymbol, crop_code, drought_class"
_ENRICH = f"round(pixels * (900/{ACRE}), 3) AS acres, {_NAME} AS land_cover, {_AG} AS is_agricultural"
_PARTS = {
    "points": [], "hits": [_hits("fx_points", "hit")], "skew": [_hits("fx_points_skew", "hits_skew")], "dry": [_SOIL_DROUGHT],
    "plain": [f"plain AS (SELECT *, {_ENRICH} FROM (SELECT mukey, musym, areasymbol, crop_code, -1 AS drought_class, count(*) AS pixels FROM hit GROUP BY ALL))"],
    "overlay": [f"overlay AS (SELECT *, {_ENRICH} FROM (SELECT d.mukey, d.musym, d.areasymbol, h.crop_code, d.drought_class, count(*) AS pixels FROM hit h JOIN soil_dry d ON d.polygon_id = h.polygon_id GROUP BY ALL))"],
    "fields": [f"""
rsoil AS (SELECT s.mukey, s.polygon_id, s.x0+r.rx1 AS a, s.y0+r.ry1 AS b, s.x0+r.rx2 AS c, s.y0+r.ry2 AS d FROM fx_soil s JOIN fx_shape_rects r ON r.shape = s.shape),
fields AS (SELECT *, (maxx-minx)*(maxy-miny)/{ACRE} AS query_acres FROM fx_fields),
parts AS (
  SELECT f.field_id, s.mukey, cast((least(f.maxx,s.c)-greatest(f.minx,s.a))*(least(f.maxy,s.d)-greatest(f.miny,s.b)) AS double) AS m2 FROM fields f JOIN rsoil s ON f.minx <= s.c AND f.maxx >= s.a AND f.miny <= s.d AND f.maxy >= s.b
  UNION ALL SELECT field_id, mukey, {_diamond('c', 'd')} - {_diamond('a', 'd')} - {_diamond('c', 'b')} + {_diamond('a', 'b')} FROM
   (SELECT f.field_id, s.mukey, f.minx-(s.x0+150) AS a, f.miny-(s.y0+150) AS b, f.maxx-(s.x0+150) AS c, f.maxy-(s.y0+150) AS d FROM fields f JOIN fx_soil s ON s.shape = 4) q WHERE greatest(a, 0, -c) + greatest(b, 0, -d) <= 210),
hits AS (SELECT field_id, mukey, sum(m2) AS inter_m2 FROM parts GROUP BY ALL),
unit AS (SELECT mukey, sum(CASE shape WHEN 0 THEN 90000.0 WHEN 1 THEN 57600.0 WHEN 2 THEN 75600.0 WHEN 3 THEN 72000.0 ELSE 88200.0 END) AS total_m2, count(*) AS polygons FROM fx_soil GROUP BY mukey),
roverlay AS (SELECT * FROM overlay),
weighted AS (SELECT h.*, h.inter_m2 / u.total_m2 AS fraction FROM hits h JOIN unit u ON u.mukey = h.mukey),
ans AS (SELECT * FROM weighted w WHERE EXISTS (SELECT 1 FROM roverlay o WHERE o.mukey = w.mukey)),
cover AS (SELECT w.field_id, o.land_cover, o.crop_code, o.is_agricultural, sum(o.acres*w.fraction) AS acres, sum(o.pixels*w.fraction) AS pixels FROM weighted w JOIN roverlay o ON o.mukey = w.mukey GROUP BY ALL),
dry AS (SELECT w.field_id, o.drought_class, sum(o.acres*w.fraction) AS acres, sum(o.pixels*w.fraction) AS pixels FROM weighted w JOIN roverlay o ON o.mukey = w.mukey GROUP BY ALL),
soilsum AS (SELECT w.field_id, coalesce(sum(w.inter_m2) FILTER (WHERE a.mukey IS NOT NULL), 0) AS rated_m2, coalesce(sum(w.inter_m2) FILTER (WHERE coalesce(a.cap_irrigated, a.cap_rainfed) BETWEEN 1 AND 4), 0) AS cultivable_m2,
  coalesce(sum(w.inter_m2) FILTER (WHERE a.cap_irrigated IS NOT NULL), 0) AS irrigable_m2, sum(w.inter_m2*a.slope_pct)/nullif(sum(w.inter_m2) FILTER (WHERE a.slope_pct IS NOT NULL), 0) AS slope_pct,
  sum(w.inter_m2*a.water_storage)/nullif(sum(w.inter_m2) FILTER (WHERE a.water_storage IS NOT NULL), 0) AS water_storage FROM ans w LEFT JOIN fx_attr a ON a.mukey = w.mukey GROUP BY w.field_id),
domin AS (SELECT field_id, muname AS dominant_soil, drainage AS dominant_drainage FROM (SELECT w.field_id, a.muname, a.drainage, row_number() OVER (PARTITION BY w.field_id ORDER BY w.inter_m2 DESC, w.mukey DESC) AS rn FROM weighted w JOIN fx_attr a ON a.mukey = w.mukey) WHERE rn = 1)"""],
}
_NEEDS = {"hits": [], "skew": [], "dry": [], "plain": ["hits"], "overlay": ["hits", "dry"], "fields": ["hits", "dry", "overlay"]}


def _with(select: str, *parts: str) -> str:
    listed: list[str] = []
    for p in parts:
        for q in [*_NEEDS[p], p]:
            if q not in listed:
                listed.append(q)
    ctes = [f"{k} AS ({v.replace('varchar(20)', 'varchar')})" for k, v in SQL.items()]
    return "WITH " + ",\n".join(ctes + [x.strip() for p in listed for x in _PARTS[p]]) + "\n" + select


_COLS = "mukey, musym, areasymbol, cast(crop_code AS int) AS crop_code, cast(drought_class AS int) AS drought_class, pixels, acres, land_cover, is_agricultural"
_Q = f"(({{s}}) * {1 - E2!r} / (1 - {E2!r}*({{s}})*({{s}})) - ln((1 - {E!r}*({{s}}))/(1 + {E!r}*({{s}}))) * {(1 - E2) / (2 * E)!r})"
_ALBERS = f"""WITH p AS (SELECT event_id, -125 + (event_id % 500)/8.0 AS lon, 25 + (event_id % 239)/10.0 AS lat FROM events),
q AS (SELECT *, 6378137.0*sqrt({C!r} - {N!r}*{_Q.format(s='sin(radians(lat))')})/{N!r} AS rho, {N!r}*(radians(lon) - ({LON0!r})) AS th FROM p)
SELECT event_id, round(rho*sin(th), 2) AS x, round({RHO0!r} - rho*cos(th), 2) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM q"""

_LAT = "SELECT phase, run, latency_ms, row_number() OVER (PARTITION BY phase, run ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY phase, run) AS n FROM fx_requests WHERE status = 200"
_AT = "greatest(1, least(n, cast(round_even({p}*n/100.0 + 0.5, 0) AS bigint)))"
_RUNS = f"""runs AS (SELECT e.*, coalesce(g.ok, 0) AS ok, g.p50_ms, g.p95_ms, g.p99_ms, g.min_ms, g.max_ms FROM
 (SELECT phase, run, count(*) AS requests, sum(CASE WHEN status <> 200 THEN 1 ELSE 0 END) AS errors, {_r('avg(CASE WHEN cached THEN 1.0 ELSE 0.0 END)', 4)} AS hit_rate, coalesce(string_agg(DISTINCT cast(CASE WHEN status <> 200 THEN status END AS varchar), ',' ORDER BY cast(CASE WHEN status <> 200 THEN status END AS varchar)), '') AS error_codes FROM fx_requests GROUP BY phase, run) e
 LEFT JOIN (SELECT phase, run, count(*) AS ok, {_r('median(latency_ms)', 2)} AS p50_ms, {_r(f'max(CASE WHEN rn = {_AT.format(p=95)} THEN latency_ms END)', 2)} AS p95_ms, {_r(f'max(CASE WHEN rn = {_AT.format(p=99)} THEN latency_ms END)', 2)} AS p99_ms, {_r('min(latency_ms)', 2)} AS min_ms, {_r('max(latency_ms)', 2)} AS max_ms FROM ({_LAT}) GROUP BY phase, run) g USING (phase, run))"""
_FX = "WITH " + ",\n".join(f"{k} AS ({v.replace('varchar(20)', 'varchar')})" for k, v in SQL.items())
_W = "sum({x}) OVER ()"

ORACLES = {
    "overlay": _with(f"SELECT {_COLS} FROM plain", "plain"),
    "overlay_broadcast": _with(f"SELECT {_COLS} FROM plain", "plain"),
    "overlay_chunked": _with(f"SELECT mukey, musym, areasymbol, cast(crop_code AS int) AS crop_code, drought_class, pixels FROM plain", "plain"),
    "overlay_skew": _with("SELECT mukey, musym, areasymbol, crop_code, count(*) AS pixels FROM hits_skew GROUP BY ALL", "skew"),
    "overlay_drought": _with(f"SELECT {_COLS} FROM overlay", "overlay"),
    "drought_refresh": _with(f"SELECT {_COLS} FROM overlay", "overlay"),
    "attach_drought": _with("SELECT polygon_id, mukey, drought_class FROM soil_dry", "dry"),
    "match_report": _with("SELECT (SELECT count(*) FROM fx_points) AS points, sum(pixels) AS matched, count(*) AS overlay_rows, round(100.0*sum(pixels)/(SELECT count(*) FROM fx_points), 3) AS match_rate, round(1.0*sum(pixels)/count(*), 3) AS compression FROM plain", "plain"),
    "unmatched_points": _with("SELECT pixel_id, x, y FROM fx_points WHERE pixel_id NOT IN (SELECT pixel_id FROM hit)", "hits"),
    "match_multiplicity": _with("SELECT CASE WHEN i AND o THEN 'both' WHEN i THEN 'inside' ELSE 'outside' END AS matched, count(*) AS points FROM (SELECT pixel_id, bool_or(areasymbol LIKE 'CA%') AS i, bool_or(areasymbol NOT LIKE 'CA%') AS o FROM hit GROUP BY pixel_id) GROUP BY 1", "hits"),
    "scanline_truth": _with("SELECT polygon_id, crop_code, count(*) AS pixels FROM hit GROUP BY ALL", "hits"),
    "validate_overlay": _with("SELECT mukey, count(*) AS pixels, count(*) AS truth, 0 AS delta, true AS same_classes, true AS ok FROM hit GROUP BY mukey", "hits"),
    "land_cover_totals": _with("SELECT land_cover, is_agricultural, round(sum(acres), 0) AS acres FROM overlay GROUP BY ALL", "overlay"),
    "drought_totals": _with(f"SELECT drought_class, {_LABEL} AS label, round(a, 3) AS acres, round(a/{_W.format(x='a')}, 6) AS share FROM (SELECT drought_class, sum(acres) AS a FROM overlay GROUP BY drought_class)", "overlay"),
    "crop_shares": _with(f"SELECT crop_code, round(a, 3) AS acres, round(100*a/{_W.format(x='a')}, 4) AS pct FROM (SELECT crop_code, sum(acres) AS a FROM overlay GROUP BY crop_code)", "overlay"),
    "acre_summary": _with("SELECT round(sum(acres), 3) AS total_acres, round(sum(acres) FILTER (WHERE is_agricultural), 3) AS ag_acres, round(100*sum(acres) FILTER (WHERE is_agricultural)/sum(acres), 4) AS ag_pct FROM overlay", "overlay"),
    "class_histogram": _with(f"SELECT crop_code, n, round(100.0*n/{_W.format(x='n')}, 4) AS pct, count(*) OVER () AS classes FROM (SELECT crop_code, count(*) AS n FROM fx_points WHERE crop_code <> 0 GROUP BY crop_code) ORDER BY n DESC, crop_code LIMIT 12"),
    "pixels_by_unit": _with("SELECT mukey, crop_code, sum(pixels) AS pixels FROM overlay GROUP BY ALL", "overlay"),
    "top_overlaps": _with(f"SELECT {_COLS} FROM overlay ORDER BY acres DESC, mukey, musym, areasymbol, crop_code, drought_class LIMIT 15", "overlay"),
    "top_units": _with("SELECT mukey, sum(pixels) AS pixels FROM overlay GROUP BY mukey ORDER BY pixels DESC, mukey LIMIT 6", "overlay"),
    "dominant_cover": _with("SELECT mukey, land_cover, crop_code, drought_class, acres FROM (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY acres DESC, crop_code, drought_class, musym DESC, areasymbol DESC) AS rn FROM overlay) WHERE rn = 1", "overlay"),
    "mapunit_lookup": _with("SELECT mukey, crop_code, drought_class, musym, areasymbol, pixels, acres, round(sum(acres) OVER (PARTITION BY mukey), 3) AS total_acres FROM overlay WHERE mukey IN (SELECT mukey FROM fx_attr)", "overlay"),
    "block_profile": _with("""SELECT coalesce(p.cx, g.cx) AS cx, coalesce(p.cy, g.cy) AS cy, coalesce(p.points, 0) AS points, coalesce(g.polygons, 0) AS polygons, coalesce(g.vertices, 0) AS vertices, coalesce(g.large, 0) AS large, round(coalesce(g.box_share, 0), 6) AS box_share FROM
 (SELECT cast(floor(x/1500.0) AS bigint) AS cx, cast(floor(y/1500.0) AS bigint) AS cy, count(*) AS points FROM fx_points GROUP BY 1, 2) p FULL JOIN
 (SELECT cx, cy, count(*) AS polygons, sum(v) AS vertices, sum(CASE WHEN (c-a)*(d-b)/2250000.0 > 0.1 THEN 1 ELSE 0 END) AS large, sum((c-a)*(d-b)/2250000.0) AS box_share FROM (SELECT unnest(range(cast(floor(a/1500.0) AS bigint), cast(floor(c/1500.0) AS bigint)+1)) AS cx, a, b, c, d, v FROM (SELECT CASE shape WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 10 WHEN 3 THEN 10 ELSE 5 END AS v, x0 - CASE WHEN shape=4 THEN 60 ELSE 0 END AS a, y0 - CASE WHEN shape=4 THEN 60 ELSE 0 END AS b, x0 + CASE WHEN shape=4 THEN 360 ELSE 300 END AS c, y0 + CASE WHEN shape=4 THEN 360 ELSE 300 END AS d FROM fx_soil)) x, LATERAL (SELECT unnest(range(cast(floor(x.b/1500.0) AS bigint), cast(floor(x.d/1500.0) AS bigint)+1)) AS cy) y GROUP BY 1, 2) g ON p.cx = g.cx AND p.cy = g.cy"""),
    "assign_block": _with("SELECT bx, by_, count(*) AS points FROM (SELECT least(3, cast(floor((x-a)*4.0/greatest(c-a, 1)) AS int)) AS bx, least(3, cast(floor((y-b)*4.0/greatest(d-b, 1)) AS int)) AS by_ FROM fx_points, (SELECT min(x) AS a, max(x) AS c, min(y) AS b, max(y) AS d FROM fx_points)) GROUP BY ALL"),
    "bounds": _with("SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM fx_points"),
    "check_bounds": _with("SELECT min(x) AS minx, min(y) AS miny, abs(min(x) - -2000000) <= 100 AND abs(min(y) - 1700000) <= 100 AS ok FROM fx_points"),
    "layer_overlap": _with("SELECT count(*) > 0 AS overlaps FROM (SELECT min(x) AS a, max(x) AS c, min(y) AS b, max(y) AS d FROM fx_points) p, (SELECT min(x0-60) AS e, max(x0+360) AS g, min(y0-60) AS f, max(y0+360) AS h FROM fx_soil) s WHERE a <= g AND e <= c AND b <= h AND f <= d"),
    "albers_projection": _ALBERS,
    "mukey_area": _with("SELECT mukey, round(sum(CASE shape WHEN 0 THEN 90000.0 WHEN 1 THEN 57600.0 WHEN 2 THEN 75600.0 WHEN 3 THEN 72000.0 ELSE 88200.0 END), 3) AS total_m2, count(*) AS polygons FROM fx_soil GROUP BY mukey"),
    "polygon_geometry": _with("SELECT polygon_id, cast(x0 - o AS double) AS minx, cast(y0 - o AS double) AS miny, x0 + 300.0 + o AS maxx, y0 + 300.0 + o AS maxy, CASE WHEN shape = 3 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type, round(CASE shape WHEN 1 THEN x0 + (36000*150 + 21600*60)/57600.0 ELSE x0+150.0 END, 3) AS cx, round(CASE shape WHEN 1 THEN y0 + (36000*60 + 21600*210)/57600.0 ELSE y0+150.0 END, 3) AS cy, 'ok' AS status FROM (SELECT *, CASE WHEN shape = 4 THEN 60 ELSE 0 END AS o FROM fx_soil)"),
    "soil_profile": _with("SELECT count(*) AS polygons, count(DISTINCT mukey) AS units, count(DISTINCT areasymbol) AS areas, min(v) AS min_acres, median(v) AS median_acres, max(v) AS max_acres FROM (SELECT *, CASE WHEN polygon_id % 6 <> 0 THEN cast(polygon_id % 50 AS double) END AS v FROM fx_soil)"),
    "dedupe_polygons": _with("SELECT polygon_id, min(t) AS tile_id, any_value(mukey) AS mukey FROM (SELECT *, polygon_id % 4 AS t FROM fx_soil UNION ALL SELECT *, (polygon_id+1) % 4 AS t FROM fx_soil WHERE polygon_id % 3 = 0) GROUP BY polygon_id"),
    "clean_attributes": _with("SELECT mukey, muname, cap_rainfed, cap_irrigated, drainage, water_storage, slope_pct FROM fx_raw_attr"),
    "attribute_coverage": _with("SELECT count(*) AS units, count(cap_rainfed) AS cap_rainfed, count(cap_irrigated) AS cap_irrigated, count(drainage) AS drainage, count(water_storage) AS water_storage, count(slope_pct) AS slope_pct, (SELECT count(DISTINCT mukey) FROM overlay WHERE mukey NOT IN (SELECT mukey FROM fx_attr)) AS without_row FROM fx_attr", "overlay"),
    "key_batches": _with("SELECT cast(floor((rn-1)/10) AS int) AS batch, count(*) AS keys, min(mukey) AS first_key FROM (SELECT mukey, row_number() OVER (ORDER BY mukey) AS rn FROM (SELECT DISTINCT mukey FROM overlay)) GROUP BY 1", "overlay"),
    "class_diff": _with("SELECT coalesce(a.mukey, b.mukey) AS mukey, coalesce(a.crop_code, b.crop_code) AS crop_code, CASE WHEN b.mukey IS NULL THEN 'a' ELSE 'b' END AS only_in FROM (SELECT DISTINCT mukey, crop_code FROM overlay WHERE drought_class < 2) a FULL JOIN (SELECT DISTINCT mukey, crop_code FROM overlay WHERE drought_class >= 2) b ON a.mukey = b.mukey AND a.crop_code = b.crop_code WHERE a.mukey IS NULL OR b.mukey IS NULL", "overlay"),
    "hash_sample": "SELECT event_id FROM events ORDER BY md5(cast(event_id AS varchar)), event_id LIMIT 100",
    "stride_sample": "SELECT s_suppkey, k AS stride FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS rn, (SELECT greatest(1, cast(floor(count(*)/7) AS bigint)) FROM supplier) AS k FROM supplier) WHERE rn % k = 0 ORDER BY rn LIMIT 7",
    "valid_weeks": "SELECT event_id, strftime(d - cast((isodow(d) + 5) % 7 AS int), '%Y%m%d') AS week0, strftime(d - cast((isodow(d) + 5) % 7 AS int) - 21, '%Y%m%d') AS week3 FROM (SELECT event_id, cast(ts AS date) AS d FROM events)",
    "labels_and_groups": _with(f"SELECT crop_code, {_NAME} AS land_cover, coalesce({_NAME}, 'Unknown (' || crop_code || ')') AS label, {_GROUP} AS group_id, {_AG} AS is_agricultural, count(*) AS n FROM fx_points GROUP BY ALL"),
    "region_slugs": "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug FROM part",
    "square_fields": """SELECT c_custkey, round(lon - h/(111320.0*greatest(0.1, abs(cos(radians(lat))))), 6) AS minx, round(lat + h/111320.0, 6) AS maxy FROM (SELECT c_custkey, -120 + (c_custkey % 97)/100.0 AS lon, 36 + (c_custkey % 89)/100.0 AS lat, CASE c_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 400 WHEN 3 THEN 800 ELSE 1600 END AS h FROM customer)""",
    "field_measure": _with(f"SELECT field_id, 'ok' AS status, cast(round(cast(query_acres AS DECIMAL(28,9)), 3) AS DOUBLE) AS query_acres FROM fields", "fields"),
    "field_hits": _with("SELECT field_id, mukey, cast(round(cast(inter_m2 AS DECIMAL(28,9)), 3) AS DOUBLE) AS inter_m2 FROM hits", "fields"),
    "field_totals": _with("SELECT f.field_id, cast(round(cast(coalesce(sum(a.inter_m2), 0) AS DECIMAL(28,9)), 3) AS DOUBLE) AS answered_m2, count(a.mukey) AS map_units FROM fields f LEFT JOIN ans a ON a.field_id = f.field_id GROUP BY f.field_id", "fields"),
    "field_soil_summary": _with("SELECT s.field_id, cast(round(cast(rated_m2 AS DECIMAL(28,9)), 3) AS DOUBLE) AS rated_m2, cast(round(cast(cultivable_m2 AS DECIMAL(28,9)), 3) AS DOUBLE) AS cultivable_m2, cast(round(cast(irrigable_m2 AS DECIMAL(28,9)), 3) AS DOUBLE) AS irrigable_m2, cast(round(cast(slope_pct AS DECIMAL(28,9)), 6) AS DOUBLE) AS slope_pct, cast(round(cast(water_storage AS DECIMAL(28,9)), 6) AS DOUBLE) AS water_storage, dominant_soil, dominant_drainage FROM soilsum s LEFT JOIN domin d ON d.field_id = s.field_id", "fields"),
    "field_breakdown": _with("SELECT field_id, 'cover' AS row_kind, land_cover, crop_code, is_agricultural, NULL AS drought_class, cast(round(cast(acres AS DECIMAL(28,9)), 4) AS DOUBLE) AS acres, cast(round(cast(pixels AS DECIMAL(28,9)), 4) AS DOUBLE) AS pixels FROM cover UNION ALL SELECT field_id, 'drought', NULL, NULL, NULL, drought_class, cast(round(cast(acres AS DECIMAL(28,9)), 4) AS DOUBLE), cast(round(cast(pixels AS DECIMAL(28,9)), 4) AS DOUBLE) FROM dry", "fields"),
    "field_groups": _with(f"SELECT field_id, g.group_id, {_r('acres', 4)} AS acres, {_r('acres/nullif(sum(acres) OVER (PARTITION BY field_id), 0)', 6)} AS share, label AS group_label, o AS group_order FROM (SELECT field_id, group_id, sum(acres) AS acres FROM (SELECT field_id, acres, {_GROUP} AS group_id FROM cover) GROUP BY ALL) g JOIN (VALUES {', '.join(f"('{g}', '{label}', {i})" for i, (g, label, _) in enumerate(GROUPS))}) AS t(group_id, label, o) ON t.group_id = g.group_id", "fields"),
    "field_top_crops": _with(f"SELECT c.field_id, rn, crop_code, land_cover, {_r('acres', 4)} AS acres, hidden, {_r('hidden_acres', 4)} AS hidden_acres FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY {_r('acres', 6)} DESC, crop_code) AS rn, greatest(count(*) OVER (PARTITION BY field_id) - 8, 0) AS hidden FROM cover) c JOIN (SELECT field_id, coalesce(sum(acres) FILTER (WHERE rn > 8), 0) AS hidden_acres FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY {_r('acres', 6)} DESC, crop_code) AS rn FROM cover) GROUP BY field_id) h ON h.field_id = c.field_id WHERE rn <= 8", "fields"),
    "field_response": _with(f"""SELECT f.field_id, round(f.query_acres, 3) AS query_acres, CASE WHEN b.t IS NULL THEN 0 ELSE round(coalesce(t.a, 0)/{ACRE}, 3) END AS answered_acres, CASE WHEN b.t IS NULL THEN 0 ELSE coalesce(t.n, 0) END AS map_units, cast(round(cast(s.cultivable_m2/nullif(s.rated_m2, 0) AS DECIMAL(28,9)), 4) AS DOUBLE) AS cultivable_share, cast(round(cast(b.ag/b.t AS DECIMAL(28,9)), 4) AS DOUBLE) AS agricultural_share, coalesce(b.k, 0) AS covers FROM fields f
 LEFT JOIN (SELECT field_id, sum(inter_m2) AS a, count(*) AS n FROM ans GROUP BY field_id) t ON t.field_id = f.field_id LEFT JOIN soilsum s ON s.field_id = f.field_id
 LEFT JOIN (SELECT field_id, coalesce(nullif(sum(acres), 0), 1) AS t, coalesce(sum(acres) FILTER (WHERE is_agricultural), 0) AS ag, count(*) AS k FROM cover GROUP BY field_id) b ON b.field_id = f.field_id""", "fields"),
    "headline_counts": _with("""SELECT headline, count(*) AS fields FROM (SELECT CASE WHEN coalesce(s.rated_m2, 0) = 0 THEN 'No soil rating for this area.' WHEN k >= 0.5 AND g >= 0.5 THEN 'Capable ground, and it is being farmed.' WHEN k >= 0.5 AND g < 0.2 THEN 'Cultivable ground, largely out of production.' WHEN k < 0.2 AND g < 0.2 THEN 'Marginal ground, and used as such.' WHEN k < 0.2 AND g >= 0.5 THEN 'Farmed well beyond what the soil alone would carry.' ELSE 'Mixed ground, partly in production.' END AS headline
 FROM (SELECT b.field_id, s.rated_m2, s.cultivable_m2/nullif(s.rated_m2, 0) AS k, b.ag/b.t AS g FROM (SELECT field_id, coalesce(nullif(sum(acres), 0), 1) AS t, coalesce(sum(acres) FILTER (WHERE is_agricultural), 0) AS ag FROM cover GROUP BY field_id) b LEFT JOIN soilsum s ON s.field_id = b.field_id) s) GROUP BY headline""", "fields"),
    "field_mapunits": _with(f"SELECT q.field_id, q.mukey, {_r('q.inter_m2', 2)} AS inter_m2, q.rn, q.n > 200 AS truncated, d.land_cover, d.crop_code, a.muname, a.drainage, a.slope_pct FROM (SELECT h.*, row_number() OVER (PARTITION BY field_id ORDER BY round(inter_m2, 3) DESC, mukey) AS rn, count(*) OVER (PARTITION BY field_id) AS n FROM hits h WHERE inter_m2 > 0 AND mukey IN (SELECT mukey FROM roverlay)) q JOIN (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY acres DESC, crop_code, drought_class, musym DESC, areasymbol DESC) AS rn FROM roverlay) d ON d.mukey = q.mukey AND d.rn = 1 LEFT JOIN fx_attr a ON a.mukey = q.mukey WHERE q.rn <= 200", "fields"),
    "consistency": _with(f"SELECT c.field_id, {_r('c.a', 6)} AS cover_acres, {_r('d.a', 6)} AS drought_acres, abs(c.a - d.a) <= 1e-6*greatest(1, c.a) AS ok FROM (SELECT field_id, sum(acres) AS a FROM cover GROUP BY field_id) c JOIN (SELECT field_id, sum(acres) AS a FROM dry GROUP BY field_id) d ON d.field_id = c.field_id", "fields"),
    "dedupe_fields": _with("SELECT count(*) AS drawings, (SELECT count(*) FROM fx_fields)*2 AS fields FROM (SELECT DISTINCT minx, miny, maxx, maxy FROM fx_fields)"),
    "zone_area_share": _with(f"SELECT outline_id, drought_class, {_r('m2', 2)} AS m2, {_r('100*m2/total', 6)} AS pct FROM (SELECT f.field_id AS outline_id, d.drought_class, cast((f.maxx-f.minx)*(f.maxy-f.miny) AS double) AS total, sum(cast((least(f.maxx,d.maxx)-greatest(f.minx,d.minx))*(least(f.maxy,d.maxy)-greatest(f.miny,d.miny)) AS double)) AS m2 FROM fx_fields f JOIN fx_drought d ON f.minx <= d.maxx AND f.maxx >= d.minx AND f.miny <= d.maxy AND f.maxy >= d.miny GROUP BY ALL)"),
    "latency_summary": _FX + ",\n" + _RUNS + " SELECT phase, run, requests, errors, hit_rate, error_codes, ok, p50_ms, p95_ms, p99_ms, min_ms, max_ms FROM runs",
    "phase_summary": _FX + ",\n" + _RUNS + f" SELECT phase, count(*) AS runs_kept, {_r('median(p50_ms)', 3)} AS p50_median_ms, min(p50_ms) AS p50_min_ms, max(p50_ms) AS p50_max_ms, {_r('median(p95_ms)', 3)} AS p95_median_ms, sum(errors) AS total_errors FROM (SELECT *, min(run) OVER (PARTITION BY phase) AS f, count(*) OVER (PARTITION BY phase) AS k FROM runs) WHERE run > f OR k = 1 GROUP BY phase",
    "run_summary": "SELECT count(*) AS runs, sum(CASE WHEN s >= 100 THEN 1 ELSE 0 END) AS excluded, round(median(s) FILTER (WHERE s < 100), 3) AS median_s, round(min(s), 3) AS min_s, round(max(s) FILTER (WHERE s < 100), 3) AS max_s, round(stddev_samp(s) FILTER (WHERE s < 100), 4) AS stdev_s, round(max(r)/median(s) FILTER (WHERE s < 100), 1) AS records_per_s FROM (SELECT event_id, 1 + (event_id*7919 % 12000)/100.0::double AS s, 1000000 AS r FROM events)",
    "tiles_for_aoi": _with("SELECT DISTINCT t.tr AS row, t.tc AS col FROM (SELECT r.i AS tr, c.i AS tc, x0 + 1000*c.i AS tx0, y0 + 1000*r.i AS ty0, least(x0 + 1000*(c.i+1), x1) AS tx1, least(y0 + 1000*(r.i+1), y1) AS ty1 FROM (SELECT min(minx) AS x0, min(miny) AS y0, max(maxx) AS x1, max(maxy) AS y1 FROM fx_fields) b, LATERAL (SELECT unnest(range(0, cast(greatest(1, ceil((b.y1-b.y0)/1000.0)) AS bigint))) AS i) r, LATERAL (SELECT unnest(range(0, cast(greatest(1, ceil((b.x1-b.x0)/1000.0)) AS bigint))) AS i) c) t JOIN fx_fields f ON f.minx <= t.tx1 AND f.maxx >= t.tx0 AND f.miny <= t.ty1 AND f.maxy >= t.ty0"),
    "raster_points": _with("SELECT x, y, crop_code FROM fx_points"),
    "point_files": _with("SELECT x, y, crop_code FROM fx_points"),
    "geometry_files": _with(f"SELECT polygon_id, 5070 AS srid, {_AREA} AS m2 FROM fx_soil"),
    "wkt_round_trip": _with(f"SELECT polygon_id, cast(x0 - o AS double) AS minx, cast(y0 - o AS double) AS miny, x0 + 300.0 + o AS maxx, y0 + 300.0 + o AS maxy, {_AREA} AS m2, CASE WHEN shape = 3 THEN 2 ELSE 1 END AS parts FROM (SELECT *, CASE WHEN shape = 4 THEN 60 ELSE 0 END AS o FROM fx_soil)"),
    "swapped_axes": _with("SELECT polygon_id, cast(y0 - o AS double) AS minx, cast(x0 - o AS double) AS miny, y0 + 300.0 + o AS maxx, x0 + 300.0 + o AS maxy FROM (SELECT *, CASE WHEN shape = 4 THEN 60 ELSE 0 END AS o FROM fx_soil)"),
    "published_overlay": _with(f"SELECT {_COLS}, CASE WHEN crop_code < 60 THEN 'west' ELSE 'east' END AS aoi FROM plain", "plain"),
    "published_rows": _with("SELECT l.load, aoi, count(*) AS rows FROM (SELECT crop_code, CASE WHEN crop_code < 60 THEN 'west' ELSE 'east' END AS aoi FROM plain) p, (SELECT cast(range AS INTEGER) AS load FROM range(3)) l WHERE (aoi = 'west' OR l.load > 0) AND (l.load < 2 OR aoi = 'east' OR crop_code < 20) GROUP BY ALL", "plain"),
    "written_overlay": _with("SELECT mukey, sum(pixels) AS pixels FROM plain GROUP BY mukey", "plain"),
    "clipped_soil": _with(f"SELECT polygon_id, {_r('m2', 3)} AS m2 FROM ({_inside_box(_BOX)}) WHERE m2 > 0"),
    "soil_in_area": _with(f"SELECT DISTINCT s.polygon_id FROM fx_soil s JOIN fx_shape_rects r ON r.shape = s.shape WHERE s.x0+r.rx1 <= {_BOX[2]} AND s.x0+r.rx2 >= {_BOX[0]} AND s.y0+r.ry1 <= {_BOX[3]} AND s.y0+r.ry2 >= {_BOX[1]} UNION SELECT polygon_id FROM fx_soil WHERE shape = 4 AND greatest({_BOX[0]}-(x0+150), 0, (x0+150)-({_BOX[2]})) + greatest({_BOX[1]}-(y0+150), 0, (y0+150)-({_BOX[3]})) <= 210"),
    "footprint_coverage": _with(f"SELECT {_r('sum(m2)', 3)} AS soil_m2, any_value(whole) AS footprint_m2, {_r('sum(m2)/any_value(whole)', 6)} AS coverage FROM (SELECT m2, (c-a)*(d-b) AS whole FROM ({_inside_box(('a', 'b', 'c', 'd'), 'fx_soil, (SELECT min(x)-15.0 AS a, min(y)-15.0 AS b, max(x)+15.0 AS c, max(y)+15.0 AS d FROM fx_points)', 'a, b, c, d')}))"),
    "layer_classes": _with("SELECT crop_code, count(*) AS pixels FROM hit GROUP BY crop_code", "hits"),
    "geometry_types": _with("SELECT CASE WHEN shape = 3 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type, count(*) AS n FROM fx_soil GROUP BY 1"),
    "prepared_soil": _with(f"SELECT mukey, sum({_AREA}) AS total_m2, count(*) AS polygons FROM fx_soil GROUP BY mukey"),
    "simplify_impact": _with(f"SELECT {_r('100*(sum(b)-sum(a))/sum(a)', 6)} AS net_pct, {_r('avg(100*abs(b-a)/a)', 6)} AS mean_abs_pct, {_r('max(100*abs(b-a)/a)', 6)} AS worst_pct FROM (SELECT 90000.0 + 150*o AS a, 90000.0 + CASE WHEN o = 50 THEN 150*o ELSE 0 END AS b FROM (SELECT CASE WHEN polygon_id % 2 = 0 THEN 10 ELSE 50 END AS o FROM fx_soil))"),
    "simplified_soil": _with("SELECT polygon_id, CASE WHEN polygon_id % 2 = 0 THEN 90000.0 ELSE 97500.0 END AS m2, CASE WHEN polygon_id % 2 = 0 THEN 5 ELSE 6 END AS vertices FROM fx_soil"),
    "answer_change": _with(f"SELECT {_r('100*(sum(b)-sum(a))/sum(a)', 6)} AS total_pct, {_r('quantile_cont(e, 0.5)', 6)} AS median_pct, {_r('quantile_cont(e, 0.95)', 6)} AS p95_pct, {_r('max(e)', 6)} AS worst_pct FROM (SELECT a, b, 100*abs(b-a)/nullif(a, 0) AS e FROM (SELECT field_id, sum(sq + tri) AS a, sum(sq + CASE WHEN o = 50 THEN tri ELSE 0 END) AS b FROM ({_DENTED_HITS}) GROUP BY field_id))"),
    "simplified_layer": _with(f"SELECT polygon_id, 90000.0 + CASE WHEN polygon_id % 3 = 0 THEN 0 ELSE 7500 END - CASE WHEN (polygon_id + 20) % 3 = 0 THEN 0 ELSE 7500 END AS m2, 5 + CASE WHEN polygon_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN (polygon_id + 20) % 3 = 0 THEN 0 ELSE 1 END AS vertices FROM fx_soil"),
    "stored_field_answers": _with(f"SELECT field_id, {_r('sum(inter_m2)', 3)} AS m2, count(*) AS units FROM hits GROUP BY field_id", "fields"),
    "field_statuses": _with(f"SELECT field_id, CASE field_id % 10 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad_ring' WHEN 2 THEN 'bad_ring' WHEN 8 THEN CASE WHEN 40000.0*w*w/{ACRE} > 100000 THEN 'too_large' ELSE 'ok' END WHEN 9 THEN 'bad_geometry' ELSE 'invalid' END AS status FROM (SELECT field_id, maxx-minx AS w FROM fx_fields)"),
    "repaired_fields": _with(f"SELECT field_id, {_r('CASE field_id % 10 WHEN 3 THEN 0.5*w*w WHEN 5 THEN 1.04*w*w WHEN 6 THEN 0.5*w*w WHEN 7 THEN 1.5*w*w WHEN 8 THEN 40000.0*w*w ELSE 1.0*w*w END', 3)} AS m2, CASE WHEN field_id % 10 IN (3, 5, 6, 7) THEN 2 ELSE 1 END AS parts, CASE WHEN field_id % 10 = 8 AND 40000.0*w*w/{ACRE} > 100000 THEN 'too_large' ELSE 'ok' END AS status FROM (SELECT field_id, cast(maxx-minx AS double) AS w FROM fx_fields) WHERE field_id % 10 IN (0, 3, 4, 5, 6, 7, 8)"),
}

_PCT = "CASE WHEN round(100*({x}), 9) < 10 THEN printf('%.1f%%', round(100*({x}), 9)) ELSE printf('%.0f%%', round(100*({x}), 9)) END"


def _pct(x: str) -> str:
    return _PCT.format(x=x)


def _even4(x: str) -> str:
    """To four places, a half to the even side, by way of decimals."""
    v = f"cast(10000*({x}) AS DECIMAL(18,5))"
    return f"cast(CASE WHEN {v} - floor({v}) > 0.5 OR {v} - floor({v}) = 0.5 AND floor({v}) % 2 = 1 THEN floor({v}) + 1 ELSE floor({v}) END AS DOUBLE)/10000"


# the values of an answer as they are before they are rounded or worded
_ANSWER = f"""
totals AS (SELECT field_id, coalesce(nullif(sum(acres), 0), 1) AS t, coalesce(sum(acres) FILTER (WHERE is_agricultural), 0) AS ag FROM cover GROUP BY field_id),
wet AS (SELECT d.field_id, coalesce(sum(acres/t) FILTER (WHERE drought_class >= 2), 0) AS severe, coalesce(sum(acres/t) FILTER (WHERE drought_class >= 0), 0) AS dry FROM dry d JOIN totals t ON t.field_id = d.field_id GROUP BY d.field_id),
got AS (SELECT field_id, sum(inter_m2) AS m2, count(*) AS units FROM ans GROUP BY field_id),
answer AS (SELECT f.field_id, f.query_acres, t.t IS NOT NULL AS answered, CASE WHEN t.t IS NULL THEN 0 ELSE g.m2/{ACRE} END AS answered_acres, CASE WHEN t.t IS NULL THEN 0 ELSE g.units END AS map_units,
  CASE WHEN t.t IS NULL THEN 0 ELSE {_even4(f'g.m2/{ACRE}/nullif(f.query_acres, 0)')} END AS coverage, round(t.ag/t.t, 9) AS farmed, w.severe, w.dry, coalesce(s.rated_m2, 0) AS rated,
  round(s.cultivable_m2/nullif(s.rated_m2, 0), 9) AS k, round(s.irrigable_m2/nullif(s.rated_m2, 0), 9) AS i, coalesce(round(s.rated_m2/nullif(g.m2, 0), 9), 0) AS rated_share, round(s.slope_pct, 9) AS slope_pct, round(s.water_storage, 9) AS water_storage, d.dominant_soil, d.dominant_drainage
  FROM fields f LEFT JOIN totals t ON t.field_id = f.field_id LEFT JOIN wet w ON w.field_id = f.field_id LEFT JOIN got g ON g.field_id = f.field_id LEFT JOIN soilsum s ON s.field_id = f.field_id LEFT JOIN domin d ON d.field_id = f.field_id)"""
_PARTS["answer"], _NEEDS["answer"] = [_ANSWER], ["hits", "dry", "overlay", "fields"]
_HEADLINE = "CASE WHEN NOT answered THEN NULL WHEN rated = 0 THEN 'No soil rating for this area.' WHEN k >= 0.5 AND farmed >= 0.5 THEN 'Capable ground, and it is being farmed.' WHEN k >= 0.5 AND farmed < 0.2 THEN 'Cultivable ground, largely out of production.' WHEN k < 0.2 AND farmed < 0.2 THEN 'Marginal ground, and used as such.' WHEN k < 0.2 AND farmed >= 0.5 THEN 'Farmed well beyond what the soil alone would carry.' ELSE 'Mixed ground, partly in production.' END"
_FOUND = [
    ("rated = 0", "caveat", "'note'", "'None of the answered area carries a USDA capability rating — typically open water, rock outcrop or made land.'"),
    ("rated > 0", "capability", "'neutral'", f"CASE WHEN k = 0 THEN 'None of the rated area is USDA capability class 1–4 (capable of cultivation); all of it is class 5–8.' WHEN k = 1 THEN 'All of the rated area is USDA capability class 1–4 (capable of cultivation).' ELSE {_pct('k')} || ' of rated area is USDA capability class 1–4 (capable of cultivation); ' || {_pct('1 - k')} || ' is class 5–8.' END || CASE WHEN coalesce(dominant_soil, '') = '' THEN '' ELSE ' Dominant soil: ' || rtrim(dominant_soil, '.') || '.' END"),
    ("rated > 0", "use", "'neutral'", f"{_pct('farmed')} || ' of land cover is agricultural.'"),
    ("rated > 0 AND i < {IRRIGABLE}", "irrigation", "'note'", f"CASE WHEN i = 0 THEN 'None of the rated area can be irrigated.' ELSE 'Only ' || {_pct('i')} || ' of rated area carries an irrigated capability rating; the rest cannot be irrigated.' END"),
    ("rated > 0 AND severe > 0", "drought", "'caution'", f"{_pct('severe')} || ' of the field is in severe drought (D2) or worse' || CASE WHEN farmed >= 0.2 THEN ', on ground that is ' || {_pct('farmed')} || ' agricultural.' ELSE '.' END"),
    ("rated > 0 AND severe <= 0 AND dry > 0", "drought", "'note'", f"{_pct('dry')} || ' of the field is under some drought classification (D0–D1).'"),
    ("rated > 0 AND slope_pct >= {STEEP}", "terrain", "'caution'", "'Mean slope ' || printf('%.0f', round(slope_pct, 9)) || '% — steep. Limits machinery and raises erosion risk.'"),
    ("rated > 0 AND slope_pct >= {ROLLING} AND slope_pct < {STEEP}", "terrain", "'note'", "'Mean slope ' || printf('%.0f', round(slope_pct, 9)) || '% — rolling.'"),
    ("rated > 0 AND water_storage < {WATER}", "water", "'note'", "'Available water storage ' || printf('%.1f', round(water_storage, 9)) || ' cm to 150 cm — low. Crops here depend on irrigation timing rather than stored moisture.' || CASE WHEN coalesce(dominant_drainage, '') = '' THEN '' ELSE ' Drainage: ' || lower(dominant_drainage) || '.' END"),
    ("rated > 0 AND coverage < {PARTIAL}", "caveat", "'note'", f"'Only ' || {_pct('coverage')} || ' of the drawn polygon fell on mapped soil; the rest is outside the survey.'"),
    ("rated > 0 AND rated_share < {RATED}", "caveat", "'note'", f"{_pct('1 - rated_share')} || ' of the answered area has no capability rating — open water, rock outcrop or made land.'"),
]
_LIMITS = {"IRRIGABLE": insight.IRRIGABLE_LOW, "STEEP": insight.SLOPE_STEEP, "ROLLING": insight.SLOPE_ROLLING, "WATER": insight.WATER_LOW, "PARTIAL": insight.COVERAGE_PARTIAL, "RATED": insight.RATED_PARTIAL}
_FINDINGS = " UNION ALL ".join(f"SELECT field_id, {n} AS o, '{kind}' AS kind, {severity} AS severity, {text} AS text FROM answer WHERE answered AND {on.format(**_LIMITS)}" for n, (on, kind, severity, text) in enumerate(_FOUND))
_SIX = ("slope_pct", "water_storage")

# a link's numbers: latitude and longitude of the first corner, then steps; each doubled, turned over if below 0, and cut into groups of five bits
_LINK = f"""list_aggregate(list_transform([b, a, 0, w, h, 0, 0, -w], lambda s: list_aggregate(list_transform(range(0, greatest(1, cast(ceil(len(ltrim(bin(CASE WHEN s < 0 THEN -2*s - 1 ELSE 2*s END), '0'))/5.0) AS BIGINT))),
  lambda k: substr('{ALPHABET}', cast(((CASE WHEN s < 0 THEN -2*s - 1 ELSE 2*s END) >> (5*k)) % 32 + CASE WHEN ((CASE WHEN s < 0 THEN -2*s - 1 ELSE 2*s END) >> (5*k + 5)) > 0 THEN 32 ELSE 0 END + 1 AS BIGINT), 1)), 'string_agg', '')), 'string_agg', '')"""

ORACLES |= {
    "square_links": f"""SELECT c_custkey, {_LINK} AS link FROM (SELECT c_custkey, x1 AS a, y1 AS b, x2 - x1 AS w, y2 - y1 AS h FROM (SELECT c_custkey, {', '.join(f"cast(round({m} {sign} {off}, 6)*1000000 AS BIGINT) AS {name}" for name, m, sign, off in (('x1', 'lon', '-', 'dx'), ('x2', 'lon', '+', 'dx'), ('y1', 'lat', '-', 'dy'), ('y2', 'lat', '+', 'dy')))}
 FROM (SELECT c_custkey, lon, lat, h/(111320.0*greatest(0.1, abs(cos(radians(lat))))) AS dx, h/111320.0 AS dy FROM (SELECT c_custkey, -120 + (c_custkey % 97)/100.0 AS lon, 36 + (c_custkey % 89)/100.0 AS lat, CASE c_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 400 WHEN 3 THEN 800 ELSE 1600 END AS h FROM customer))))""",
    "field_answers": _with(f"SELECT field_id, map_units, dominant_soil, dominant_drainage, {_HEADLINE} AS headline, {_r('query_acres', 3)} AS query_acres, {_r('answered_acres', 3)} AS answered_acres, {_r('coverage', 4)} AS coverage, {_r('slope_pct', 6)} AS slope_pct, {_r('water_storage', 6)} AS water_storage, {_r('k', 6)} AS cultivable_share, {_r('i', 6)} AS irrigable_share, {_r('CASE WHEN answered THEN rated_share END', 6)} AS rated_share, {_r('farmed', 6)} AS agricultural_share FROM answer", "answer"),
    "field_answer_lists": _with(f"SELECT c.field_id, 'cover' AS kind, cast(row_number() OVER (PARTITION BY c.field_id ORDER BY {_r('acres', 6)} DESC, crop_code) - 1 AS INTEGER) AS pos, crop_code AS code, land_cover AS label, is_agricultural, {_r('acres', 3)} AS acres, {_r('pixels', 1)} AS pixels, {_r('acres/t', 4)} AS share FROM cover c JOIN totals t ON t.field_id = c.field_id UNION ALL SELECT d.field_id, 'drought', cast(row_number() OVER (PARTITION BY d.field_id ORDER BY drought_class) - 1 AS INTEGER), drought_class, {_LABEL}, NULL, {_r('acres', 3)}, NULL, {_r('acres/t', 4)} FROM dry d JOIN totals t ON t.field_id = d.field_id", "answer"),
    "field_findings": _with(f"SELECT field_id, cast(row_number() OVER (PARTITION BY field_id ORDER BY o) - 1 AS INTEGER) AS pos, kind, severity, text FROM ({_FINDINGS})", "answer"),
    "field_feature_rows": _with(f"SELECT q.field_id, q.rn, q.n > 200 AS truncated, q.mukey, d.musym, d.areasymbol, a.muname, d.land_cover, d.crop_code, d.is_agricultural, d.drought_class, {_LABEL} AS drought_label, coalesce(a.cap_irrigated, a.cap_rainfed) AS capability_class, {_r(f'q.inter_m2/{ACRE}', 3)} AS acres FROM (SELECT h.*, row_number() OVER (PARTITION BY field_id ORDER BY round(inter_m2, 3) DESC, mukey) AS rn, count(*) OVER (PARTITION BY field_id) AS n FROM hits h WHERE inter_m2 > 0 AND mukey IN (SELECT mukey FROM roverlay)) q JOIN (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY acres DESC, crop_code, drought_class, musym DESC, areasymbol DESC) AS rn FROM roverlay) d ON d.mukey = q.mukey AND d.rn = 1 LEFT JOIN fx_attr a ON a.mukey = q.mukey WHERE q.rn <= 200", "fields"),
}
