"""The slide queries as SQL for DuckDB over the same tables."""

from __future__ import annotations

_LEVELS = """lv AS (
  SELECT slide_id, slide_level, max(width) AS width, max(height) AS height, max(downsample) AS downsample, max(mpp) AS mpp, max(magnification) AS magnification
  FROM slide_levels WHERE slide_id IS NOT NULL AND slide_level IS NOT NULL GROUP BY slide_id, slide_level),
zero AS (SELECT slide_id, width AS w0, height AS h0, mpp AS mpp0, magnification AS mag0 FROM lv WHERE slide_level = 0),
want AS (SELECT DISTINCT slide_id, m AS want_mpp FROM lv, (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0)) v(m))"""

_ROUND = "round_even({}, 10)"

#: Regions, boxes and edges of the polygons, in mask cells of 16 pixels.
_REGIONS = """once AS (SELECT polygon_id, min_by(slide_id, polygon_id) AS slide_id, any_value(label) AS label, any_value(points) AS points, any_value(holes) AS holes FROM polygons GROUP BY polygon_id),
reg AS (SELECT * FROM once WHERE slide_id IS NOT NULL AND polygon_id IS NOT NULL AND len(points) >= 3 AND {keep}),
ring AS (
  SELECT slide_id, polygon_id, label, 0 AS k, points AS r FROM reg UNION ALL
  SELECT slide_id, polygon_id, label, i AS k, holes[i] AS r FROM reg, unnest(generate_series(1, len(holes))) t(i)),
edge AS (
  SELECT slide_id, polygon_id, label, k, r[i].x / 16.0 AS px, r[i].y / 16.0 AS py, r[i % len(r) + 1].x / 16.0 AS qx, r[i % len(r) + 1].y / 16.0 AS qy
  FROM ring, unnest(generate_series(1, len(r))) t(i)),
box AS (
  SELECT slide_id, polygon_id, any_value(label) AS label, round_even(min(px), 10) AS bx1, round_even(min(py), 10) AS by1, round_even(max(px), 10) AS bx2, round_even(max(py), 10) AS by2
  FROM edge WHERE k = 0 GROUP BY slide_id, polygon_id)"""

#: Valid ones of cand (slide_id, polygon_id, label, seq, mx, my), of 4 cells a side.
_VALID = """clip AS (
  SELECT c.polygon_id, c.seq, e.k, e.px, e.py, e.qx, e.qy, c.my AS y1, c.my + 4.0 AS y2,
         greatest(least(e.px, e.qx), c.mx) AS lo, least(greatest(e.px, e.qx), c.mx + 4.0) AS hi
  FROM cand c JOIN edge e ON c.polygon_id = e.polygon_id AND e.px <> e.qx AND least(e.px, e.qx) < c.mx + 4.0 AND greatest(e.px, e.qx) > c.mx),
line AS (
  SELECT *, (qy - py) / (qx - px) AS m, py + (qy - py) / (qx - px) * (lo - px) AS ul, py + (qy - py) / (qx - px) * (hi - px) AS uh
  FROM clip WHERE px <> qx AND lo < hi),
term AS (
  SELECT polygon_id, seq, k, sign(qx - px) * CASE WHEN abs(uh - ul) < 1e-12 THEN (greatest(y1, least(y2, ul)) - y1) * (hi - lo)
    ELSE ((greatest(uh - y1, 0) ** 2 - greatest(uh - y2, 0) ** 2) / 2 - (greatest(ul - y1, 0) ** 2 - greatest(ul - y2, 0) ** 2) / 2) / m END AS t FROM line),
part AS (SELECT polygon_id, seq, k, abs(sum(t)) AS a FROM term GROUP BY ALL),
good AS (SELECT polygon_id, seq FROM part GROUP BY ALL HAVING round_even(sum(CASE WHEN k = 0 THEN a ELSE -a END), 8) >= 8.0),
valid AS (
  SELECT slide_id, c.polygon_id AS region_id, c.seq, CAST(round_even(mx * 16, 0) AS BIGINT) AS x, CAST(round_even(my * 16, 0) AS BIGINT) AS y, label
  FROM cand c JOIN good g ON c.polygon_id = g.polygon_id AND c.seq = g.seq)"""


def _last(lo: str, hi: str, step: str) -> str:
    k = f"ceil(({hi} - {lo}) / {step})"
    at = lambda i: f"round_even({lo} + ({i}) * {step}, 10)"
    return f"CAST(CASE WHEN {k} > 0 AND {at(k + ' - 1')} >= {hi} THEN {k} - 1 WHEN {at(k)} < {hi} THEN {k} + 1 ELSE {k} END AS BIGINT)"


def _grid(step: float) -> str:
    s = f"{step}::DOUBLE"
    return f"""size AS (SELECT *, {_last('bx1', 'bx2', s)} AS nx, {_last('by1', 'by2', s)} AS ny FROM box),
cand AS (
  SELECT slide_id, polygon_id, label, iy * (nx + 1) + ix AS seq, bx1 + ix * {s} AS mx, by1 + iy * {s} AS my
  FROM size, unnest(generate_series(0, ny)) a(iy), unnest(generate_series(0, nx)) b(ix))"""


_CELLS = "cells AS (SELECT DISTINCT slide_id, CAST(floor(x / 2048.0) AS BIGINT) AS x, CAST(floor(y / 2048.0) AS BIGINT) AS y FROM points WHERE slide_id IS NOT NULL)"
_PLACED = "SELECT slide_id, region_id, seq, x, y, label FROM valid"
_RASTER = f"""{_LEVELS}, out AS (
  SELECT patch_id, slide_id, CAST(floor(x / 64.0) AS BIGINT) AS px, CAST(floor(y / 64.0) AS BIGINT) AS py, CAST(round_even(w / 64.0, 0) AS BIGINT) AS n, w0 // 64 AS rw, h0 // 64 AS rh, (patch_id % 100) / 100.0::DOUBLE AS v
  FROM patches JOIN zero USING (slide_id)),
place AS (
  SELECT *, px + i AS x, py + j AS y FROM out, unnest(generate_series(0, n - 1)) a(i), unnest(generate_series(0, n - 1)) b(j)
  WHERE px + i BETWEEN 0 AND rw - 1 AND py + j BETWEEN 0 AND rh - 1),
cell AS (SELECT slide_id, c AS class, x, y, avg(CASE WHEN c = 0 THEN v ELSE 1 - v END) AS prob FROM place, unnest([0, 1]) k(c) GROUP BY ALL),
laid AS (
  SELECT slide_id, c AS class, x, y, ((patch_id + 7 * CAST(floor((j + 0.5) * 2 / n) AS BIGINT) + 13 * CAST(floor((i + 0.5) * 2 / n) AS BIGINT)) % 100 / 100.0)::FLOAT AS v FROM place, unnest([0, 1]) k(c))"""
_RGB = f"""{_LEVELS}, px AS (
  SELECT slide_id, x, y, (7 * x + 13 * y) % 256 AS r, (3 * x + 5 * y + 40) % 256 AS g, (x * y + 80) % 256 AS b
  FROM zero, unnest(generate_series(0, w0 // 1024 - 1)) s(x), unnest(generate_series(0, h0 // 1024 - 1)) t(y))"""

_MASK_BOX = "mbox AS (SELECT slide_id, min(x)::DOUBLE AS bx1, min(y)::DOUBLE AS by1, max(x) + 1.0 AS bx2, max(y) + 1.0 AS by2 FROM cells GROUP BY slide_id)"
_GRID_4 = f"""size AS (SELECT *, {_last('bx1', 'bx2', '4.0::DOUBLE')} AS nx, {_last('by1', 'by2', '4.0::DOUBLE')} AS ny FROM mbox),
cand AS (SELECT slide_id, iy * (nx + 1) + ix AS seq, bx1 + ix * 4.0 AS mx, by1 + iy * 4.0 AS my FROM size, unnest(generate_series(0, ny)) a(iy), unnest(generate_series(0, nx)) b(ix))"""
_POINTS_4 = "cand AS (SELECT m.slide_id, p.point_id AS seq, p.x / 2048.0 AS mx, p.y / 2048.0 AS my FROM (SELECT DISTINCT slide_id, point_id, x, y FROM points) p JOIN mbox m USING (slide_id))"


def _draws(seed: int, n: int) -> str:
    """The first n random places of a mask's box, which is region 0."""
    return f"""s AS (SELECT *, ({seed}::BIGINT * 7919 + seq * 48271 + 1) % 2147483647 AS s FROM mbox, unnest(generate_series(1, {n})) t(seq)),
u AS (SELECT *, (s * s + seq) % 2147483647 AS u0 FROM s), v AS (SELECT *, (u0 * u0 + s) % 2147483647 AS u1 FROM u), w AS (SELECT *, (u1 * u1 + s + 1) % 2147483647 AS u2 FROM v),
cand AS (SELECT slide_id, seq, bx1 + (bx2 - bx1) * (u1 / 2147483647::DOUBLE) AS mx, by1 + (by2 - by1) * (u2 / 2147483647::DOUBLE) AS my FROM w)"""


#: Windows of cand (4 cells a side) with a fifth of foreground.
_TISSUE = """win AS (SELECT *, round_even(mx, 0)::BIGINT AS x1, round_even(my, 0)::BIGINT AS y1, round_even(mx + 4.0, 0)::BIGINT AS x2, round_even(my + 4.0, 0)::BIGINT AS y2 FROM cand),
tissue AS (
  SELECT w.slide_id, w.seq, w.mx, w.my FROM win w JOIN cells c ON w.slide_id = c.slide_id AND c.x >= w.x1 AND c.x < w.x2 AND c.y >= w.y1 AND c.y < w.y2
  WHERE w.x1 >= 0 AND w.y1 >= 0 GROUP BY w.slide_id, w.seq, w.mx, w.my, w.x1, w.y1, w.x2, w.y2 HAVING round_even(count(*) / ((w.x2 - w.x1) * (w.y2 - w.y1))::DOUBLE, 10) >= 0.2)"""
#: Windows of tissue with half of their area in the mask's box and in no polygon's box: a sweep over each window's strips.
_OUTSIDE = """bare AS (SELECT polygon_id, any_value(slide_id) AS slide_id, any_value(points) AS points FROM polygons GROUP BY polygon_id),
hole AS (
  SELECT slide_id, list_min([v.x FOR v IN points]) / 2048.0 AS hx1, list_min([v.y FOR v IN points]) / 2048.0 AS hy1, list_max([v.x FOR v IN points]) / 2048.0 AS hx2, list_max([v.y FOR v IN points]) / 2048.0 AS hy2
  FROM bare WHERE slide_id IS NOT NULL AND len(points) >= 3),
near AS (
  SELECT t.slide_id, t.seq, greatest(hx1, mx) AS x1, least(hx2, mx + 4) AS x2, greatest(hy1, my) AS y1, least(hy2, my + 4) AS y2 FROM tissue t JOIN hole h USING (slide_id)
  WHERE hx1 < mx + 4 AND hx2 > mx AND hy1 < my + 4 AND hy2 > my AND hx2 > hx1 AND hy2 > hy1),
cut AS (SELECT slide_id, seq, x1 AS v FROM near UNION SELECT slide_id, seq, x2 FROM near),
strip AS (SELECT *, lead(v) OVER (PARTITION BY slide_id, seq ORDER BY v) AS w FROM cut),
seg AS (
  SELECT s.slide_id, s.seq, s.v, s.w, n.y1, n.y2, max(n.y2) OVER (PARTITION BY s.slide_id, s.seq, s.v ORDER BY n.y1, n.y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
  FROM strip s JOIN near n USING (slide_id, seq) WHERE s.w IS NOT NULL AND n.x1 <= s.v AND n.x2 >= s.w),
taken AS (SELECT slide_id, seq, sum((w - v) * greatest(0, y2 - greatest(y1, coalesce(upto, y1)))) AS a FROM seg GROUP BY slide_id, seq),
free AS (
  SELECT t.* FROM tissue t JOIN mbox USING (slide_id) LEFT JOIN taken k USING (slide_id, seq)
  WHERE round_even(greatest(0, least(mx + 4, bx2) - greatest(mx, bx1)) * greatest(0, least(my + 4, by2) - greatest(my, by1)) - coalesce(a, 0), 8) >= 8.0)"""


def _masked(source: str, label: str) -> str:
    return f"SELECT slide_id, CAST(0 AS BIGINT) AS region_id, seq, CAST(round_even(mx * 2048, 0) AS BIGINT) AS x, CAST(round_even(my * 2048, 0) AS BIGINT) AS y, '{label}' AS label FROM {source}"


#: The regions that are read, and whether each may lie beyond the image: (x, y) at level 0 of the made rasters, 16 pixels wide there.
_READ = f"""{_LEVELS}, img AS (SELECT slide_id, w0 // 256 AS w, h0 // 256 AS h, mpp0 FROM zero),
req AS (
  SELECT point_id, slide_id, w, h, mpp0, CAST(floor(x / 512.0) * 2 - 4 AS BIGINT) AS x, CAST(floor(y / 512.0) * 2 - 4 AS BIGINT) AS y
  FROM (SELECT DISTINCT slide_id, point_id, x, y FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND point_id IS NOT NULL) JOIN img USING (slide_id)),
ok AS (
  SELECT *, x < 0 OR y < 0 OR x + 26 > w OR y + 26 > h AS pads FROM req
  WHERE x <= w AND y <= h AND (NOT (x < 0 OR y < 0) OR (x + 16 > 0 AND y + 16 > 0 AND NOT ((x < 0 AND 16 > w) OR (y < 0 AND 16 > h))))),
pixel AS (
  SELECT point_id, pads, i, j, x + i >= 0 AND x + i < w AND y + j >= 0 AND y + j < h AS there, 1 + (7 * (x + i) + 13 * (y + j)) % 251 AS r, 1 + (3 * (x + i) + 5 * (y + j)) % 241 AS g, 1 + ((x + i) * (y + j)) % 239 AS b
  FROM ok, unnest(generate_series(0, 15)) s(i), unnest(generate_series(0, 15)) t(j) WHERE {{known}})"""


def _halved(outside: str) -> str:
    """8 x 8 pixels from 16 x 16: columns first, then rows, each rounded half up."""
    value = lambda c: f"CASE WHEN there THEN {c} ELSE {outside} END"
    return ", ".join([
        "px AS (SELECT point_id, pads, i // 2 AS i, j, " + ", ".join(f"floor(avg({value(c)}) + 0.5) AS {c}" for c in "rgb") + ", bool_or(there) AS there FROM pixel GROUP BY point_id, pads, i // 2, j)",
        "half AS (SELECT point_id, pads, i, j // 2 AS j, " + ", ".join(f"floor(avg({c}) + 0.5) AS {c}" for c in "rgb") + ", bool_or(there) AS there FROM px GROUP BY point_id, pads, i, j // 2)",
    ])


def _summed(source: str, size: int, white: bool) -> str:
    value = lambda c: f"CASE WHEN there THEN {c} WHEN pads THEN 255 ELSE 0 END" if white else c
    return f"SELECT point_id, {size} AS width, {size} AS height, " + ", ".join(f"CAST(sum({value(c)}) AS BIGINT) AS sum_{c}" for c in "rgb") + f" FROM {source} GROUP BY point_id"


_SPREAD = "true AS inside, CAST(0 AS BIGINT) AS n_close, true AS some, true AS fewer_valid"

_OTSU = f"""{_RGB},
h AS (SELECT slide_id, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INTEGER) AS gray, count(*) AS n FROM px GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER u AS n0, sum(n * gray) OVER u AS s0, sum(n) OVER w AS na, sum(n * gray) OVER w AS sa FROM h
              WINDOW u AS (PARTITION BY slide_id ORDER BY gray), w AS (PARTITION BY slide_id)),
        v AS (SELECT slide_id, gray, CASE WHEN na > n0 THEN n0::DOUBLE * (na - n0)::DOUBLE * (s0::DOUBLE / n0 - (sa - s0)::DOUBLE / (na - n0)) * (s0::DOUBLE / n0 - (sa - s0)::DOUBLE / (na - n0)) ELSE 0 END AS v FROM c),
otsu AS (SELECT slide_id, gray AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY v DESC, gray) = 1)"""
_TISSUE_CELLS = "dark AS (SELECT p.slide_id, p.x, p.y FROM px p JOIN otsu o USING (slide_id) WHERE floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) <= threshold)"


def _ramp(knots: list[tuple[float, float]]) -> str:
    parts = [f"WHEN pos <= {x1} THEN {y0} + (pos - {x0}) * ({y1} - {y0}) / ({x1} - {x0})" for (x0, y0), (x1, y1) in zip(knots, knots[1:])]
    return f"CAST(floor((CASE {' '.join(parts)} ELSE {knots[-1][1]} END) * 255) AS INTEGER)"


ORACLES: dict[str, str] = {
    "slide_names": r"""
        SELECT DISTINCT slide_id, regexp_extract(wsi_file, '([^/\\]*)$', 1) AS name,
               regexp_replace(regexp_extract(wsi_file, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1') AS slide_key FROM slide_levels
    """,
    "slide_pyramids": f"""WITH {_LEVELS}
        SELECT slide_id, count(*) AS n_levels, CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS n_pixels, max(CASE WHEN slide_level = 0 THEN mpp END) AS mpp FROM lv GROUP BY slide_id
    """,
    "level_by_shape": "SELECT slide_id, width, height, max(slide_level) AS found_level FROM slide_levels WHERE slide_id IS NOT NULL AND slide_level IS NOT NULL GROUP BY ALL",
    "level_by_size": f"""WITH {_LEVELS}
        SELECT slide_id, coalesce(max(slide_level) FILTER (width >= 4000 AND height >= 4000), 0) AS least_4000,
               nullif(coalesce(max(slide_level) FILTER (width >= 20000 AND height >= 20000), 0), 0) AS over_zero, 99 AS plain FROM lv GROUP BY slide_id
    """,
    "level_by_mpp": f"""WITH {_LEVELS},
        hit AS (
          SELECT w.slide_id, w.want_mpp, min(slide_level) FILTER (round_even(abs(mpp - want_mpp), 10) < 0.003) AS near, bool_and(coalesce(mpp <> 0, false)) AS known,
                 coalesce(max(slide_level) FILTER (round_even(mpp, 10) <= round_even(want_mpp, 10)), 0) AS base_level
          FROM want w JOIN lv USING (slide_id) GROUP BY ALL)
        SELECT slide_id, want_mpp, CASE WHEN known THEN coalesce(near, -1) ELSE -1 END AS found_level, base_level,
               want_mpp >= 0.001 AND want_mpp <= round_even(mpp0 * coalesce(nullif(mag0, 0), 40), 10) AS in_range FROM hit LEFT JOIN zero USING (slide_id)
    """,
    "resample_plan": f"""WITH {_LEVELS},
        base AS (SELECT w.slide_id, want_mpp, coalesce(max(slide_level) FILTER (round_even(mpp, 10) <= round_even(want_mpp, 10)), 0) AS base_level FROM want w JOIN lv USING (slide_id) GROUP BY ALL)
        SELECT b.slide_id, want_mpp, base_level, round(want_mpp / l.mpp, 9) AS base_factor, round(want_mpp / mpp0, 9) AS zero_factor,
               CAST(round_even(l.width / (want_mpp / l.mpp), 0) AS BIGINT) AS new_width, CAST(round_even(l.height / (want_mpp / l.mpp), 0) AS BIGINT) AS new_height
        FROM base b LEFT JOIN lv l ON b.slide_id = l.slide_id AND b.base_level = l.slide_level LEFT JOIN zero z ON b.slide_id = z.slide_id
    """,
    "resample_batches": f"""WITH {_LEVELS},
        hit AS (
          SELECT w.slide_id, want_mpp, min(slide_level) FILTER (round_even(abs(mpp - want_mpp), 10) < 0.003) AS near, bool_and(coalesce(mpp <> 0, false)) AS known,
                 coalesce(max(slide_level) FILTER (round_even(mpp, 10) <= round_even(want_mpp, 10)), 0) AS base_level
          FROM want w JOIN lv USING (slide_id) GROUP BY ALL)
        SELECT slide_id, base_level, string_agg(CAST(want_mpp AS VARCHAR), ' ' ORDER BY want_mpp) AS mpps FROM hit WHERE NOT known OR near IS NULL GROUP BY slide_id, base_level
    """,
    "tiff_resolutions": "SELECT DISTINCT slide_id, slide_level, round(10000 / (mpp * 1.0), 6) AS pixels_cm FROM (SELECT DISTINCT * FROM slide_levels WHERE mpp IS NOT NULL)",
    "location_checks": f"""WITH {_LEVELS}, p AS (SELECT DISTINCT point_id, slide_id, x - 256 AS x, y - 256 AS y FROM points)
        SELECT point_id, x <= w0 AND y <= h0 AND (NOT (x < 0 OR y < 0) OR (x + 512 > 0 AND y + 512 > 0 AND NOT ((x < 0 AND 512 > w0) OR (y < 0 AND 512 > h0)))) AS valid,
               x < 0 OR y < 0 OR x + 512 + 10 > w0 OR y + 512 + 10 > h0 AS pads FROM p JOIN zero USING (slide_id)
    """,
    "multires_locations": f"""WITH {_LEVELS}, t AS (SELECT * FROM (VALUES (0, CAST(NULL AS DOUBLE)), (1, 0.5), (2, 1.0), (3, 2.0)) v(member, target_mpp))
        SELECT patch_id, member, target_mpp,
               CAST(round_even(((x + w * (mpp0 / mpp0) / 2) / (coalesce(target_mpp, mpp0) / mpp0) - w / 2.0) * (coalesce(target_mpp, mpp0) / mpp0), 0) AS BIGINT) AS target_x,
               CAST(round_even(((y + h * (mpp0 / mpp0) / 2) / (coalesce(target_mpp, mpp0) / mpp0) - h / 2.0) * (coalesce(target_mpp, mpp0) / mpp0), 0) AS BIGINT) AS target_y
        FROM patches JOIN zero USING (slide_id), t
    """,
    "polygon_areas": """
        WITH once AS (SELECT polygon_id, any_value(points) AS p FROM polygons WHERE len(points) >= 3 GROUP BY polygon_id)
        SELECT polygon_id, round(abs(list_sum([p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y FOR i IN generate_series(1, len(p))])) / 2, 4) AS area,
               list_min([v.x FOR v IN p]) AS x1, list_min([v.y FOR v IN p]) AS y1, list_max([v.x FOR v IN p]) AS x2, list_max([v.y FOR v IN p]) AS y2 FROM once
    """,
    "polygon_grid": f"WITH {_REGIONS.format(keep='true')}, {_grid(4.0)}, {_VALID} {_PLACED}",
    "polygon_grid_labels": f"""WITH {_REGIONS.format(keep="coalesce(label NOT IN ('tumor', 'stroma'), true)")}, {_grid(2.0)}, {_VALID},
        one AS (SELECT DISTINCT slide_id, x, y, label FROM valid), labels AS (SELECT DISTINCT label FROM polygons)
        SELECT l.label, count(o.x) AS n FROM labels l LEFT JOIN one o ON l.label IS NOT DISTINCT FROM o.label GROUP BY l.label
    """,
    "polygon_random": f"""WITH {_REGIONS.format(keep='true')},
        s AS (SELECT *, (11::BIGINT * 7919 + (polygon_id % 2147483647) * 104729 + seq * 48271 + 1) % 2147483647 AS s FROM box, unnest(generate_series(1, 300)) t(seq)),
        u AS (SELECT *, (s * s + seq) % 2147483647 AS u0 FROM s), v AS (SELECT *, (u0 * u0 + s) % 2147483647 AS u1 FROM u),
        w AS (SELECT *, (u1 * u1 + s + 1) % 2147483647 AS u2 FROM v),
        cand AS (SELECT slide_id, polygon_id, label, seq, bx1 + (bx2 - bx1) * (u1 / 2147483647::DOUBLE) AS mx, by1 + (by2 - by1) * (u2 / 2147483647::DOUBLE) AS my FROM w),
        {_VALID} {_PLACED} QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY seq) <= 3
    """,
    "polygon_points": f"""WITH {_REGIONS.format(keep='true')}, p AS (SELECT DISTINCT slide_id, point_id, x, y FROM points),
        cand AS (
          SELECT b.slide_id, b.polygon_id, b.label, p.point_id AS seq, p.x / 16.0 AS mx, p.y / 16.0 AS my FROM p JOIN box b ON p.slide_id = b.slide_id
          WHERE p.x / 16.0 <= bx2 AND p.x / 16.0 + 4 >= bx1 AND p.y / 16.0 <= by2 AND p.y / 16.0 + 4 >= by1), {_VALID} {_PLACED}
    """,
    "mask_boxes": f"""WITH {_CELLS}, every AS (SELECT slide_id FROM cells UNION SELECT slide_id FROM slide_levels WHERE slide_id IS NOT NULL)
        SELECT slide_id, coalesce(min(x), 0) AS x1, coalesce(min(y), 0) AS y1, coalesce(max(x), 0) AS x2, coalesce(max(y), 0) AS y2 FROM every LEFT JOIN cells USING (slide_id) GROUP BY slide_id
    """,
    "mask_outline": f"""WITH {_CELLS}
        SELECT c.* FROM cells c WHERE (
          SELECT count(*) FROM cells d WHERE d.slide_id = c.slide_id AND ((d.x = c.x AND abs(d.y - c.y) = 1) OR (d.y = c.y AND abs(d.x - c.x) = 1))) < 4
    """,
    "whole_grid": f"""WITH {_CELLS},
        box AS (SELECT slide_id, min(x)::DOUBLE AS bx1, min(y)::DOUBLE AS by1, max(x) + 1.0 AS bx2, max(y) + 1.0 AS by2 FROM cells GROUP BY slide_id),
        size AS (SELECT *, {_last('bx1', 'bx2', '4.0::DOUBLE')} AS nx, {_last('by1', 'by2', '4.0::DOUBLE')} AS ny FROM box),
        cand AS (SELECT slide_id, iy * (nx + 1) + ix AS seq, bx1 + ix * 4.0 AS mx, by1 + iy * 4.0 AS my FROM size, unnest(generate_series(0, ny)) a(iy), unnest(generate_series(0, nx)) b(ix))
        SELECT a.slide_id, CAST(0 AS BIGINT) AS region_id, a.seq, CAST(mx * 2048 AS BIGINT) AS x, CAST(my * 2048 AS BIGINT) AS y, 'tissue' AS label
        FROM cand a JOIN cells c ON a.slide_id = c.slide_id AND c.x >= a.mx AND c.x < a.mx + 4 AND c.y >= a.my AND c.y < a.my + 4
        GROUP BY a.slide_id, a.seq, mx, my HAVING round_even(count(*) / 16.0, 10) >= 0.2
    """,
    "patch_distinct": "SELECT slide_id, min(patch_id) AS seq, x, y, w, h, label FROM patches GROUP BY slide_id, x, y, w, h, label",
    "patch_label_counts": """
        WITH l AS (SELECT label FROM polygons UNION SELECT 'never used')
        SELECT l.label, count(p.patch_id) AS n FROM l LEFT JOIN patches p ON l.label IS NOT DISTINCT FROM p.label GROUP BY l.label
    """,
    "patch_pool_counts": """
        SELECT slide_id, label, count(*) AS n, CAST(1 - grouping(slide_id) AS INTEGER) AS by_slide, CAST(1 - grouping(label) AS INTEGER) AS by_label
        FROM patches GROUP BY GROUPING SETS ((slide_id, label), (slide_id), (label), ())
    """,
    "patch_included": "SELECT label, count(*) AS n FROM patches WHERE label IN ('tumor', 'stroma', 'fat') GROUP BY label",
    "patch_problems": """
        SELECT slide_id, 'duplicate location' AS problem, x || ',' || y AS detail, count(*) AS n FROM patches GROUP BY slide_id, x, y HAVING count(*) > 1
        UNION ALL
        SELECT slide_id, 'unknown label', label, count(*) FROM patches p WHERE NOT EXISTS (SELECT 1 FROM polygons q WHERE q.label IS NOT DISTINCT FROM p.label) GROUP BY slide_id, label
    """,
    "patch_numbers": "SELECT patch_id, row_number() OVER (ORDER BY patch_id) - 1 AS overall, row_number() OVER (PARTITION BY slide_id ORDER BY patch_id) - 1 AS in_slide FROM patches",
    "patch_sets": "SELECT patch_id, row_number() OVER (ORDER BY slide_id, patch_id) AS set_number FROM patches WHERE slide_id IS NOT NULL",
    "patch_files": "SELECT patch_id, 'out/' || coalesce(slide_id || '_', '') || 'm0000001_qc_' || CASE WHEN label <> '' THEN label || '_' ELSE '' END || 'x' || x || '_y' || y || '.png' AS path FROM patches",
    "patch_files_by_label": "SELECT patch_id, 'out/' || coalesce(nullif(label, ''), 'unlabelled') || '/' || coalesce(slide_id || '_', '') || 'm0000001_qc_' || coalesce(nullif(label, ''), 'unlabelled') || '_x' || x || '_y' || y || '.png' AS path FROM patches",
    "annotation_rows": """
        WITH a AS (SELECT DISTINCT * FROM annotations), k AS (
          SELECT *, CASE WHEN ann_type IN ('Rectangle', 'rectangle', 'ellipse') THEN 4 ELSE 3 END AS need, coalesce(len(coordinates), -1) AS n FROM a
          WHERE (vendor = 'asap' AND ann_type IN ('Polygon', 'Spline', 'Rectangle')) OR (vendor = 'sedeen' AND ann_type IN ('polygon', 'rectangle', 'ellipse')))
        SELECT annotation_id, ann_type AS user_label, CASE WHEN vendor = 'sedeen' THEN substr(ann_color, 1, greatest(length(ann_color) - 2, 0)) ELSE lower(ann_color) END AS color,
               CASE WHEN coordinates IS NULL THEN NULL WHEN need = 4 AND n <> 4 THEN ann_type || ' needs 4 points' WHEN need = 3 AND n < 3 THEN ann_type || ' needs 3 points or more' END AS problem FROM k
    """,
    "region_native": f"WITH {_READ.format(known='true')} {_summed('pixel', 16, True)}",
    "region_tile_mode": f"WITH {_READ.format(known='mpp0 IS NOT NULL')}, {_halved('CASE WHEN pads THEN 255 ELSE 0 END')} {_summed('half', 8, False)}",
    "region_wsi_mode": f"WITH {_READ.format(known='mpp0 IS NOT NULL')}, {_halved('0')} {_summed('half', 8, True)}",
    "class_bytes": f"""WITH {_RASTER}
        SELECT slide_id, CAST(rw AS INTEGER) AS w, CAST(rh AS INTEGER) AS h, count(CASE WHEN v > 0 THEN 1 END) AS n, CAST(coalesce(sum(v), 0) AS BIGINT) AS total
        FROM (SELECT DISTINCT slide_id, rw, rh FROM out) LEFT JOIN (SELECT slide_id, floor(round(prob, 9) * 255) AS v FROM cell WHERE class = 0) USING (slide_id) GROUP BY slide_id, rw, rh
    """,
    "patch_predictions": "SELECT patch_id, round((patch_id % 256) / 255.0::DOUBLE / 2, 4) AS p0, round((1 - (patch_id % 256) / 255.0::DOUBLE) / 2, 4) AS p1 FROM patches",
    "mean_maps": f"WITH {_RASTER} SELECT slide_id, class, x, y, round(avg(CASE WHEN class = 0 THEN v ELSE (1 - v)::FLOAT END), 4) AS prob FROM laid GROUP BY ALL",
    "mean_probability": f"WITH {_RASTER} SELECT slide_id, class, x, y, round(prob, 6) AS prob FROM cell",
    "probability_range": f"WITH {_RASTER} SELECT slide_id, class, round(min(prob), 6) AS vmin, round(max(prob), 6) AS vmax FROM cell GROUP BY slide_id, class",
    "heatmap_pixels": f"""
        WITH p AS (SELECT patch_id, (patch_id % 100) / 100.0::DOUBLE AS prob FROM patches),
        q AS (SELECT *, least(255, greatest(0, floor(prob * 256))) / 255 AS pos FROM p)
        SELECT patch_id,
          CASE WHEN prob < 0.1 THEN 0 ELSE {_ramp([(0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)])} END AS r,
          CASE WHEN prob < 0.1 THEN 0 ELSE {_ramp([(0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)])} END AS g,
          CASE WHEN prob < 0.1 THEN 0 ELSE {_ramp([(0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)])} END AS b,
          CASE WHEN prob < 0.1 THEN 0 ELSE 128 END AS a, CAST(floor(prob * 255) AS INTEGER) AS byte FROM q
    """,
    "tissue_hsv": f"""WITH {_RGB}, s AS (SELECT *, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE ELSE 0 END AS c FROM px)
        SELECT slide_id, x, y FROM s QUALIFY c > (1 + 0.1::DOUBLE) * avg(c) OVER (PARTITION BY slide_id)
    """,
    "annotation_ellipses": """
        WITH a AS (SELECT DISTINCT * FROM annotations WHERE vendor = 'sedeen' AND ann_type = 'ellipse' AND len(coordinates) = 4),
        c AS (SELECT annotation_id, round_even((coordinates[1].x + coordinates[2].x) / 2.0, 0) AS cx, round_even((coordinates[1].y + coordinates[4].y) / 2.0, 0) AS cy,
                     round_even((coordinates[2].x - coordinates[1].x) / 2.0, 0) AS rx, round_even((coordinates[4].y - coordinates[1].y) / 2.0, 0) AS ry FROM a)
        SELECT annotation_id, CAST(i AS INTEGER) AS vertex, round_even(cx + rx * cos(-i * pi() / 32), 0) AS x, round_even(cy + ry * sin(-i * pi() / 32), 0) AS y FROM c, unnest(generate_series(0, 64)) t(i)
    """,
    "tissue_lab": f"""WITH {_RGB},
        lin AS (SELECT slide_id, x, y, {", ".join(f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 ELSE {c} / 255.0::DOUBLE / 12.92 END AS {c}" for c in "rgb")} FROM px),
        t AS (SELECT slide_id, x, y, (0.0 + 0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.95047::DOUBLE AS tx, (0.0 + 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b) / 1.0::DOUBLE AS ty FROM lin),
        ch AS (SELECT slide_id, x, y, 500 * ((CASE WHEN tx > 0.008856 THEN cbrt(tx) ELSE 7.787::DOUBLE * tx + 16 / 116.0::DOUBLE END) - (CASE WHEN ty > 0.008856 THEN cbrt(ty) ELSE 7.787::DOUBLE * ty + 16 / 116.0::DOUBLE END)) AS a FROM t)
        SELECT slide_id, x, y FROM ch QUALIFY a > (1 + 0.1::DOUBLE) * avg(a) OVER (PARTITION BY slide_id)
    """,
    "polygon_poisson_spread": f"WITH {_REGIONS.format(keep='true')} SELECT slide_id, polygon_id AS region_id, {_SPREAD} FROM box WHERE bx2 > bx1 AND by2 > by1",
    "whole_poisson_spread": f"WITH {_CELLS}, {_MASK_BOX} SELECT slide_id, CAST(0 AS BIGINT) AS region_id, {_SPREAD} FROM mbox",
    "inverted_poisson_spread": f"WITH {_CELLS}, {_MASK_BOX} SELECT slide_id, CAST(0 AS BIGINT) AS region_id, {_SPREAD} FROM mbox",
    "whole_random": f"WITH {_CELLS}, {_MASK_BOX}, {_draws(3, 500)}, {_TISSUE} {_masked('tissue', 'tissue')} QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY seq) <= 5",
    "whole_points": f"WITH {_CELLS}, {_MASK_BOX}, {_POINTS_4}, {_TISSUE} {_masked('tissue', 'tissue')} QUALIFY row_number() OVER (PARTITION BY slide_id, mx, my ORDER BY seq) = 1",
    "inverted_grid": f"WITH {_CELLS}, {_MASK_BOX}, {_GRID_4}, {_TISSUE}, {_OUTSIDE} {_masked('free', '')}",
    "inverted_random": f"WITH {_CELLS}, {_MASK_BOX}, {_draws(7, 500)}, {_TISSUE}, {_OUTSIDE} {_masked('free', '')} QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY seq) <= 5",
    "inverted_points": f"WITH {_CELLS}, {_MASK_BOX}, {_POINTS_4}, {_TISSUE}, {_OUTSIDE} {_masked('free', '')}",
    "box_relations": """
        WITH bare AS (SELECT polygon_id, any_value(slide_id) AS slide_id, any_value(points) AS points FROM polygons GROUP BY polygon_id),
        box AS (
          SELECT slide_id, polygon_id AS id, list_min([v.x FOR v IN points]) AS x1, list_min([v.y FOR v IN points]) AS y1, list_max([v.x FOR v IN points]) AS x2, list_max([v.y FOR v IN points]) AS y2
          FROM bare WHERE slide_id IS NOT NULL AND len(points) >= 3),
        pair AS (
          SELECT p.slide_id, p.id AS a, q.id AS b, (least(p.x2, q.x2) - greatest(p.x1, q.x1)) * (least(p.y2, q.y2) - greatest(p.y1, q.y1)) AS s,
                 (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (q.x2 - q.x1) * (q.y2 - q.y1) AS qa
          FROM box p JOIN box q ON p.slide_id = q.slide_id AND p.id < q.id AND p.x1 < q.x2 AND q.x1 < p.x2 AND p.y1 < q.y2 AND q.y1 < p.y2)
        SELECT slide_id, a, b, CASE WHEN s >= qa - 1e-7 * greatest(pa, qa) THEN 'contains' WHEN s >= pa - 1e-7 * greatest(pa, qa) THEN 'within' ELSE 'overlaps' END AS relation, round(s, 1) AS shared
        FROM pair WHERE s > 1e-7 * greatest(pa, qa)
    """,
    "tissue_cleaned": f"""WITH {_CELLS},
        step AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
        nine AS (SELECT a AS dx, b AS dy FROM unnest([-1, 0, 1]) t(a), unnest([-1, 0, 1]) u(b)),
        hole AS (
          SELECT c.slide_id, c.x + dx AS x, c.y + dy AS y, count(*) AS n FROM cells c, step WHERE c.x + dx BETWEEN 0 AND 109 AND c.y + dy BETWEEN 0 AND 109
          AND NOT EXISTS (SELECT 1 FROM cells d WHERE d.slide_id = c.slide_id AND d.x = c.x + dx AND d.y = c.y + dy) GROUP BY ALL),
        filled AS (SELECT slide_id, x, y FROM cells UNION SELECT slide_id, x, y FROM hole WHERE n = 4 - (x IN (0, 109))::INT - (y IN (0, 109))::INT),
        grown AS (SELECT DISTINCT f.slide_id, f.x + dx AS x, f.y + dy AS y FROM filled f, nine WHERE f.x + dx BETWEEN 0 AND 109 AND f.y + dy BETWEEN 0 AND 109),
        eaten AS (
          SELECT g.slide_id, g.x, g.y FROM grown g, nine JOIN grown h ON h.slide_id = g.slide_id AND h.x = g.x + dx AND h.y = g.y + dy
          GROUP BY ALL HAVING count(*) = (3 - (g.x IN (0, 109))::INT) * (3 - (g.y IN (0, 109))::INT))
        SELECT e.slide_id, e.x, e.y FROM eaten e WHERE EXISTS (SELECT 1 FROM eaten d WHERE d.slide_id = e.slide_id AND abs(d.x - e.x) + abs(d.y - e.y) = 1)
    """,
    "tissue_otsu": f"WITH {_OTSU} SELECT * FROM otsu",
    "tissue_otsu_cells": f"WITH {_OTSU}, {_TISSUE_CELLS} SELECT * FROM dark",
    "tissue_overlay": f"""WITH {_OTSU}, {_TISSUE_CELLS},
        step AS (SELECT slide_id, x, y, x + dx AS nx, y + dy AS ny FROM dark, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy)),
        side AS (SELECT t.slide_id, t.x, t.y, count(*) AS n FROM step t JOIN dark e ON e.slide_id = t.slide_id AND e.x = t.nx AND e.y = t.ny GROUP BY ALL),
        kind AS (SELECT p.*, d.slide_id IS NOT NULL AS lit, d.slide_id IS NOT NULL AND coalesce(n, 0) < 4 AS edge FROM px p LEFT JOIN dark d USING (slide_id, x, y) LEFT JOIN side USING (slide_id, x, y))
        SELECT slide_id, x, y, {", ".join(f"CAST(CASE WHEN edge THEN {o} WHEN lit THEN floor({c} * (1 - 128 / 255.0::DOUBLE) + {m} * (128 / 255.0::DOUBLE) + 0.5) ELSE {c} END AS INTEGER) AS {c}" for c, m, o in (("r", 0, 0), ("g", 128, 0), ("b", 0, 255)))} FROM kind
    """,
    "polygon_mask": """
        WITH once AS (SELECT DISTINCT polygon_id, slide_id, points FROM polygons WHERE slide_id IS NOT NULL AND len(points) > 0),
        ring AS (SELECT polygon_id, slide_id, [{'x': trunc(v.x / 1024)::BIGINT, 'y': trunc(v.y / 1024)::BIGINT} FOR v IN points] AS r FROM once),
        edge AS (SELECT polygon_id, slide_id, r[i].x AS px, r[i].y AS py, r[i % len(r) + 1].x AS qx, r[i % len(r) + 1].y AS qy FROM ring, unnest(generate_series(1, len(r))) t(i)),
        cell AS (
          SELECT polygon_id, slide_id, x, y FROM (SELECT polygon_id, slide_id, min(px) AS x1, max(px) AS x2, min(py) AS y1, max(py) AS y2 FROM edge GROUP BY ALL), unnest(generate_series(x1, x2)) s(x), unnest(generate_series(y1, y2)) t(y)),
        side AS (SELECT c.*, e.px, e.py, e.qx, e.qy, (e.qx - e.px) * (c.y - e.py) - (e.qy - e.py) * (c.x - e.px) AS k FROM cell c JOIN edge e ON c.polygon_id = e.polygon_id AND c.slide_id = e.slide_id)
        SELECT DISTINCT slide_id, x, y FROM (
          SELECT polygon_id, slide_id, x, y, bool_or(k = 0 AND x BETWEEN least(px, qx) AND greatest(px, qx) AND y BETWEEN least(py, qy) AND greatest(py, qy)) AS lies_on,
                 count(*) FILTER (((py > y) <> (qy > y)) AND k <> 0 AND ((k < 0) = (qy < py))) % 2 = 1 AS inside FROM side GROUP BY polygon_id, slide_id, x, y)
        WHERE (lies_on OR inside) AND x >= 0 AND y >= 0
    """,
    "stream_first_arrivals": "SELECT DISTINCT slide_id, x, y, w, h, label FROM patches",
    "saved_windows": """
        SELECT time_bucket(INTERVAL 1 HOUR, saved_at) AS start, time_bucket(INTERVAL 1 HOUR, saved_at) + INTERVAL 1 HOUR AS "end", slide_id, label, count(*) AS n
        FROM patches WHERE saved_at IS NOT NULL AND slide_id IS NOT NULL GROUP BY ALL
    """,
    "saved_sessions": """
        WITH g AS (
          SELECT slide_id, saved_at, CASE WHEN saved_at < lag(saved_at) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS first
          FROM patches WHERE saved_at IS NOT NULL AND slide_id IS NOT NULL WINDOW w AS (PARTITION BY slide_id ORDER BY saved_at)),
        s AS (SELECT *, sum(first) OVER (PARTITION BY slide_id ORDER BY saved_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT min(saved_at) AS start, max(saved_at) + INTERVAL 5 MINUTE AS "end", slide_id, count(*) AS n FROM s GROUP BY slide_id, k
    """,
}
