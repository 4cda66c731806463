"""The core queries as SQL for DuckDB over the same tables."""

from __future__ import annotations

#: The nodes of the sessions' JSON trees: np is the path without places, no_of the place in a list.
_SESSION_TREE = r"""node AS (
  SELECT s.session_id, t.id, t.parent, t.type, t.value, t.key, regexp_replace(replace(t.fullkey, '"', ''), '\[[0-9]+\]', '', 'g') AS np,
         CAST(regexp_extract(t.fullkey, '\[([0-9]+)\]$', 1) AS VARCHAR) AS place
  FROM annotation_sessions s, json_tree(s.body) t WHERE s.body IS NOT NULL AND s.session_id IS NOT NULL),
obj AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS INTEGER) AS object_no FROM node
  WHERE type = 'OBJECT' AND value <> '{}' AND (
    (regexp_matches(np, '\.(Annotations|overlays|polygons|children)(\.(Annotation|graphic))?$') AND NOT json_exists(value, '$.Annotation') AND NOT json_exists(value, '$.graphic') AND NOT (regexp_matches(np, 'Annotations$') AND json_exists(value, '$.Coordinate')))
    OR (regexp_matches(np, '^\$(\.project)?$') AND (json_exists(value, '$.points') OR json_exists(value, '$.Coordinates'))))),
up AS (
  SELECT o.session_id, o.object_no, o.parent AS at FROM obj o
  UNION ALL
  SELECT u.session_id, u.object_no, n.parent FROM up u JOIN node n ON n.session_id = u.session_id AND n.id = u.at
  WHERE NOT EXISTS (SELECT 1 FROM obj p WHERE p.session_id = u.session_id AND p.id = u.at)),
above AS (SELECT u.session_id, u.object_no, p.object_no AS parent_object_no FROM up u JOIN obj p ON p.session_id = u.session_id AND p.id = u.at),
object AS (SELECT o.session_id, o.id, o.object_no, a.parent_object_no FROM obj o LEFT JOIN above a USING (session_id, object_no)),
own AS (
  SELECT o.session_id, o.object_no, 0 AS ring_no, n.id, n.type, n.value FROM object o JOIN node n ON n.session_id = o.session_id AND n.parent = o.id
  WHERE n.key IN ('Coordinates', 'point-list', 'points') AND n.type <> 'NULL' AND n.value <> '{}'),
hole AS (
  SELECT o.session_id, o.object_no, n.id, n.type, n.value FROM object o JOIN node n ON n.session_id = o.session_id AND n.parent = o.id WHERE n.key = 'holes' AND n.type <> 'NULL'),
ring AS (
  SELECT * FROM own UNION ALL
  SELECT h.session_id, h.object_no, CAST(n.place AS INTEGER) + 1, n.id, n.type, n.value FROM hole h JOIN node n ON n.session_id = h.session_id AND n.parent = h.id WHERE h.type = 'ARRAY' AND n.type <> 'NULL'
  UNION ALL SELECT session_id, object_no, 1, id, type, value FROM hole WHERE type = 'OBJECT' AND value <> '{}'),
list AS (
  SELECT session_id, object_no, ring_no, id, type, value FROM ring WHERE NOT (type = 'OBJECT' AND (json_exists(value, '$.Coordinate') OR json_exists(value, '$.point') OR json_exists(value, '$.points')))
  UNION ALL
  SELECT r.session_id, r.object_no, r.ring_no, n.id, n.type, n.value FROM ring r JOIN node n ON n.session_id = r.session_id AND n.parent = r.id
  WHERE r.type = 'OBJECT' AND n.key IN ('Coordinate', 'point', 'points') AND n.type <> 'NULL'),
vertex AS (
  SELECT l.session_id, l.object_no, l.ring_no, CAST(n.place AS INTEGER) AS place, n.value FROM list l JOIN node n ON n.session_id = l.session_id AND n.parent = l.id WHERE l.type = 'ARRAY' AND n.type <> 'NULL'
  UNION ALL SELECT session_id, object_no, ring_no, 0, value FROM list WHERE type <> 'ARRAY' AND value <> '{}'),
numbered AS (
  SELECT session_id, object_no, ring_no, coalesce(TRY_CAST(TRY_CAST(json_extract_string(value, '$.Order') AS DOUBLE) AS INTEGER), place) AS vertex_no,
         coalesce(json_extract_string(value, '$.point'), CASE WHEN json_type(value) = 'VARCHAR' THEN value ->> '$' END) AS pair, value FROM vertex),
placed AS (
  SELECT session_id, object_no, ring_no, vertex_no,
    coalesce(trim(split_part(pair, ',', 1)), json_extract_string(value, '$.X'), json_extract_string(value, '$.x'), json_extract_string(value, '$[0]')) AS x,
    coalesce(trim(split_part(pair, ',', 2)), json_extract_string(value, '$.Y'), json_extract_string(value, '$.y'), json_extract_string(value, '$[1]')) AS y FROM numbered)"""

_LINES = r"""
        WITH line AS (
          SELECT line_id, vendor, regexp_replace(regexp_replace(coalesce(line_text, ''), '^\x{FEFF}', ''), '(\r\n|\r|\n)\z', '') AS t FROM annotation_lines),
        f AS (
          SELECT line_id, vendor, t,
                 regexp_matches(t, '(?s)\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z') AS quoted_well,
                 regexp_extract_all(t || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1) AS parts FROM line),
        g AS (
          SELECT *, [CASE WHEN p[1] = '"' THEN replace(p[2:-2], '""', '"') ELSE p END FOR p IN parts] AS v FROM f),
        h AS (
          SELECT *, v[2] AS kind, string_split(v[6], ';') AS pts FROM g),
        k AS (
          SELECT *, CASE WHEN vendor = 'asap' THEN '\A *[+-]?[0-9]+([.,][0-9]+)? +[+-]?[0-9]+([.,][0-9]+)? *\z'
                         ELSE '\A *[+-]?[0-9]+(\.[0-9]+)?,[+-]?[0-9]+(\.[0-9]+)? *\z' END AS pat FROM h)
"""


ORACLES: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_SESSION_TREE} SELECT DISTINCT session_id, object_no, ring_no, vertex_no FROM placed",
    "p1_tables": f"""WITH RECURSIVE {_SESSION_TREE}
        SELECT DISTINCT 'object' AS in_table, session_id, object_no, parent_object_no, CAST(NULL AS INTEGER) AS ring_no, CAST(NULL AS INTEGER) AS vertex_no, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM object
        UNION ALL SELECT DISTINCT 'ring', session_id, object_no, NULL, ring_no, NULL, NULL, NULL FROM ring
        UNION ALL SELECT DISTINCT 'vertex', session_id, object_no, NULL, ring_no, vertex_no, TRY_CAST(replace(x, ',', '.') AS DOUBLE), TRY_CAST(replace(y, ',', '.') AS DOUBLE) FROM placed
    """,
    "p2_found": """
        SELECT DISTINCT patch_id FROM (
          SELECT patch_id, min(patch_id) OVER (PARTITION BY wsi_file, x, y, w, h, label) AS first
          FROM patches WHERE wsi_file IS NOT NULL)
        WHERE patch_id > first
    """,
    "p2_label_load": """
        WITH l AS (SELECT wsi_file, label, count(*) AS n, sum(CAST(w AS BIGINT) * h) AS s FROM patches GROUP BY ALL),
             r AS (SELECT wsi_file, label, count(*) AS n, sum(coalesce(len(points), 0)) AS s FROM polygons GROUP BY ALL)
        SELECT l.wsi_file, l.label, l.n * r.n AS n_pairs, CAST(l.s * r.n AS BIGINT) AS sum_pixels, CAST(r.s * l.n AS BIGINT) AS sum_vertices
        FROM l JOIN r ON l.wsi_file = r.wsi_file AND l.label = r.label
    """,
    "p4_found": """
        WITH shape AS (
          SELECT DISTINCT polygon_id, slide_id, points, holes FROM polygons
          WHERE slide_id IS NOT NULL AND len(points) >= 3),
        ring AS (
          SELECT polygon_id, slide_id, 0 AS ring_no, points AS r FROM shape
          UNION ALL
          SELECT polygon_id, slide_id, i AS ring_no, holes[i] AS r FROM shape, unnest(generate_series(1, len(holes))) t(i)),
        edge AS (
          SELECT polygon_id, slide_id, ring_no, r[i].x AS x1, r[i].y AS y1, r[i % len(r) + 1].x AS x2, r[i % len(r) + 1].y AS y2
          FROM ring, unnest(generate_series(1, len(r))) t(i)),
        box AS (
          SELECT polygon_id, slide_id, min(x1) - 32 AS lox, max(x1) + 32 AS hix, min(y1) - 32 AS loy, max(y1) + 32 AS hiy
          FROM edge GROUP BY ALL),
        pair AS (
          SELECT DISTINCT p.point_id, p.x, p.y, b.polygon_id FROM points p JOIN box b
          ON p.slide_id = b.slide_id AND p.x BETWEEN b.lox AND b.hix AND p.y BETWEEN b.loy AND b.hiy),
        seg AS (
          SELECT q.point_id, q.polygon_id, e.ring_no, q.x, q.y, e.x1, e.y1, e.x2, e.y2,
                 (e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1) AS l2
          FROM pair q JOIN edge e ON q.polygon_id = e.polygon_id),
        part AS (
          SELECT point_id, polygon_id, ring_no, x, y, x1, y1, x2, y2,
                 CASE WHEN l2 > 0 THEN greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) ELSE 0 END AS t FROM seg),
        per_ring AS (
          SELECT point_id, polygon_id, ring_no,
                 sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside,
                 min((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))) AS d2
          FROM part GROUP BY ALL)
        SELECT point_id, polygon_id FROM per_ring GROUP BY ALL
        HAVING min(d2) <= 1024 OR (bool_or(inside AND ring_no = 0) AND NOT bool_or(inside AND ring_no > 0))
    """,
    "p5_found": f"""{_LINES}
        SELECT * FROM (
          SELECT DISTINCT line_id, CASE
            WHEN NOT quoted_well THEN 'quoting'
            WHEN len(v) <> 6 THEN 'column_count'
            WHEN NOT ((vendor = 'asap' AND kind IN ('Polygon', 'Rectangle', 'Spline', 'Dot', 'Measurement'))
                   OR (vendor = 'sedeen' AND kind IN ('polygon', 'rectangle', 'ellipse'))) THEN 'bad_type'
            WHEN len([p FOR p IN pts IF NOT regexp_matches(p, pat)]) > 0 THEN 'bad_coordinates'
            WHEN kind IN ('Rectangle', 'rectangle', 'ellipse') AND len(pts) <> 4 THEN 'point_count'
            WHEN kind IN ('Polygon', 'polygon', 'Spline') AND len(pts) < 3 THEN 'point_count'
            WHEN kind = 'Dot' AND len(pts) <> 1 THEN 'point_count'
            WHEN kind = 'Measurement' AND len(pts) <> 2 THEN 'point_count' END AS reason FROM k)
        WHERE reason IS NOT NULL
    """,
    "p5_valid": f"""{_LINES},
        bad AS (
        SELECT * FROM (
          SELECT DISTINCT line_id, CASE
            WHEN NOT quoted_well THEN 'quoting'
            WHEN len(v) <> 6 THEN 'column_count'
            WHEN NOT ((vendor = 'asap' AND kind IN ('Polygon', 'Rectangle', 'Spline', 'Dot', 'Measurement'))
                   OR (vendor = 'sedeen' AND kind IN ('polygon', 'rectangle', 'ellipse'))) THEN 'bad_type'
            WHEN len([p FOR p IN pts IF NOT regexp_matches(p, pat)]) > 0 THEN 'bad_coordinates'
            WHEN kind IN ('Rectangle', 'rectangle', 'ellipse') AND len(pts) <> 4 THEN 'point_count'
            WHEN kind IN ('Polygon', 'polygon', 'Spline') AND len(pts) < 3 THEN 'point_count'
            WHEN kind = 'Dot' AND len(pts) <> 1 THEN 'point_count'
            WHEN kind = 'Measurement' AND len(pts) <> 2 THEN 'point_count' END AS reason FROM k)
        WHERE reason IS NOT NULL)
        SELECT line_id, vendor, v[1] AS wsi_file, v[2] AS ann_type, v[3] AS ann_name, v[4] AS group_text, CAST(len(pts) AS INTEGER) AS n_points
        FROM k WHERE line_id NOT IN (SELECT line_id FROM bad)
    """,
    "p7_found": r"""
        SELECT min(list_id) AS list_id FROM patch_file_list
        WHERE n_bytes > 0 AND patch_file IS NOT NULL AND regexp_extract(patch_file, '([^/\\]*)$', 1) <> ''
        GROUP BY lower(regexp_extract(patch_file, '([^/\\]*)$', 1))
    """,
    "p7_index": r"""
        WITH listed AS (SELECT *, lower(regexp_extract(patch_file, '([^/\\]*)$', 1)) AS file_key FROM patch_file_list WHERE n_bytes > 0),
        lanes AS (SELECT greatest(1, ceil(sum(n_bytes) / (64 * 134217728.0)), ceil(count(*) / 100000.0))::BIGINT AS n FROM listed),
        file AS (SELECT file_key, min(list_id) AS list_id, min_by(n_bytes, list_id) AS n_bytes, min_by(patch_file, list_id) AS patch_file, min_by(struct_pack(c := checksum), list_id).c AS checksum
                 FROM listed WHERE file_key <> '' GROUP BY file_key),
        lane AS (SELECT *, ('0x' || md5(patch_file)[1:8])::BIGINT % n AS lane FROM file, lanes),
        run AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY lane ORDER BY patch_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lane)
        SELECT list_id, file_key, n_bytes, patch_file, checksum, n_bytes::BIGINT AS byte_length, (before - min(before) OVER (PARTITION BY lane, before // 134217728))::BIGINT AS byte_offset,
               'c' || lpad(lane::VARCHAR, 8, '0') || '-' || lpad((before // 134217728)::VARCHAR, 4, '0') AS container_id FROM run
    """,
}
