"""Queries of this subpackage as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

_REACH = r"""key AS (
  SELECT slide_id, regexp_extract(lower(regexp_extract(wsi_file, '([^/\\]*)$', 1)), '(?:^|[^a-z0-9])([a-z]{2}[ ._-]*[0-9]{2}[ ._-]*[0-9]+)', 1) AS raw FROM slide_levels),
clean AS (SELECT slide_id, regexp_replace(raw, '[ ._-]', '', 'g') AS c FROM key WHERE raw <> ''),
member AS (
  SELECT DISTINCT slide_id, 'case ' || c[1:4] || ltrim(c[5:], '0') AS k FROM clean
  UNION
  SELECT slide_id, label || ' ' || CAST(list_sort(list_distinct(points)) AS VARCHAR) AS k FROM polygons
  WHERE label IS NOT NULL AND len(list_distinct(points)) >= 3),
reach(slide_id, other) AS (
  SELECT slide_id, slide_id AS other FROM member
  UNION
  SELECT r.slide_id, b.slide_id FROM reach r JOIN member a ON r.other = a.slide_id JOIN member b ON a.k = b.k)"""

_SPLITS = f"""{_REACH},
        slide AS (SELECT slide_id FROM slide_levels UNION SELECT slide_id FROM polygons),
        grouped AS (SELECT s.slide_id, coalesce(min(r.other), s.slide_id) AS group_id FROM slide s LEFT JOIN reach r USING (slide_id) WHERE s.slide_id IS NOT NULL GROUP BY s.slide_id),
        share(name, weight) AS (VALUES ('train', 0.70::DOUBLE), ('validation', 0.15), ('test', 0.15)),
assigned AS (
        SELECT slide_id, group_id, arg_max(name, -weight / ln((('0x' || md5(group_id || '|' || name)[1:12])::BIGINT + 0.5) / 281474976710656.0::DOUBLE)) AS split
        FROM grouped, share GROUP BY slide_id, group_id)"""

_CANONICAL = r"""stated AS (
  SELECT DISTINCT annotation_id,
    CASE WHEN trim(o) <> '' AND lower(trim(o)) <> 'none' THEN own
         WHEN regexp_matches(ann_name, '(?i)^\s*(annotation|region)\s*\d+\s*$') THEN NULL
         WHEN trim(n) <> '' AND lower(trim(n)) <> 'none' THEN ann_name END AS value
  FROM (SELECT *, regexp_replace(own, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS o, regexp_replace(ann_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS n
        FROM (SELECT *, CASE WHEN vendor = 'sedeen' THEN ann_description ELSE part_of_group END AS own FROM annotations))),
said AS (SELECT value, count(*) AS n FROM stated WHERE annotation_id IS NOT NULL AND value IS NOT NULL GROUP BY value),
token AS (
  SELECT DISTINCT value, rtrim(t, '.') AS token, t LIKE '%.' AND length(t) > 3 AS cut
  FROM (SELECT value, unnest(regexp_extract_all(regexp_replace(replace(lower(strip_accents(value)), 'ß', 'ss'), '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'), '[\p{L}\p{N}]+\.?')) AS t FROM said)
  WHERE NOT regexp_matches(t, '\p{Nd}')),
entry AS (SELECT DISTINCT group_id AS gid, regexp_extract_all(lower(strip_accents(group_name)), '[\p{L}\p{N}]+') AS parts FROM canonical_groups),
word AS (SELECT DISTINCT gid, unnest(parts) AS known FROM entry),
total AS (SELECT count(DISTINCT gid) AS n FROM entry),
idf AS (SELECT known, ln(any_value(n) / count(DISTINCT gid)::DOUBLE) + 1 AS idf FROM word, total GROUP BY known),
heavy AS (
  SELECT gid, known, idf, sqrt(sum(idf * idf) OVER (PARTITION BY gid)) AS norm, sqrt(sum(idf * idf) OVER (PARTITION BY gid ORDER BY idf DESC, known ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rest
  FROM word JOIN idf USING (known)),
form AS (
  SELECT DISTINCT known AS form, [known] AS parts FROM word
  UNION SELECT array_to_string(p, ''), p FROM (SELECT parts[a:b] AS p FROM entry, unnest(generate_series(1, len(parts))) s(a), unnest(generate_series(1, len(parts))) t(b) WHERE b > a)
  UNION SELECT array_to_string(list_reverse(parts), ''), list_reverse(parts) FROM entry WHERE len(parts) > 1),
near AS (
  SELECT token, parts, 1.0 - d / (2.0 * (length(form) + 1))::DOUBLE AS sim
  FROM (SELECT token, form, parts, damerau_levenshtein(token, form) AS d FROM (SELECT DISTINCT token FROM token), form WHERE abs(length(token) - length(form)) <= 2)
  WHERE d <= CASE WHEN length(form) < 3 THEN 0 WHEN length(form) < 5 THEN 1 ELSE 2 END),
kept AS (SELECT * FROM (SELECT *, max(sim) OVER (PARTITION BY token) AS most FROM near) WHERE len(parts) = 1 OR sim = most),
repair AS (
  SELECT token, NULL::BOOLEAN AS for_cut, i - 1 AS part, parts[i] AS known, sim FROM kept, unnest(generate_series(1, len(parts))) t(i)
  UNION ALL SELECT DISTINCT token, true, 0, known, 0.97::DOUBLE FROM token JOIN (SELECT DISTINCT known FROM word) ON starts_with(known, token) WHERE cut),
held AS (SELECT t.value, t.token, r.part, r.known, max(r.sim) AS sim, any_value(idf) AS idf FROM token t JOIN repair r ON t.token = r.token AND (r.for_cut IS NULL OR t.cut) JOIN idf ON r.known = idf.known GROUP BY ALL),
weight AS (SELECT value, token, part, max({'sim': sim, 'idf': idf, 'known': known}).idf AS w FROM held GROUP BY value, token, part),
norm AS (
  SELECT value, sqrt(k2 + (t.n - k.n) * (ln(total.n) + 1) ** 2) AS vnorm FROM (SELECT value, count(DISTINCT token) AS n FROM token GROUP BY value) t
  JOIN (SELECT value, sum(w * w) AS k2, count(DISTINCT token) AS n FROM weight GROUP BY value) k USING (value), total),
best AS (SELECT value, known, max({'sim': sim, 'w': w}) AS b FROM held JOIN weight USING (value, token, part) GROUP BY value, known),
pair AS (SELECT DISTINCT b.value, h.gid FROM best b JOIN heavy h ON b.known = h.known WHERE h.rest >= h.norm * (0.78 - 1e-6)),
score AS (
  SELECT p.value, p.gid, round(sum(b.b.sim * b.b.w * h.idf) / any_value(h.norm) / any_value(vnorm), 9) AS score
  FROM pair p JOIN heavy h ON p.gid = h.gid JOIN best b ON b.value = p.value AND b.known = h.known JOIN norm ON norm.value = p.value GROUP BY p.value, p.gid),
ranked AS (SELECT value, max(score) AS best, min(gid) FILTER (score = top) AS low, max(gid) FILTER (score = top) AS high FROM (SELECT *, max(score) OVER (PARTITION BY value) AS top FROM score) GROUP BY value),
chosen AS (SELECT said.value, said.n, CASE WHEN best >= 0.78 AND low = high THEN low ELSE 0 END AS group_id, coalesce(best, 0.0) AS score FROM said LEFT JOIN ranked USING (value))"""

ORACLES: dict[str, str] = {
    "p3_found": f"WITH {_CANONICAL} SELECT DISTINCT annotation_id, group_id FROM stated JOIN chosen USING (value) WHERE annotation_id IS NOT NULL",
    "p3_unmatched": f"WITH {_CANONICAL} SELECT value, n, round(score, 6) AS best_score FROM chosen WHERE group_id = 0",
    "p6_found": f"WITH RECURSIVE {_REACH} SELECT slide_id, min(other) AS group_id FROM reach GROUP BY slide_id HAVING count(*) > 1",
    "p6_splits": f"WITH RECURSIVE {_SPLITS} SELECT * FROM assigned",
    "p6_shares": f"WITH RECURSIVE {_SPLITS} SELECT split, count(*) AS n_slides, count(DISTINCT group_id) AS n_groups, round(count(*) / (SELECT count(*) FROM assigned)::DOUBLE, 6) AS share FROM assigned GROUP BY split",
}
