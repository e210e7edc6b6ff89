"""SQL of the pN_ queries that SQL can express over whole tables; the others are tested in tests/llm."""

from __future__ import annotations

_LINES = """
src AS (
  SELECT record_id, canonical_url, content_text,
    regexp_replace(coalesce(nullif(lower(regexp_replace(domain, '^\\s+|\\s+$', '', 'g')), ''),
      lower(regexp_extract(canonical_url, '^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1))), '^www\\.', '') AS site
  FROM url_discovery),
line AS (
  SELECT record_id, canonical_url, site, CAST(i AS INTEGER) AS line_no,
    regexp_replace(lower(string_split(content_text, chr(10))[i]), '[^a-z0-9]', '', 'g') AS k
  FROM src, LATERAL (SELECT unnest(range(1, len(string_split(content_text, chr(10))) + 1)) AS i) WHERE content_text IS NOT NULL AND site <> ''),
hot AS (SELECT site, k FROM line WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT canonical_url) >= 6)"""


# Blocks: lines that follow each other on six pages or more hang together; a line number stands for its key.
_BLOCKS = f"""{_LINES},
node AS (SELECT site, k, count(DISTINCT canonical_url) AS pages, row_number() OVER (ORDER BY site, k) AS v FROM line WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT canonical_url) >= 6),
step AS (SELECT site, canonical_url, k AS a, lead(k) OVER (PARTITION BY record_id, canonical_url ORDER BY line_no) AS b FROM line WHERE k <> '' AND canonical_url IS NOT NULL),
edge AS (SELECT x.v AS a, y.v AS b FROM step JOIN node x ON x.site = step.site AND x.k = step.a JOIN node y ON y.site = step.site AND y.k = step.b
  WHERE step.a <> step.b GROUP BY x.v, y.v HAVING count(DISTINCT canonical_url) >= 6),
way AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(n, r) AS (SELECT v, v FROM node UNION SELECT way.b, reach.r FROM reach JOIN way ON way.a = reach.n),
block AS (SELECT n AS v, min(r) AS block FROM reach GROUP BY n),
placed AS (SELECT line.record_id, line.site, line.line_no, node.k, node.pages, block.block FROM line JOIN node USING (site, k) JOIN block USING (v))"""


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"


def _shingled(k: int) -> str:
    return f"""
run AS (SELECT DISTINCT text_id, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS g FROM own, LATERAL (SELECT unnest(range(1, len(w) - {k - 2})) AS i)),
n AS (SELECT text_id, count(*) AS n FROM run GROUP BY text_id),
common AS (SELECT a.text_id AS a, b.text_id AS b, count(*) AS c FROM run a JOIN run b ON a.g = b.g AND a.text_id < b.text_id GROUP BY a.text_id, b.text_id),
pair AS (SELECT a, b FROM common JOIN n na ON na.text_id = a JOIN n nb ON nb.text_id = b WHERE c * 10 >= 6 * (na.n + nb.n - c))"""


_SPLITS = f"""
own AS (SELECT DISTINCT text_id, lower(trim(split)) AS split, {_words("processed_text")} AS w FROM training_dataset
  WHERE lower(trim(split)) IN ('train', 'calibration', 'test') AND len({_words("processed_text")}) >= 8),{_shingled(2)},
side AS (SELECT text_id, split = 'train' AS train FROM own)"""


def _category(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '[- ]', '_', 'g')"


_CELLS = f"""
rec AS (SELECT DISTINCT text_id, {_category("source_type")} AS s, {_category("aspect")} AS a, {_category("dataset_tier")} AS t FROM candidate_labeling_dataset),
size AS (SELECT count(DISTINCT text_id) // 5 AS s FROM candidate_labeling_dataset),
cell AS (SELECT s, a, t, count(DISTINCT text_id) AS n FROM rec GROUP BY s, a, t),
want AS (
  SELECT target_id, coalesce(n, 0) AS available, greatest(coalesce(min_rows, 0), CAST(ceil(coalesce(target_permille, 0) * size.s / 1000.0) AS BIGINT)) AS wanted
  FROM sampling_targets g CROSS JOIN size
  LEFT JOIN cell ON cell.s = {_category("g.source_type")} AND cell.a = {_category("g.aspect")} AND cell.t = {_category("g.dataset_tier")})"""


def _key(c: str) -> str:
    v = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    rest = f"regexp_replace(regexp_extract({v}, '^.*?://(.*)$', 1), '#.*$', '')"
    params = f"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|fbclid|gclid)(?:=|$)')))"
    url = (
        f"'://' || regexp_replace(lower(regexp_extract({rest}, '^([^/?]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), '/+$', '')"
        f" || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"
    )
    return f"CASE WHEN lower({v}) IN ('', '-', 'n/a', 'unknown') THEN NULL WHEN contains({v}, '://') THEN {url} ELSE nullif(string_split({v}, '#')[1], '') END"


_WORDINGS = f"""
own AS (SELECT text_id, min(struct_pack(w := array_to_string({_words("processed_text")}, ' '), split := lower(trim(split)))) AS s FROM training_dataset
  WHERE lower(trim(split)) IN ('train', 'calibration', 'test') GROUP BY text_id),
long AS (SELECT text_id, s.w AS w, s.split AS split FROM own WHERE len(string_split(s.w, ' ')) >= 8),
member AS (SELECT text_id, min(text_id) OVER (PARTITION BY w) AS rep, split, w FROM long)"""

ORACLES = {
    "p1_blocks": f"""WITH RECURSIVE {_BLOCKS},
per_line AS (SELECT site, block, k, pages, count(*) AS n FROM placed GROUP BY site, block, k, pages)
SELECT site, min(k) AS first_line, count(*) AS n_lines, max(pages) AS pages, CAST(sum(n) AS BIGINT) AS n_places FROM per_line GROUP BY site, block""",
    "p1_cleaned": f"""WITH RECURSIVE {_BLOCKS},
mark AS (
  SELECT line.record_id, line.line_no, line.k, placed.block,
    last_value(placed.block IGNORE NULLS) OVER w AS above, last_value(CASE WHEN line.k <> '' AND placed.block IS NULL THEN line.line_no END IGNORE NULLS) OVER w AS stop_above,
    last_value(CASE WHEN placed.block IS NOT NULL THEN line.line_no END IGNORE NULLS) OVER w AS at_above,
    first_value(placed.block IGNORE NULLS) OVER x AS below, first_value(CASE WHEN line.k <> '' AND placed.block IS NULL THEN line.line_no END IGNORE NULLS) OVER x AS stop_below,
    first_value(CASE WHEN placed.block IS NOT NULL THEN line.line_no END IGNORE NULLS) OVER x AS at_below
  FROM line LEFT JOIN placed ON placed.record_id = line.record_id AND placed.line_no = line.line_no
  WINDOW w AS (PARTITION BY line.record_id ORDER BY line.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    x AS (PARTITION BY line.record_id ORDER BY line.line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
gone AS (SELECT record_id, list(line_no) AS gone FROM mark
  WHERE block IS NOT NULL OR (k = '' AND above = below AND coalesce(stop_above, 0) < at_above AND coalesce(stop_below, 1000000000) > at_below) GROUP BY record_id)
SELECT u.record_id, CASE WHEN gone IS NULL THEN content_text ELSE coalesce(array_to_string(list_transform(
  list_filter(range(1, len(string_split(content_text, chr(10))) + 1), lambda i: NOT list_contains(gone, i)), lambda i: string_split(content_text, chr(10))[i]), chr(10)), '') END AS content_text
FROM url_discovery u LEFT JOIN gone ON gone.record_id = u.record_id""",
    "p2_members": f"WITH {_WORDINGS} SELECT text_id, rep, split FROM member",
    "p2_links": f"""WITH {_WORDINGS},
side AS (SELECT rep, min(w) AS w, bool_or(split = 'train') AS l, bool_or(split <> 'train') AS r FROM member GROUP BY rep),
run AS (SELECT DISTINCT rep, l, r, array_to_string(list_slice(string_split(w, ' '), i, i + 1), ' ') AS g FROM side, LATERAL (SELECT unnest(range(1, len(string_split(w, ' ')))) AS i)),
n AS (SELECT rep, count(*) AS n FROM run GROUP BY rep),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM run a JOIN run b ON a.g = b.g AND a.rep <= b.rep AND ((a.l AND b.r) OR (a.r AND b.l)) GROUP BY a.rep, b.rep)
SELECT a AS rep_a, b AS rep_b, CAST(c AS INTEGER) AS common, CAST(na.n + nb.n - c AS INTEGER) AS total FROM common JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE c * 10 >= 6 * (na.n + nb.n - c)""",
    "p3_margins": f"""WITH {_CELLS},
goal AS (SELECT {_category("g.source_type")} AS s, {_category("g.aspect")} AS a, {_category("g.dataset_tier")} AS t, least(available, wanted) AS n FROM want JOIN sampling_targets g USING (target_id)),
margin AS (SELECT 'source_type' AS category, s AS value, n FROM goal UNION ALL SELECT 'aspect', a, n FROM goal UNION ALL SELECT 'dataset_tier', t, n FROM goal)
SELECT category, value, CAST(sum(n) AS BIGINT) AS wanted, CAST(sum(n) AS DOUBLE) AS expected FROM margin GROUP BY category, value""",
    "p5_groups": f"""WITH RECURSIVE own AS (SELECT text_id, array_to_string({_words("min(text)")}, ' ') AS x FROM candidate_labeling_dataset GROUP BY text_id HAVING len({_words("min(text)")}) >= 12),
member AS (SELECT text_id, x, min(text_id) OVER (PARTITION BY x) AS rep FROM own),
rep AS (SELECT DISTINCT rep, string_split(x, ' ') AS w FROM member),
run AS (SELECT DISTINCT rep, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM rep, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
n AS (SELECT rep, count(*) AS n FROM run GROUP BY rep),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM run a JOIN run b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM common JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE c * 10 >= 6 * (na.n + nb.n - c)),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(n, r) AS (SELECT DISTINCT rep, rep FROM member UNION SELECT way.b, reach.r FROM reach JOIN way ON way.a = reach.n),
grp AS (SELECT n AS rep, min(r) AS group_id FROM reach GROUP BY n), deg AS (SELECT a AS rep, count(*) AS n_links FROM way GROUP BY a)
SELECT text_id, rep, group_id, coalesce(n_links, 0) AS n_links FROM member JOIN grp USING (rep) LEFT JOIN deg USING (rep)""",
    "p9_items": f"""WITH q AS (SELECT item_id, {_words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
  qg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM q, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)),
  d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
  hit AS (SELECT doc_id, item_id, i FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)) JOIN qg USING (g)),
  start AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) <= 12 THEN 0 ELSE 1 END AS s FROM hit),
  run AS (SELECT doc_id, item_id, i, sum(s) OVER (PARTITION BY doc_id, item_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM start),
  passage AS (SELECT doc_id, item_id, max(i) - min(i) + 12 AS n FROM run GROUP BY doc_id, item_id, r)
SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(n) AS INTEGER) AS longest FROM passage GROUP BY item_id""",
    "p1_found": f"WITH {_LINES} SELECT record_id, line_no FROM line JOIN hot USING (site, k)",
    "p2_found": f"""WITH {_SPLITS} SELECT a AS text_id_a, b AS text_id_b FROM pair JOIN side x ON x.text_id = a JOIN side y ON y.text_id = b WHERE x.train <> y.train""",
    "p3_found": f"WITH {_CELLS} SELECT target_id FROM want WHERE available < wanted",
    "p3_cells": f"WITH {_CELLS} SELECT target_id, available, wanted, least(available, wanted) AS drawn, greatest(wanted - available, 0) AS gap FROM want",
    "p5_found": f"""WITH own AS (SELECT text_id, {_words("min(text)")} AS w FROM candidate_labeling_dataset GROUP BY text_id HAVING len({_words("min(text)")}) >= 12),{_shingled(3)}
SELECT a AS text_id_a, b AS text_id_b FROM pair""",
    "p7_found": f"""WITH RECURSIVE k AS (
  SELECT DISTINCT text_id, c, v FROM (
    SELECT text_id, 1 AS c, {_key("group_id")} AS v FROM training_dataset UNION ALL SELECT text_id, 2, {_key("normalized_source_url")} FROM training_dataset
    UNION ALL SELECT text_id, 3, {_key("base_text_id")} FROM training_dataset) WHERE v IS NOT NULL AND text_id IS NOT NULL),
  star AS (SELECT text_id, min(text_id) OVER (PARTITION BY c, v) AS hub FROM k),
  e AS (SELECT DISTINCT text_id AS x, hub AS y FROM star WHERE text_id <> hub UNION SELECT DISTINCT hub, text_id FROM star WHERE text_id <> hub),
  reach(n, r) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.n)
SELECT n AS text_id, min(r) AS first_text_id FROM reach GROUP BY n""",
    "p9_found": f"""WITH q AS (SELECT item_id, {_words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
  qg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM q, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)),
  d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
  dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN qg USING (g)""",
}
