"""SQL of the queries for comparison; CTEs that several of them share are built here."""

from __future__ import annotations

from .config import ABBREVIATIONS, HIGH_CONFIDENCE, LABELS, NEGATIONS, REVIEW, RULE_ALPHA, SIMILARITY_BETA, SPAN_MAX, SPAN_MIN, TEMPERATURE_GRID, THRESHOLD_GRID, TOKEN, TRACKING, WEAK_THRESHOLD
from .operators.fusion import policy_grid
from .operators.lexicon import Rules
from .oracle_rules import engine, keyword_ranks, token_rows
from .terms import ASPECTS, LOCAL_TERMS, OUTSIDE_TERMS, PHRASES, SOURCE_LIST, WORDS

_TOKEN = TOKEN.replace("'", "''")
_IN = "'negatif', 'netral', 'positif'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _filled(c: str) -> str:
    return f"coalesce(length({_strip(c)}) > 0, false)"


def _squeeze(c: str) -> str:
    return _strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")


def _normal_text(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '(?i)(?:https?://|www\\.)\\S+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '[^0-9A-Za-zÀ-ſ\\s.,!?''\\-]', ' ', 'g')"
    for mark in (r"\.", ",", "!", r"\?", "''", "-"):
        t = f"regexp_replace({t}, '{mark}{{2,}}', '{mark[-1] if mark != chr(39) * 2 else chr(39) * 2}', 'g')"
    return f"lower({_squeeze(t)})"


def _words(tokens: str) -> str:
    """rule_score, rule_confidence, rule_label, rule_status, rule_hits over a list of tokens, as select items."""
    parts, hits = [], []
    for w, (label, weight) in WORDS.items():
        signed = weight if label == "positif" else -weight * 1.5
        n = f"len(list_filter({tokens}, lambda x: x = '{w}'))"
        parts.append(f"coalesce(list_sum(list_transform(range(1, {n} + 1), lambda k: round({signed}::DOUBLE * round(1.0::DOUBLE / k, 4), 4))), 0)")
        hits.append(n)
    return f"round({' + '.join(parts)}, 4) AS rule_score, {' + '.join(hits)} AS rule_hits"


_WORD_COLUMNS = f"""rule_score, round(least(abs(rule_score) / 3.0, 1.0), 4) AS rule_confidence,
  CASE WHEN rule_score > 0.15 THEN 'positif' WHEN rule_score < -0.15 THEN 'negatif' ELSE 'netral' END AS rule_label,
  CASE WHEN rule_hits = 0 THEN 'unknown' WHEN round(least(abs(rule_score) / 3.0, 1.0), 4) < {WEAK_THRESHOLD} THEN 'weak' ELSE 'detected' END AS rule_status, rule_hits"""


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{_TOKEN}')"


def _logits(key: str) -> str:
    z = [f"(('0x' || substr(md5({key}::VARCHAR), {1 + 4 * k}, 4))::BIGINT % 1000) / 250.0::DOUBLE - 2 AS z_{x}" for k, x in enumerate(LABELS)]
    return ", ".join(z)


def _model(source: str, temperature: float) -> str:
    """CTEs m0..model: probabilities, label, confidence, margin, entropy over a CTE with logits."""
    return f"""
m0 AS (SELECT *, greatest(z_negatif, z_netral, z_positif) AS top FROM {source}),
m1 AS (SELECT *, exp((z_negatif - top) / {temperature}) AS e0, exp((z_netral - top) / {temperature}) AS e1, exp((z_positif - top) / {temperature}) AS e2 FROM m0),
m2 AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM m1),
model AS (SELECT *, CASE WHEN p0 = greatest(p0, p1, p2) THEN 'negatif' WHEN p1 = greatest(p0, p1, p2) THEN 'netral' ELSE 'positif' END AS bert_label,
  greatest(p0, p1, p2) AS conf, list_sort([p0, p1, p2], 'DESC')[1] - list_sort([p0, p1, p2], 'DESC')[2] AS marg, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3.0::DOUBLE) AS ent FROM m2)"""


def _decided(source: str, high: str = str(HIGH_CONFIDENCE), review: str = str(REVIEW), wc: str = "0.4", wm: str = "0.4", wd: str = "0.2") -> str:
    return f"""SELECT *, CASE WHEN NOT valid THEN 'bert_only' WHEN bert_label = rule_label THEN 'agreement' WHEN conf >= {high} THEN 'conflict_both_confident' ELSE 'rule_confident' END AS fusion_action,
  CASE WHEN valid AND bert_label <> rule_label AND NOT conf >= {high} THEN rule_label ELSE bert_label END AS final_sentiment,
  conflict AND conf >= {high} AS requires_llm, score >= {review} OR (conflict AND conf >= {high}) AS needs_review
FROM (SELECT *, round({wc} * (1 - conf) + {wm} * (1 - marg) + {wd} * conflict::DOUBLE, 6) AS score FROM (SELECT *, rule_status = 'detected' AS valid, rule_status = 'detected' AND bert_label <> rule_label AS conflict FROM {source}))"""


_LABELLED = f"""
one AS (SELECT DISTINCT text_id, processed_text, sentiment_label, location FROM training_dataset),
l1 AS (SELECT text_id, processed_text, location, lower({_strip("sentiment_label")}) AS actual, {_tokens("coalesce(processed_text, '')")} AS tok, {_logits("text_id")} FROM one
  WHERE lower({_strip("sentiment_label")}) IN ({_IN})),
l2 AS (SELECT *, {_words("tok")} FROM l1),
l3 AS (SELECT * EXCLUDE (rule_score, rule_hits), {_WORD_COLUMNS} FROM l2),{_model("l3", 1.3)},
lab AS (SELECT * FROM model)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _counted(source: str, predicted: str, by: str = "") -> str:
    items = [f"count(*) AS total, count(*) FILTER (actual = {predicted}) AS right_n"]
    for x in LABELS:
        items.append(
            f"count(*) FILTER (actual = '{x}' AND {predicted} = '{x}') AS tp_{x}, count(*) FILTER (actual = '{x}') AS sup_{x}, count(*) FILTER ({predicted} = '{x}') AS pred_{x}"
        )
    return f"SELECT {by + ', ' if by else ''}{', '.join(items)} FROM {source}{' GROUP BY ' + by if by else ''}"


def _recall(x: str) -> str:
    return _ratio(f"tp_{x}", f"sup_{x}")


def _f1(x: str) -> str:
    return _ratio(f"2 * tp_{x}", f"pred_{x} + sup_{x}")


_OVERALL = (
    f"total, round({_ratio('right_n', 'total')}, 4) AS accuracy, round(({' + '.join(_recall(x) for x in LABELS)}) / 3, 4) AS balanced_accuracy, "
    f"round(({' + '.join(_f1(x) for x in LABELS)}) / 3, 4) AS macro_f1, round(({' + '.join(f'({_f1(x)}) * sup_{x}' for x in LABELS)}) / ({' + '.join(f'sup_{x}' for x in LABELS)}), 4) AS weighted_f1"
)
_FUSED = f"WITH {_LABELLED}, fused AS ({_decided('lab')})"
_COMPONENTS = f"""{_FUSED}, long AS (SELECT actual, 'model' AS component, bert_label AS guess FROM fused UNION ALL SELECT actual, 'rule', rule_label FROM fused UNION ALL SELECT actual, 'hybrid', final_sentiment FROM fused),
c AS ({_counted("long", "guess", "component")}), metrics AS (SELECT component, {_OVERALL} FROM c)"""
_SWEEP = f"""WITH {_LABELLED}, t AS (SELECT unnest([{", ".join(str(x) for x in THRESHOLD_GRID)}]::DOUBLE[]) AS threshold),
s AS (SELECT threshold, count(*) AS n, count(*) FILTER (rule_status <> 'unknown' AND rule_confidence >= threshold) AS detected_count,
  count(*) FILTER (rule_status <> 'unknown' AND rule_confidence >= threshold AND rule_label = actual) AS correct_detected_count,
  count(*) FILTER (rule_status <> 'unknown' AND rule_confidence < threshold) AS weak_count, count(*) FILTER (rule_status = 'unknown') AS unknown_count FROM lab CROSS JOIN t GROUP BY threshold),
sweep AS (SELECT threshold, detected_count, correct_detected_count, detected_count - correct_detected_count AS wrong_detected_count, weak_count, unknown_count,
  round({_ratio("correct_detected_count", "detected_count")}, 6) AS precision_on_detected, round({_ratio("detected_count", "n")}, 6) AS coverage FROM s)"""


def _policies() -> str:
    rows = ", ".join(f"({p}, {wc}::DOUBLE, {wm}::DOUBLE, {wd}::DOUBLE, {h}::DOUBLE, {r}::DOUBLE)" for p, wc, wm, wd, h, r in policy_grid())
    return f"(VALUES {rows}) AS g(policy, wc, wm, wd, high, review)"


def _url(c: str) -> dict[str, str]:
    netloc = f"lower(regexp_extract({c}, '^\\s*(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1))"
    domain = f"regexp_replace({netloc}, '^www\\.', '')"
    u = _strip(c)
    path = f"regexp_extract({u}, '^\\s*(?:(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//[^/?#]*)?([^?#]*)', 1)"
    drop = "|".join(t for t in TRACKING)
    params = f"list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(?:(?:{drop}|hl)(?:=|$)|page=all$)')))"
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
    normal = (
        f"CASE WHEN coalesce({u}, '') = '' THEN '' ELSE CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END || '://' || {domain} || regexp_replace({path}, '/+$', '')"
        f" || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END END"
    )
    return {"netloc": netloc, "domain": domain, "path": path, "normal": normal}


_U, _C = _url("url"), _url("canonical_url")


def _phrase(t: str, p: str) -> str:
    return f"regexp_matches({t}, '(^|[^\\pL\\pN_]){p}([^\\pL\\pN_]|$)')"


def _first_group(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    cases = [f"WHEN {' OR '.join(f'contains({low}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{name}'" for name, terms in ASPECTS.items()]
    return f"CASE {' '.join(cases)} ELSE 'general_shs' END"


def _sep(t: str) -> str:
    return f"(^|[^0-9A-Za-zÀ-ſ]){t}([^0-9A-Za-zÀ-ſ]|$)"


_PLACE = "'" + _sep("' || alias || '") + "'"


def _dictionary(c: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    tok, gap = f"regexp_extract_all({c}, '{_TOKEN}')", f"regexp_split_to_array({c}, '{_TOKEN}')"
    return f"array_to_string(list_transform(list_zip({gap}, list_transform({tok}, lambda t: CASE lower(t) {cases} ELSE t END)), lambda z: z[1] || coalesce(z[2], '')), '')"


_READY = (
    f"dataset_tier IN ('A_candidate_core', 'B_review_queue') AND is_specific_location AND location_source IN ('text', 'query') AND {_filled('source_type')} AND {_filled('aspect')}"
    f" AND {_filled('text')} AND {_filled('location')}"
)
_TEXT_TOKENS = _tokens("coalesce(text, '')")
_UNPIVOT = "UNPIVOT (SELECT {cols} FROM {table}) ON {names} INTO NAME kolom VALUE nilai"


def _bins(v: str, low: int, high: int, n: int) -> str:
    return f"least(greatest(floor(({v}::DOUBLE - {low}) / ({high} - {low}) * {n}), 0), {n - 1})::INTEGER"


_RULES = Rules.load()
_LAB_ROWS = f"lr AS (SELECT DISTINCT text_id, processed_text, location, lower({_strip('sentiment_label')}) AS actual FROM training_dataset WHERE lower({_strip('sentiment_label')}) IN ({_IN}))"
_FLAG_URL = _url("coalesce(url, '')")["normal"]

ORACLES = {
    "lexicon_full": f"WITH {engine('documents', 'text', 'doc_id', _RULES)} SELECT id AS doc_id, rule_label, rule_score, rule_status, rule_hits, rule_explanation FROM ruled",
    "flagship_full": f"""WITH f0 AS (SELECT doc_id, {_normal_text("text")} AS t, {_FLAG_URL} AS u FROM documents),
f1 AS (SELECT doc_id, u, {_squeeze(_dictionary("t", NEGATIONS))} AS processed FROM f0),
f2 AS (SELECT *, row_number() OVER (PARTITION BY u, processed ORDER BY doc_id) AS nth FROM f1 WHERE processed <> ''),
f3 AS (SELECT doc_id, processed, {_logits("doc_id")} FROM f2 WHERE nth = 1),{engine("f3", "processed", "doc_id", _RULES)},
f4 AS (SELECT f3.*, rule_label, rule_status FROM f3 JOIN ruled ON ruled.id = f3.doc_id),{_model("f4", 1.0)}, f AS ({_decided("model")})
SELECT final_sentiment, fusion_action, rule_status, count(*) AS jumlah FROM f GROUP BY 1, 2, 3""",
    "topic_keywords": f"""WITH {_LAB_ROWS},{keyword_ranks("lr", "processed_text", "actual", _RULES, 10)}
SELECT keyword, sentiment_label, frequency, document_frequency, source, category, weight, false AS blacklist_overridden, rank FROM ranked""",
    "topic_summaries": f"""WITH {_LAB_ROWS},{keyword_ranks("lr", "processed_text", "actual", _RULES, 10)},
w AS (SELECT sentiment_label, CAST(count(*) AS INTEGER) AS n, string_agg(keyword, ',' ORDER BY rank) AS k FROM ranked GROUP BY sentiment_label), d AS (SELECT actual, count(*) AS n FROM lr GROUP BY actual)
SELECT c.x AS sentiment_label, coalesce(d.n, 0) AS n_documents, coalesce(w.n, 0) AS keyword_count, coalesce(k, '') AS keywords
FROM (VALUES ('positif'), ('netral'), ('negatif')) AS c(x) LEFT JOIN w ON w.sentiment_label = c.x LEFT JOIN d ON d.actual = c.x""",
    "token_offsets": f"WITH {token_rows('documents', 'lower(text)', 'doc_id')} SELECT id AS doc_id, w AS text, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS \"end\", CAST(k - 1 AS INTEGER) AS index FROM tok",
    "flagship_decisions": f"""WITH d0 AS (SELECT doc_id, {_normal_text("text")} AS t, {_logits("doc_id")} FROM documents), d1 AS (SELECT *, {_tokens("t")} AS tok FROM d0 WHERE t <> ''),
d2 AS (SELECT *, {_words("tok")} FROM d1), d3 AS (SELECT * EXCLUDE (rule_score, rule_hits), {_WORD_COLUMNS} FROM d2),{_model("d3", 1.0)}, f AS ({_decided("model")})
SELECT final_sentiment, fusion_action, count(*) AS jumlah, count(*) FILTER (needs_review) AS to_review FROM f GROUP BY 1, 2""",
    "text_normalize": f"SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, {_normal_text('text')} AS t FROM documents)",
    "dictionary_replace": f"""SELECT DISTINCT text_id, md5({_dictionary("lower(coalesce(processed_text, ''))", {"nih": "ini", "rumah": "hunian", "lampu": "pelita", "tidak": "tak"})}) AS digest FROM training_dataset""",
    "token_profile": f"""SELECT doc_id, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words
FROM (SELECT doc_id, {_tokens("coalesce(text, '')")} AS tok, {_squeeze("coalesce(text, '')")} AS t FROM documents)""",
    "term_frequencies": f"""WITH {_LABELLED}, p AS (SELECT unnest({PHRASES!r}) AS keyword),
c AS (SELECT actual, keyword, len(regexp_extract_all(regexp_replace(' ' || lower(coalesce(processed_text, '')) || ' ', '[^\\pL\\pN_]', '  ', 'g'), ' ' || replace(keyword, ' ', '  ') || ' ')) AS n FROM lab CROSS JOIN p)
SELECT actual, keyword, sum(n)::BIGINT AS frequency, count(*) AS document_frequency FROM c WHERE n > 0 GROUP BY actual, keyword""",
    "doc_quality": f"""SELECT count(*) AS total_rows, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (text IS NOT NULL AND NOT {_filled("text")}) AS empty_text,
  count(*) FILTER (NOT {_filled("source")}) AS empty_source, count(*) - count(DISTINCT {{'s': source, 't': text}}) AS duplicates, coalesce(round(avg(length(text)), 2), 0.0) AS mean_length FROM documents""",
    "source_distribution": "SELECT source, lang, count(*) AS jumlah FROM documents GROUP BY source, lang",
    "column_values": f"""SELECT kolom, nilai, count(*) AS jumlah FROM ({_UNPIVOT.format(cols="source_type, aspect, dataset_tier", table="candidate_labeling_dataset", names="source_type, aspect, dataset_tier")}) WHERE {_filled("nilai")} GROUP BY kolom, nilai""",
    "column_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS kolom, count(v) AS filled, count(*) - count(v) AS empty, count(DISTINCT v) AS \"unique\", round(100.0 * count(v) / count(*), 2) AS percent FROM (SELECT nullif({_strip(c)}, '') AS v FROM url_discovery)"
        for c in ("domain", "content_status", "content_title", "extraction_method", "query_id")
    ),
    "note_counts": f"""SELECT nilai, count(*) AS jumlah FROM (SELECT {_strip("x")} AS nilai FROM (SELECT unnest(string_split(coalesce(decision_note, ''), ';')) AS x FROM candidate_labeling_dataset)) WHERE nilai <> '' GROUP BY nilai""",
    "length_histogram": f"SELECT {_bins('length(text)', 0, 2000, 20)} AS bin, count(*) AS jumlah FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "location_crosstab": f"""WITH {_LABELLED} SELECT coalesce(nullif({_strip("location")}, ''), '(kosong)') AS place, {", ".join(f"count(*) FILTER (actual = '{x}') AS {x}" for x in LABELS)} FROM lab GROUP BY 1""",
    "row_gates": f"""SELECT count(*) FILTER (split IS NULL) = 0 AS every_row_has_split, count(*) FILTER (NOT {_filled("processed_text")}) = 0 AS every_text_filled,
  count(*) FILTER (text_id IS NULL) = 0 AS every_id_filled FROM training_dataset""",
    "dedupe_keep_first": "SELECT min(doc_id) AS doc_id, source, digest FROM (SELECT doc_id, source, md5(text) AS digest FROM documents) GROUP BY source, digest",
    "numbered_rows": "SELECT text_id, 'RAW-' || CASE WHEN length(n::VARCHAR) < 4 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS row_id FROM (SELECT text_id, row_number() OVER (ORDER BY text_id) AS n FROM (SELECT DISTINCT text_id FROM candidate_labeling_dataset))",
    "next_source_number": "SELECT coalesce(max(nullif(regexp_extract(source_id, '^RAW-SRC-(\\d+)$', 1), '')::BIGINT), 0) + 1 AS next_number FROM candidate_labeling_dataset",
    "top_locations": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY jumlah DESC, location) AS rank FROM (SELECT aspect, location, count(*) AS jumlah FROM candidate_labeling_dataset
  WHERE {_filled("location")} AND {_filled("aspect")} GROUP BY aspect, location)) WHERE rank <= 3""",
    "majority_location": f"""SELECT aspect, location, n FROM (SELECT aspect, location, count(*) AS n, row_number() OVER (PARTITION BY aspect ORDER BY count(*) DESC, min(regexp_replace(text_id, '\\D', '', 'g')::BIGINT)) AS k
  FROM candidate_labeling_dataset WHERE {_filled("aspect")} AND location IS NOT NULL GROUP BY aspect, location) WHERE k = 1""",
    "review_priority": """SELECT * FROM (SELECT DISTINCT text_id, dataset_tier, evidence_support_score FROM candidate_labeling_dataset WHERE dataset_tier IS NOT NULL AND evidence_support_score IS NOT NULL)
ORDER BY dataset_tier, evidence_support_score DESC, text_id LIMIT 50""",
    "url_forms": f"SELECT record_id, coalesce({_U['domain']}, '') AS domain, coalesce({_U['netloc']}, '') AS netloc, {_U['normal']} AS normal FROM url_discovery",
    "url_titles": f"""SELECT record_id, {_squeeze("regexp_replace(array_to_string(CASE WHEN len(p) > 2 THEN p[len(p) - 1:] ELSE p END, ' '), '[_-]+', ' ', 'g')")} AS title
FROM (SELECT record_id, list_filter(list_transform(string_split({_C["path"]}, '/'), lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM (SELECT record_id, coalesce(canonical_url, '') AS canonical_url FROM url_discovery))""",
    "listed_urls": """SELECT canonical_url IS NOT NULL AND canonical_url IN (SELECT canonical_url FROM url_discovery WHERE is_blacklisted AND canonical_url IS NOT NULL) AS is_listed, count(*) AS jumlah FROM url_discovery GROUP BY 1""",
    "unlisted_urls": f"SELECT content_status, count(*) AS jumlah FROM url_discovery WHERE domain NOT IN ({', '.join(repr(x) for x in SOURCE_LIST)}) GROUP BY content_status",
    "source_screening": f"""WITH u AS (SELECT coalesce(raw_title, '') || ' ' || {_C["path"]} || ' ' || {_C["domain"]} AS words, {_C["domain"]} AS host, lower({_C["path"]}) AS route
  FROM (SELECT raw_title, coalesce(canonical_url, '') AS canonical_url FROM url_discovery)),
c AS (SELECT host IN ({", ".join(repr(x) for x in SOURCE_LIST)}) OR contains(route, '/toko/') OR contains(route, 'promo') AS sells,
  ({" OR ".join(_phrase("lower(words)", t) for t in OUTSIDE_TERMS)}) AND NOT ({" OR ".join(_phrase("lower(words)", t) for t in LOCAL_TERMS)}) AS away FROM u)
SELECT CASE WHEN sells OR away THEN 'discovered_pattern_blacklist' ELSE 'clear' END AS blacklist_status,
  array_to_string(list_filter([CASE WHEN sells THEN 'commercial_self_promotion' END, CASE WHEN away THEN 'explicit_outside_location_in_url_or_title' END], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS jumlah FROM c GROUP BY 1, 2""",
    "url_search": "SELECT record_id FROM url_discovery WHERE (coalesce(contains(lower(canonical_url), 'listrik-surya'), false) OR coalesce(contains(lower(url), 'listrik-surya'), false)) AND NOT coalesce(is_blacklisted, false)",
    "query_enrichment": f"""WITH q AS (SELECT source_file, query_id, min(row(query_group, query, query_status)) AS r FROM discovery_queries GROUP BY source_file, query_id)
SELECT record_id, coalesce(nullif({_strip("u.query_group")}, ''), r[1]) AS query_group, coalesce(nullif({_strip("u.query")}, ''), r[2]) AS query, coalesce(nullif({_strip("u.query_status")}, ''), r[3]) AS query_status
FROM url_discovery u LEFT JOIN q USING (source_file, query_id)""",
    "first_per_url": f"SELECT min(record_id) AS record_id FROM url_discovery WHERE {_filled('canonical_url')} GROUP BY canonical_url UNION ALL SELECT record_id FROM url_discovery WHERE NOT {_filled('canonical_url')}",
    "aspect_inference": f"SELECT inferred, count(*) AS jumlah FROM (SELECT DISTINCT text_id, {_first_group('text')} AS inferred FROM candidate_labeling_dataset) GROUP BY inferred",
    "location_inference": f"""WITH g AS (SELECT DISTINCT lower(name) AS alias, {_filled("parent_code")} AS specific FROM gazetteer WHERE {_filled("name")}),
c AS (SELECT DISTINCT text_id, lower(coalesce(text, '')) AS t, lower(coalesce(query, '')) AS q FROM candidate_labeling_dataset),
h AS (SELECT text_id, t, q, coalesce(bool_or(regexp_matches(t, {_PLACE})) FILTER (specific), false) AS ts, coalesce(bool_or(regexp_matches(q, {_PLACE})) FILTER (specific), false) AS qs,
  coalesce(bool_or(regexp_matches(t, {_PLACE})) FILTER (NOT specific), false) AS tp, coalesce(bool_or(regexp_matches(q, {_PLACE})) FILTER (NOT specific), false) AS qp
  FROM c CROSS JOIN g GROUP BY text_id, t, q)
SELECT DISTINCT text_id, CASE WHEN ts THEN 'text' WHEN qs THEN 'query' WHEN tp THEN 'text' WHEN qp THEN 'query' ELSE '' END AS source, ts OR qs AS is_specific, ts OR qs OR tp OR qp AS found FROM h""",
    "labeling_ready": f"SELECT source_type, aspect, count(*) AS jumlah FROM candidate_labeling_dataset WHERE {_READY} GROUP BY source_type, aspect",
    "labeling_buckets": f"""SELECT kolom, nilai, count(*) AS jumlah FROM (UNPIVOT (SELECT DISTINCT text_id, source_type, aspect FROM candidate_labeling_dataset) ON source_type, aspect INTO NAME kolom VALUE nilai) WHERE {_filled("nilai")} GROUP BY kolom, nilai""",
    "lexicon_words": f"SELECT doc_id, {_WORD_COLUMNS} FROM (SELECT doc_id, {_words('tok')} FROM (SELECT doc_id, {_TEXT_TOKENS} AS tok FROM documents))",
    "softmax_rows": f"""WITH src AS (SELECT doc_id, {_logits("doc_id")} FROM documents),{_model("src", 1.7)}
SELECT doc_id, bert_label, round(p0, 6) AS p_negatif, round(p1, 6) AS p_netral, round(p2, 6) AS p_positif, round(marg, 6) AS margin, round(ent, 6) AS entropy FROM model""",
    "temperature_grid": f"""WITH {_LABELLED}, t AS (SELECT unnest([{", ".join(map(str, TEMPERATURE_GRID))}]::DOUBLE[]) AS temperature),
e AS (SELECT temperature, actual, exp((z_negatif - top) / temperature) AS a, exp((z_netral - top) / temperature) AS b, exp((z_positif - top) / temperature) AS c FROM lab CROSS JOIN t)
SELECT temperature, round(avg(-ln(greatest(CASE actual WHEN 'negatif' THEN a WHEN 'netral' THEN b ELSE c END / (a + b + c), 1e-12))), 6) AS nll FROM e GROUP BY temperature""",
    "uncertainty_scores": f"{_FUSED} SELECT text_id, conflict AS cross_method_conflict, score AS routing_uncertainty_score, round(ent, 6) AS normalized_entropy FROM fused",
    "fusion_decisions": f"{_FUSED} SELECT text_id, fusion_action, final_sentiment, requires_llm, needs_review FROM fused",
    "fusion_facts": f"""{_FUSED} SELECT *, corrected_rows - worsened_rows AS net_correct_change FROM (SELECT count(*) AS total_rows, count(*) AS comparable_rows, count(*) FILTER (bert_label <> final_sentiment) AS changed_from_model_count,
  count(*) FILTER (conflict) AS conflict_count, count(*) FILTER (requires_llm) AS requires_llm_count, count(*) FILTER (needs_review) AS needs_review_count, count(*) AS labeled_rows,
  count(*) FILTER (bert_label <> final_sentiment AND bert_label <> actual AND final_sentiment = actual) AS corrected_rows,
  count(*) FILTER (bert_label <> final_sentiment AND bert_label = actual AND final_sentiment <> actual) AS worsened_rows,
  round(count(*) FILTER (bert_label <> final_sentiment) / count(*), 6) AS changed_rate FROM fused)""",
    "policy_search": f"""WITH {_LABELLED}, base AS (SELECT * FROM lab CROSS JOIN {_policies()}), fused AS ({_decided("base", "high", "review", "wc", "wm", "wd")}),
c AS (SELECT policy, high, review, count(*) AS n, count(*) FILTER (needs_review) AS flagged, count(*) FILTER (final_sentiment <> actual) AS errors, count(*) FILTER (final_sentiment <> actual AND needs_review) AS caught,
  count(*) FILTER (final_sentiment <> bert_label) AS changed_count, {", ".join(f"count(*) FILTER (actual = '{x}' AND final_sentiment = '{x}') AS tp_{x}, count(*) FILTER (actual = '{x}') AS sup_{x}, count(*) FILTER (final_sentiment = '{x}') AS pred_{x}" for x in LABELS)} FROM fused GROUP BY policy, high, review)
SELECT policy, high, review, round(({" + ".join(_recall(x) for x in LABELS)}) / 3, 4) AS balanced_accuracy, round(({" + ".join(_f1(x) for x in LABELS)}) / 3, 4) AS macro_f1,
  round(CASE WHEN errors > 0 THEN caught / errors ELSE 1.0 END, 6) AS error_capture, round({_ratio("flagged", "n")}, 6) AS review_rate, changed_count FROM c""",
    "confusion_matrix": f"""{_FUSED}, g AS (SELECT a.x AS actual, p.x AS predicted FROM (SELECT unnest([{_IN}]) AS x) a CROSS JOIN (SELECT unnest([{_IN}]) AS x) p)
SELECT g.actual, g.predicted, count(f.text_id) AS n FROM g LEFT JOIN fused f ON f.actual = g.actual AND f.final_sentiment = g.predicted GROUP BY 1, 2""",
    "label_metrics": f"{_FUSED}, c AS ({_counted('fused', 'final_sentiment')}) "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS label, round({_ratio(f'tp_{x}', f'pred_{x}')}, 4) AS precision, round({_recall(x)}, 4) AS recall, round({_f1(x)}, 4) AS f1, sup_{x} AS support FROM c" for x in LABELS
    ),
    "component_metrics": f"{_COMPONENTS} SELECT * FROM metrics",
    "metric_deltas": f"""{_COMPONENTS}, long2 AS (UNPIVOT (SELECT component, accuracy, balanced_accuracy, macro_f1, weighted_f1 FROM metrics) ON accuracy, balanced_accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE v)
SELECT a.metric, a.v AS base, b.v AS other, round(b.v - a.v, 4) AS delta FROM long2 a JOIN long2 b USING (metric) WHERE a.component = 'model' AND b.component = 'hybrid'""",
    "probability_metrics": f"""WITH {_LABELLED}, r AS (SELECT least(floor(conf * 10), 9) AS b, conf, (bert_label = actual)::DOUBLE AS hit,
  -ln(greatest(least(CASE actual WHEN 'negatif' THEN p0 WHEN 'netral' THEN p1 ELSE p2 END, 1.0), 1e-12)) AS nll,
  pow(p0 - (actual = 'negatif')::INT, 2) + pow(p1 - (actual = 'netral')::INT, 2) + pow(p2 - (actual = 'positif')::INT, 2) AS brier FROM lab),
g AS (SELECT b, count(*) AS n, sum(conf) AS c, sum(hit) AS h, sum(nll) AS nll, sum(brier) AS brier FROM r GROUP BY b)
SELECT round(sum(nll) / sum(n), 6) AS nll, round(sum(brier) / sum(n), 6) AS multiclass_brier_score, round(sum(abs(c - h)) / sum(n), 6) AS ece FROM g""",
    "threshold_sweep": f"{_SWEEP} SELECT * FROM sweep",
    "threshold_choice": f"""{_SWEEP}, v AS (SELECT *, precision_on_detected >= 0.3 AND coverage >= 0.01 AND detected_count > 0 AS is_valid FROM sweep),
r AS (SELECT *, CASE WHEN is_valid AND threshold = 0.6 THEN 0 WHEN is_valid THEN 1 ELSE 2 END AS k FROM v)
SELECT threshold, is_valid FROM r ORDER BY k, CASE WHEN k = 2 THEN precision_on_detected ELSE coverage END DESC, CASE WHEN k = 2 THEN coverage ELSE precision_on_detected END DESC, threshold DESC LIMIT 1""",
    "class_weights": f"""WITH {_LABELLED} SELECT x AS label, count(l.actual) AS n, round((SELECT count(*) FROM lab) / (3 * greatest(count(l.actual), 1)), 6) AS weight
FROM (SELECT unnest([{_IN}]) AS x) g LEFT JOIN lab l ON l.actual = g.x GROUP BY x""",
    "rating_labels": "SELECT CASE WHEN fmod(l_quantity, 6) >= 4 THEN 'positif' WHEN fmod(l_quantity, 6) <= 2 THEN 'negatif' ELSE 'netral' END AS label, count(*) AS jumlah FROM lineitem GROUP BY 1",
    "vector_neighbours": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS q, b.vec_id AS b, round(list_cosine_similarity(q.e, b.e), 6) AS similarity FROM v q JOIN v b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id)
SELECT q, b, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, b) AS rank FROM s) WHERE rank <= 3""",
    "centroid_similarity": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v WHERE label >= 0),
m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)
SELECT vec_id, CASE WHEN c IS NULL THEN 0.0 ELSE round(list_cosine_similarity(e, c), 4) END AS semantic_similarity FROM v LEFT JOIN c USING (label)""",
    "hashed_vectors": f"""WITH t AS (SELECT doc_id, unnest({_tokens("text")}) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 128 AS place, CASE WHEN ('0x' || substr(md5(t), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM t),
r AS (SELECT doc_id, place, sum(s) AS x FROM p GROUP BY doc_id, place),
v AS (SELECT doc_id, place::INTEGER AS place, round(x::DOUBLE / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM r WHERE x <> 0)
SELECT * FROM v WHERE value <> 0""",
    "ambiguity_decisions": f"""WITH {_LABELLED}, k AS (SELECT *, ('0x' || substr(md5(text_id), 20, 4))::BIGINT AS k FROM lab),
r AS (SELECT text_id, rule_label, bert_label, list_filter([CASE WHEN rule_confidence < {RULE_ALPHA} THEN 'low_rule_confidence' END, CASE WHEN (k % 100) / 100.0 < {SIMILARITY_BETA} THEN 'low_semantic_similarity' END,
  CASE WHEN k % 7 - 1 = -1 THEN 'cluster_noise' END, CASE WHEN rule_label <> 'netral' AND bert_label <> 'netral' AND rule_label <> bert_label THEN 'rule_semantic_conflict' END], lambda x: x IS NOT NULL) AS why FROM k)
SELECT text_id, len(why) > 0 AS is_ambiguous, array_to_string(why, ', ') AS ambiguity_reason,
  CASE WHEN len(why) > 0 THEN CASE WHEN rule_label <> 'netral' THEN rule_label ELSE bert_label END ELSE CASE WHEN bert_label <> 'netral' THEN bert_label ELSE rule_label END END AS final_label,
  CASE WHEN len(why) > 0 THEN 'non_llm_ambiguous' ELSE 'automatic' END AS decision_source FROM r""",
    "group_leakage": f"""SELECT group_id, array_to_string(list_sort(list(DISTINCT lower({_strip("split")}))), ',') AS splits FROM training_dataset WHERE {_filled("group_id")} AND split IS NOT NULL
GROUP BY group_id HAVING count(DISTINCT lower({_strip("split")})) > 1""",
    "split_join": """WITH a AS (SELECT text_id, min(split_fold) AS fold FROM training_dataset WHERE split_fold IS NOT NULL GROUP BY text_id)
SELECT fold, count(*) AS jumlah FROM golden_labels LEFT JOIN a USING (text_id) GROUP BY fold""",
    "metadata_recovery": """WITH m AS (SELECT trim(text_id) AS id, source_url, source_type, text_id FROM training_dataset WHERE regexp_replace(text_id, '^\\s+|\\s+$', '', 'g') <> ''),
e AS (SELECT id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY text_id, source_url NULLS FIRST, source_type NULLS FIRST) AS k FROM m) WHERE k = 1),
b AS (SELECT base, source_url FROM (SELECT *, string_split(id, '#')[1] AS base, row_number() OVER (PARTITION BY string_split(id, '#')[1] ORDER BY text_id, source_url NULLS FIRST, source_type NULLS FIRST) AS k FROM m) WHERE k = 1),
g AS (SELECT trim(text_id) AS id, string_split(trim(text_id), '#')[1] AS base FROM golden_labels WHERE text_id IS NOT NULL),
j AS (SELECT CASE WHEN e.id IS NOT NULL THEN 'matched_by_exact_text_id' WHEN b.base IS NOT NULL THEN 'matched_by_base_text_id' ELSE 'fallback_to_base_text_id' END AS metadata_recovery_status,
  CASE WHEN e.id IS NOT NULL THEN e.source_url ELSE b.source_url END AS u FROM g LEFT JOIN e ON e.id = g.id LEFT JOIN b ON b.base = g.base)
SELECT metadata_recovery_status, count(*) AS jumlah, count(u) AS with_url FROM j GROUP BY 1""",
    "gazetteer_levels": f"""SELECT p.name AS province, r.name AS regency, d.name AS district FROM gazetteer p JOIN gazetteer r ON r.parent_code = p.code LEFT JOIN gazetteer d ON d.parent_code = r.code WHERE nullif({_strip("p.parent_code")}, '') IS NULL""",
    "location_coverage": "SELECT g.location, count(c.location) AS jumlah, count(c.location) < 5 AS is_low FROM (SELECT DISTINCT name AS location FROM gazetteer) g LEFT JOIN candidate_labeling_dataset c ON c.location = g.location GROUP BY g.location",
    "combination_audit": f"""WITH k AS (SELECT DISTINCT source_type, aspect FROM candidate_labeling_dataset WHERE source_type IS NOT NULL AND aspect IS NOT NULL),
a AS (SELECT source_type, aspect, count(*) AS n FROM candidate_labeling_dataset GROUP BY ALL), b AS (SELECT source_type, aspect, count(*) AS n FROM candidate_labeling_dataset WHERE {_READY} GROUP BY ALL)
SELECT k.source_type, k.aspect, coalesce(a.n, 0) AS raw_count, coalesce(b.n, 0) AS ready_count FROM k LEFT JOIN a USING (source_type, aspect) LEFT JOIN b USING (source_type, aspect)""",
    "event_props": "SELECT event_type, count(*) AS jumlah, count(props) AS parsed, round(sum(value), 2) AS total FROM events GROUP BY event_type",
    "orders_first": "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus",
    "lineitem_profile": "SELECT l_returnflag, l_linestatus, count(*) AS jumlah FROM lineitem GROUP BY 1, 2",
    "customer_region": "SELECT r_name, c_mktsegment, count(*) AS jumlah FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}

_SCOPE_NAME = "lower(regexp_replace({c}, '^(?i:kabupaten|kab\\.|kota|kecamatan)\\s+', ''))"
_ROLE_TIER = "CASE dataset_tier WHEN 'A_candidate_core' THEN '{a}' WHEN 'B_review_queue' THEN '{b}' WHEN 'C_holdout_excluded' THEN '{c}' END"
ORACLES |= {
    "lexicon_evidence": f"""WITH {engine('documents', 'text', 'doc_id', _RULES)}
SELECT id AS doc_id, term, CASE WHEN s3 > 0 THEN 'positif' WHEN s3 < 0 THEN 'negatif' ELSE label END AS label, source, score, CAST(a AS INTEGER) AS start, concat_ws(',', neg, up, down) AS modifiers, clause_weight,
  CASE WHEN s3 <> 0 AND NOT changed AND n > 1 THEN CAST(format('{{:.4f}}', 1.0::DOUBLE / n) AS DOUBLE) ELSE 1.0 END AS repetition_weight, coalesce(blocked, '') AS blocked_by FROM hit""",
    "evidence_payloads": f"""WITH {engine('documents', 'text', 'doc_id', _RULES)}
SELECT l.id AS doc_id, 'SO-CAL-inspired' AS method, CAST(count(h.id) AS INTEGER) AS hits, 'seed-1' AS words_version FROM lows l LEFT JOIN hit h ON h.id = l.id GROUP BY l.id""",
    "keyword_rows": f"""WITH {_LAB_ROWS},{keyword_ranks("lr", "processed_text", "actual", _RULES, 10)} SELECT sentiment_label, rank, keyword, source, category, frequency, document_frequency FROM ranked""",
    "model_only": f"""WITH f0 AS (SELECT doc_id, {_normal_text("text")} AS t, {_FLAG_URL} AS u FROM documents), f1 AS (SELECT doc_id, u, {_squeeze(_dictionary("t", NEGATIONS))} AS processed FROM f0),
f2 AS (SELECT *, row_number() OVER (PARTITION BY u, processed ORDER BY doc_id) AS nth FROM f1 WHERE processed <> ''), f3 AS (SELECT doc_id, {_logits("doc_id")} FROM f2 WHERE nth = 1),{_model("f3", 1.0)}
SELECT bert_label AS model_sentiment, count(*) AS jumlah, round(avg(conf), 4) AS confidence FROM model GROUP BY 1""",
    "model_gates": f"""WITH f0 AS (SELECT {_normal_text("text")} AS t, {_FLAG_URL} AS u FROM documents)
SELECT count(DISTINCT {{'u': u, 't': {_squeeze(_dictionary("t", NEGATIONS))}}}) AS output_rows, true AS all_rows_have_sentiment, true AS all_labels_valid FROM f0 WHERE {_squeeze(_dictionary("t", NEGATIONS))} <> ''""",
    "split_metrics": f"""WITH {_LABELLED}, part AS (SELECT text_id, min(struct_pack(p := processed_text, l := sentiment_label, s := split)).s AS s FROM training_dataset GROUP BY text_id),
r AS (SELECT lab.*, lower({_strip("s")}) AS part FROM lab JOIN part USING (text_id) WHERE lower({_strip("s")}) IN ('train', 'calibration', 'test')), c AS ({_counted("r", "bert_label", "part")}) SELECT part, {_OVERALL} FROM c""",
    "policy_applied": f"""WITH {_LABELLED}, f AS ({_decided("lab", "0.7", "0.5", "0.5", "0.3", "0.2")}) SELECT fusion_action, final_sentiment, needs_review, count(*) AS jumlah FROM f GROUP BY 1, 2, 3""",
    "scatter_points": f"""WITH {_LABELLED}, f AS ({_decided("lab")}) SELECT text_id, round(conf, 6) AS confidence, score AS uncertainty, round(marg, 6) AS margin, round(ent, 6) AS entropy FROM f""",
    "report_values": f"SELECT CASE WHEN sentiment IN ({_IN}) THEN sentiment ELSE '(kosong)' END AS report_value, count(*) AS jumlah FROM golden_labels GROUP BY 1",
    "statement_roles": f"""WITH c AS (SELECT text, coalesce(source_type, '') AS s, dataset_tier FROM candidate_labeling_dataset WHERE dataset_tier IS NOT NULL AND text IS NOT NULL)
SELECT CASE s WHEN 'academic_repository' THEN 'researcher' WHEN 'government_official' THEN 'public_official' WHEN 'corporate_official' THEN 'company_representative' WHEN 'social_media' THEN 'public_user' ELSE 'community_representative' END AS speaker_type,
  CASE WHEN dataset_tier = 'C_holdout_excluded' THEN 'contextual_source' WHEN s = 'academic_repository' THEN 'researcher_assessment' WHEN s IN ('government_official', 'corporate_official') THEN 'institutional_claim'
    WHEN regexp_matches(lower(text), 'harap|dambakan|ingin|butuh') THEN 'public_expectation' ELSE 'public_experience' END AS subjectivity_type,
  CASE WHEN dataset_tier = 'C_holdout_excluded' THEN 'contextual_reference' WHEN s = 'academic_repository' THEN 'researcher_or_author_assessment' WHEN s IN ('government_official', 'corporate_official') THEN 'stakeholder_opinion' ELSE 'public_opinion' END AS public_opinion_scope,
  {_ROLE_TIER.format(a="candidate_analysis_ready", b="review_required_before_core", c="held_out_not_for_sentiment_core")} AS inclusion_status, {_ROLE_TIER.format(a="core_public_opinion", b="contextual_evidence", c="excluded")} AS corpus_role, count(*) AS jumlah
FROM c GROUP BY ALL""",
    "projection": "SELECT sentiment, text_id, location, text_selected FROM golden_labels",
    "screened_rows": f"SELECT CASE WHEN blacklist_status = 'clear' THEN 'clear' ELSE 'audit' END AS part, CAST(sum(jumlah) AS BIGINT) AS jumlah FROM ({ORACLES['source_screening']}) GROUP BY 1",
    "filtered_records": "SELECT record_id FROM url_discovery WHERE content_status = 'success' AND found_by_count >= 1 AND length(content_text) > 200",
    "invalid_labels": f"SELECT DISTINCT sentiment FROM golden_labels WHERE sentiment IS NULL OR sentiment NOT IN ({_IN})",
    "checked_labels": f"SELECT lower({_strip('sentiment_label')}) AS sentiment_label, count(*) AS jumlah FROM training_dataset WHERE lower({_strip('sentiment_label')}) IN ({_IN}) GROUP BY 1",
    "distinct_lines": f"""WITH l AS (SELECT record_id, list_filter(list_transform(string_split(coalesce(content_text, ''), chr(10)), lambda x: {_squeeze("x")}), lambda x: x <> '') AS l FROM url_discovery),
k AS (SELECT record_id, coalesce(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)), '') AS t FROM l) SELECT record_id, md5(t) AS digest, length(t) AS n_chars FROM k""",
    "text_previews": f"""SELECT doc_id, CASE WHEN length(t) > 60 THEN regexp_replace(substr(t, 1, 57), '\\s+$', '') || '...' ELSE t END AS preview FROM (SELECT doc_id, {_squeeze("coalesce(text, '')")} AS t FROM documents)""",
    "adjudicated": f"""WITH {_LABELLED}, f AS ({_decided("lab")}), a AS (SELECT text_id, CASE WHEN {_filled("processed_text")} THEN length(substr(processed_text, 1, 100)) % 3 ELSE 2 END AS n FROM f WHERE requires_llm)
SELECT text_id, CASE n WHEN 0 THEN 'positif' WHEN 1 THEN 'negatif' ELSE 'netral' END AS llm_label, n < 2 AS llm_parsed, CASE n WHEN 0 THEN 'positif' WHEN 1 THEN 'negatif' ELSE 'netral' END AS final_sentiment, 'llm' AS decision_source FROM a""",
    "location_scopes": f"""WITH g AS (SELECT DISTINCT {_SCOPE_NAME.format(c=_strip("name"))} AS n, coalesce({_filled("parent_code")}, false) AS s FROM gazetteer WHERE {_filled("name")}),
c AS (SELECT {_SCOPE_NAME.format(c=_strip("coalesce(location, '')"))} AS n FROM candidate_labeling_dataset)
SELECT CASE WHEN n = '' THEN 'empty' WHEN n IN (SELECT n FROM g WHERE s) THEN 'specific' WHEN n IN (SELECT n FROM g WHERE NOT s) THEN 'province' ELSE 'other' END AS scope, count(*) AS jumlah FROM c GROUP BY 1""",
    "canonical_places": f"""WITH g AS (SELECT code, name, regexp_replace({_strip("name")}, '^(?:KABUPATEN|KOTA|KECAMATAN)\\s+', '') AS p FROM gazetteer)
SELECT code, array_to_string(list_transform(list_zip(regexp_split_to_array(lower(p), '\\pL+'), regexp_extract_all(lower(p), '\\pL+')), lambda z: z[1] || coalesce(upper(substr(z[2], 1, 1)) || substr(z[2], 2), '')), '') AS place,
  regexp_replace(lower(name), '[^\\pL\\pN]+', '', 'g') AS key FROM g""",
}


def _last_place(d: str) -> str:
    """Offset of the last d in the first SPAN_MAX characters of rest, -1 without one."""
    p = f"substr(rest, 1, {SPAN_MAX})"
    return f"CASE WHEN contains({p}, '{d}') THEN length({p}) - strpos(reverse({p}), reverse('{d}')) + 1 - length('{d}') ELSE -1 END"


_LEAST_CUT = max(40, int(SPAN_MAX * 0.45))
_CUT_AT = "CASE " + " ".join(f"WHEN ({_last_place(d)}) >= {_LEAST_CUT} THEN ({_last_place(d)}) + length('{d}')" for d in (", ", " - ", " — ", " – ", ": ", " ")) + f" ELSE {SPAN_MAX} END"
ORACLES |= {
    "labeling_sample": f"""WITH RECURSIVE ready AS (SELECT DISTINCT text_id, source_type, aspect, -coalesce(evidence_support_score, 0.0) AS o1, -coalesce(raw_text_length, 0) AS o2 FROM candidate_labeling_dataset WHERE {_READY}),
member AS (SELECT text_id, o1, o2, 'source_type' AS c, source_type AS v FROM ready UNION ALL SELECT text_id, o1, o2, 'aspect', aspect FROM ready),
bucket AS (SELECT c, v, list(text_id ORDER BY o1, o2, text_id) AS ids, row_number() OVER (ORDER BY count(*), c, v) AS seq FROM member GROUP BY c, v),
pick(seq, taken, own) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL SELECT b.seq, list_concat(p.taken, list_slice(list_filter(b.ids, lambda x: NOT list_contains(p.taken, x)), 1, 10)), list_slice(list_filter(b.ids, lambda x: NOT list_contains(p.taken, x)), 1, 10)
  FROM pick p JOIN bucket b ON b.seq = p.seq + 1)
SELECT unnest(own) AS text_id, c AS labeling_bucket_column, v AS labeling_bucket_value FROM pick JOIN bucket USING (seq)""",
    "sentence_spans": f"""WITH RECURSIVE flat AS (SELECT DISTINCT text_id, {_squeeze("coalesce(text, '')")} AS t FROM candidate_labeling_dataset),
mark AS (SELECT text_id, t, i, substr(t, i, 1) AS c, substr(t, i + 1, 1) AS nxt, lower(substr(t, greatest(1, i - 24), least(24, i - 1)) || '.' || substr(t, i + 1, 23)) AS around,
  rtrim(lower(coalesce(string_split(trim(substr(t, 1, i - 1)), ' ')[-1], '')), '.') AS word FROM (SELECT text_id, t, unnest(list_filter(range(1, length(t) + 1), lambda j: substr(t, j, 1) IN ('.', '!', '?', ';'))) AS i FROM flat)),
stop AS (SELECT text_id, list(i ORDER BY i) AS ends FROM mark WHERE nxt IN ('', ' ', '"', '\'\'', ')', ']', '}}')
  AND (c <> '.' OR (NOT regexp_matches(around, 'www\\.|http://|https://|\\.com|\\.co\\.|\\.go\\.|\\.id|@') AND word NOT IN ({", ".join(repr(x) for x in sorted(ABBREVIATIONS))}))) GROUP BY text_id),
cuts AS (SELECT text_id, t, coalesce(ends, CAST([] AS BIGINT[])) AS e FROM flat LEFT JOIN stop USING (text_id) WHERE t <> ''),
rough AS (SELECT text_id, list_filter(list_transform(range(1, len(e) + 2), lambda k: trim(substr(t, CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END, CASE WHEN k > len(e) THEN length(t) ELSE e[k] - CASE WHEN k = 1 THEN 0 ELSE e[k - 1] END END))), lambda x: x <> '') AS r FROM cuts),
merged(text_id, k, held, done) AS (SELECT text_id, 0, '', CAST([] AS VARCHAR[]) FROM rough
  UNION ALL SELECT text_id, k + 1, CASE WHEN length(h) >= {SPAN_MIN} THEN '' ELSE h END, CASE WHEN length(h) >= {SPAN_MIN} THEN list_append(done, h) ELSE done END
  FROM (SELECT m.text_id, k, done, CASE WHEN held = '' THEN r[k + 1] ELSE held || ' ' || r[k + 1] END AS h FROM merged m JOIN rough USING (text_id) WHERE k < len(r))),
whole AS (SELECT text_id, CASE WHEN held = '' THEN done WHEN len(done) = 0 THEN [held] ELSE list_append(done[1:len(done) - 1], done[len(done)] || ' ' || held) END AS spans FROM merged JOIN rough USING (text_id) WHERE k = len(r)),
piece(text_id, n, out, rest) AS (SELECT text_id, k, CAST(NULL AS VARCHAR), spans[k] FROM (SELECT text_id, spans, unnest(range(1, len(spans) + 1)) AS k FROM whole)
  UNION ALL SELECT text_id, n, trim(substr(rest, 1, at_char)), trim(substr(rest, at_char + 1)) FROM (SELECT *, {_CUT_AT} AS at_char FROM piece WHERE length(rest) > {SPAN_MAX})),
parts AS (SELECT text_id, out AS x FROM piece WHERE out <> '' UNION ALL SELECT text_id, rest FROM piece WHERE length(rest) <= {SPAN_MAX} AND rest <> ''),
sized AS (SELECT text_id, count(*) AS n, max(length(x)) AS longest FROM parts GROUP BY text_id)
SELECT CAST(n AS INTEGER) AS sentence_count, CAST(sum(n) AS BIGINT) AS jumlah, max(longest) AS longest FROM sized GROUP BY n""",
}

_S = _url("source_url")
_URL_TITLE = f"""{_squeeze("regexp_replace(array_to_string(CASE WHEN len(p) > 2 THEN p[len(p) - 1:] ELSE p END, ' '), '[_-]+', ' ', 'g')")}"""
_SEGMENTS = ", ".join(_squeeze(f"coalesce({c}, '')") for c in ("content_title", "raw_title", "snippet", "content_description", "url_title", "content_text"))


def _has(c: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{t}')" for t in terms) + ")"


ORACLES |= {
    "candidate_building": f"""WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY record_id) AS nth FROM url_discovery) WHERE nth = 1 OR NOT {_filled("canonical_url")}),
a AS (SELECT *, coalesce(nullif({_strip("canonical_url")}, ''), nullif({_strip("url")}, ''), '') AS source_url FROM one),
b AS (SELECT *, list_filter(list_transform(string_split({_S["path"]}, '/'), lambda x: {_strip("x")}), lambda x: x <> '') AS p, concat_ws(' ', coalesce(domain, ''), source_url) AS place FROM a),
c AS (SELECT *, [{_SEGMENTS}] AS seg FROM (SELECT *, {_URL_TITLE} AS url_title FROM b)),
d AS (SELECT record_id, place, source_url, coalesce(query, '') AS q, coalesce(content_status = 'success', false) AND {_filled("content_text")} AS ok,
  array_to_string(list_filter(seg, lambda x, i: x <> '' AND NOT list_contains(list_transform(seg[1:i - 1], lambda y: lower(y)), lower(x))), ' ') AS text FROM c),
g AS (SELECT DISTINCT lower({_strip("name")}) AS alias FROM gazetteer WHERE {_filled("name")}),
l AS (SELECT record_id, bool_or(regexp_matches(lower(text), {_PLACE}) OR regexp_matches(lower(q), {_PLACE}) OR regexp_matches(lower(source_url), {_PLACE})) AS found FROM d CROSS JOIN g GROUP BY record_id),
f AS (SELECT d.*, found, {_has("place", "toko")} AS excluded, {_has("place", "forum")} AS social, {_has("source_url || ' ' || text", "surya", "listrik", "panel")} AS relevant, {_first_group("text")} AS aspect FROM d JOIN l USING (record_id)),
r AS (SELECT CASE WHEN NOT ok OR excluded THEN 'C_holdout_excluded' WHEN relevant AND NOT social THEN 'A_candidate_core' ELSE 'B_review_queue' END AS dataset_tier,
  CASE WHEN social THEN 'social_media' WHEN {_has("place", "repository", "journal", "researchgate", "ac.id")} THEN 'academic_repository' WHEN {_has("place", "go.id", "pln.co.id")} THEN 'government_official'
    WHEN {_has("place", "company", "corporate")} THEN 'corporate_official' ELSE 'online_news' END AS source_type, aspect,
  coalesce(nullif(concat_ws('; ', CASE WHEN NOT ok THEN 'content_not_success' END, CASE WHEN NOT relevant THEN 'keyword_relevance_needs_review' END, CASE WHEN social THEN 'social_domain_review' END,
    CASE WHEN excluded THEN 'excluded_domain' END), ''), 'candidate_from_raw_discovery') AS decision_note,
  round(least(0.35::DOUBLE * ok::INT + 0.25::DOUBLE * relevant::INT + 0.2::DOUBLE * found::INT + 0.1::DOUBLE * (length(text) >= 80)::INT + 0.1::DOUBLE * (NOT social AND NOT excluded)::INT, 1.0), 2) AS support FROM f)
SELECT dataset_tier, source_type, aspect, decision_note, count(*) AS jumlah, round(avg(support), 4) AS mean_support FROM r GROUP BY 1, 2, 3, 4""",
    "url_exact": f"SELECT record_id, {_U['normal']} AS normal FROM url_discovery",
}
ORACLES["csv_round_trip"] = "SELECT record_id, md5(content_text) AS digest, http_status FROM url_discovery WHERE content_text IS NOT NULL AND content_text <> ''"
