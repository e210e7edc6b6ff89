"""The rule engine, topic keywords and sentence spans in SQL, for comparison over whole tables."""

from __future__ import annotations

from .config import CLAUSE_WEIGHTS, TOKEN, WEAK_THRESHOLD
from .operators.lexicon import Rules

_TOKEN = TOKEN.replace("'", "''")
_WORD_CHAR = "[\\pL\\pN_]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rows_of(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(quoted(v) if isinstance(v, str) else 'NULL::DOUBLE' if v is None else f'{v}::DOUBLE' if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)}) AS v({names})"


def _r4(x: str) -> str:
    """To four digits as the binary value has them, not half up."""
    return f"CAST(format('{{:.4f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def token_rows(source: str, low: str, key: str) -> str:
    """CTEs of the tokens of a lower-case text: id, k (from 1), w, a, b (offsets)."""
    return f"""
lows AS (SELECT {key} AS id, {low} AS low FROM {source}),
tok AS (SELECT id, k, w, b - length(w) AS a, b FROM (SELECT *, CAST(sum(length(g) + length(w)) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS b FROM (
  SELECT id, unnest(regexp_split_to_array(low, '{_TOKEN}')[1:len(t)]) AS g, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS k FROM (SELECT id, low, regexp_extract_all(low, '{_TOKEN}') AS t FROM lows))))"""


def places_of(name: str, terms: str, source: str = "lows") -> str:
    """CTE of the occurrences of terms between characters that are no word characters: id, term, a, b."""
    return f"""
{name} AS (SELECT id, term, a, a + length(term) AS b FROM (
  SELECT id, low, term, i, n, CAST(sum(length(piece) + length(term)) OVER (PARTITION BY id, term ORDER BY i) AS BIGINT) - length(term) AS a FROM (
    SELECT id, low, term, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i, len(p) AS n FROM (
      SELECT id, low, term, string_split(low, term) AS p FROM {source} JOIN {terms} ON contains(low, term))))
  WHERE i < n AND (a = 0 OR NOT regexp_matches(substr(low, a, 1), '{_WORD_CHAR}')) AND NOT regexp_matches(substr(low, a + length(term) + 1, 1), '{_WORD_CHAR}'))"""


def engine(source: str, text: str, key: str, rules: Rules) -> str:
    """CTEs up to `ruled`: id, rule_label, rule_score, rule_status, rule_hits, rule_explanation of each row of source."""
    phrases = [(p, k, *rules.phrases[p][:2]) for k, p in enumerate(sorted(rules.phrases, key=len, reverse=True))]
    words = [(w, *r[:2]) for w, r in rules.words.items()]
    marks = [(t, k, *CLAUSE_WEIGHTS[e]) for k, (t, e) in enumerate(rules.contrasts)]
    near = "(SELECT {pick} FROM tok t JOIN {table} n ON n.term = t.w WHERE t.id = h.id AND t.k BETWEEN h.first_k - {reach} AND h.first_k - 1{more})"
    return f"""{token_rows(source, f"lower(coalesce({text}, ''))", key)},
phrase_rule AS (SELECT * FROM {rows_of(phrases, "term, rank, label, weight")}), word_rule AS (SELECT * FROM {rows_of(words, "term, label, weight")}),
neg AS (SELECT * FROM {rows_of([(t, n) for t, n in rules.negations.items()], "term, scope")}), block AS (SELECT * FROM {rows_of([(t, n) for t, n in rules.blockers.items()], "term, scope")}),
mult AS (SELECT * FROM {rows_of([(t, float(x)) for t, x in rules.multipliers.items()], "term, factor")}), mark_rule AS (SELECT * FROM {rows_of(marks, "term, rank, before, after")}),
{places_of("said", "phrase_rule").strip()},{places_of("marked", "mark_rule")},
cand AS (SELECT s.id, s.term, s.a, s.b, rank, label, weight FROM said s JOIN phrase_rule USING (term)),
taken AS (SELECT c.*, (SELECT min(k) FROM tok t WHERE t.id = c.id AND t.a >= c.a AND t.b <= c.b) AS first_k, (SELECT max(k) FROM tok t WHERE t.id = c.id AND t.a >= c.a AND t.b <= c.b) AS last_k
  FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.id = c.id AND o.rank < c.rank AND c.a < o.b AND o.a < c.b)),
hit0 AS (
  SELECT id, 'phrase' AS source, term, label, weight, a, b, first_k, last_k, 0 AS kind, rank FROM taken WHERE first_k IS NOT NULL
  UNION ALL SELECT t.id, 'word', t.w, label, weight, t.a, t.b, t.k, t.k, 1, 0 FROM tok t JOIN word_rule r ON r.term = t.w
    WHERE label <> 'netral' AND NOT EXISTS (SELECT 1 FROM taken p WHERE p.id = t.id AND p.a <= t.a AND t.b <= p.b)),
clause0 AS (SELECT id, CAST(0 AS BIGINT) AS pos, -1 AS rank, CAST(0 AS BIGINT) AS a, 0 AS o, 1.0::DOUBLE AS w FROM lows
  UNION ALL SELECT id, 0, rank, a, 0, before FROM marked JOIN mark_rule USING (term) WHERE before IS NOT NULL UNION ALL SELECT id, b, rank, a, 1, after FROM marked JOIN mark_rule USING (term)),
clause AS (SELECT *, pos * 1000000 + row_number() OVER (PARTITION BY id ORDER BY rank, a, o) AS place FROM clause0),
hit1 AS (SELECT h.*, {near.format(pick="arg_max(t.w, t.k)", table="neg", reach=4, more=" AND h.first_k - t.k <= n.scope")} AS neg,
  {near.format(pick="arg_max(t.w, t.k)", table="mult", reach=3, more="")} AS up, {near.format(pick="arg_max(n.factor, t.k)", table="mult", reach=3, more="")} AS up_factor,
  (SELECT max(t.w) FROM tok t JOIN mult n ON n.term = t.w WHERE t.id = h.id AND t.k = h.last_k + 1) AS down, (SELECT max(n.factor) FROM tok t JOIN mult n ON n.term = t.w WHERE t.id = h.id AND t.k = h.last_k + 1) AS down_factor,
  {near.format(pick="arg_max(t.w, t.k)", table="block", reach=4, more=" AND h.first_k - t.k <= n.scope")} AS blocked,
  (SELECT arg_max(c.w, c.place) FROM clause c WHERE c.id = h.id AND c.pos <= h.a) AS clause_weight,
  CASE label WHEN 'positif' THEN weight WHEN 'negatif' THEN -weight ELSE 0.0::DOUBLE END AS s0 FROM hit0 h),
hit2 AS (SELECT *, s0 * (coalesce(up_factor, 1.0::DOUBLE) * coalesce(down_factor, 1.0::DOUBLE)) AS s1 FROM hit1),
hit3 AS (SELECT *, (CASE WHEN neg IN ({", ".join(quoted(t) for t in sorted(rules.shifting))}) AND s1 <> 0 THEN s1 - sign(s1) * {rules.shift}::DOUBLE ELSE s1 END) * clause_weight AS s2 FROM hit2),
hit4 AS (SELECT *, CASE WHEN blocked IS NOT NULL THEN 0.0::DOUBLE ELSE {_r4(f"CASE WHEN s2 < 0 THEN s2 * {rules.negative_weight}::DOUBLE ELSE s2 END")} END AS s3,
  neg IS NOT NULL OR up IS NOT NULL OR down IS NOT NULL AS changed, row_number() OVER (PARTITION BY id ORDER BY kind, rank, a) AS hn FROM hit3),
hit5 AS (SELECT *, row_number() OVER (PARTITION BY id, source, term, s3 <> 0 AND NOT changed ORDER BY a, b) AS n FROM hit4),
hit AS (SELECT *, CASE WHEN s3 <> 0 AND NOT changed AND n > 1 THEN {_r4(f"s3 * {_r4('1.0 / n')}")} ELSE s3 END AS score FROM hit5),
modifier AS (SELECT id, term, min(place) AS place FROM (SELECT id, neg AS term, hn * 4 AS place FROM hit UNION ALL SELECT id, up, hn * 4 + 1 FROM hit UNION ALL SELECT id, down, hn * 4 + 2 FROM hit) WHERE term IS NOT NULL GROUP BY id, term),
told AS (SELECT id, string_agg(term, ', ' ORDER BY place) AS modifiers FROM modifier GROUP BY id),
summed AS (SELECT id, {_r4("coalesce(sum(score) FILTER (score > 0), 0)")} AS pos, {_r4("abs(coalesce(sum(score) FILTER (score < 0), 0))")} AS neg, count(*) FILTER (score <> 0) AS counted,
  string_agg(term, ', ' ORDER BY hn) AS hits, string_agg(term, ', ' ORDER BY hn) FILTER (kind = 0) AS by_phrase, string_agg(term, ', ' ORDER BY hn) FILTER (kind = 1) AS by_word FROM hit GROUP BY id),
scored AS (SELECT l.id, coalesce(pos, 0.0) AS pos, coalesce(neg, 0.0) AS neg, {_r4("coalesce(pos, 0.0) - coalesce(neg, 0.0)")} AS rule_score, coalesce(counted, 0) AS counted, coalesce(hits, '') AS rule_hits, by_phrase, by_word, modifiers
  FROM lows l LEFT JOIN summed s ON s.id = l.id LEFT JOIN told t ON t.id = l.id),
named AS (SELECT *, CASE WHEN rule_score > 0.15 THEN 'positif' WHEN rule_score < -0.15 THEN 'negatif' ELSE 'netral' END AS rule_label,
  CASE WHEN counted = 0 THEN 'unknown' WHEN {_r4(f"least(abs(rule_score) / {rules.max_abs}, 1.0)")} < {WEAK_THRESHOLD} THEN 'weak' ELSE 'detected' END AS rule_status FROM scored),
ruled AS (SELECT id, rule_label, rule_score, rule_status, rule_hits, CASE WHEN rule_status = 'unknown' THEN 'Tidak ada rule sentimen yang dihitung.' ELSE
  format('Label {{}} ({{}}) dari skor SO {{:.4f}}; positif={{:.4f}}, negatif={{:.4f}}; {{}}.', rule_label, rule_status, rule_score, pos, neg,
    coalesce(nullif(concat_ws('; ', 'frasa: ' || by_phrase, 'kata: ' || by_word, 'modifier: ' || modifiers), ''), 'tanpa evidence detail')) END AS rule_explanation FROM named)"""


def keyword_ranks(source: str, text: str, label: str, rules: Rules, top: int) -> str:
    """CTEs up to `ranked`: keyword, sentiment_label, source, category, weight, frequency, document_frequency, rank."""
    dim = [(t, s, r[0], r[2], float(r[1])) for s, entries in (("phrase", rules.phrases), ("word", rules.words)) for t, r in entries.items()]
    order = "source, document_frequency DESC, frequency DESC, len(string_split(keyword, ' ')) DESC, keyword"
    return f"""
own AS (SELECT row_number() OVER () AS id, {label} AS label, lower(regexp_replace(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS low FROM {source}),
dim AS (SELECT * FROM {rows_of(dim, "term, source, label, category, weight")}),{places_of("said", "(SELECT DISTINCT term FROM dim) AS t", "own")},
n AS (SELECT said.id, said.term, count(*) AS n FROM said GROUP BY said.id, said.term),
counted AS (SELECT d.term AS keyword, d.label AS sentiment_label, d.source, d.category, d.weight, CAST(sum(n) AS BIGINT) AS frequency, count(*) AS document_frequency
  FROM n JOIN own USING (id) JOIN dim d ON d.term = n.term AND d.label = own.label GROUP BY ALL),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY {order}) AS k FROM counted WHERE source = 'phrase') WHERE k <= {top}),
used AS (SELECT DISTINCT sentiment_label, unnest(string_split(keyword, ' ')) AS keyword FROM first),
both_kinds AS (SELECT * EXCLUDE (k) FROM first UNION ALL SELECT * FROM counted c WHERE source = 'word' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.sentiment_label = c.sentiment_label AND u.keyword = c.keyword)),
ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sentiment_label ORDER BY {order}) AS INTEGER) AS rank FROM both_kinds) WHERE rank <= {top})"""
