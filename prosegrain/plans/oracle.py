"""The registered queries in SQL that another engine can run on the same tables."""

from __future__ import annotations

from ..functions import blocks
from ..functions.text import STOPWORDS
from ..operators import rules as R
from .samples import DECORATED_SQL

STOP = "(" + ", ".join("'" + w + "'" for w in STOPWORDS) + ")"
NL = "chr(10)"


def tokens(text: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower(coalesce({text}, '')), ':[a-z0-9_+''\\-]+:', ' ', 'g'), '[a-z][a-z0-9''\\-]+')"


def tok(table: str = "documents", unit: str = "doc_id", text: str = "text", extra: str = "") -> str:
    return f"tok AS (SELECT {unit} AS unit, {tokens(text)} AS toks{extra} FROM {table}), long AS (SELECT * EXCLUDE (toks), unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM tok)"


def grams(keys: str = "unit", extra: str = "") -> str:
    return f"""win AS (SELECT *, lead(w, 1) OVER (PARTITION BY {keys} ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY {keys} ORDER BY i) AS w3 FROM long),
grams AS (SELECT {keys}{extra}, w AS term, 1 AS size FROM win WHERE w NOT IN {STOP}
 UNION ALL SELECT {keys}{extra}, w || ' ' || w2, 2 FROM win WHERE w2 IS NOT NULL AND w NOT IN {STOP} AND w2 NOT IN {STOP}
 UNION ALL SELECT {keys}{extra}, w || ' ' || w2 || ' ' || w3, 3 FROM win WHERE w3 IS NOT NULL AND w NOT IN {STOP} AND w3 NOT IN {STOP})"""


SIDE = ", CASE WHEN lang = 'en' THEN 'approved' ELSE 'contrast' END AS side"
LEXICON = f"""{tok(extra=SIDE)}, {grams(extra=', side')},
lens AS (SELECT side, len(toks) AS n, row_number() OVER (PARTITION BY side ORDER BY len(toks)) AS r, count(*) OVER (PARTITION BY side) AS c FROM tok),
stats AS (SELECT side, count(*) AS docs, sum(n)::BIGINT AS tokens, max(n) FILTER (r = c // 2 + 1)::BIGINT AS median_tokens FROM lens GROUP BY side),
one AS (SELECT max(docs) FILTER (side = 'approved') AS a_docs, max(tokens) FILTER (side = 'approved') AS a_n, max(median_tokens) FILTER (side = 'approved') AS a_med,
 max(docs) FILTER (side = 'contrast') AS c_docs, max(tokens) FILTER (side = 'contrast') AS c_n, max(median_tokens) FILTER (side = 'contrast') AS c_med FROM stats),
bars AS (SELECT *, round_even(greatest(greatest(0.015::DOUBLE, least(0.10::DOUBLE, 0.10::DOUBLE * c_med / 250)), 8::DOUBLE / c_docs), 4) AS low,
 round_even(greatest(greatest(0.01::DOUBLE, least(0.05::DOUBLE, 0.05::DOUBLE * a_med / 250)), 3::DOUBLE / a_docs), 4) AS high FROM one),
by_doc AS (SELECT unit, side, term, count(*) AS n FROM grams GROUP BY ALL),
counts AS MATERIALIZED (SELECT term, coalesce(sum(n) FILTER (side = 'approved'), 0)::BIGINT AS a_tf, count(*) FILTER (side = 'approved') AS a_df, coalesce(sum(n) FILTER (side = 'contrast'), 0)::BIGINT AS c_tf, count(*) FILTER (side = 'contrast') AS c_df FROM by_doc GROUP BY term),
approved AS MATERIALIZED (SELECT term, a_tf AS approved_count, round_even(a_df::DOUBLE / a_docs, 4)::DOUBLE AS approved_doc_share FROM counts, bars WHERE a_tf >= 3 AND a_df >= 2),
keyed AS (SELECT *, 2 * (CASE WHEN c_tf > 0 THEN c_tf * ln(c_tf / (c_n * (c_tf + a_tf)::DOUBLE / (c_n + a_n))) ELSE 0 END + CASE WHEN a_tf > 0 THEN a_tf * ln(a_tf / (a_n * (c_tf + a_tf)::DOUBLE / (c_n + a_n))) ELSE 0 END) AS ll,
 log2(((CASE WHEN c_tf > 0 THEN c_tf ELSE 0.5 END)::DOUBLE / c_n) / ((CASE WHEN a_tf > 0 THEN a_tf ELSE 0.5 END)::DOUBLE / a_n)) AS lr, c_df::DOUBLE / c_docs AS share_c, a_df::DOUBLE / a_docs AS share_a FROM counts, bars),
jargon AS (SELECT term, c_tf AS contrast_count, a_tf AS approved_count, round_even(ll, 2)::DOUBLE AS log_likelihood, round_even(lr, 2)::DOUBLE AS log_ratio, round_even(share_c, 4)::DOUBLE AS contrast_doc_share, round_even(share_a, 4)::DOUBLE AS approved_doc_share, 0.0::DOUBLE AS zipf_en
 FROM keyed WHERE c_tf >= 5 AND share_c >= low AND share_a <= high AND ll >= 15.13 AND lr >= 2.0)"""
#: Hits of every unit's terms against the lexicon.
HITS = f"""hits AS (SELECT g.unit, g.term, g.size, count(*) AS n, any_value(j.term) IS NOT NULL AS is_jargon, any_value(a.term) IS NOT NULL AS is_approved, any_value(j.log_ratio) AS log_ratio FROM grams g LEFT JOIN jargon j ON g.term = j.term LEFT JOIN approved a ON g.term = a.term GROUP BY g.unit, g.term, g.size),
classed AS (SELECT *, CASE WHEN is_jargon THEN 'jargon' WHEN is_approved OR regexp_matches(term, '\\d') THEN NULL WHEN size = 1 THEN 'unapproved_unigram' WHEN size = 2 THEN 'unapproved_bigram' END AS class FROM hits)"""
SCORES = f"""contents AS (SELECT unit, len(toks)::BIGINT AS tokens, len(list_filter(toks, lambda t: t NOT IN {STOP}))::BIGINT AS content_words FROM tok),
sums AS (SELECT unit AS u, coalesce(sum(n) FILTER (class = 'jargon'), 0)::BIGINT AS jargon_hits, coalesce(sum(n) FILTER (class = 'unapproved_unigram'), 0)::BIGINT AS unapproved_unigram_hits, coalesce(sum(n) FILTER (class = 'unapproved_bigram'), 0)::BIGINT AS unapproved_bigram_hits, coalesce(sum(n) FILTER (size = 1 AND is_approved), 0)::BIGINT AS covered FROM classed GROUP BY unit),
raw AS (SELECT unit, tokens, content_words, coalesce(jargon_hits, 0) AS jargon_hits, coalesce(unapproved_unigram_hits, 0) AS unapproved_unigram_hits, coalesce(unapproved_bigram_hits, 0) AS unapproved_bigram_hits, coalesce(covered, 0) AS covered FROM contents LEFT JOIN sums ON unit = u),
scores AS (SELECT *, round_even(1000::DOUBLE / greatest(content_words, 1) * jargon_hits, 2)::DOUBLE AS jargon_density_per_1k, round_even(1000::DOUBLE / greatest(content_words, 1) * unapproved_unigram_hits, 2)::DOUBLE AS unapproved_unigram_density_per_1k,
 round_even(1000::DOUBLE / greatest(content_words, 1) * unapproved_bigram_hits, 2)::DOUBLE AS unapproved_bigram_density_per_1k, round_even(covered::DOUBLE / greatest(content_words, 1), 4)::DOUBLE AS approved_coverage FROM raw)"""
SCORED = f"{LEXICON}, {HITS}, {SCORES}"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapped(text: str, pattern: str, change: str) -> str:
    """SQL for ``text`` with each match m of the pattern replaced by ``change`` (an expression of m)."""
    p = _lit(pattern)
    return f"(CASE WHEN regexp_matches({text}, {p}) THEN array_to_string(list_transform(range(1, len(regexp_extract_all({text}, {p})) + 2), lambda k: regexp_split_to_array({text}, {p})[k] || CASE WHEN k <= len(regexp_extract_all({text}, {p})) THEN list_transform([regexp_extract_all({text}, {p})[k]], lambda m: {change})[1] ELSE '' END), '') ELSE {text} END)"


BLANK = "regexp_replace(m, '[^\\n]', ' ', 'g')"
#: A stretch of Latin-1 letters counts as word characters, as it does for readers of Unicode.
LETTERS = "[À-ÖØ-öø-ÿ]"
BODY = f"""{DECORATED_SQL}, unfenced AS (SELECT path, text, lang, source, {mapped('text', '(?sm)^[ \\t]*(?:```.*?(?:```|\\z)|~~~.*?(?:~~~|\\z))', BLANK)} AS t FROM decorated),
bodies AS (SELECT path, text AS raw, lang, source, {mapped('t', '`[^`\\n]+`', "rpad('0', len(m)::INTEGER, ' ')")} AS body FROM unfenced)"""


def scan(source: str, pattern: str, rule: str, label: str, fix: str = "NULL", column: str = "body") -> str:
    """SQL rows (path, line, rule, label, match, fix) of a pattern's matches in ``column`` of ``source``."""
    p = _lit("(" + pattern + ")")
    return f"""SELECT path, (1 + len(before) - len(replace(before, {NL}, '')))::INTEGER AS line, '{rule}' AS rule, '{label}' AS label, regexp_replace(trim(regexp_replace(substr(b, len(before) + 1, len(hit)), '\\s+', ' ', 'g')), '\\s+$', '') AS match, {fix}::VARCHAR AS fix FROM (
 SELECT path, b, array_to_string(list_transform(range(1, k + 1), lambda q: gaps[q] || CASE WHEN q < k THEN hits[q] ELSE '' END), '') AS before, hits[k] AS hit FROM (
  SELECT path, {column} AS b, regexp_split_to_array(regexp_replace({column}, '{LETTERS}', '_', 'g'), {p}) AS gaps, regexp_extract_all(regexp_replace({column}, '{LETTERS}', '_', 'g'), {p}) AS hits, unnest(range(1, len(regexp_extract_all(regexp_replace({column}, '{LETTERS}', '_', 'g'), {p})) + 1)) AS k FROM {source}))"""


def words(alternatives: list[str], close: bool = True) -> str:
    return r"(?i)\b(?:" + "|".join(alternatives) + ")" + (r"\b" if close else "")


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


FINDINGS = {
    "W-M2": union(*[scan("bodies", "(?i)" + p, "W-M2", label) for label, p in R.INVERSION.items()]),
    "W-M3": scan("bodies", words(R.ASSISTANT), "W-M3", "assistant phrase"),
    "W-M4": scan("bodies", words(R.REGISTER), "W-M4", "register word"),
    "W-M6": scan("bodies", words(R.HEDGE), "W-M6", "hedge phrase"),
    "W-M8": union(*[scan("bodies", "(?i)" + p, "W-M8", label) for label, p in R.PROCESS.items()]),
    "W-M9": union(*[scan("bodies", p.replace("(?U)", ""), "W-M9", label) for label, p in R.CLUSTERS.items()]),
    "T-M8": union(*[scan("bodies", words([w]), "T-M8", "unapproved word", f"'{f}'") for w, f in R.APPROVED_WORDS.items()]),
    "T-M9": scan("bodies", words(R.IDIOM), "T-M9", "idiom"),
    "P-M3": scan("bodies", R.INVISIBLE, "P-M3", "agent watermark", column="raw"),
}
FINDINGS["W-M1"] = f"""SELECT path, (1 + len(before) - len(replace(before, {NL}, '')))::INTEGER AS line, 'W-M1' AS rule, CASE hit WHEN '—' THEN 'em dash' ELSE 'en dash' END AS label,
 trim(regexp_replace(l || hit || r, '\\s+', ' ', 'g')) AS match, NULL::VARCHAR AS fix FROM (
 SELECT *, CASE WHEN len(before) > 16 AND regexp_matches(substr(body, len(before) - 16, 1), '[\\p{{L}}\\p{{N}}]') THEN regexp_replace(right(before, 16), '^[\\p{{L}}\\p{{N}}]+', '') ELSE right(before, 16) END AS l,
 CASE WHEN len(before) + 17 < len(body) THEN regexp_replace(substr(body, len(before) + 2, 16), '[\\p{{L}}\\p{{N}}]+$', '') ELSE substr(body, len(before) + 2, 16) END AS r FROM (
  SELECT path, body, hits[k] AS hit, array_to_string(list_transform(range(1, k + 1), lambda q: gaps[q] || CASE WHEN q < k THEN hits[q] ELSE '' END), '') AS before FROM (
   SELECT path, body, regexp_split_to_array(body, '[—–]') AS gaps, regexp_extract_all(body, '[—–]') AS hits, unnest(range(1, len(regexp_extract_all(body, '[—–]')) + 1)) AS k FROM bodies)))
 WHERE NOT (hit = '–' AND regexp_matches(right(before, 12), '\\d[\\d,]*\\s*$') AND regexp_matches(substr(body, len(before) + 2, 12), '^\\s*\\d'))"""
FINDINGS["W-M7"] = f"""SELECT path, (1 + len(lead) - len(replace(lead, {NL}, '')))::INTEGER AS line, 'W-M7' AS rule, 'throat-clearing opener' AS label, regexp_replace(substr(head, 1, 60), '\\s+$', '') AS match, NULL::VARCHAR AS fix
 FROM (SELECT path, regexp_extract(body, '^\\s*') AS lead, regexp_extract(body, '\\S[^\\n]*') AS head FROM bodies) WHERE regexp_matches(head, {_lit('(?i)^(?:' + '|'.join(R.OPENER) + ')')})"""
LINES = f"lines AS (SELECT path, unnest(string_split(body, {NL})) AS line_text, generate_subscripts(string_split(body, {NL}), 1) AS line FROM bodies)"
ITEMS = f"""{LINES}, items AS (SELECT path, line::INTEGER AS line, regexp_matches(line_text, '^[ \\t]*\\d') AS ordered, trim(regexp_extract(line_text, '^[ \\t]*(?:[-*+]|\\d+[.)])[ \\t]+(.*)$', 1)) AS body FROM lines WHERE regexp_matches(line_text, '^[ \\t]*(?:[-*+]|\\d+[.)])[ \\t]+(.*)$'))"""
PARAGRAPHS = f"""{LINES}, islands AS (SELECT *, sum(CASE WHEN regexp_matches(line_text, '\\S') THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line) AS island FROM lines),
paras AS (SELECT path, min(line)::INTEGER AS line, string_agg(regexp_replace(regexp_replace(line_text, '^\\s+', ''), '\\s+$', ''), ' ' ORDER BY line) AS text FROM islands WHERE regexp_matches(line_text, '\\S') GROUP BY path, island
 HAVING NOT bool_or(regexp_matches(line_text, '^[ \\t]*(#{{1,6}}[ \\t]|[-*+][ \\t]|\\d+[.)][ \\t]|>|\\|)')))"""
TRIMMED = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
#: Sentences: a mark of its own is put behind each end, which this dialect cannot look behind for.
SENTENCES_B = f"""marked AS (SELECT path, line, string_split(regexp_replace(text, '([.!?])["'')\\]]*\\s+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM paras),
sents AS (SELECT path, line, list_filter(list_transform(parts, lambda s: {TRIMMED.format('s')}), lambda s: len(regexp_extract_all(s, '[A-Za-z0-9][A-Za-z0-9''\\-_/.]*')) >= 3) AS sents FROM marked)"""
T_M3 = f"SELECT p.path, p.line, 'T-M3' AS rule, len(sents) || ' sentences in one paragraph' AS label, trim(substr(text, 1, 60)) AS match, NULL::VARCHAR AS fix FROM paras p JOIN sents s ON p.path = s.path AND p.line = s.line WHERE len(sents) > 6"
T_M11 = f"""SELECT path, (1 + len(before) - len(replace(before, {NL}, '')))::INTEGER AS line, 'T-M11' AS rule, 'condition after the first clause' AS label, regexp_replace(regexp_extract(s, {_lit(R.LATE_CONDITION.replace('(?iU)', '(?i)'))}), '\\s+', ' ', 'g') AS match, NULL::VARCHAR AS fix FROM (
 SELECT path, s, substr(body, 1, strpos(body, s) - 1) AS before FROM (SELECT path, body, unnest(list_filter(list_transform(string_split(regexp_replace(body, '([.!?])["'')\\]]*\\s+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {TRIMMED.format('s')}), lambda s: len(regexp_extract_all(s, '[A-Za-z0-9][A-Za-z0-9''\\-_/.]*')) >= 3)) AS s FROM bodies))
 WHERE regexp_matches(s, {_lit(R.LATE_CONDITION.replace('(?iU)', '(?i)'))})"""
#: Advisory findings: terms of the lexicon in the decorated documents.
W_M10 = f"""dtok AS (SELECT path AS unit, {tokens('raw')} AS toks FROM bodies), dlong AS (SELECT unit, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM dtok), {grams().replace('win', 'dwin').replace('grams AS', 'dgrams AS').replace('FROM long', 'FROM dlong')},
found AS (SELECT unit, term, count(*) AS n FROM dgrams WHERE term IN (SELECT term FROM jargon) GROUP BY unit, term)
SELECT path, CASE WHEN strpos(lower(body), term) > 0 THEN 1 + len(substr(lower(body), 1, strpos(lower(body), term) - 1)) - len(replace(substr(lower(body), 1, strpos(lower(body), term) - 1), {NL}, '')) ELSE 1 END::INTEGER AS line, 'W-M10' AS rule, 'jargon term x' || n AS label, term AS match, NULL::VARCHAR AS fix FROM found JOIN bodies ON path = unit"""
T_M12 = "SELECT path, line, 'T-M12' AS rule, 'two actions in one item' AS label, trim(substr(body, 1, 70)) AS match, NULL::VARCHAR AS fix FROM items WHERE ordered AND regexp_matches(body, '(?i),\\s*then\\s|\\band then\\b|\\band also\\b|;\\s')"
P_M5 = "SELECT path, 1 AS line, 'P-M5' AS rule, 'missing field' AS label, field AS match, NULL::VARCHAR AS fix FROM bodies, (VALUES ('content'), ('surface'), ('destination_type'), ('channel_id'), ('audience'), ('intent')) f(field) WHERE field NOT IN ('surface', 'audience') AND (field <> 'content' OR NOT regexp_matches(body, '\\S'))"
P_M1 = scan("bodies", r"(?i)\bevo-(?:modeler|b-gate|hydra-lib)\b", "P-M1", "short name").replace("NULL::VARCHAR AS fix", "CASE lower(hit) WHEN 'evo-modeler' THEN 'modeler' WHEN 'evo-b-gate' THEN 'b-gate' ELSE 'hydralib' END AS fix")
FIELDS = {"surface": "chat", "audience": "team"}
FINDINGS |= {"T-M3": T_M3, "T-M11": T_M11, "T-M12": T_M12, "P-M1": P_M1, "P-M5": P_M5}
#: Every rule that reads the text alone.
CHECKED = tuple(sorted(FINDINGS, key=R.rule_order))
ALL_FINDINGS = f"{BODY}, {PARAGRAPHS}, {ITEMS.removeprefix(LINES + ', ')}, {SENTENCES_B}, found AS ({union(*[FINDINGS[r] for r in CHECKED])})"
ALL_WORDS = f"words AS (SELECT sum(len({tokens('raw')}))::BIGINT AS words FROM bodies)"

_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(x, '{regex}') THEN '{kind}'" for kind, regex in (("F", r"^\s*(```|~~~)"), ("L", r"^\s*([-*+]|\d+\.) "), ("S", r"^\s*$|^#{1,6} |^\s*\||^\s*>|^\s*[-=]{3,}\s*$|^<"), ("H", r"^#{1,6}\s*$"))) + " ELSE 'P' END"
UNWRAPPED = f"""WITH {DECORATED_SQL}, texts AS (SELECT path, regexp_replace(text, '\\r\\n?', {NL}, 'g') AS t FROM decorated),
pieces AS (SELECT path, t, regexp_split_to_array(t, '{_ENDS}') AS p FROM texts), rows AS (SELECT path, t, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS ls FROM pieces),
kinds AS (SELECT *, CASE WHEN trim(ls[1]) = '---' AND list_contains(ls[2:], '---') THEN list_position(ls[2:], '---') + 1 ELSE 0 END AS front, array_to_string(list_transform(ls, lambda x: {_KIND}), '') AS k FROM rows),
found AS (SELECT path, t, ls, regexp_extract_all(repeat('X', front::INTEGER) || substr(k, front + 1), '{blocks.SEGMENT}') AS toks FROM kinds),
each AS (SELECT path, t, ls, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM found), placed AS (SELECT *, len(tok) AS n, (sum(len(tok)) OVER (PARTITION BY path ORDER BY i))::BIGINT AS stop FROM each),
joined AS (SELECT path, t, i, CASE WHEN n = 1 OR left(tok, 1) IN ('X', 'F') THEN array_to_string(ls[stop - n + 1:stop], {NL}) ELSE regexp_replace(ls[stop - n + 1], '\\s+$', '') || ' ' || array_to_string(list_transform(ls[stop - n + 2:stop], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' ') END AS line FROM placed)
SELECT path, string_agg(line, {NL} ORDER BY i) || CASE WHEN ends_with(any_value(t), {NL}) THEN {NL} ELSE '' END AS text FROM joined GROUP BY path"""

#: Words of the text without code and markup, with the white space before each; places where list items' bodies begin.
STARTS = f"""WITH {BODY}, {{markup}}, cut AS (SELECT path, regexp_extract_all(t, '\\s+|\\S+') AS ps FROM m3), parts AS (SELECT path, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM cut),
spaced AS (SELECT path, k, p, sum(length(p)) OVER (PARTITION BY path ORDER BY k) - length(p) AS idx, lag(p) OVER (PARTITION BY path ORDER BY k) AS gap FROM parts),
words AS (SELECT path, idx, gap, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS i FROM spaced WHERE NOT regexp_matches(p, '^\\s')),
bl AS (SELECT path, string_split(body, {NL}) AS ls FROM bodies), lined AS (SELECT path, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM bl), begun AS (SELECT path, l, sum(length(l) + 1) OVER (PARTITION BY path ORDER BY k) - length(l) - 1 AS spot FROM lined),
items AS (SELECT path, spot + length(regexp_extract(l, '^[ \\t]*(?:[-*+]|\\d+[.)])[ \\t]+')) AS idx FROM begun WHERE regexp_matches(l, '^[ \\t]*(?:[-*+]|\\d+[.)])[ \\t]+\\S'))
SELECT path, i::INTEGER AS i FROM words w WHERE i > 0 AND (regexp_matches(gap, '\\n[ \\t]*\\n') OR EXISTS (FROM items x WHERE x.path = w.path AND x.idx = w.idx))"""
