"""SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import license_scan as LS
from . import secret_scan as SS
from .oracle_spelling import SPELLING
from .oracle_trie import TRIE
from .quality_rules import RULES

WS = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FAILS = ", ".join(f"({rule}) AS fail_{name}" for name, rule in RULES.items())
_SUMS = ", ".join(f"count(*) FILTER (fail_{r}) AS k_{r}" for r in RULES)
_TOTALS = ", ".join(f"sum(k_{r})::DOUBLE AS sum_{r}, sum((k_{r} * k_{r})::DOUBLE / n) AS sq_{r}" for r in RULES)
_PRIORS = ", ".join(
    f"sum_{r} / greatest(docs, 1) AS m_{r}, least(greatest((sum_{r} / greatest(docs, 1)) * (1 - sum_{r} / greatest(docs, 1)) / greatest(sq_{r} / greatest(docs, 1) - (sum_{r} / greatest(docs, 1)) * (sum_{r} / greatest(docs, 1)) - (sum_{r} / greatest(docs, 1)) * (1 - sum_{r} / greatest(docs, 1)) * (hosts - 1) / greatest(docs, 1), 1e-9) - 1, 1.0), 1e6) AS s_{r}"
    for r in RULES
)
_RATES = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r})" for r in RULES)
QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, {WORDS.format('t')} AS ws FROM d)),
win AS (SELECT rid, i, w, lead(w, 1) OVER (PARTITION BY rid ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS w3 FROM w),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM win WHERE w3 IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, source, len({WORDS.format('t')})::BIGINT AS n_words, len(regexp_replace(t, '{SPACE_CLASS}+', '', 'g'))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines, len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS own_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_lines - own_lines AS n_dup_lines FROM m), ruled AS (SELECT *, {_FAILS} FROM f),
hosts AS (SELECT source AS host, count(*) AS n, {_SUMS} FROM ruled GROUP BY source), total AS (SELECT sum(n)::DOUBLE AS docs, count(*) AS hosts, {_TOTALS} FROM hosts), prior AS (SELECT {_PRIORS} FROM total),
verdict AS (SELECT host, greatest({_RATES}) > 0.5 AS host_bad FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_short OR fail_repetitive AS base_failed, NOT (fail_short OR fail_repetitive) AND NOT host_bad AS kept, host_bad FROM ruled JOIN verdict ON host IS NOT DISTINCT FROM source"""


def spans(rule: SS.Rule, rank: int) -> str:
    """List of (start, rank, stop, kind) of a rule's matches in ``t``."""
    p = quoted(rule.scan or rule.regex)
    hits, gaps = f"regexp_extract_all(t, {p})", f"regexp_split_to_array(t, {p})"
    held = hits if not rule.group else f"regexp_extract_all(t, {p}, {rule.group})"
    before = f"list_sum(list_transform({gaps}[:k], lambda g: len(g)))::BIGINT + coalesce(list_sum(list_transform({hits}[:k - 1], lambda h: len(h))), 0)::BIGINT"
    each = f"list_transform(list_filter(range(1, len({hits}) + 1), lambda k: len({held}[k]) >= {rule.least}), lambda k: struct_pack(s := {before}, r := {rank}, e := {before} + len({hits}[k]), kind := '{rule.kind}'))"
    return f"(CASE WHEN regexp_matches(t, {p}) THEN {each} ELSE [] END)"


_SPAN = "list_transform({}, lambda x: x.kind || ':' || x.s || ':' || x.e)"
_BASE = len(SS.BASE)
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), each AS (SELECT doc_id, {', '.join(f'{spans(r, k)} AS f{k}' for k, r in enumerate(SS.RULES))} FROM d),
lists AS (SELECT doc_id, {', '.join(f'f{k}' for k in range(_BASE))}, list_sort(flatten([{', '.join(f'f{k}' for k in range(_BASE))}])) AS base, list_sort(flatten([{', '.join(f'f{k}' for k in range(len(SS.RULES)))}])) AS found FROM each)
SELECT doc_id, len(f0)::BIGINT AS n_assign, len(f1)::BIGINT AS n_access, len(f2)::BIGINT AS n_hex, sha256(array_to_string({_SPAN.format('base')}, ',')) AS base_sha256, array_to_string({_SPAN.format('found')}, ',') AS spans FROM lists"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lists AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM d),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM lists),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
linked AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM lists UNION SELECT reach.doc_id, v FROM reach JOIN linked ON u = r)
SELECT l.doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id FROM lists l JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""


def licences() -> str:
    """Sentences as rows, joined with the table of spellings, and put together again."""
    spelled = ", ".join(f"({quoted(s)}, {quoted(k)})" for k, all_ in LS.SENTENCES.items() for s in all_)
    rules = ", ".join(f"({n}, {quoted(r.licence)}, {quoted(LS.rule_regex(r))}, {quoted(r.licence + ':' + '+'.join(r.ids))})" for n, r in enumerate(LS.RULES))
    plain = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    one = "n"
    for pattern, form in LS.SLOTS:
        one = f"regexp_replace({one}, {quoted(pattern)}, {quoted(form.replace('{1}', chr(92) + '1'))})"
    tags = f"list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(string_split(s, {quoted(LS.SPDX)})[-1], {quoted(LS.SPDX_EXCEPTION)}, '', 'g'), {quoted(LS.SPDX_JOINS)}), lambda x: {plain('x')}), lambda x: x <> ''), lambda x: {quoted(LS.TAG.format(''))} || x)"
    chosen = f"list_transform(string_split(substr(n, {len(LS.EITHER_OF) + 1}), {quoted(LS.OR)}), lambda x: 'licensed under the ' || regexp_replace(x, {quoted(LS.OF_CHOICE)}, '', 'g'))"
    lookups = f"CASE WHEN contains(s, {quoted(LS.SPDX)}) THEN {tags} WHEN starts_with(n, {quoted(LS.EITHER_OF)}) THEN {chosen} WHEN contains(n, 'software') THEN [{one}] ELSE [n] END"
    cut_at = lambda way, ends, where: f"SELECT rid, {way} AS way, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT rid, regexp_split_to_array(t, {quoted(ends)}) AS p FROM d WHERE {where})"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), spelled AS (SELECT * FROM (VALUES {spelled}) v(spelling, ident)), rules AS (SELECT * FROM (VALUES {rules}) v(place, licence, pattern, shown)),
s AS ({cut_at(1, LS.ENDS, 'true')} UNION ALL {cut_at(2, LS.WRAPPED_ENDS, f"regexp_matches(lower(t), {quoted(LS.GATE)})")}),
asked AS (SELECT rid, way, i, {lookups} AS wanted FROM (SELECT *, {plain('s')} AS n FROM s WHERE trim(s) <> '')),
found_ids AS (SELECT rid, way, i, string_agg(ident, '+' ORDER BY j) AS ident FROM (SELECT rid, way, i, unnest(wanted) AS spelling, generate_subscripts(wanted, 1) AS j FROM asked) JOIN spelled USING (spelling) GROUP BY ALL),
known AS (SELECT rid, way, i, coalesce(ident, '-') AS ident FROM asked LEFT JOIN found_ids USING (rid, way, i)),
seqs AS (SELECT rid, way, string_agg(ident, ' ' ORDER BY i) AS seq, count(*) AS n, string_agg(ident, ' ' ORDER BY i) FILTER (ident <> '-') AS ids FROM known GROUP BY rid, way),
met AS (SELECT DISTINCT rid, place, licence, shown FROM seqs, rules WHERE ids IS NOT NULL AND regexp_matches(seq, pattern)),
found AS (SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses, string_agg(shown, ',' ORDER BY place) AS rules FROM met GROUP BY rid),
gated AS (SELECT rid, regexp_matches(lower(t), {quoted(LS.GATE)}) AS twice FROM d),
out AS (SELECT d.rid, doc_id, a.n, a.ids AS x, b.ids AS y, twice FROM d JOIN gated USING (rid) LEFT JOIN seqs a ON a.rid = d.rid AND a.way = 1 LEFT JOIN seqs b ON b.rid = d.rid AND b.way = 2)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, CASE WHEN x IS NULL AND y IS NULL THEN '' WHEN twice THEN concat_ws(' ', x, '/', y) ELSE x END AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(rules, '') AS rules FROM out LEFT JOIN found USING (rid)"""


MIXING = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len({WORDS.format('text')})::BIGINT AS size, ('0x' || substr(md5('11:' || coalesce(doc_id || ':', '') || md5(coalesce(text, ''))), 1, 15))::BIGINT AS mixed FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE WHEN source_size > 0 THEN (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 ELSE 0 END AS weight FROM sums),
c AS (SELECT *, 3 * source_size AS cap, CASE WHEN weight > 0 THEN (3 * source_size)::DOUBLE / weight ELSE -1 END AS ratio FROM w),
l AS (SELECT *, 1.0::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining, sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM c),
v AS (SELECT *, CASE WHEN onward > 0 THEN remaining / onward END AS level FROM l),
f AS (SELECT *, min(CASE WHEN cap > weight * coalesce(level, 0) AND weight > 0 THEN struct_pack(a := ratio, b := level) END) OVER () AS final FROM v),
targets AS (SELECT source, source_size, CASE WHEN weight > 0 THEN least(cap::DOUBLE, weight * coalesce(final.b, 'infinity'::DOUBLE)) ELSE 0.0 END::DOUBLE AS target FROM f),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY mixed, doc_id) AS served FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT q.*, e, (e * source_size + served)::DOUBLE / target AS time FROM q, range(3) r(e) WHERE size > 0 AND target > 0),
upto AS (SELECT *, sum(size) OVER (ORDER BY time) AS spent FROM i), ok AS (SELECT rid, count(*)::INTEGER AS epochs FROM upto WHERE spent <= (SELECT sum(size) FROM d) GROUP BY rid)
SELECT doc_id, size, source_size, target, (size * coalesce(epochs, 0))::BIGINT AS taken, source, coalesce(epochs, 0)::INTEGER AS epochs FROM q LEFT JOIN ok USING (rid)"""

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format('text')} AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
firsts AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS k FROM win JOIN firsts USING (w) WHERE first < doc_id),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": QUALITY,
    "op5_secret_scan": SECRETS,
    "op6_jaccard_join": JACCARD,
    "op8_license_scan": licences(),
    "op9_mixing": MIXING,
    "op11_prefix_trie": TRIE,
    "op12_substring_dedup": SUBSTRINGS,
    "op13_spelling": SPELLING,
}
