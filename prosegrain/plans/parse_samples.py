"""A fixed token table over whole documents, and the parse rules over it in SQL.

No parser is at hand where the queries are held against SQL, so words get their
part of speech, their dependency and their head from their digests: every word
and sentence of the table takes part, and both engines make the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import running
from ..functions.text import let
from ..operators import parse_rules as P

PIECE = r"[A-Za-z]+|[.!?]|\n"
#: The k-th match has k marks before it.
SENTENCE = r"[^.!?]*[.!?]|[^.!?]+"
#: By the first two digits of a word's digest, below the number: what the word is replaced by, so that every rule has words to look for.
WORDS = [(6, "have"), (10, "had"), (16, "you"), (22, "we"), (30, "should"), (36, "must")]
#: By the third digit, up to the number: part of speech and tag.
TAGS = [(5, "NOUN", "NN"), (6, "PROPN", "NNP"), (8, "VERB", "VB"), (9, "VERB", "VBG"), (10, "VERB", "VBN"), (11, "AUX", "VB"), (15, "X", "XX")]
#: By the fourth: dependency.
DEPS = [(1, "nsubj"), (2, "nsubjpass"), (3, "auxpass"), (5, "conj"), (7, "aux"), (8, "expl"), (15, "dep")]


def _by(number: Column, table: list, place: int, size: int = 16) -> Column:
    """The entry of the first row whose bound ``number`` (under ``size``) does not pass, as one look into an array."""
    return F.get(F.array(*[F.lit(next((row[place] for row in table if n <= row[0]), None)).cast("string") for n in range(size)]), number)


def _pieces(docs: DataFrame) -> DataFrame:
    """(path, sent, first, text_line, ws): a row a sentence, its words, marks and line ends as ``ws``, made in the document's row."""
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE), F.lit(0))
    each = F.transform(cut, lambda s: F.regexp_extract_all(s, F.lit(PIECE), F.lit(0)))

    def placed(all_: Column) -> Column:
        size, ends = F.transform(all_, F.size), F.transform(all_, lambda ws: F.size(F.filter(ws, lambda w: w == "\n")))
        return let(running(size), lambda n: let(running(ends), lambda m: F.transform(all_, lambda ws, k: F.struct((F.get(n, k) - F.size(ws)).alias("first"), (F.coalesce(F.get(m, k - 1), F.lit(0)) + 1).alias("text_line"), ws.alias("ws")))))

    found = docs.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(let(each, placed)).alias("sent", "x"))
    return found.select("path", "sent", "x.*").where(F.size("ws") > 0)


def _tokens(*more: str) -> Column:
    """The array of a sentence's tokens, out of the columns of :func:`_pieces`; ``more``: ``line`` and ``chunk``."""
    n, first = F.size("ws"), F.col("first")
    root = (first + F.conv(F.substring(F.md5(F.concat_ws(":", "path", F.col("sent").cast("string"))), 1, 4), 16, 10).cast("int") % n).cast("int")

    def token(w: Column, k: Column, root: Column, lines: Column | None) -> Column:
        def made(h: Column) -> Column:
            digits = lambda at, many=1: F.shiftright(h, 4 * (10 - at - many)).bitwiseAND((1 << 4 * many) - 1).cast("int")
            i, at = (first + k).cast("int"), (first + digits(5, 4) % n).cast("int")
            space, punct = w == "\n", w.isin(".", "!", "?")
            other = lambda value, a, b: F.when(space, a).when(punct, b).otherwise(value)
            fields = {
                "i": i, "text": other(F.coalesce(_by(digits(1, 2), [(k - 1, w) for k, w in WORDS], 1, 256), w), w, w),
                "pos": other(_by(digits(3), TAGS, 1), "SPACE", "PUNCT"), "tag": other(_by(digits(3), TAGS, 2), "_SP", "."),
                "dep": F.when(i == root, "ROOT").otherwise(_by(digits(4), DEPS, 1)), "head": F.when((at == i) | (i == root), root).otherwise(at), "is_space": space, "is_punct": punct,
            }
            if more:
                fields |= {"line": (F.col("text_line") + F.get(lines, k) - space.cast("int")).cast("int"), "chunk": F.when(digits(9) >= 3, F.floor(i / 9).cast("int"))}
            return F.struct(*[c.alias(name) for name, c in fields.items()])

        return let(F.conv(F.substring(F.md5(F.lower(w)), 1, 9), 16, 10).cast("long"), made)

    lines = running(F.transform("ws", lambda w: (w == "\n").cast("int"))) if more else F.lit(None).cast("array<int>")
    return let(root, lambda r: let(lines, lambda m: F.transform("ws", lambda w, k: token(w, k, r, m))))


def sentence_table(docs: DataFrame) -> DataFrame:
    """``parse_rules.SENTENCES`` for documents (doc_id, text): a row a sentence with its tokens, made in the document's row."""
    return _pieces(docs).select("path", "sent", "text_line", F.array_join("ws", " ").alias("sent_text"), _tokens().alias("tokens"))


def token_table(docs: DataFrame) -> DataFrame:
    """``parse_rules.TOKENS`` for documents (doc_id, text): words, marks that end a sentence, and line ends. A sentence's text is on its first token."""
    rows = _pieces(docs).select("path", "sent", "text_line", "first", F.array_join("ws", " ").alias("said"), F.inline(_tokens("line", "chunk")))
    names = [c.split()[0] for c in P.TOKENS.split(", ")]
    return rows.withColumn("sent_text", F.when(F.col("i") == F.col("first"), F.col("said"))).select(*names)


def item_table(tokens: DataFrame) -> DataFrame:
    """The sentences of a token table, or of a table of sentences, as items, each with a line of its own."""
    return tokens.withColumn("text_line", F.col("sent"))


def _cases(number: str, table: list, place: int) -> str:
    return "CASE " + " ".join(f"WHEN {number} <= {row[0]} THEN '{row[place]}'" for row in table) + " END"


def _sql_digit(digest: str, at: int, n: int = 1) -> str:
    return f"('0x' || substr({digest}, {at}, {n}))::INTEGER"


def _one_line(text: str) -> str:
    return f"rtrim(left(trim(regexp_replace({text}, '\\s+', ' ', 'g')), 80))"


TOKENS_SQL = f"""ws AS (SELECT doc_id::VARCHAR AS path, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[.!?]|\\n') AS ws FROM documents),
pieces AS (SELECT path, (i - 1)::INTEGER AS i, w, w = chr(10) AS is_space, w IN ('.', '!', '?') AS is_punct, md5(lower(w)) AS h FROM (SELECT path, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws)),
counted AS (SELECT *, count(*) FILTER (is_punct) OVER b AS sent, 1 + count(*) FILTER (is_space) OVER b AS line FROM pieces WINDOW b AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
whole AS (SELECT path, sent, min(i) AS first, count(*) AS n, min(line) AS text_line, string_agg(w, ' ' ORDER BY i) AS sent_text FROM counted GROUP BY ALL),
placed AS (SELECT *, (first + {_sql_digit("md5(path || ':' || sent)", 1, 4)} % n) AS root, (first + {_sql_digit('h', 5, 4)} % n) AS spot FROM counted JOIN whole USING (path, sent)),
tokens AS (SELECT path, text_line, sent, sent_text, i, line, is_space, is_punct, CASE WHEN is_space OR is_punct THEN w ELSE coalesce({_cases(_sql_digit('h', 1, 2), [(k - 1, w) for k, w in WORDS], 1)}, w) END AS text,
 CASE WHEN is_space THEN 'SPACE' WHEN is_punct THEN 'PUNCT' ELSE {_cases(_sql_digit('h', 3), TAGS, 1)} END AS pos, CASE WHEN is_space THEN '_SP' WHEN is_punct THEN '.' ELSE {_cases(_sql_digit('h', 3), TAGS, 2)} END AS tag,
 CASE WHEN i = root THEN 'ROOT' ELSE {_cases(_sql_digit('h', 4), DEPS, 1)} END AS dep, CASE WHEN spot = i OR i = root THEN root ELSE spot END AS head, CASE WHEN {_sql_digit('h', 9)} >= 3 THEN i // 9 END AS chunk FROM placed),
roots AS (SELECT path, sent, i AS r, text AS r_text, pos AS r_pos, tag AS r_tag FROM tokens WHERE head = i),
sents AS (SELECT t.path, t.sent, any_value(sent_text) AS sent_text, any_value(text_line) AS line, any_value(r) AS r, any_value(r_text) AS r_text, any_value(r_tag) AS r_tag,
 any_value(r_pos) IN ('VERB', 'AUX') AND any_value(r_tag) = 'VB' AND count(*) FILTER (dep IN ('nsubj', 'nsubjpass', 'expl') AND head = r) = 0 AS imperative FROM tokens t JOIN roots USING (path, sent) GROUP BY t.path, t.sent HAVING count(*) FILTER (NOT is_space AND NOT is_punct) >= 3)"""
_FOUND = "path, line::INTEGER AS line, '{rule}' AS rule, {label} AS label, {match} AS match, {fix} AS fix"


def _rule(rule: str, label: str, match: str, source: str, fix: str = "NULL::VARCHAR") -> str:
    return f"WITH {TOKENS_SQL} SELECT {_FOUND.format(rule=rule, label=label, match=match, fix=fix)} FROM {source}"


_SENT = _one_line("sent_text")
_LISTED = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
RULES_SQL = {
    "T-M1": _rule("T-M1", "n || '-word ' || CASE WHEN imperative THEN 'instruction' ELSE 'description' END || ', limit ' || CASE WHEN imperative THEN 20 ELSE 25 END", _SENT, "(SELECT *, len(regexp_extract_all(sent_text, '[A-Za-z0-9][A-Za-z0-9''\\-_/.]*')) AS n FROM sents) WHERE n > CASE WHEN imperative THEN 20 ELSE 25 END"),
    "T-M2": _rule("T-M2", "(len(more) + 1) || ' instructions (' || r_text || ', ' || array_to_string(more, ', ') || ')'", _SENT, "(SELECT s.path, s.sent, any_value(s.line) AS line, any_value(s.sent_text) AS sent_text, any_value(r_text) AS r_text, list(t.text ORDER BY t.i) AS more FROM sents s JOIN tokens t ON t.path = s.path AND t.sent = s.sent AND t.dep = 'conj' AND t.tag = 'VB' AND t.head = s.r WHERE imperative GROUP BY s.path, s.sent)"),
    "T-M4": _rule("T-M4", "'perfect tense (' || x.have || ' ' || x.done || ')'", _SENT, f"""(SELECT s.*, x FROM sents s JOIN (SELECT path, sent, min_by(struct_pack(have := text, done := CASE WHEN t1 = 'VBN' THEN w1 WHEN t2 = 'VBN' THEN w2 ELSE w3 END), i) AS x FROM
 (SELECT *, lead(tag, 1) OVER o AS t1, lead(text, 1) OVER o AS w1, lead(tag, 2) OVER o AS t2, lead(text, 2) OVER o AS w2, lead(tag, 3) OVER o AS t3, lead(text, 3) OVER o AS w3 FROM tokens WINDOW o AS (PARTITION BY path, sent ORDER BY i))
 WHERE lower(text) IN {_LISTED(P.HAVE)} AND pos IN ('AUX', 'VERB') AND (t1 = 'VBN' OR t2 = 'VBN' OR t3 = 'VBN') GROUP BY path, sent) y USING (path, sent))"""),
    "T-M5": _rule("T-M5", "'-ing main verb (' || r_text || ')'", _SENT, "sents WHERE r_tag = 'VBG'"),
    "T-M7": _rule("T-M7", "n || ' nouns in a row'", "words", """(SELECT path, best.n AS n, best.line AS line, best.words AS words FROM (SELECT path, chunk, max_by(struct_pack(n := n, line := line, words := words), struct_pack(n := n, f := -first)) AS best FROM (SELECT path, chunk, count(*) AS n, min(i) AS first, min_by(line, i) AS line, string_agg(text, ' ' ORDER BY i) AS words FROM
 (SELECT *, spot - row_number() OVER (PARTITION BY path, chunk ORDER BY i) AS island FROM (SELECT *, row_number() OVER (PARTITION BY path, chunk ORDER BY i) AS spot FROM tokens WHERE chunk IS NOT NULL) WHERE pos IN ('NOUN', 'PROPN')) GROUP BY path, chunk, island HAVING count(*) > 3) GROUP BY path, chunk))"""),
    "T-M10": _rule("T-M10", "'non-imperative instruction (' || s.text || ' ' || m.text || ')'", "regexp_replace(left(s.sent_text, 70), '^\\s+|\\s+$', '', 'g')", f"""(SELECT path, sent AS line, any_value(s) AS s, min(m) AS m, any_value(h) AS h FROM (SELECT a.path, a.sent, a.s, struct_pack(i := b.i, text := b.text) AS m, c.text AS h
 FROM (SELECT path, sent, min_by(struct_pack(text := text, head := head, sent_text := sent_text), i) AS s FROM tokens WHERE dep = 'nsubj' AND lower(text) IN ('you', 'we') GROUP BY path, sent) a JOIN tokens b ON b.path = a.path AND b.sent = a.sent AND b.head = a.s.head AND b.dep IN ('aux', 'auxpass') AND lower(b.text) IN {_LISTED(P.MODALS)}
 JOIN tokens c ON c.path = a.path AND c.sent = a.sent AND c.i = a.s.head) GROUP BY path, sent)""", "upper(left(h, 1)) || lower(substr(h, 2)) || ' ...'"),
    "W-M11": _rule("W-M11", "'passive clause (' || h || ')'", _SENT, "(SELECT s.*, t.text AS h FROM sents s JOIN (SELECT path, sent, min_by(head, i) AS of FROM tokens WHERE dep IN ('nsubjpass', 'auxpass') GROUP BY path, sent) f USING (path, sent) JOIN tokens t ON t.path = s.path AND t.sent = s.sent AND t.i = f.of)"),
}
