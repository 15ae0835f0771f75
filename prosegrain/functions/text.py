"""Tokens, n-grams, sentences and counts as Column expressions.

Every function is built from native expressions, so a query over them stays in
the JVM and needs no shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that are never terms and never open or close a phrase.
STOPWORDS = """a an and are as at be but by for from has have i if in into is it its
me my no not of on or our ours so that the their them they this to was we were what when
which who will with you your yours he she his her had do does did been than then there
these those can could would should may might must shall about above after again all am
any because before below between both down during each few further here how just more
most only other out over own same some such too under until up very while""".split()
TOKEN = r"[a-z][a-z0-9'\-]+"
SHORTCODE = r":[a-z0-9_+'\-]+:"
WORD = r"[A-Za-z0-9][A-Za-z0-9'\-_/.]*"
PLAIN_WORD = r"[A-Za-z0-9][A-Za-z0-9'\-]*"
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n{2,}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
PROSE_SENTENCE_END = r"(?U)(?<=[.!?])[\"')\]]*\s+(?=[A-Z0-9\"'(])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where the body uses it inside a lambda."""
    return F.transform(F.array(value), lambda x: body(x)).getItem(0)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def normalise_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def lenient(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are left out, and replacement characters that the text has itself stay.

    All steps work on bytes: a text's own replacement characters are set aside, so that only those that stand for bad
    bytes go.
    """
    aside, bad = "\ue000", "\ufffd"
    swap = lambda c, *pairs: c if not pairs else swap(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:])
    raw = content.cast("string")
    clean = swap(F.make_valid_utf8(swap(raw, (aside, aside + "a"), (bad, aside + "b"))), (bad, ""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(swap(clean, (aside + "b", bad), (aside + "a", aside)))


def tokenize(text: Column) -> Column:
    """Lower-case tokens of two characters or more, emoji shortcodes left out; null gives no token."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SHORTCODE, " ")
    return F.regexp_extract_all(cleaned, F.lit(TOKEN), F.lit(0))


def is_stopword(word: Column) -> Column:
    return word.isin(STOPWORDS)


def content_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_stopword(t))


def phrases(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens that neither open nor close on a stopword."""

    def runs(w: Column) -> Column:
        starts = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda t, i: F.when(~is_stopword(t) & ~is_stopword(F.get(w, i + (n - 1))), F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))
        return F.array_compact(starts)

    return let(tokens, runs)


def grams(tokens: Column, n_max: int = 3) -> Column:
    """Content words, then phrases of 2 to ``n_max`` tokens."""
    return let(tokens, lambda w: F.concat(content_words(w), *[phrases(w, n) for n in range(2, n_max + 1)]))


def has_digit(term: Column) -> Column:
    return term.rlike(r"(?U)\d")


def sentence_words(text: Column) -> Column:
    """Words of one sentence, a hyphenated compound counting as one."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def plain_words(text: Column) -> Column:
    """Words as calibration counts them."""
    return F.size(F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0)))


def scored_sentences(text: Column) -> Column:
    """Pieces between sentence ends or blank lines that hold three tokens or more."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: F.size(tokenize(s)) >= 3)


def prose_sentences(text: Column) -> Column:
    """Sentences of three words or more; a sentence opens on a capital, a digit, a quote or a bracket."""
    return F.filter(F.transform(F.split(text, PROSE_SENTENCE_END, -1), strip), lambda s: sentence_words(s) >= 3)


def one_line(text: Column, limit: int = 80) -> Column:
    return F.regexp_replace(F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, limit), r"(?U)\s+\z", "")


def number_text(v: Column) -> Column:
    """0 as ``0``, below ten with up to two decimals, else with one."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), r"\.$", "")
    return F.when(v == 0, F.lit("0")).when(v < 10, short).otherwise(F.format_string("%.1f", v))


def split_text(text: Column, mode: str) -> Column:
    """Pieces of a document: the whole (``none``), by blank lines (``blank``), or by lines (``line``); blank pieces go."""
    if mode not in ("none", "blank", "line"):
        raise ValueError(f"unknown split: {mode}")
    pieces = F.array(text) if mode == "none" else F.split(text, r"(?U)\n\s*\n" if mode == "blank" else LINE_END, -1)
    return F.filter(pieces, lambda p: p.rlike(r"(?U)\S"))
