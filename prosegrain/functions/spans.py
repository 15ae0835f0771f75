"""Matches of regular expressions with their places, and length-preserving blanking.

The pieces between the matches and the matches themselves, laid end to end, are
the text; so lengths give the places, and no marker character is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, one_line

#: Most pieces of a text that are appended one by one.
APPENDED = 64
#: Numbers that are summed one by one.
BLOCK = 16
MATCH = "array<struct<start:int,stop:int,line:int,hit:string>>"
#: A fence opens at the start of a line and closes at the next fence of its kind, else at the end of the text.
FENCE = r"(?smd)^[ \t]*(```+|~~~+).*?(?:\1|\z)"
INLINE = r"`[^`\n]+`"
# Headings, lines under headings, table rows, list markers.
MARKUP = (r"(?md)^[ \t]*#{1,6}[ \t][^\n]*$", r"(?md)^[ \t]*(?:=+|-{3,})[ \t]*$", r"(?md)^[ \t]*\|[^\n]*$", r"(?md)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _pieces(text: Column, regex: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.concat(hits, F.array(F.lit(""))).alias("hit"))


def _doubled(values: Column) -> Column:
    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")

    def add(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda v, i: v + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), steps - 1), values, add)


def running(values: Column) -> Column:
    """Sums of an array of ints from its first element on: appended within blocks of ``BLOCK``, whose totals are summed by
    doubling steps. Neither is the square of the length, and only one element in ``BLOCK`` takes part in the steps."""
    none = F.array().cast("array<int>")

    def block(x: Column) -> Column:
        append = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out"))
        return F.aggregate(x, F.struct(F.lit(0).alias("at"), none.alias("out")), append)

    def joined(blocks: Column) -> Column:
        return let(_doubled(F.transform(blocks, lambda x: x["at"])), lambda t: F.flatten(F.transform(blocks, lambda x, k: F.transform(x["out"], lambda v: v + F.coalesce(F.get(t, k - 1), F.lit(0))))))

    def dealt(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return let(F.transform(starts, lambda k: block(F.slice(v, k, F.lit(BLOCK)))), joined)

    return let(values, dealt)


def find_all(text: Column, regex: str, lined: bool = True) -> Column:
    """Leftmost non-overlapping matches as (start, stop, line, hit): code points from 0, lines from 1, or null unless ``lined``."""
    none, none_yet = F.array().cast(MATCH), F.lit(None).cast("int")

    def add(acc: Column, x: Column) -> Column:
        start, line = acc["at"] + F.length(x["gap"]), acc["line"] + newlines(x["gap"]) if lined else none_yet
        stop = start + F.length(x["hit"])
        found = F.array(F.struct(start.alias("start"), stop.alias("stop"), line.alias("line"), x["hit"].alias("hit"))).cast(MATCH)
        return F.struct(stop.alias("at"), (line + newlines(x["hit"]) if lined else none_yet).alias("line"), F.when(x["hit"] != "", F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def few(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("at"), (F.lit(1) if lined else none_yet).alias("line"), none.alias("out")), add, lambda a: a["out"])

    def many(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        lines = running(F.transform(p, lambda x: newlines(x["gap"]) + newlines(x["hit"]))) if lined else F.array().cast("array<int>")
        placed = let(ends, lambda e: let(lines, lambda n: F.transform(p, lambda x, i: place(x, F.get(e, i), F.get(n, i)))))
        return F.filter(placed, lambda x: x["hit"] != "").cast(MATCH)

    def place(x: Column, stop: Column, n: Column) -> Column:
        return F.struct((stop - F.length(x["hit"])).alias("start"), stop.alias("stop"), (n - newlines(x["hit"]) + 1 if lined else none_yet).alias("line"), x["hit"].alias("hit"))

    pieces = F.transform(_pieces(text, regex), lambda x: F.struct(F.coalesce(x["gap"], F.lit("")).alias("gap"), F.coalesce(x["hit"], F.lit("")).alias("hit")))
    # Both give the same; appending is quicker for a few matches and takes the square of many.
    found = let(pieces, lambda p: F.when(F.size(p) <= APPENDED, few(p)).otherwise(many(p)))
    return F.when(text.rlike(regex), found).otherwise(none)


def map_matches(text: Column, regex: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match replaced by ``change(match)``."""
    done = F.array_join(F.transform(_pieces(text, regex), lambda x: F.concat(x["gap"], F.when(x["hit"] == "", "").otherwise(change(x["hit"])))), "")
    return F.when(text.rlike(regex), done).otherwise(text)


def blank(text: Column) -> Column:
    """As many spaces; line ends stay."""
    return F.regexp_replace(text, r"[^\n]", " ")


def strip_code(text: Column) -> Column:
    """Fenced blocks blanked, inline code as one digit and spaces; the length stays."""
    fenced = F.when(text.contains("```") | text.contains("~~~"), map_matches(text, FENCE, blank)).otherwise(text)
    return let(fenced, lambda t: F.when(t.contains("`"), map_matches(t, INLINE, lambda m: F.rpad(F.lit("0"), F.length(m), F.lit(" ")))).otherwise(t))


def strip_markup(text: Column) -> Column:
    """Headings, lines under headings, table rows and list markers blanked; the length stays."""
    for regex in MARKUP:
        text = let(text, partial(map_matches, regex=regex, change=blank))
    return text


def snippet(text: Column, start: Column, stop: Column, width: int) -> Column:
    """The match with ``width`` characters on both sides, cut to whole words, on one line."""
    if not width:
        return one_line(F.substr(text, start + 1, stop - start), 200)
    low = F.greatest(F.lit(0), start - width)
    high = F.least(F.length(text), stop + width)
    left, right = F.substr(text, low + 1, start - low), F.substr(text, stop + 1, high - stop)
    alnum = r"(?U)[\p{L}\p{N}]"
    left = F.when((low > 0) & F.substr(text, low, F.lit(1)).rlike(alnum), F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.when(high < F.length(text), F.regexp_replace(right, r"[\p{L}\p{N}]+\z", "")).otherwise(right)
    return one_line(F.concat(left, F.substr(text, start + 1, stop - start), right), 200)
