"""Lines, paragraphs, list items and unwrapping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import running
from .text import LINE_END, let, strip

# What makes a list item, a line of structure, a fence and a line that no other joins; ends of lines.
ITEM = r"(?U)^[ \t]*([-*+]|(\d+)[.)])[ \t]+([^\n]*)$"
STRUCTURE = r"(?U)^[ \t]*(#{1,6}[ \t]|[-*+][ \t]|\d+[.)][ \t]|>|\|)"
PARAGRAPH = "array<struct<line:int,text:string>>"
FENCE_LINE = r"(?U)^\s*(```|~~~)"
BREAKING = r"(?U)^\s*\z|^#{1,6} |^\s*([-*+]|\d+\.) |^\s*\||^\s*>|^\s*[-=]{3,}\s*\z|^<"
LIST_LINE = r"(?U)^\s*([-*+]|\d+\.) "
HASHES = r"(?U)^#{1,6}\s*\z"


def lines(text: Column) -> Column:
    """(line, text) from 1."""
    return F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text")))


def list_items(text: Column) -> Column:
    """(line, ordered, body) of every list item that has a body."""
    item = lambda x: F.struct(x["line"].alias("line"), (F.regexp_extract(x["text"], ITEM, 2) != "").alias("ordered"), strip(F.regexp_extract(x["text"], ITEM, 3)).alias("body"))
    return F.filter(F.transform(F.filter(lines(text), lambda x: x["text"].rlike(ITEM)), item), lambda x: x["body"] != "")


def paragraphs(text: Column) -> Column:
    """(first line, text) of every block of non-blank lines without a heading, item, quote or table line in it."""

    def close(acc: Column) -> Column:
        whole = (F.size(acc["held"]) > 0) & ~acc["structural"]
        return F.when(whole, F.concat(acc["out"], F.array(F.struct(acc["first"].alias("line"), F.array_join(acc["held"], " ").alias("text"))).cast(PARAGRAPH))).otherwise(acc["out"])

    def add(acc: Column, x: Column) -> Column:
        blank_, none = ~x["text"].rlike(r"(?U)\S"), F.size(acc["held"]) == 0
        return F.struct(
            F.when(blank_, close(acc)).otherwise(acc["out"]).alias("out"),
            F.when(blank_, F.array().cast("array<string>")).otherwise(F.concat(acc["held"], F.array(strip(x["text"])))).alias("held"),
            F.when(none, x["line"]).otherwise(acc["first"]).alias("first"),
            F.when(blank_, F.lit(False)).otherwise(acc["structural"] | x["text"].rlike(STRUCTURE)).alias("structural"),
        )

    start = F.struct(F.array().cast(PARAGRAPH).alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("first"), F.lit(False).alias("structural"))
    return let(lines(text), lambda x: F.aggregate(x, start, add, close))


#: Kinds of lines, a letter each: X of the front matter, F opens or closes a fence, L a list item, S another line that
#: stands alone, H number signs only, P any other. Lines of one segment become one line: a list item or other line takes
#: all H and P that follow; number signs take one, which makes a heading of them; fences and front matter stay.
SEGMENT = "X+|F[^F]*F?|[LP][HP]*|H[HP]?|S"


def line_kind(line: Column) -> Column:
    return F.when(line.rlike(FENCE_LINE), "F").when(line.rlike(LIST_LINE), "L").when(line.rlike(BREAKING), "S").when(line.rlike(HASHES), "H").otherwise("P")


def unwrap(text: Column) -> Column:
    """Hard-wrapped Markdown with each paragraph and list item on one line; fences and front matter stay as they are.

    Each line becomes a letter; one expression over the letters finds the
    segments, and their lengths say which lines to join. So a line is looked at
    a fixed number of times, whatever the paragraph's length.
    """
    ended = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    rows = let(ended, lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))

    def segment(ls: Column, token: Column, stop: Column) -> Column:
        n = F.length(token)
        stays = (n == 1) | F.substring(token, 1, 1).isin("X", "F")
        head, rest = F.get(ls, stop - n), F.slice(ls, stop - n + 2, n - 1)
        joined = F.array_join(F.concat(F.array(F.regexp_replace(head, r"(?U)\s+\z", "")), F.transform(rest, strip)), " ")
        return F.when(stays, F.array_join(F.slice(ls, stop - n + 1, n), "\n")).otherwise(joined)

    def fold(ls: Column) -> Column:
        closing = F.array_position(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))), "---")
        front = F.when((strip(F.get(ls, F.lit(0))) == "---") & (closing > 0), closing + 1).otherwise(0).cast("int")
        kinds = F.array_join(F.transform(ls, line_kind), "")
        shape = F.concat(F.repeat(F.lit("X"), front), F.substr(kinds, front + 1))
        tokens = F.regexp_extract_all(shape, F.lit(SEGMENT), F.lit(0))
        stops = let(tokens, lambda t: F.arrays_zip(t.alias("token"), running(F.transform(t, F.length)).alias("stop")))
        return F.array_join(F.transform(stops, lambda x: segment(ls, x["token"], x["stop"])), "\n")

    whole = let(rows, lambda ls: F.when(F.size(ls) == 0, "").otherwise(fold(ls)))
    return F.when(text.isNotNull(), F.concat(whole, F.when(text.endswith("\n"), "\n").otherwise("")))
