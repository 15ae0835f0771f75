"""Mechanical writing rules: text in, line-numbered findings out.

A rule is a builder of a Column: an array of (rule, line, label, match, fix).
The rules asked for are put side by side over one scan of the documents and
exploded once; there is no shuffle before the final sort. Each rule has a second
Column for the number of its findings alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import list_items, paragraphs
from ..functions.spans import find_all, newlines, snippet, strip_code
from ..functions.text import let, one_line, prose_sentences, strip

FINDING = "array<struct<rule:string,line:int,label:string,match:string,fix:string>>"

# Phrases and words the rules look for (regular expressions, read without regard to case).
ASSISTANT = ["certainly", "i'?d be happy to", "great question", "happy to help", "i hope this helps", "let me know if you have any questions", "don'?t hesitate", "i'?m excited to share", "thrilled to", "in summary", "to recap"]
REGISTER = ["delve", "tapestry", "seamless(?:ly)?", "robust", "cutting-edge", "best-in-class", "world-class", "leverag(?:e|ed|es|ing)", "utiliz(?:e|ed|es|ing|ation)", "unlock", "synerg(?:y|ies)", "passionate", "spearhead(?:ed|ing)?", "thought leader", "comprehensive"]
HEDGE = ["seemed worth (?:flagging|looking)", "for what it'?s worth", "just my two cents", "no urgency from me", "may or may not be useful", "i believe", "i feel that"]
OPENER = ["i'?ve been meaning to", "i am writing to", "i wanted to reach out", "as an ai", "in this (?:document|doc|post)", "this (?:document|doc) (?:will|aims)"]
IDIOM = ["touch(?:ing|ed)? base", "moving forward", "paint(?:s|ed|ing)? a picture", "circl(?:e|ing|ed) back", "deep div(?:e|ing)", "low-hanging fruit", "at the end of the day", "on the same page", "hit the ground running", "mov(?:e|es|ed|ing) the needle", "boil the ocean", "double(?:d)? down", "in the weeds", "heavy lifting", "apples to apples", "under the hood", "out of the box", "table stakes", "north star", "game changer"]
INVERSION = {
    "inverted construction": r"\b(?:it'?s|that'?s|this is|isn'?t|is not|not)\b[^.!?\n]{2,60}?,\s*(?:it'?s|its|it is)\b",
    "not-only construction": r"\bnot (?:just|only|about)\b[^.!?\n]{2,60}?,?\s*(?:but|it'?s)\b",
}
PROCESS = {
    "ticket id": r"(?:#\d+|\b(?:JIRA|LINEAR|GH|CE|EXEC|FLEX)-\d+)",
    "process reference": r"\b(?:slice|sprint|phase|milestone) \d",
    "document pointer": r"\b(?:per the (?:PRD|spec|object map|retro)|acceptance criteri|decision log)",
    "change narration": r"\b(?:this change (?:adds|makes)|now reads)\b",
}
APPROVED_WORDS = {"commenc(?:e|es|ed|ing|ement)": "start", "perform(?:s|ed|ing)?": "do", "utiliz(?:e|es|ed|ing|ation)": "use", "indicat(?:e|es|ed|ing)": "show", "approximately": "about"}
JOINER = r"(?iU),\s*then\s|\band then\b|\band also\b|;\s"
LATE_CONDITION = r"(?iU)^[A-Z][^.!?\n]{3,}?,\s*(?:if|when|unless)\b"
CLUSTERS = {"emoji cluster": r"(?U)(?:[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}]\s*){2,}", "exclamation cluster": r"(?U)!\s*!+"}
INVISIBLE = "\u2060\u2060|\u200b\u2060"
INPUT_FIELDS = ["content", "surface", "destination_type", "channel_id", "audience", "intent"]
SHORT_NAMES = {"evo-modeler": "modeler", "evo-b-gate": "b-gate", "evo-hydra-lib": "hydralib"}


class Context(NamedTuple):
    """What a rule may look at besides the text."""

    raw: Column
    fields: Mapping[str, str] = {}
    short_names: Mapping[str, str] = SHORT_NAMES


def any_of(words: list[str], close: bool = True) -> str:
    return r"(?iU)\b(?:" + "|".join(words) + ")" + (r"\b" if close else "")


def findings(found: Column, rule: str, label: str | Callable[[Column], Column], match: Callable[[Column], Column], fix: Callable[[Column], Column] | str | None = None) -> Column:
    def one(x: Column) -> Column:
        name = F.lit(label) if isinstance(label, str) else label(x)
        better = F.lit(fix) if fix is None or isinstance(fix, str) else fix(x)
        return F.struct(F.lit(rule).alias("rule"), x["line"].alias("line"), name.alias("label"), match(x).alias("match"), better.cast("string").alias("fix"))

    return F.transform(found, one).cast(FINDING)


def scan(body: Column, regex: str, rule: str, label: str, width: int = 0, fix: str | None = None) -> Column:
    return findings(find_all(body, regex), rule, label, lambda x: snippet(body, x["start"], x["stop"], width), fix)


def dash_places(body: Column, regex: str = "[—–]") -> Column:
    """Em and en dashes; an en dash between numbers is a range and passes."""

    def is_range(x: Column) -> Column:
        left = F.substr(body, F.greatest(x["start"] - 12, F.lit(0)) + 1, F.least(x["start"], F.lit(12)))
        return (x["hit"] == "–") & left.rlike(r"(?U)\d[\d,]*\s*\z") & F.substr(body, x["stop"] + 1, F.lit(12)).rlike(r"(?U)^\s*\d")

    return F.filter(find_all(body, regex), lambda x: ~is_range(x))


def dashes(body: Column, ctx: Context) -> Column:
    return findings(dash_places(body), "W-M1", lambda x: F.when(x["hit"] == "—", "em dash").otherwise("en dash"), lambda x: snippet(body, x["start"], x["stop"], 16))


def opens_idly(head: Column) -> Column:
    return head.rlike(r"(?iU)^\s*(?:" + "|".join(OPENER) + ")")


def opener(body: Column, ctx: Context) -> Column:
    """The first line that is not blank opens with a phrase that says nothing."""
    blank = F.regexp_extract(body, r"(?U)^(\s*)", 1)
    head = F.regexp_extract(body, r"(?U)^\s*(\S[^\n]*)", 1)
    hit = opens_idly(head)
    line = F.array(F.struct((newlines(blank) + 1).cast("int").alias("line"), head.alias("head")))
    return F.when(hit, findings(line, "W-M7", "throat-clearing opener", lambda x: strip(F.substring(x["head"], 1, 60)))).otherwise(F.array().cast(FINDING))


def long_ones(body: Column) -> Column:
    return F.filter(paragraphs(body), lambda p: F.size(prose_sentences(p["text"])) > 6)


def long_paragraph(body: Column, ctx: Context) -> Column:
    found = long_ones(body)
    label = lambda x: F.format_string("%d sentences in one paragraph", F.size(prose_sentences(x["text"])))
    return findings(found, "T-M3", label, lambda x: strip(F.substring(x["text"], 1, 60)))


def late_ones(body: Column) -> Column:
    return F.filter(prose_sentences(body), lambda s: s.rlike(LATE_CONDITION))


def late_condition(body: Column, ctx: Context) -> Column:
    found = late_ones(body)
    lines = F.transform(found, lambda s: F.struct((newlines(F.substr(body, F.lit(1), F.greatest(F.instr(body, s) - 1, F.lit(0)))) + 1).cast("int").alias("line"), s.alias("s")))
    return findings(lines, "T-M11", "condition after the first clause", lambda x: F.regexp_replace(F.regexp_extract(x["s"], LATE_CONDITION, 0), r"(?U)\s+", " "))


def joined_items(body: Column) -> Column:
    return F.filter(list_items(body), lambda x: x["ordered"] & x["body"].rlike(JOINER))


def two_actions(body: Column, ctx: Context) -> Column:
    found = joined_items(body)
    return findings(found, "T-M12", "two actions in one item", lambda x: strip(F.substring(x["body"], 1, 70)))


def long_names(ctx: Context) -> str:
    return r"(?iU)\b(?:" + "|".join(re.escape(n) for n in ctx.short_names) + r")\b"


def short_names(body: Column, ctx: Context) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ctx.short_names.items() for x in pair])
    return findings(find_all(body, long_names(ctx)), "P-M1", "short name", lambda x: x["hit"], lambda x: F.element_at(names, F.lower(x["hit"])))


def input_contract(body: Column, ctx: Context) -> Column:
    given = {"content": strip(body)} | {k: strip(F.lit(v)) for k, v in ctx.fields.items()}
    missing = F.array_compact(F.array(*[F.when(given.get(f, F.lit("")) == "", F.struct(F.lit(1).alias("line"), F.lit(f).alias("field"))) for f in INPUT_FIELDS]))
    return findings(missing, "P-M5", "missing field", lambda x: x["field"])


def matches(*regexes: str) -> Callable[[Column, Context], Column]:
    """How many matches the expressions have together, without their places."""
    return lambda body, ctx: sum((F.regexp_count(body, F.lit(r)) for r in regexes), F.lit(0))


ALL, TECHNICAL, PERSONAL = ("westinghouse", "technical", "personal"), ("technical",), ("personal",)


class Rule(NamedTuple):
    sets: tuple[str, ...]
    build: Callable[[Column, Context], Column]
    #: The number of findings alone, where no line, label or snippet is wanted.
    count: Callable[[Column, Context], Column]
    needs: str = ""


def scanned(sets: tuple[str, ...], rule: str, patterns: Mapping[str, str]) -> Rule:
    """A rule that is matches of expressions, by label."""
    places = lambda body, ctx: F.concat(*[scan(body, p, rule, label) for label, p in patterns.items()])
    return Rule(sets, places, matches(*patterns.values()))


def unapproved_words(body: Column, ctx: Context) -> Column:
    return F.concat(*[scan(body, any_of([w]), "T-M8", "unapproved word", fix=f) for w, f in APPROVED_WORDS.items()])


RULES: dict[str, Rule] = {
    # Texts without an en dash, which may be a range, need no places.
    "W-M1": Rule(ALL, dashes, lambda body, ctx: F.regexp_count(body, F.lit("—")) + F.when(body.contains("–"), F.size(dash_places(body, "–"))).otherwise(0)),
    "W-M2": scanned(ALL, "W-M2", {k: "(?iU)" + p for k, p in INVERSION.items()}),
    "W-M3": scanned(ALL, "W-M3", {"assistant phrase": any_of(ASSISTANT)}),
    "W-M4": scanned(ALL, "W-M4", {"register word": any_of(REGISTER)}),
    "W-M6": scanned(ALL, "W-M6", {"hedge phrase": any_of(HEDGE)}),
    "W-M7": Rule(ALL, opener, lambda body, ctx: opens_idly(F.regexp_extract(body, r"(?U)^\s*(\S[^\n]*)", 1)).cast("int")),
    "W-M8": scanned(ALL, "W-M8", {k: "(?iU)" + v for k, v in PROCESS.items()}),
    "W-M9": scanned(ALL, "W-M9", CLUSTERS),
    "W-M10": Rule(ALL, lambda body, ctx: F.array().cast(FINDING), lambda body, ctx: F.lit(0), needs="lexicon"),
    "T-M3": Rule(TECHNICAL, long_paragraph, lambda body, ctx: F.size(long_ones(body))),
    "T-M8": Rule(TECHNICAL, unapproved_words, matches(*[any_of([w]) for w in APPROVED_WORDS])),
    "T-M9": scanned(TECHNICAL, "T-M9", {"idiom": any_of(IDIOM)}),
    "T-M11": Rule(TECHNICAL, late_condition, lambda body, ctx: F.size(late_ones(body))),
    "T-M12": Rule(TECHNICAL, two_actions, lambda body, ctx: F.size(joined_items(body))),
    "P-M1": Rule(PERSONAL, short_names, lambda body, ctx: F.regexp_count(body, F.lit(long_names(ctx)))),
    "P-M3": Rule(PERSONAL, lambda body, ctx: scan(ctx.raw, INVISIBLE, "P-M3", "agent watermark"), lambda body, ctx: F.regexp_count(ctx.raw, F.lit(INVISIBLE))),
    "P-M5": Rule(PERSONAL, input_contract, lambda body, ctx: F.size(input_contract(body, ctx)), needs="fields"),
}
PARSED = {"T-M1": TECHNICAL, "T-M2": TECHNICAL, "T-M4": TECHNICAL, "T-M5": TECHNICAL, "T-M7": TECHNICAL, "T-M10": TECHNICAL, "W-M11": TECHNICAL}


def rule_order(rule: str) -> tuple[int, int]:
    return "WTP".index(rule[0]), int(rule[3:])


def select(wanted: str | list[str] | None = None, have_lexicon: bool = False, have_fields: bool = False, have_parser: bool = False) -> tuple[list[str], list[str]]:
    """(rules to run, rules skipped for want of input) for a set's name or a list of ids."""
    known = {**{k: r.sets for k, r in RULES.items()}, **PARSED}
    names = "westinghouse" if wanted is None else wanted
    if isinstance(names, str) and names in ALL:
        ids = [k for k, sets in known.items() if names in sets]
    else:
        ids = [x.strip() for x in (names.split(",") if isinstance(names, str) else names)]
        if unknown := sorted(set(ids) - set(known)):
            raise ValueError(f"unknown rule: {', '.join(unknown)}")
    have = {"": True, "lexicon": have_lexicon, "fields": have_fields}
    run = [k for k in ids if (have[RULES[k].needs] if k in RULES else have_parser)]
    return sorted(run, key=rule_order), sorted(set(ids) - set(run), key=rule_order)


def _bodies(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("raw")).withColumn("body", strip_code(F.col("raw")))


def check(docs: DataFrame, rules: list[str], fields: Mapping[str, str] | None = None, short: Mapping[str, str] = SHORT_NAMES) -> DataFrame:
    """(path, line, rule, label, match, fix) of the text rules over ``docs`` (path, text); not sorted."""
    ids = [r for r in rules if r in RULES]
    if not ids:
        return docs.select("path", F.inline(F.array().cast(FINDING))).select("path", "line", "rule", "label", "match", "fix")
    body, ctx = _bodies(docs, "path"), Context(F.col("raw"), fields or {}, short)
    every = F.concat(*[RULES[r].build(F.col("body"), ctx) for r in ids])
    return body.select("path", F.inline(every)).select("path", "line", "rule", "label", "match", "fix")


def counts(docs: DataFrame, rules: list[str], by: str | None = None, fields: Mapping[str, str] | None = None, short: Mapping[str, str] = SHORT_NAMES) -> DataFrame:
    """(by, rule, findings) of the text rules over ``docs`` (by, text), zero where there is none; without ``by``, of all documents.

    Findings are counted in the row, with no places, snippets or rows of their own; only sums are shuffled.
    """
    ids = [r for r in rules if r in RULES]
    keys = [by] if by else []
    ctx = Context(F.col("raw"), fields or {}, short)
    each = _bodies(docs, *keys).select(*keys, *[RULES[r].count(F.col("body"), ctx).cast("long").alias(f"n{k}") for k, r in enumerate(ids)])
    sums = each.groupBy(*keys).agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(ids))])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"n{k}").alias("findings")) for k, r in enumerate(ids)])
    return sums.select(*keys, F.inline(rows.cast("array<struct<rule:string,findings:bigint>>")))


def sort_findings(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "line", "rule", "match")


def finding_line(found: DataFrame) -> DataFrame:
    """``path:line: [RULE] label: "match" for "fix"``"""
    fix = F.when(F.coalesce(F.col("fix"), F.lit("")) != "", F.format_string(' for "%s"', F.col("fix"))).otherwise("")
    return found.select(F.concat(F.col("path").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit(": ["), "rule", F.lit("] "), "label", F.lit(': "'), "match", F.lit('"'), fix).alias("value"))


def jargon_findings(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Advisory findings: each flagged term of a document at its first place in the text without code, else line 1.

    ``hits``: rows of ``score.jargon_hits`` whose unit is the path.
    """
    body = docs.select("path", F.lower(strip_code(F.coalesce("text", F.lit("")))).alias("body"))
    rows = hits.select(F.col("unit").alias("u"), "term", "n").join(body, F.col("u") == F.col("path"))
    at = F.instr("body", F.col("term"))
    line = F.when(at > 0, newlines(F.substr("body", F.lit(1), at - 1)) + 1).otherwise(1)
    return rows.select("path", line.cast("int").alias("line"), F.lit("W-M10").alias("rule"), F.format_string("jargon term x%d", "n").alias("label"), F.col("term").alias("match"), F.lit(None).cast("string").alias("fix"))
