"""Secret scan through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams. The index
holds, for the trigrams that any rule asks for, the keys of the texts they
occur in; a rule's candidates are the intersection of its clauses' postings.
Only candidates run the rule's regular expression. A rule whose expression has
no mandatory trigram (a bare run of hex digits) is run on every text.

DataFrame functions only. Equal texts share a key, so copies cost one posting
each; the join that brings the candidates back is left to the planner, which
splits a key that holds many rows.

Clauses and rules are counted in words of WORD bits, so there may be any number
of them. A private key is followed over up to 200 stretches of hyphens and 16
header lines: beyond them the span ends where its lines or words of base64 do.

Defined cases: a null text is empty and has no finding; repeated rows each get
their findings; an empty table gives an empty result; other columns than id and
text are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import running
from .common import let, need, unpacked, with_row
from .trigram_query import trigram_query


class Rule(NamedTuple):
    kind: str
    regex: str
    #: Group that must have ``least`` characters or the match is dropped; 0: the whole match.
    group: int = 0
    least: int = 1
    #: Another expression with the same matches that are kept, quicker to run.
    scan: str = ""


BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
#: A private key runs from its BEGIN line to its END line, over headers and body; where END is missing, to the last
#: line that is all base64, or, indented or on one line, to the last 40 characters of base64 and one short piece more.
#: A BEGIN line alone is found too. Loops are over single characters or bounded: Java keeps a frame for others.
_NAME = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_TO_END = r"[^-]*(?:-[^-]+){0,200}-{5,6}END " + _NAME
_HEADERS = r"(?:\r?\n[A-Za-z][A-Za-z-]*:\x20[^\n]*){0,16}"
_LINES = r"[\x20\t\r]*\n[A-Za-z0-9+/=\r\n]*[A-Za-z0-9+/=](?m:$)"
_WORDS = r"[A-Za-z0-9+/=\s\\]*[A-Za-z0-9+/=]{40}(?:\s+(?:[A-Za-z0-9+/]+={1,2}|[A-Za-z0-9+/=]+(?m:$)))?"
PRIVATE_KEY = r"-----BEGIN " + _NAME + "(?:" + _TO_END + "|" + _HEADERS + "(?:" + _LINES + "|" + _WORDS + "))?"
#: Fixed formats that issuers publish for their keys.
MORE = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Bits of a whole number that are used.
WORD = 62
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, stop, kind) in code points, failing ones dropped."""
    # The pieces between matches and the matches themselves give the places by their lengths.
    regex = rule.scan or rule.regex
    between = F.split(text, regex, -1)
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    held = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group))
    pieces = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), held.alias("held"))

    def place(x: Column, stop: Column) -> Column:
        good = F.length(x["held"]) >= rule.least
        return F.struct(good.alias("good"), (stop - F.length(x["hit"])).alias("start"), stop.alias("stop"))

    def places(p: Column) -> Column:
        stops = running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        every = let(stops, lambda e: F.transform(p, lambda x, i: place(x, F.get(e, i))))
        kept = F.filter(every, lambda x: x["good"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(rule.kind).alias("kind"))).cast(SPAN)

    return let(pieces, lambda p: F.when(F.size(p) == 0, F.array().cast(SPAN)).otherwise(places(p)))


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of ``docs`` (key, text) for the given trigrams; matched in lower case."""
    low = F.lower(F.col("text"))
    there = let(low, lambda t: F.filter(F.array(*[F.lit(x) for x in trigrams]), lambda x: F.contains(t, x)))
    return docs.select("key", F.explode(there).alias("trigram"))


def candidates(docs: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, mask): bit k % WORD of number k // WORD of the mask says that rule k's query holds for the text."""
    spark = docs.sparkSession
    rows = [(k, c, t) for k, clauses in queries.items() for c, clause in enumerate(clauses) for t in sorted(clause)]
    if not rows:
        return docs.sparkSession.createDataFrame([], "key binary, mask array<long>")
    clauses = spark.createDataFrame(rows, "rule int, clause int, trigram string")  # fixed by the rules
    words, out = -(-max(map(len, queries.values())) // WORD), -(-(max(queries) + 1) // WORD)
    full = lambda n: [(1 << min(WORD, max(0, n - WORD * w))) - 1 for w in range(words)]
    need_all = F.create_map(*[x for k, q in queries.items() for x in (F.lit(k), F.array(*[F.lit(n).cast("long") for n in full(len(q))]))])
    bit = lambda place, w: F.expr(f"if({place} div {WORD} = {w}, shiftleft(1L, cast({place} % {WORD} as int)), 0L)")
    postings = index(docs, sorted({t for *_, t in rows}))
    met = postings.join(F.broadcast(clauses), "trigram").groupBy("key", "rule").agg(*[F.bit_or(bit("clause", w)).alias(f"m{w}") for w in range(words)])
    whole = met.where(F.array(*[F.col(f"m{w}") for w in range(words)]) == F.element_at(need_all, F.col("rule")))
    held = whole.groupBy("key").agg(*[F.bit_or(bit("rule", w)).alias(f"r{w}") for w in range(out)])
    return held.select("key", F.array(*[f"r{w}" for w in range(out)]).alias("mask"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, whole: bool = False) -> DataFrame:
    """One row a document: id and ``found``, its spans by start, then by the rules' order.

    With ``whole``, the document is there as struct ``row``, its columns by place, instead of its id.
    """
    named = with_row(docs, text=text_col) if whole else need(docs, id_col, text_col).toDF("row", "text")
    rows = named.select("row", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.unhex(F.md5("text")))
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex))}
    hits = candidates(keyed, queries).withColumnRenamed("key", "of")
    joined = keyed.join(hits, F.col("key") == F.col("of"), "left")
    asked = lambda k: F.coalesce(F.get("mask", F.lit(k // WORD)).bitwiseAND(F.lit(1 << k % WORD).cast("long")) != 0, F.lit(False)) if k in queries else F.lit(True)
    none = F.array().cast(SPAN)
    found = [F.when(asked(k), spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    return joined.select(F.col("row").alias("row" if whole else id_col), F.array_sort(F.concat(*found)).alias("found"))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span of ``found`` replaced by ``<kind>``; of overlapping spans the first one's name stays."""

    def add(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by its kind; the length column follows the text, other columns stay."""
    found = secret_scan(docs, id_col, text_col, rules, whole=True)
    old = lambda name: F.col("row")[f"c{docs.columns.index(name)}"]
    out = found.select("row", redact(old(text_col), F.col("found")).alias("text"), (F.size("found") > 0).alias("changed"))
    new = {text_col: F.col("text")}
    if length_col in docs.columns:
        kind = docs.schema.fields[docs.columns.index(length_col)].dataType
        new[length_col] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(old(length_col))
    return unpacked(out, docs, new)
