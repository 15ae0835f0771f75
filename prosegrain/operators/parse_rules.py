"""Rules over a dependency parse, as relations over a table of parsed tokens.

Token table: (path, text_line, sent, sent_text, i, line, text, pos, tag, dep, head, chunk,
is_space, is_punct): ``sent_text`` is the sentence, on its first token at least (on every one it
would take the square of a sentence's length), ``text_line`` its first line, ``line`` the token's,
``head`` the head's ``i``, ``chunk`` the noun chunk or null. ``parse``
makes it with spaCy where that is installed; without it the rules are skipped.

Rules about one sentence look at an array of its tokens, in the row. They take a token table,
which is gathered by one shuffle, or sentences that have their tokens already (``SENTENCES``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import list_items
from ..functions.spans import find_all, strip_code, strip_markup
from ..functions.text import let, one_line, sentence_words, strip

TOKENS = "path string, text_line int, sent int, sent_text string, i int, line int, text string, pos string, tag string, dep string, head int, chunk int, is_space boolean, is_punct boolean"
SENTENCES = "path string, sent int, text_line int, sent_text string, tokens array<struct<i:int,text:string,pos:string,tag:string,dep:string,head:int,is_space:boolean,is_punct:boolean>>"
KEY = ["path", "sent"]
FIELDS = ["i", "text", "pos", "tag", "dep", "head", "is_space", "is_punct"]
# What parts two blocks, a list item's marker, forms of "have", and modal verbs.
BLANK_LINES = r"\n(?:[ \t]*\n)+\s*"
ITEM_MARK = r"(?md)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(?=[^\n])"
HAVE = ["have", "has", "had", "having", "'ve", "'s", "'d"]
MODALS = ["should", "must", "can", "could", "need", "have", "may", "might", "will"]


def available() -> bool:
    try:
        import spacy  # noqa: F401
    except ImportError:
        return False
    return True


def item_texts(docs: DataFrame) -> DataFrame:
    """(path, line, body): the list items of documents (path, text), code blanked, each a text of its own."""
    return docs.select("path", F.inline(list_items(strip_code(F.coalesce("text", F.lit("")))))).select("path", "line", "body")


def breaks(docs: DataFrame) -> DataFrame:
    """(path, at): places, in code points, where a sentence must start: after a blank line, and where a list item's marker ends."""
    coded = strip_code(F.coalesce("text", F.lit("")))
    after = lambda text, regex: F.transform(find_all(text, regex, lined=False), lambda x: x["stop"])
    return docs.select("path", F.explode(F.array_distinct(F.concat(after(strip_markup(coded), BLANK_LINES), after(coded, ITEM_MARK)))).alias("at"))


def sentence_starts(tokens: DataFrame, places: DataFrame) -> DataFrame:
    """(path, i): tokens (path, i, idx, text, is_space) that open a sentence: a place (path, at) lies between the end of the
    last token that is no white space and the token's beginning. A document's first token opens none.

    Places and tokens go through one window, in order of place, so neither side is searched for the other.
    """
    words = tokens.where(~F.col("is_space")).select("path", F.col("idx").alias("at"), "i", (F.col("idx") + F.length("text")).alias("end"))
    both = words.unionByName(places.select("path", "at", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("end")))
    # At one place the break comes before the token.
    order = W.partitionBy("path").orderBy("at", F.col("i").asc_nulls_first())
    seen = both.withColumns({"broken": F.max(F.when(F.col("i").isNull(), F.col("at"))).over(order), "last": F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))})
    return seen.where("i IS NOT NULL AND broken >= last").select("path", "i")


def parse_rows(rows: DataFrame, model: str = "en_core_web_sm") -> DataFrame:
    """Token table of texts (path, line, body, starts): ``line`` is added to a sentence's line, ``starts`` are places where sentences must start.

    ``path`` is a string.
    """

    def run(frames: Iterator) -> Iterator:
        import bisect

        import pandas as pd
        import spacy
        from spacy.language import Language

        @Language.component("sentence_starts")
        def starts(doc):
            end = 0
            for token in doc:
                if not token.is_space:
                    places = doc.user_data["starts"]
                    if end and bisect.bisect_left(places, end) < bisect.bisect_right(places, token.idx):
                        token.is_sent_start = True
                    end = token.idx + len(token.text)
            return doc

        nlp = spacy.load(model, disable=["ner"])
        nlp.add_pipe("sentence_starts", before="parser")
        for frame in frames:
            found = []
            for path, first, body, places in frame.itertuples(index=False):
                doc = nlp.make_doc(body)
                doc.user_data["starts"] = sorted(places)
                for _, pipe in nlp.pipeline:
                    doc = pipe(doc)
                chunk = {t.i: k for k, c in enumerate(doc.noun_chunks) for t in c}
                for k, sent in enumerate(doc.sents):
                    line = doc.text.count("\n", 0, sent.start_char) + first
                    found += [(path, line, k, sent.text if t.i == sent.start else None, t.i, doc.text.count("\n", 0, t.idx) + first, t.text, t.pos_, t.tag_, t.dep_, t.head.i, chunk.get(t.i), t.is_space, t.is_punct) for t in sent]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in TOKENS.split(", ")])

    return rows.select("path", "line", "body", "starts").mapInPandas(run, TOKENS)


def parse(docs: DataFrame, model: str = "en_core_web_sm") -> DataFrame:
    """Token table of ``docs`` (path, text), code and markup blanked. A sentence starts at a blank line and at a list item."""
    none = F.array().cast("array<int>")
    at = breaks(docs).groupBy(F.col("path").alias("of")).agg(F.collect_list("at").alias("starts"))
    bodies = docs.select("path", F.lit(1).alias("line"), strip_markup(strip_code(F.coalesce("text", F.lit("")))).alias("body"))
    return parse_rows(bodies.join(at, F.col("path") == F.col("of"), "left").withColumn("starts", F.coalesce("starts", none)), model)


def parse_items(docs: DataFrame, model: str = "en_core_web_sm") -> DataFrame:
    """Token table of the list items of ``docs``, each parsed alone, for :func:`non_imperative`: ``text_line`` is the item's line
    and ``sent_text`` its body."""
    items = item_texts(docs)
    alone = items.select(F.to_json(F.struct("path", "line")).alias("path"), "line", "body", F.array().cast("array<int>").alias("starts"))
    key = F.from_json("path", "path string, line int")
    found = parse_rows(alone, model).withColumn("key", key).select(F.col("key.path").alias("path"), F.col("key.line").alias("text_line"), *[c.split()[0] for c in TOKENS.split(", ")[2:]])
    bodies = items.select(F.col("path").alias("p"), F.col("line").alias("l"), "body")
    return found.join(bodies, (F.col("path") == F.col("p")) & (F.col("text_line") == F.col("l"))).withColumn("sent_text", F.when(F.col("i") == 0, F.col("body"))).drop("p", "l", "body")


def gathered(tokens: DataFrame, *key: str) -> DataFrame:
    """(path, line, sent_text, tokens) a sentence, or what else ``key`` names: its tokens as an array, by their places.

    A table that has ``tokens`` already, as :data:`SENTENCES`, is taken as it is, so nothing is shuffled.
    """
    if "tokens" in tokens.columns:
        return tokens.select("path", F.col("text_line").alias("line"), "sent_text", "tokens")
    rows = tokens.groupBy(*key).agg(F.first("sent_text", ignorenulls=True).alias("said"), F.first("text_line").alias("line"), F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("tokens"))
    return rows.select("path", "line", F.col("said").alias("sent_text"), "tokens")


def _first(tokens: Column, keep: Callable[[Column], Column]) -> Column:
    """The first token for which ``keep`` holds, or null."""
    return F.get(F.filter(tokens, keep), F.lit(0))


def _found(path: str, line: Column, rule: str, label: Column, match: Column, fix: Column | None = None) -> list[Column]:
    return [F.col(path), line.cast("int").alias("line"), F.lit(rule).alias("rule"), label.alias("label"), match.alias("match"), (F.lit(None) if fix is None else fix).cast("string").alias("fix")]


def _each(rows: DataFrame, hit: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with the fields of ``hit(tokens)``, where it is not null. It is exploded, as a filter would be pushed below and computed twice."""
    return rows.select("path", "line", "sent_text", F.inline(F.array_compact(F.array(let(F.col("tokens"), hit)))))


def _sentence(t: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(root, imperative)`` for a sentence of three words or more: its root, and whether it is an instruction."""

    def known(root: Column) -> Column:
        subject = F.exists(t, lambda x: F.coalesce(x["dep"].isin("nsubj", "nsubjpass", "expl") & (x["head"] == root["i"]), F.lit(False)))
        return body(root, F.coalesce(root["pos"].isin("VERB", "AUX") & (root["tag"] == "VB") & ~subject, F.lit(False)))

    words = F.size(F.filter(t, lambda x: ~x["is_space"] & ~x["is_punct"]))
    return F.when(words >= 3, let(_first(t, lambda x: x["head"] == x["i"]), known))


def sentence_length(tokens: DataFrame) -> DataFrame:
    rows = gathered(tokens, *KEY).withColumn("n", sentence_words(F.col("sent_text"))).where("n > 20")  # the lower limit
    of = lambda t: _sentence(t, lambda _, told: F.struct(told.alias("told")))
    rows = rows.select("path", "line", "sent_text", "n", F.inline(F.array_compact(F.array(let(F.col("tokens"), of))))).where("told OR n > 25")
    kind, most = F.when(F.col("told"), "instruction").otherwise("description"), F.when(F.col("told"), 20).otherwise(25)
    return rows.select(*_found("path", F.col("line"), "T-M1", F.format_string("%d-word %s, limit %d", F.col("n"), kind, most), one_line(strip(F.col("sent_text")))))


def one_instruction(tokens: DataFrame) -> DataFrame:
    def hit(t: Column) -> Column:
        def more(root: Column, told: Column) -> Column:
            others = F.filter(t, lambda x: (x["dep"] == "conj") & (x["tag"] == "VB") & (x["head"] == root["i"]))
            return F.when(told, let(others, lambda o: F.when(F.size(o) > 0, F.struct((F.size(o) + 1).alias("n"), F.array_join(F.concat(F.array(root["text"]), F.transform(o, lambda x: x["text"])), ", ").alias("verbs")))))

        return _sentence(t, more)

    rows = _each(gathered(tokens, *KEY), hit)
    return rows.select(*_found("path", F.col("line"), "T-M2", F.format_string("%d instructions (%s)", "n", "verbs"), one_line(F.col("sent_text"))))


def simple_tenses(tokens: DataFrame) -> DataFrame:
    def hit(t: Column) -> Column:
        done = lambda k: _first(F.slice(t, k + 2, F.lit(3)), lambda y: y["tag"] == "VBN")
        perfect = F.transform(t, lambda x, k: F.when(F.lower(x["text"]).isin(HAVE) & x["pos"].isin("AUX", "VERB"), F.struct(x["text"].alias("have"), done(k).alias("done"))))
        return _sentence(t, lambda *_: _first(perfect, lambda x: x["done"].isNotNull()))

    rows = _each(gathered(tokens, *KEY), hit)
    return rows.select(*_found("path", F.col("line"), "T-M4", F.format_string("perfect tense (%s %s)", "have", "done.text"), one_line(F.col("sent_text"))))


def ing_main_verb(tokens: DataFrame) -> DataFrame:
    rows = _each(gathered(tokens, *KEY), lambda t: _sentence(t, lambda root, _: F.when(root["tag"] == "VBG", F.struct(root["text"].alias("verb")))))
    return rows.select(*_found("path", F.col("line"), "T-M5", F.format_string("-ing main verb (%s)", "verb"), one_line(F.col("sent_text"))))


def noun_clusters(tokens: DataFrame) -> DataFrame:
    """Longest run of nouns in each noun chunk, the first of equal ones, if over three."""
    in_chunk = tokens.where("chunk IS NOT NULL")
    nouns = in_chunk.withColumn("at", F.row_number().over(W.partitionBy("path", "chunk").orderBy("i"))).where(F.col("pos").isin("NOUN", "PROPN"))
    nouns = nouns.withColumn("island", F.col("at") - F.row_number().over(W.partitionBy("path", "chunk").orderBy("i")))
    runs = nouns.groupBy("path", "chunk", "island").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.min_by("line", "i").alias("line"), F.sort_array(F.collect_list(F.struct("i", "text"))).alias("words")).where("n > 3")
    best = runs.groupBy("path", "chunk").agg(F.max_by(F.struct("n", "line", "words"), F.struct("n", (-F.col("first")).alias("f"))).alias("x")).select("path", "x.*")
    return best.select(*_found("path", F.col("line"), "T-M7", F.format_string("%d nouns in a row", "n"), F.array_join(F.transform("words", lambda x: x["text"]), " ")))


def non_imperative(items: DataFrame) -> DataFrame:
    """List items parsed alone: the token table of items, whose ``path`` and ``text_line`` are the document's and ``sent_text`` the item's body.

    Fires on "you" or "we" as subject of a verb with a modal auxiliary.
    """

    def hit(t: Column) -> Column:
        def of(s: Column) -> Column:
            modal = _first(t, lambda x: x["dep"].isin("aux", "auxpass") & F.lower(x["text"]).isin(MODALS) & (x["head"] == s["head"]))
            verb = _first(t, lambda x: x["i"] == s["head"])
            return let(F.struct(modal.alias("m"), verb.alias("h")), lambda x: F.when(x["m"].isNotNull() & x["h"].isNotNull(), F.struct(s["text"].alias("subject"), x["m"]["text"].alias("modal"), x["h"]["text"].alias("verb"))))

        return let(_first(t, lambda x: (x["dep"] == "nsubj") & F.lower(x["text"]).isin("you", "we")), of)

    rows = _each(gathered(items, "path", "text_line"), hit)
    fix = F.concat(F.upper(F.substring("verb", 1, 1)), F.lower(F.expr("substring(verb, 2)")), F.lit(" ..."))
    return rows.select(*_found("path", F.col("line"), "T-M10", F.format_string("non-imperative instruction (%s %s)", "subject", "modal"), strip(F.substring("sent_text", 1, 70)), fix))


def passive_voice(tokens: DataFrame) -> DataFrame:
    def hit(t: Column) -> Column:
        first = _first(t, lambda x: x["dep"].isin("nsubjpass", "auxpass"))
        return _sentence(t, lambda *_: let(first, lambda f: _first(t, lambda x: x["i"] == f["head"])))

    rows = _each(gathered(tokens, *KEY), hit)
    return rows.select(*_found("path", F.col("line"), "W-M11", F.format_string("passive clause (%s)", "text"), one_line(F.col("sent_text"))))


PARSE_RULES = {"T-M1": sentence_length, "T-M2": one_instruction, "T-M4": simple_tenses, "T-M5": ing_main_verb, "T-M7": noun_clusters, "W-M11": passive_voice}


def check_parsed(tokens: DataFrame, rules: list[str]) -> DataFrame:
    """Findings of the parse rules asked for over one token table; T-M10 takes a table of items (:func:`non_imperative`)."""
    out = None
    for r in rules:
        if r in PARSE_RULES:
            found = PARSE_RULES[r](tokens)
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("none of these rules reads a parse")
    return out
