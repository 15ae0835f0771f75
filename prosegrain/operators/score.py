"""Scores of units (documents or sentences) against a lexicon, and comparison of two corpora.

Units are ``unit`` and ``tokens``, a row a unit. Terms of units are counted by lots
inside a task; the distinct terms of a lot are looked up in the vocabulary, wherever
it is, and jargon is joined by term, which is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_digit, is_stopword, strip
from .lexicon import Lexicon
from .resample import exact_sums, poisson_sums
from .store import written
from .terms import in_lots, known_terms, lengths_of, unit_terms

CLASSES = ("jargon", "unapproved_unigram", "unapproved_bigram")


def _jargon(lexicon: Lexicon) -> DataFrame:
    columns = [F.lit(True).alias("is_jargon"), F.col("log_ratio").cast("double").alias("log_ratio"), F.col("approved_count").cast("long").alias("approved_count")]
    return lexicon.jargon.select(F.col("term").alias("known"), *columns).groupBy("known").agg(*[F.max(c).alias(c) for c in ("is_jargon", "log_ratio", "approved_count")])


def term_hits(units: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(unit, term, n, size, is_jargon, is_approved, class, log_ratio, approved_count): a row a distinct term of a unit, which is one row.

    A term of three tokens or more has a class only as jargon, so of those only jargon has a row: they meet the jargon
    alone, whose number is bounded by its bar on documents. The vocabulary, which grows with the corpus, is asked by lots
    for single words and pairs. ``units`` may be in lots (:func:`terms.in_lots`), here and wherever units are scored.
    """
    rows = known_terms(in_lots(units), lexicon.approved.where(F.size(F.split("term", " ")) < 3)).withColumnRenamed("is_known", "is_approved")
    rows = rows.join(_jargon(lexicon), F.col("term") == F.col("known"), "left").withColumn("is_jargon", F.coalesce("is_jargon", F.lit(False))).where("size < 3 OR is_jargon")
    free = ~F.col("is_jargon") & ~F.col("is_approved") & ~has_digit(F.col("term"))
    if lexicon.stoplist:
        free &= ~F.arrays_overlap(F.split("term", " "), F.array(*[F.lit(s) for s in lexicon.stoplist]))
    ordinary: Column = F.lit(False)
    if lexicon.zipf is not None:
        z = lexicon.zipf.select(F.col("term").alias("z_term"), "zipf")
        rows = rows.join(z, F.col("term") == F.col("z_term"), "left")
        ordinary = F.coalesce(F.col("zipf") >= lexicon.zipf_gate, F.lit(False))
    kind = F.when(F.col("is_jargon"), "jargon").when(free & (F.col("size") == 1) & ~ordinary, "unapproved_unigram").when(free & (F.col("size") == 2), "unapproved_bigram")
    return rows.select("unit", "term", "n", "size", "is_jargon", "is_approved", kind.alias("class"), "log_ratio", "approved_count")


def jargon_hits(units: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(unit, term, n): those of :func:`term_hits` that are jargon. The vocabulary has no part in them and is not asked."""
    return unit_terms(units).join(_jargon(lexicon), F.col("term") == F.col("known")).select("unit", "term", "n")


def density(hits: Column, content: Column) -> Column:
    return F.bround(1000 / F.greatest(content, F.lit(1)) * hits, 2)


def _lengths(units: DataFrame) -> DataFrame:
    if "codes" in units.columns:
        return lengths_of(units)
    content = F.size(F.filter("tokens", lambda t: ~is_stopword(t)))
    return units.select("unit", F.size("tokens").cast("long").alias("tokens"), content.cast("long").alias("content_words"))


def _scored(base: DataFrame, hits: DataFrame) -> DataFrame:
    of = lambda c: F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"{c}_hits")
    covered = F.sum(F.when((F.col("size") == 1) & F.col("is_approved"), F.col("n")).otherwise(0)).alias("covered")
    sums = hits.groupBy(F.col("unit").alias("u")).agg(*[of(c) for c in CLASSES], covered)
    return base.join(sums, F.col("unit") == F.col("u"), "left").drop("u").fillna(0, [f"{c}_hits" for c in CLASSES] + ["covered"])


def _rates(rows: DataFrame) -> DataFrame:
    per = {f"{c}_density_per_1k": density(F.col(f"{c}_hits"), F.col("content_words")) for c in CLASSES}
    return rows.withColumns(per).withColumn("approved_coverage", F.bround(F.col("covered") / F.greatest("content_words", F.lit(1)), 4)).drop("covered")


def score(units: DataFrame, lexicon: Lexicon, hits: DataFrame | None = None) -> DataFrame:
    """One row a unit, also for units without a hit. ``hits``: :func:`term_hits`, where they are at hand."""
    if hits is None:
        units = in_lots(units)
        hits = term_hits(units, lexicon)
    return _rates(_scored(_lengths(units), hits))


def ranked_terms(hits: DataFrame, k: int = 15) -> DataFrame:
    """(class, rank, term, docs, hits): the ``k`` terms of every class in one pass.

    Jargon goes by uses, others by documents, then uses; then by name. Each task keeps its ``k`` best of a class before
    anything is shuffled.
    """
    rows = hits.where("class IS NOT NULL").groupBy("class", "term").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("hits"))
    first = F.when(F.col("class") == "jargon", F.col("hits")).otherwise(F.col("docs"))
    order = W.partitionBy("class").orderBy(first.desc(), F.desc("hits"), F.asc("term"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def corpus_report(units: DataFrame, lexicon: Lexicon, k: int = 15) -> DataFrame:
    """One row: totals, pooled densities and coverage, units with a hit of each class, and the ``k`` first terms of each class as
    arrays (term, docs, hits). The hits are made once and written; totals and terms both come from them."""
    units = in_lots(units)
    hits = written(term_hits(units, lexicon), "hits")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = _scored(_lengths(units), hits).agg(F.count("*").alias("docs"), total("tokens"), total("content_words"), total("covered"), *[total(f"{c}_hits") for c in CLASSES], *[F.count_if(F.col(f"{c}_hits") > 0).alias(f"docs_with_{c}") for c in CLASSES])
    entry = F.struct("rank", "term", "docs", "hits")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col("class") == c, entry))), lambda x: F.struct(x["term"].alias("term"), x["docs"].alias("docs"), x["hits"].alias("hits"))).alias(f"top_{c}")
    lists = ranked_terms(hits, k).agg(*[listed(c) for c in CLASSES])  # k rows a class
    return _rates(sums.crossJoin(lists))


def file_rows(units: DataFrame, lexicon: Lexicon, k: int = 3) -> DataFrame:
    """Scores with the ``k`` most used flagged and unapproved single terms of each unit as arrays, unsorted."""
    units = in_lots(units)
    hits = written(term_hits(units, lexicon), "hits")
    tops = None
    for name, kind in (("top_terms", "jargon"), ("top_unapproved", "unapproved_unigram")):
        each = top_of_each(hits, kind, k).groupBy(F.col("unit").alias("u")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias(name))
        tops = each if tops is None else tops.join(each, "u", "full")
    out = score(units, lexicon, hits).join(tops, F.col("unit") == F.col("u"), "left").drop("u")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("top_terms", "top_unapproved")})


def sentence_report(sentences: DataFrame, lexicon: Lexicon, cut: int = 160) -> DataFrame:
    """(unit, sentence, terms, unapproved): sentences (unit, sentence, tokens) with a hit, cut to ``cut`` characters, and their
    flagged and unapproved terms, most used first."""
    hits = term_hits(sentences, lexicon).where("class IS NOT NULL")
    kind = F.when(F.col("class") == "jargon", 0).when(F.col("class") == "unapproved_unigram", 1).otherwise(2)
    terms = lambda keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(kind.alias("c"), (-F.col("n")).alias("m"), "term")))), lambda x: x["term"])
    found = hits.groupBy(F.col("unit").alias("u")).agg(terms(kind == 0).alias("terms"), terms(kind > 0).alias("unapproved"))
    return sentences.join(found, F.col("unit") == F.col("u")).select("unit", F.substring(strip(F.col("sentence")), 1, cut).alias("sentence"), "terms", "unapproved")


def advisory(scores: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """One row, the line of the advisory summary: the scores of the unit that comes last, and its ``k`` most used flagged terms.

    The last unit is an aggregate, so nothing is sorted; no unit gives no row.
    """
    last = scores.agg(F.max_by(F.struct(*[c for c in scores.columns if c != "unit"]), "unit").alias("s"), F.max("unit").alias("last")).where("last IS NOT NULL")
    best = hits.where("is_jargon").join(F.broadcast(last.select("last")), F.col("unit") == F.col("last")).orderBy(F.desc("n"), "term").limit(k)
    terms = best.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), lambda x: F.concat(x["term"], F.lit("×"), (-x["m"]).cast("string"))).alias("terms"))
    per = lambda c: F.col(f"s.{c}_density_per_1k").cast("string")
    line = F.concat(F.lit("jargon (W-M10, advisory): "), per("jargon"), F.lit("/1k · unapproved "), per("unapproved_unigram"), F.lit("/1k unigrams, "), per("unapproved_bigram"), F.lit("/1k bigrams over "), F.format_number("s.content_words", 0), F.lit(" content words"))
    return last.crossJoin(terms).select(F.concat(line, F.when(F.size("terms") > 0, F.concat(F.lit(" · top: "), F.array_join("terms", ", "))).otherwise("")).alias("value"))


def score_corpus(scores: DataFrame) -> DataFrame:
    """One row: totals, pooled densities (ratios of sums) and how many units have a hit of each class."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    out = scores.agg(F.count("*").alias("docs"), total("tokens"), total("content_words"), *[total(f"{c}_hits") for c in CLASSES], *[F.count_if(F.col(f"{c}_hits") > 0).alias(f"docs_with_{c}") for c in CLASSES])
    return out.withColumns({f"{c}_density_per_1k": density(F.col(f"{c}_hits"), F.col("content_words")) for c in CLASSES})


def top_terms(hits: DataFrame, kind: str, k: int = 15) -> DataFrame:
    """The ``k`` terms of a class: jargon by uses, others by documents, then uses, then name."""
    rows = hits.where(F.col("class") == kind).groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("hits"))
    order = [F.desc("hits"), F.asc("term")] if kind == "jargon" else [F.desc("docs"), F.desc("hits"), F.asc("term")]
    return rows.orderBy(*order).limit(k)


def top_of_each(hits: DataFrame, kind: str, k: int = 3) -> DataFrame:
    """The ``k`` most used terms of a class in each unit."""
    order = W.partitionBy("unit").orderBy(F.desc("n"), F.asc("term"))
    return hits.where(F.col("class") == kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("unit", "rank", "term", F.col("n").alias("hits"))


def delta(units: DataFrame, reps: int = 2000, exact: bool = False, seed: int = 7) -> DataFrame:
    """One row a class: densities of sides a and b, their difference, its 95 % range, whether it is credible.

    ``units``: (side, unit, content_words, <class>_hits). Every replicate draws
    units with replacement: with ``exact`` as many as the side has, by a
    generator with a seed; else each a Poisson number of times, by a digest of replicate,
    unit and side, which every engine draws alike. See :mod:`resample`.
    """
    units = written(units, "compared-units")  # read for the replicates and as a whole; scores are not made twice
    values = ["content_words", *[f"{k}_hits" for k in CLASSES]]
    sums = lambda df, w: df.agg(*[F.sum(F.col(c) * w).alias(c) for c in values])
    reps_sums = exact_sums(units, values, reps, seed) if exact else poisson_sums(units, values, reps)
    whole = sums(units.groupBy(F.lit(-1).cast("long").alias("rep"), "side"), F.lit(1))
    rate = lambda k: F.expr(f"1000 * {k}_hits / greatest(content_words, 1)")
    rows = reps_sums.unionByName(whole).select("rep", "side", F.explode(F.create_map(*[x for k in CLASSES for x in (F.lit(k), rate(k))])).alias("class", "rate"))
    by_rep = rows.groupBy("rep", "class").agg(F.max(F.when(F.col("side") == "a", F.col("rate"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("rate"))).alias("b"))
    n = F.size("diffs")
    at = lambda q: F.get("diffs", F.floor(q * n).cast("int"))
    out = by_rep.groupBy("class").agg(  # a number a replicate
        F.max(F.when(F.col("rep") < 0, F.col("a"))).alias("a"), F.max(F.when(F.col("rep") < 0, F.col("b"))).alias("b"),
        F.sort_array(F.collect_list(F.when(F.col("rep") >= 0, F.col("a") - F.col("b")))).alias("diffs"),
    ).withColumns({"low": at(0.025), "high": at(0.975)})
    return out.select("class", F.bround("a", 2).alias("a_density"), F.bround("b", 2).alias("b_density"), F.bround(F.col("a") - F.col("b"), 2).alias("delta"), F.bround("low", 2).alias("ci_low"), F.bround("high", 2).alias("ci_high"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("credible"))
