"""Lexicons: jargon that a contrast corpus overuses, the vocabulary of an approved one, and extensions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .terms import corpus_stats, in_lots, log_likelihood, log_ratio, scaled_share, term_counts


class Lexicon(NamedTuple):
    jargon: DataFrame
    approved: DataFrame
    stoplist: tuple[str, ...] = ()
    zipf: DataFrame | None = None
    zipf_gate: float = 5.0


class Settings(NamedTuple):
    min_contrast_count: int = 5
    min_approved_count: int = 3
    ll_threshold: float = 15.13
    lr_threshold: float = 2.0
    min_contrast_dispersion: float | None = None
    max_approved_dispersion: float | None = None
    zipf_gate: float = 5.0


def build_stats(corpus: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: documents, tokens and median length of both sides, and the two dispersion bars."""
    s = corpus_stats(corpus)
    of = lambda side, c: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0)).alias(f"{side}_{c}")
    one = s.agg(*[of(side, c) for side in ("approved", "contrast") for c in ("docs", "tokens", "median_tokens")])
    low = F.lit(settings.min_contrast_dispersion) if settings.min_contrast_dispersion is not None else scaled_share(F.col("contrast_median_tokens"), F.col("contrast_docs"), 0.10, 0.015, 0.10, 8)
    high = F.lit(settings.max_approved_dispersion) if settings.max_approved_dispersion is not None else scaled_share(F.col("approved_median_tokens"), F.col("approved_docs"), 0.05, 0.01, 0.05, 3)
    return one.withColumns({"min_contrast_dispersion": low, "max_approved_dispersion": high})


def build(corpus: DataFrame, settings: Settings = Settings(), stoplist: tuple[str, ...] = (), zipf: DataFrame | None = None, n_max: int = 3) -> Lexicon:
    """Lexicon of a corpus with sides ``approved`` and ``contrast`` (see :mod:`terms`).

    Texts are tokenized once, into lots (:func:`terms.in_lots`), and ``corpus`` may be in lots already. Both sides are
    counted in one pass. Counts that reach a floor of either list
    are written, as both come from them; most terms occur once and never are. The
    statistics are one row, which is why it is broadcast. ``zipf`` (term, zipf)
    leaves out ordinary words.
    """
    corpus = in_lots(corpus.withColumnRenamed("doc_id", "unit"))
    wanted = (F.col("tf_contrast") >= settings.min_contrast_count) | (F.col("tf_approved") >= settings.min_approved_count) & (F.col("df_approved") >= 2)
    if stoplist:
        wanted |= F.col("term").isin(*stoplist)
    counts = written(term_counts(corpus, n_max).where(wanted), "term-counts")
    stats = F.broadcast(written(build_stats(corpus, settings), "term-stats"))  # one row
    rows = counts.crossJoin(stats)
    approved = rows.where((F.col("tf_approved") >= settings.min_approved_count) & (F.col("df_approved") >= 2)).select(
        "term", F.col("tf_approved").alias("approved_count"), F.bround(F.col("df_approved") / F.greatest("approved_docs", F.lit(1)), 4).alias("approved_doc_share"), F.lit(None).cast("string").alias("source")
    )
    if stoplist:
        approved = with_stoplist(approved, counts, stats, stoplist)
    jargon = rows.where(F.col("tf_contrast") >= settings.min_contrast_count)
    if stoplist:
        jargon = jargon.where(~F.col("term").isin(*stoplist) & ~F.arrays_overlap(F.split("term", " "), F.array(*[F.lit(s) for s in stoplist])))
    share_c, share_a = F.col("df_contrast") / F.greatest("contrast_docs", F.lit(1)), F.col("df_approved") / F.greatest("approved_docs", F.lit(1))
    args = [F.col(c) for c in ("tf_contrast", "contrast_tokens", "tf_approved", "approved_tokens")]
    n = [args[0], F.greatest(args[1], F.lit(1)), args[2], F.greatest(args[3], F.lit(1))]
    jargon = jargon.where((share_c >= F.col("min_contrast_dispersion")) & (share_a <= F.col("max_approved_dispersion")))
    jargon = jargon.withColumns({"ll": log_likelihood(*n), "lr": log_ratio(*n)}).where((F.col("ll") >= settings.ll_threshold) & (F.col("lr") >= settings.lr_threshold))
    jargon = jargon.select(
        "term", F.col("tf_contrast").alias("contrast_count"), F.col("tf_approved").alias("approved_count"), F.bround("ll", 2).alias("log_likelihood"), F.bround("lr", 2).alias("log_ratio"),
        F.bround(share_c, 4).alias("contrast_doc_share"), F.bround(share_a, 4).alias("approved_doc_share"),
    )
    if zipf is None:
        jargon = jargon.withColumn("zipf_en", F.lit(0.0))
    else:
        z = zipf.select(F.col("term").alias("z_term"), F.col("zipf").alias("zipf_en"))
        word = F.instr("term", " ") == 0
        jargon = jargon.join(z, (F.col("term") == F.col("z_term")) & word, "left").withColumn("zipf_en", F.bround(F.coalesce("zipf_en", F.lit(0.0)), 2)).where("zipf_en < " + str(settings.zipf_gate)).drop("z_term")
    # Written, so that the planner knows how small it is and joins it without dealing out what it meets.
    return Lexicon(written(jargon, "jargon"), approved, tuple(stoplist), zipf, settings.zipf_gate)


def with_stoplist(approved: DataFrame, counts: DataFrame, stats: DataFrame, stoplist: tuple[str, ...]) -> DataFrame:
    """Names of the stoplist count as approved, with their counts if they occur; entries that are there stay."""
    names = approved.sparkSession.createDataFrame([(s,) for s in sorted(set(stoplist))], "name string")
    new = F.broadcast(names).join(counts.select("term", "tf_approved", "df_approved").where(F.col("term").isin(*stoplist)), F.col("name") == F.col("term"), "left").crossJoin(stats)
    new = new.select(F.col("name").alias("term"), F.coalesce("tf_approved", F.lit(0)).cast("long").alias("approved_count"), F.bround(F.coalesce("df_approved", F.lit(0)) / F.greatest("approved_docs", F.lit(1)), 4).alias("approved_doc_share"), F.lit("stoplist").alias("source"))
    return approved.unionByName(new.join(approved.select("term"), "term", "left_anti"))


def profile(docs: DataFrame, min_count: int = 3, min_docs: int = 2, n_max: int = 3) -> tuple[DataFrame, DataFrame]:
    """(vocabulary: term, count, doc_share; one row of docs, tokens, median_doc_tokens, max_approved_dispersion) of ``docs`` (doc_id, tokens)."""
    corpus = docs.where(F.size("tokens") >= 3).select("doc_id", F.lit("profile").alias("side"), "tokens")
    bar = F.least(F.lit(1.0), scaled_share(F.col("median_tokens"), F.col("docs"), 0.05, 0.01, 0.05, 3))
    meta = corpus_stats(corpus).select("docs", "tokens", F.col("median_tokens").alias("median_doc_tokens"), bar.alias("max_approved_dispersion"))
    counts = term_counts(corpus, n_max, ("profile",)).where((F.col("tf_profile") >= min_count) & (F.col("df_profile") >= min_docs))
    share = F.bround(F.col("df_profile") / F.greatest("docs", F.lit(1)), 4)
    return counts.crossJoin(F.broadcast(meta)).select("term", F.col("tf_profile").alias("count"), share.alias("doc_share")), meta


def vetoed(jargon: DataFrame, vocabulary: DataFrame, bar: DataFrame) -> DataFrame:
    """Jargon terms that the extension's documents use more widely than the bar."""
    wide = vocabulary.crossJoin(F.broadcast(bar.select("max_approved_dispersion"))).where(F.col("doc_share") > F.col("max_approved_dispersion"))
    return jargon.join(wide.select("term"), "term", "left_semi")


def extend(lexicon: Lexicon, vocabulary: DataFrame, bar: DataFrame) -> Lexicon:
    """The lexicon with an extension: its vocabulary is added, and what it uses widely is no jargon. Nothing becomes jargon."""
    gone = vetoed(lexicon.jargon, vocabulary, bar)
    new = vocabulary.join(lexicon.approved.select("term"), "term", "left_anti").select("term", F.col("count").alias("approved_count"), F.col("doc_share").alias("approved_doc_share"), F.lit("extension").alias("source"))
    return lexicon._replace(jargon=lexicon.jargon.join(gone.select("term"), "term", "left_anti"), approved=lexicon.approved.unionByName(new))
