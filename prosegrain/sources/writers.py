"""Lexicons, extensions and findings as files, written by the engine's own commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lexicon import Lexicon
from ..operators.rules import finding_line, sort_findings


def _as_map(rows: DataFrame, key: str, name: str) -> DataFrame:
    entry = F.struct(*[c for c in rows.columns if c != key])
    return rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("v")))).alias(name))


def write_lexicon_tables(lexicon: Lexicon, path: str) -> None:
    """Two Parquet tables: the form for lexicons of any size."""
    lexicon.jargon.write.mode("errorifexists").parquet(f"{path}/jargon")
    lexicon.approved.write.mode("errorifexists").parquet(f"{path}/approved")


def read_lexicon_tables(spark, path: str, stoplist: tuple[str, ...] = ()) -> Lexicon:
    return Lexicon(spark.read.parquet(f"{path}/jargon"), spark.read.parquet(f"{path}/approved"), stoplist)


def write_lexicon_json(lexicon: Lexicon, meta: DataFrame, path: str) -> None:
    """One JSON document. It is one row by its format: for exchange of small lexicons; tables have no such bound."""
    doc = meta.select(F.struct("*").alias("meta")).crossJoin(_as_map(lexicon.jargon, "term", "jargon")).crossJoin(_as_map(lexicon.approved, "term", "approved_vocabulary"))
    doc.coalesce(1).write.mode("errorifexists").json(path)


def write_extension_json(vocabulary: DataFrame, meta: DataFrame, path: str) -> None:
    meta.select(F.struct("*").alias("meta")).crossJoin(_as_map(vocabulary, "term", "vocabulary")).coalesce(1).write.mode("errorifexists").json(path)


def write_findings_text(found: DataFrame, path: str) -> None:
    finding_line(sort_findings(found)).write.mode("errorifexists").text(path)


def write_findings_json(found: DataFrame, path: str) -> None:
    sort_findings(found).write.mode("errorifexists").json(path)


def findings_report(found: DataFrame, run: list[str], skipped: list[str], tiers: list[str]) -> DataFrame:
    """One row of counts by rule, with the rules that ran; the findings themselves stay a table."""
    counts = found.groupBy("rule").agg(F.count("*").alias("n"))
    as_map = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("counts"))
    many = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return as_map.select(many(run).alias("rules"), many(tiers).alias("tiers_run"), many(skipped).alias("rules_skipped"), "counts")
