"""Streaming forms of operators that look at one document at a time, and of counts over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators.bands import finding_counts
from ..operators.rules import check


def tokenized_stream(docs: DataFrame) -> DataFrame:
    """(path, tokens) of a streaming or batch DataFrame: a stateless map, so it runs in append mode."""
    return docs.select("path", tokenize(F.col("text")).alias("tokens"))


def findings_stream(docs: DataFrame, rules: list[str]) -> DataFrame:
    """Findings of text rules as documents arrive: stateless, append mode."""
    return check(docs, rules)


def finding_counts_stream(docs: DataFrame, rules: list[str]) -> DataFrame:
    """Findings by rule so far: an aggregate with a row a rule, for complete or update mode."""
    return finding_counts(check(docs, rules))


def windowed_counts(docs: DataFrame, rules: list[str], length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Findings by rule and window of ``ts``; documents later than ``late`` are left out. Columns of ``docs``: path, text, ts."""
    with_time = docs.withWatermark("ts", late)
    found = check(with_time.select(F.struct("path", "ts").alias("path"), "text"), rules)
    rows = found.select(F.col("path.ts").alias("ts"), "rule")
    return rows.groupBy(F.window("ts", length).alias("window"), "rule").agg(F.count("*").alias("findings"))
