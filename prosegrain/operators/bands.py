"""Rates of findings per 1,000 words, compared with reference bands, and calibration of bands from corpora."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 300
#: Rules for which a high human rate is style, not a sign of a machine.
HUMAN_HIGH = ("W-M11", "T-M1", "T-M2", "T-M3", "T-M4", "T-M5", "T-M7", "T-M8", "T-M9", "T-M10", "T-M11", "T-M12")
BANDS = "bands string, rule string, direction string, hu_lo double, hu_hi double, hi_lo double, hi_hi double, ai_u double, ai_i double"


def finding_counts(found: DataFrame) -> DataFrame:
    return found.where("rule <> 'W-M10'").groupBy("rule").agg(F.count("*").alias("findings"))


def rate(count: Column, words: Column) -> Column:
    return F.bround(1000 * count / words, 2)


def position(r: Column) -> tuple[Column, Column]:
    """(status, reason) of rate ``r`` against the band columns."""
    ai = F.coalesce("ai_u", "ai_i")
    high = F.col("direction") == "human-high"
    no_band, over = F.col("hu_hi").isNull(), r > F.col("hu_hi")
    machine = F.coalesce(r >= ai, F.lit(False))
    status = F.when(no_band, "-").when(high & ~over, "PASS").when(high, "FAIL").when(machine, "FAIL").when(over, "WARN").otherwise("PASS")
    reason = F.when(no_band, "no band").when(high & ~over, "within human range").when(high, "above human range (style)").when(machine, "ai-range").when(over, "elevated above human band").otherwise("human-band")
    return status, reason


def verdicts(counts: DataFrame, words: DataFrame, bands: DataFrame, always: Iterable[str] = ("W-M1",)) -> DataFrame:
    """(rule, rate_per_1k, status, position, direction) of rules with findings, and of ``always``; none under MIN_WORDS words.

    ``counts`` has at most a row a rule, ``words`` (words) is one row, ``bands``
    a small fixed table.
    """
    spark = counts.sparkSession
    zero = spark.createDataFrame([(r, 0) for r in always], "rule string, findings long")
    shown = counts.select("rule", "findings").unionByName(zero).groupBy("rule").agg(F.sum("findings").alias("findings"))
    rows = shown.join(F.broadcast(bands), "rule").crossJoin(F.broadcast(words.select("words"))).where(F.col("words") >= MIN_WORDS)
    rows = rows.withColumn("rate_per_1k", rate(F.col("findings"), F.greatest("words", F.lit(1))))
    status, reason = position(F.col("rate_per_1k"))
    return rows.select("rule", "findings", "rate_per_1k", status.alias("status"), reason.alias("position"), "direction")


def calibration_rates(corpora: DataFrame, words: DataFrame, found: DataFrame, rules: list[str]) -> DataFrame:
    """(label, rule, findings, per_1k) for every corpus and rule, zero where there is none.

    ``corpora`` (label, ...), ``words`` (label, words), ``found`` (label, rule),
    a row a finding, or with their number as ``findings``.
    """
    rule = F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule")
    counts = found.groupBy("label", "rule").agg((F.sum("findings") if "findings" in found.columns else F.count("*")).alias("n")).toDF("c_label", "c_rule", "n")
    rows = corpora.select("label", rule).join(words.select(F.col("label").alias("w_label"), "words"), F.col("label") == F.col("w_label"))
    rows = rows.join(counts, (F.col("label") == F.col("c_label")) & (F.col("rule") == F.col("c_rule")), "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("label", "rule", n.cast("long").alias("findings"), rate(n, F.greatest("words", F.lit(1))).alias("per_1k"))


def calibrate(corpora: DataFrame, rates: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Bands by surface and rule: human [min, max] and machine median over corpora, for both origins, with the numbers of corpora.

    ``corpora`` (label, surface, side, origin); ``exclusions`` (label, rule)
    leaves a corpus out for a rule.
    """
    rows = rates
    if exclusions is not None:
        rows = rows.join(exclusions, ["label", "rule"], "left_anti")
    rows = rows.join(corpora.select("label", "surface", "side", "origin"), "label")
    groups = [("human", "universal"), ("human", "internal"), ("ai", "universal"), ("ai", "internal")]
    aggs = []
    for side, origin in groups:
        v = F.when((F.col("side") == side) & (F.col("origin") == origin), F.col("per_1k"))
        if side == "human":
            aggs += [F.min(v).alias(f"human_{origin}_lo"), F.max(v).alias(f"human_{origin}_hi")]
        else:
            aggs.append(F.bround(F.median(v), 2).alias(f"ai_{origin}"))
        aggs.append(F.count(v).alias(f"{side}_{origin}_n"))
    direction = F.when(F.col("rule").isin(*HUMAN_HIGH), "human-high").otherwise("ai-high")
    return rows.groupBy("surface", "rule").agg(*aggs).withColumn("direction", direction)


def check_groups(bands: DataFrame) -> None:
    """Every surface and rule needs a human and a machine reference from public corpora."""
    short = bands.where("human_universal_n = 0 OR ai_universal_n = 0").select("surface", "rule").limit(5).collect()
    if short:
        raise ValueError("no public reference for " + ", ".join(f"{r.surface} {r.rule}" for r in short))
