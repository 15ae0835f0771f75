"""Host-level quality rules with an empirical beta prior.

Each document gets rule verdicts from its text alone. Failures are summed by
host, each host's failure rate is shrunk towards the mean of all hosts with a
beta prior fitted by the method of moments, and the host's verdict is joined
back to its documents. DataFrame functions only.

Defined cases: a null text has no words; a null host is a host of its own; a
repeated row counts as often as it occurs; an empty table gives an empty
result; columns other than the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, let, need, words

SYMBOLS = "#*$%&|<>"
#: rule -> condition on the measures; the first two decide base_failed.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE_RULES = ("short", "repetitive")


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in array ``w``.

    Windows are hashed to 64 bits and sorted with their place, so equal ones
    are neighbours: n log n in the words of a document, and no shuffle.
    """

    def marked(h: Column) -> Column:
        def cover(s: Column) -> Column:
            twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            places = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["p"]))
            step = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return let(places, lambda p: F.aggregate(step(p), F.lit(0), lambda a, x: a + x))

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, cover))

    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(windows, marked)


def measures(text: Column) -> Column:
    """Struct of the counts the rules look at."""
    t = F.coalesce(text, F.lit(""))
    bare = F.translate(t, SPACES, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own")))
    by_word = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again")))
    return F.struct(
        by_word.alias("w"),
        by_line.alias("l"),
        F.length(bare).alias("chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("symbols"),
    )


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: id, host, counts, ``fail_<rule>`` and ``base_failed``."""
    m = F.col("m")
    long = lambda c, name: c.cast("long").alias(name)
    counts = need(docs, id_col, text_col, host_col).select(
        F.col(id_col), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m")
    ).select(
        id_col, "host", long(m["w"]["n"], "n_words"), long(m["chars"], "word_chars"), long(m["symbols"], "n_symbols"),
        long(m["l"]["all"] - m["l"]["own"], "n_dup_lines"), long(m["w"]["again"], "n_repeat_words"), long(m["l"]["all"], "n_lines"),
    )
    failed = counts.select("*", *[F.expr(rule).alias(f"fail_{name}") for name, rule in RULES.items()])
    return failed.withColumn("base_failed", F.expr(" OR ".join(f"fail_{r}" for r in BASE_RULES)))


def host_verdicts(ruled: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row a host: documents, shrunk failure rate of each rule, ``host_bad``.

    The prior of a rule is Beta(m * s, (1 - m) * s): m is the rate over all
    documents, s follows from the variance between hosts that sampling does
    not explain. With one host, or hosts that agree, s is large and every
    host gets the common rate. A host is bad if any shrunk rate exceeds
    ``max_rate``.
    """
    hosts = ruled.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"fail_{r}")).alias(f"k_{r}") for r in RULES])
    total = hosts.agg(F.sum("n").alias("docs"), F.count("*").alias("hosts"), *[F.sum(f"k_{r}").alias(f"sum_{r}") for r in RULES],
                      *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"sq_{r}") for r in RULES])

    def prior(r: str) -> list[Column]:
        m = F.col(f"sum_{r}") / F.greatest(F.col("docs"), F.lit(1))
        between = F.col(f"sq_{r}") / F.greatest(F.col("docs"), F.lit(1)) - m * m - m * (1 - m) * (F.col("hosts") - 1) / F.greatest(F.col("docs"), F.lit(1))
        strength = F.least(F.greatest(m * (1 - m) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))
        return [m.alias(f"m_{r}"), strength.alias(f"s_{r}")]

    shrunk = lambda r: ((F.col(f"k_{r}") + F.col(f"m_{r}") * F.col(f"s_{r}")) / (F.col("n") + F.col(f"s_{r}"))).alias(f"rate_{r}")
    out = hosts.crossJoin(F.broadcast(total.select(*[c for r in RULES for c in prior(r)])))  # one row: the prior
    out = out.select("host", F.col("n").alias("host_docs"), *[shrunk(r) for r in RULES])
    return out.withColumn("host_bad", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Documents with their counts, rule verdicts, host rates and ``kept``.

    The counts are written once to the shared folder, since both the sums by
    host and the final join read them. The join is left to the planner, which
    splits a host that holds much of the table.
    """
    ruled = cut(document_rules(docs, id_col, text_col, host_col), "quality")
    hosts = host_verdicts(ruled, max_rate).withColumnRenamed("host", "of_host")
    joined = ruled.join(hosts, ruled["host"].eqNullSafe(hosts["of_host"]), "left").drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_bad"), F.lit(False)))
