"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order. An instance of a
document (a source may be gone through up to ``max_epochs`` times) finishes at
the virtual time (words of its source served up to and with it) / (target of
the source). All instances are ordered by that time and the order is cut where
the total budget is spent, so every source advances at the pace of its weight.

Prefix sums are taken in two levels, so no source is ever in one task: within
(source, bucket of the shuffle order), then over the sums of the buckets. The
global order is likewise ranged by virtual time into ``time_buckets`` slices;
only the slice in which the budget ends is ordered row by row. DataFrame
functions only.

Defined cases: a null text has size 0; null is a source of its own and comes
last; repeated rows are separate documents that share one decision; a source without words gets target
0 and takes nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, need, unpacked, with_row


def source_targets(sizes: DataFrame, budget_share: float = 1.0, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight, target): the budget shared by weight, no target above ``max_epochs`` sizes.

    Water-filling in closed form: sources in order of cap / weight; those
    whose cap lies below the level of the rest stop at it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())  # a row a source
    cycle = F.array(*[F.lit(w) for w in weights])
    s = by_source.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights))))
    s = s.withColumn("weight", F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0)).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    order = [F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(-1.0), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("left", budget_share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("level", F.when(F.sum("weight").over(onward) > 0, F.col("left") / F.sum("weight").over(onward)))
    s = s.withColumn("full", F.col("cap") <= F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0)))
    s = s.withColumn("final", F.min(F.when(~F.col("full") & (F.col("weight") > 0), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level"))))
                     .over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.col("final"), F.lit(float("inf"))))
    return s.select("source", "source_size", "weight", F.when(F.col("weight") > 0, target).otherwise(0.0).alias("target"))


def mixed(seed: int, id_: Column, text: Column) -> Column:
    """Place of a document in its source's shuffled order."""
    name = F.concat_ws(":", F.lit(str(seed)), id_.cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    return F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 15), 16, 10).cast("long")


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, budget_share: float = 1.0,
             max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), order_buckets: int = 4096, time_buckets: int = 4096, size: Column | None = None) -> DataFrame:
    """One row a document: id, source, size, source_size, weight, target, epochs (times taken), taken (words), first_time, mixed."""
    text = F.col(text_col)
    sizes = cut(need(docs, id_col, text_col, source_col).select(
        F.col(id_col), F.col(source_col).alias("source"), (n_words(text) if size is None else size).alias("size"),
        mixed(seed, F.col(id_col), text).alias("mixed"),
    ), "mix")
    bucket = F.floor(F.col("mixed") / (1 << 60) * order_buckets)  # ranges of the shuffled order
    rows = sizes.withColumn("bucket", bucket)
    targets = source_targets(sizes, budget_share, max_epochs, weights)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).drop("in_bucket")
    base = base.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    base = base.withColumnsRenamed({"source": "of", "bucket": "at"})
    # Rows that are equal in source, id and text are peers: they are served together and share one decision.
    upto = W.partitionBy("source", "bucket").orderBy("mixed", id_col).rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("served", F.sum("size").over(upto))
    rows = rows.join(base, rows["source"].eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).withColumn("served", F.col("served") + F.col("base")).drop("of", "at", "base")
    queued = cut(rows, "queued")

    def finish(e: int | Column) -> Column:
        return F.when(F.col("target") > 0, (F.lit(e) * F.col("source_size") + F.col("served")) / F.col("target"))

    some = queued.where("size > 0")
    instances = some.select("size", F.explode(F.array(*[finish(e) for e in range(max_epochs)])).alias("time"))
    # Slices beyond time 2 widen with the time, so a long tail adds time_buckets of them each time it doubles.
    late = 2 * time_buckets + F.floor(F.log2(F.col("time") / 2) * time_buckets)
    sliced = instances.withColumn("slice", F.when(F.col("time") <= 2, F.floor(F.col("time") * time_buckets)).otherwise(late))
    by_slice = sliced.groupBy("slice").agg(F.sum("size").alias("words"), F.min("time").alias("low"))
    run = W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = sizes.agg((F.coalesce(F.sum("size"), F.lit(0)) * budget_share).alias("budget"))
    over = by_slice.withColumn("upto", F.sum("words").over(run)).crossJoin(F.broadcast(budget)).where("upto > budget")
    last = over.agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"), "budget", "low"), "slice").alias("x")).select("x.*").where("slice is not null")
    inside = sliced.join(F.broadcast(last), "slice").groupBy("time").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("budget").alias("budget"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(W.orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow)))
    # One row: the last virtual time served within the budget; infinite if the budget is never spent.
    cutoff = last.select("low").join(
        inside.where("upto <= budget").agg(F.max("time").alias("high")), how="left").agg(
        F.coalesce(F.max("high"), F.max("low"), F.lit(float("inf"))).alias("cutoff"), F.max("high").isNull().alias("open"))
    inside_cut = lambda e: F.when(F.col("open"), finish(e) < F.col("cutoff")).otherwise(finish(e) <= F.col("cutoff"))
    epochs = sum((F.coalesce(inside_cut(e).cast("int"), F.lit(0)) for e in range(max_epochs)), F.lit(0))
    out = queued.crossJoin(F.broadcast(cutoff)).withColumn("epochs", F.when(F.col("size") > 0, epochs).otherwise(0))
    return out.select(id_col, "source", "size", "source_size", "weight", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"), finish(0).alias("first_time"), "mixed")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **options) -> DataFrame:
    """``docs`` as mixed: rows that are not taken go, a row taken n times is there n times. Other columns stay as they are, clashing names too."""
    taken = fair_mix(docs, id_col, text_col, source_col, seed, **options).where("epochs > 0")
    taken = taken.select(F.col(id_col).alias("of_id"), F.col("source").alias("of_source"), F.col("mixed").alias("of_mixed"), F.col("epochs").alias("times")).distinct()
    rows = with_row(docs, i=id_col, s=source_col, t=text_col).withColumn("m", mixed(seed, F.col("i"), F.col("t"))).drop("t")
    same = F.col("i").eqNullSafe(F.col("of_id")) & F.col("s").eqNullSafe(F.col("of_source")) & (F.col("m") == F.col("of_mixed"))
    return unpacked(rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), "times")).alias("time")), docs)
