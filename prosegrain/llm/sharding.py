"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group and stay together; only a group that is larger than a
shard's share of all bytes or rows, which no shard can take whole, is dealt in
a portion a shard or smaller ones. Every
group has a vector of bytes, tokens and rows and belongs to a class of like
vectors (``steps`` classes each time a dimension doubles). A class's groups are
ranked and dealt to at most ``blocks`` blocks; a class of fewer groups, as those
of large groups are, has a block a group. So the number of units that are
placed is bounded by parameters at any size of input.

Units are placed from the largest to the smallest by their exact sums; each
goes to the shard where the dot product of its vector with the residual
capacity is highest.

Ranks and slots are taken in two levels, within buckets and over the buckets'
counts, so no class and no shard is ever in one task.

Defined cases: a null text is an empty one; repeated rows are documents of
their own; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, need

DIMENSIONS = ("bytes", "tokens", "rows")
BUCKETS = 256


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector (units x dimensions): greedy by dot product with residual capacity, largest unit first."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), dtype=np.int64)
    for k in np.argsort(-share.sum(axis=1), kind="stable"):
        out[k] = best = int(np.argmax(left @ share[k]))
        left[best] -= share[k]
    return out


def ranked(df: DataFrame, within: str, order: str, name: str) -> DataFrame:
    """``df`` with ``name``, numbers from 0 without a gap in each value of ``within``; ``order`` is spread over buckets by its hash."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(BUCKETS)))
    counts = df.groupBy(F.col(within).alias("_of"), F.col("_bucket").alias("_at")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_of").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(within, "_bucket").orderBy(order)) - 1
    joined = df.withColumn("_inside", inside).join(base, (F.col(within) == F.col("_of")) & (F.col("_bucket") == F.col("_at")))
    return joined.withColumn(name, F.col("_base") + F.col("_inside")).drop("_bucket", "_inside", "_of", "_at", "_base")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", blocks: int = 96, steps: int = 2) -> DataFrame:
    """One row a document: id, size, text_crc32, n_tokens, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(need(docs, id_col, text_col).select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        n_words(F.col(text_col)).alias("n_tokens"), F.unhex(F.md5(text)).alias("group"), F.monotonically_increasing_id().alias("row"),
    ), "shard-rows")
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    share = max(1.0, total["bytes"] / shards), max(1.0, total["rows"] / shards)
    groups = cut(rows.groupBy("group").agg(*sums), "groups")

    # Larger than a shard's share: at most 2 * shards groups, so they are broadcast; their rows are dealt to portions by rank.
    portions = F.ceil(F.greatest(F.col("bytes") / share[0], F.col("rows") / share[1]))
    large = groups.where((F.col("rows") > 1) & (portions > 1))
    over = large.select(F.col("group").alias("of"), F.least(F.greatest(portions, F.lit(shards)), F.col("rows")).alias("portions"))
    dealt = ranked(rows.join(F.broadcast(over), F.col("group") == F.col("of")).drop("of"), "group", "row", "rank")
    dealt = dealt.select("row", "size", "n_tokens", F.concat(F.hex("group"), F.lit(":"), F.col("rank") % F.col("portions")).alias("unit"))

    # All others: by class, then by rank in the class.
    step: Column = lambda c: F.floor(F.log2(F.col(c) + 1) * steps).cast("string")
    classed = groups.join(F.broadcast(over.select("of")), F.col("group") == F.col("of"), "left_anti").withColumn("class", F.concat_ws(":", *[step(c) for c in DIMENSIONS]))
    classed = ranked(classed, "class", "group", "rank").withColumn("unit", F.concat("class", F.lit("/"), F.col("rank") % blocks))
    classed = cut(classed.select("group", "unit", "bytes", "tokens", "rows"), "units")

    # At most classes * blocks + 4 * shards * shards units; classes are bounded by steps and the widths of the numbers.
    by_portion = cut(dealt, "portions")
    units = classed.groupBy("unit").agg(*[F.sum(c) for c in DIMENSIONS]).union(by_portion.groupBy("unit").agg(*sums)).collect()
    units.sort(key=lambda r: r["unit"])
    placed = place(np.array([r[1:4] for r in units], dtype=float).reshape(-1, 3), shards)
    where = spark.createDataFrame([(r["unit"], int(s)) for r, s in zip(units, placed)], "placed string, shard int")
    by_group = classed.join(where, F.col("unit") == F.col("placed")).select(F.col("group").alias("of"), "shard")
    by_row = by_portion.join(where, F.col("unit") == F.col("placed")).select(F.col("row").alias("of"), "shard")
    # The rows of large groups never meet a join by group.
    small = rows.join(F.broadcast(over.select("of")), F.col("group") == F.col("of"), "left_anti").join(by_group, F.col("group") == F.col("of")).drop("of")
    big = rows.join(F.broadcast(over.select("of")), F.col("group") == F.col("of"), "left_semi").join(by_row, F.col("row") == F.col("of")).drop("of")
    out = ranked(cut(small.unionByName(big).drop("group"), "placed"), "shard", "row", "slot")
    return out.select(id_col, "size", "text_crc32", "n_tokens", "shard", "slot")
