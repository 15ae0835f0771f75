"""Bootstrap resamples of units: sums of columns in every replicate, made where the units are.

Each task adds up its own units for all replicates at once, as one array, and
arrays are added in two levels; there is no row for a unit in a replicate, and
nothing about single units goes to the driver.

``poisson_sums`` draws a unit a Poisson number of times by a digest of its name.
``exact_sums`` draws n of n: the units of a side are numbered and stand in
blocks of one size, so that how many units lie in any range of blocks follows
from n alone. How many of a replicate's draws fall to a range is split between
its halves by a binomial draw, whose generator is seeded by the range; each task
walks from the whole side down to its own block, so all tasks agree without a
word between them, and the draws add up to n.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Replicates that one digest serves, with 16 bits for each.
EACH = 8
#: Units in a block, and replicates whose draws a task holds at once.
BLOCK, AT_ONCE = 1 << 16, 32
#: Arrays of one side that meet in the last task.
LOTS = 64


def numbered(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``rows``, written, with ``idx``, from 0 in each group of ``within`` in the order of the columns ``order``.

    Rows are range-sorted over all groups, so a group that holds much of the
    table lies in many ranges; a row for each range and group says what is before it.
    """
    ranged = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    # The number holds the range in its upper bits and the row's place in the lower 33.
    at = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    pieces = at.groupBy(*within, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = at.join(pieces.withColumn("_before", before), [*within, "_range"])
    return placed.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_n", "_before")


def poisson_bars() -> list[int]:
    """A number of 16 bits draws as many as it reaches bars: the distribution function of a Poisson number of mean 1."""
    upto, p, out = 0.0, math.exp(-1), []
    for k in range(1, 9):
        upto, p = upto + p, p / k
        out.append(math.floor(65536 * upto))
    return out


def poisson_times(names: list[str], blocks: int) -> np.ndarray:
    """How often each unit is drawn in ``blocks * EACH`` replicates, by digests of block and name."""
    table = np.searchsorted(poisson_bars(), np.arange(1 << 16), side="right").astype(np.uint8)
    digests = b"".join(hashlib.md5(f"{b}:{name}".encode()).digest() for name in names for b in range(blocks))
    return table[np.frombuffer(digests, ">u2")].reshape(len(names), blocks * EACH)


def generator(*name: object) -> np.random.Generator:
    """A counter-based generator of its own for every name."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.blake2b(repr(name).encode(), digest_size=16).digest(), "little")))


def draws(seed: int, side: str, n: int, block: int, k: int, reps: int) -> np.ndarray:
    """How many of the n draws of each replicate fall to the k-th block of a side of n units."""
    low, high, out = 0, -(-n // block), np.full(reps, n, np.int64)
    units = lambda a, b: min(b * block, n) - a * block
    while high - low > 1:
        middle = (low + high) // 2
        left = generator(seed, side, "split", low, high).binomial(out, units(low, middle) / units(low, high))
        low, high, out = (low, middle, left) if k < middle else (middle, high, out - left)
    return out


def block_sums(values: np.ndarray, times: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums of the columns of ``values`` over as many draws of its rows as ``times`` says, a row a replicate."""
    n, out = len(values), np.zeros((len(times), values.shape[1]))
    for a in range(0, len(times), AT_ONCE):
        some = times[a : a + AT_ONCE]
        drawn = rng.integers(0, n, int(some.sum())) + np.repeat(np.arange(len(some)) * n, some)
        out[a : a + AT_ONCE] = np.bincount(drawn, minlength=len(some) * n).reshape(len(some), n) @ values
    return out


def _packed(sums: np.ndarray) -> bytes:
    return np.rint(sums).astype("<i8").tobytes()


def _added(by: list[str]):
    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("sums").combine_chunks())
        return pa.table([rows.column(c).slice(0, 1) for c in by] + [pa.array([total.tobytes()], pa.binary())], [*by, "sums"])

    return add


def _totals(arrays: DataFrame, values: list[str], reps: int) -> DataFrame:
    """arrays (side, lot, sums) -> (rep, side, *values)."""
    lots = arrays.groupBy("side", "lot").applyInArrow(_added(["side", "lot"]), "side string, lot long, sums binary")
    whole = lots.groupBy("side").applyInArrow(_added(["side"]), "side string, sums binary")  # LOTS arrays of a side at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                each = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, len(values))[:reps]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(each))), pa.array([side] * len(each)), *[pa.array(c) for c in each.T]], ["rep", "side", *values])

    return whole.mapInArrow(rows, "rep long, side string, " + ", ".join(f"{v} long" for v in values))


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], 1)


def poisson_sums(units: DataFrame, values: list[str], reps: int) -> DataFrame:
    """units (side, unit, *values) -> (rep, side, *values). A replicate has n units on average only; every run draws alike."""
    blocks = -(-reps // EACH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        lot = 0
        for batch in batches:
            for a in range(0, len(batch), 512):
                some = batch.slice(a, 512)
                sides, names, matrix = np.array(some.column(0).to_pylist()), some.column(1).to_pylist(), _matrix(some.columns[3:])
                lot = some.column(2)[0].as_py()
                times = poisson_times([f"{u}:{s}" if u is not None else s for u, s in zip(names, sides)], blocks)
                for s in set(sides.tolist()):
                    own = sides == s
                    sums[s] = sums.get(s, 0) + times[own].T.astype(np.float64) @ matrix[own]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([lot] * len(sums), pa.int64()), pa.array([_packed(x) for x in sums.values()], pa.binary())], ["side", "lot", "sums"])

    rows = units.select("side", F.col("unit").cast("string").alias("unit"), (F.spark_partition_id() % LOTS).cast("long").alias("lot"), *values)
    return _totals(rows.mapInArrow(run, "side string, lot long, sums binary"), values, reps)


def exact_sums(units: DataFrame, values: list[str], reps: int, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """units (side, unit, *values) -> (rep, side, *values) over n draws from the n units of a side, in every replicate.

    The same units and seed give the same draws, however they are partitioned.
    Unit names that repeat are ordered by their values.
    """
    rows = numbered(units.select("side", "unit", *values), ["side"], ["unit", *values])
    n = rows.groupBy("side").agg(F.count("*").alias("n"))  # a row a side
    placed = rows.join(F.broadcast(n), "side").select("side", F.floor(F.col("idx") / block).alias("block"), "n", "idx", *values)

    def drawn(rows: pa.Table) -> pa.Table:
        side, k, n = (rows.column(c)[0].as_py() for c in ("side", "block", "n"))
        matrix = _matrix([rows.column(v).combine_chunks() for v in values])[np.argsort(rows.column("idx").to_numpy())]
        sums = block_sums(matrix, draws(seed, side, n, block, k, reps), generator(seed, side, "block", k))
        return pa.table([pa.array([side]), pa.array([k % LOTS], pa.int64()), pa.array([_packed(sums)], pa.binary())], ["side", "lot", "sums"])

    return _totals(placed.groupBy("side", "block").applyInArrow(drawn, "side string, lot long, sums binary"), values, reps)
