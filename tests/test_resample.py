"""Exact resamples: n draws of n units in every replicate, in any blocks and partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegrain.operators import resample as RS

VALUES = ["one", "x"]


def units(spark, n_a, n_b):
    rows = [("a", f"u{k:03}", 1, k * k) for k in range(n_a)] + [("b", f"u{k:03}", 1, 3) for k in range(n_b)]
    return spark.createDataFrame(rows, "side string, unit string, one long, x long")


def test_numbers_run_from_zero_in_every_group(spark):
    rows = spark.range(1000).select((F.col("id") % 7 == 0).cast("string").alias("side"), F.sha2(F.col("id").cast("string"), 256).alias("unit"))
    got = {(r.side, r.unit): r.idx for r in RS.numbered(rows.repartition(13), ["side"], ["unit"]).collect()}
    for side in ("true", "false"):
        assert [got[k] for k in sorted(k for k in got if k[0] == side)] == list(range(sum(k[0] == side for k in got)))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_every_replicate_has_n_draws(spark, block):
    got = RS.exact_sums(units(spark, 50, 3), VALUES, 40, block=block).collect()
    assert sorted((r.rep, r.side) for r in got) == sorted((k, s) for k in range(40) for s in "ab")
    assert all(r.one == {"a": 50, "b": 3}[r.side] for r in got)
    assert all(r.x == 9 for r in got if r.side == "b") and len({r.x for r in got if r.side == "a"}) > 30


def test_draws_do_not_hang_on_partitions(spark):
    u = units(spark, 90, 40)
    assert sorted(RS.exact_sums(u, VALUES, 20, block=16).collect()) == sorted(RS.exact_sums(u.orderBy(F.desc("unit")).repartition(9), VALUES, 20, block=16).collect())
    assert sorted(RS.exact_sums(u, VALUES, 20, 1, 16).collect()) != sorted(RS.exact_sums(u, VALUES, 20, 2, 16).collect())


@pytest.mark.parametrize("n, block", [(1, 4), (10, 4), (1000, 64), (1001, 7)])
def test_blocks_share_the_draws(n, block):
    each = np.stack([RS.draws(7, "a", n, block, k, 500) for k in range(-(-n // block))])
    assert (each.sum(0) == n).all() and (each >= 0).all()
    sizes = np.array([min(block, n - k * block) for k in range(len(each))])
    spread = np.sqrt(sizes * (1 - sizes / n) / 500) + 1e-9
    assert (abs(each.mean(1) - sizes) < 6 * spread).all()
    assert (abs(each.var(1) - sizes * (1 - sizes / n)) < 0.6 * sizes + 1e-9).all()


def test_draws_of_a_block_are_even():
    counts = RS.block_sums(np.eye(20), np.full(3000, 20), RS.generator(1))
    assert (counts.sum(1) == 20).all()
    assert abs(counts.mean(0) - 1).max() < 0.1 and abs(counts.var(0) - 0.95).max() < 0.15
    assert abs(np.corrcoef(counts.T)[0, 1:] + 1 / 19).max() < 0.08


def test_no_unit_gives_no_replicate(spark):
    none = units(spark, 1, 1).where("false")
    assert RS.exact_sums(none, VALUES, 5).collect() == [] == RS.poisson_sums(none, VALUES, 5).collect()


def test_poisson_sums_are_those_of_single_units(spark):
    u = units(spark, 40, 30)
    got = {(r.rep, r.side): (r.one, r.x) for r in RS.poisson_sums(u.repartition(5), VALUES, 21).collect()}
    want = {}
    for r in u.collect():
        times = RS.poisson_times([f"{r.unit}:{r.side}"], 3)[0]
        for k in range(21):
            a, b = want.get((k, r.side), (0, 0))
            want[k, r.side] = a + int(times[k]), b + int(times[k]) * r.x
    assert got == want
