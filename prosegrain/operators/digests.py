"""SHA-256 digests of pieces of text in order, for groups of any size.

A digest is made in order from its first byte to its last, so one task must see
all bytes of a group; but it need not see its rows. Rows are range-sorted over
all groups and packed into large pieces where they lie; the task that makes a
digest then takes the pieces in order and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a packed piece, about.
PACKED = 1 << 20


def ordered_digests(rows: DataFrame, key: str, order: list[str], piece: str, opens: str = "", between: str = "", closes: str = "") -> DataFrame:
    """(key, sha256): for each ``key``, the digest of ``opens``, its pieces in the order of ``order`` with ``between`` among them, and ``closes``."""
    chosen = rows.select(F.col(key).cast("string").alias("key"), F.col(piece).cast("string").alias("piece"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    by = ["key", *[f"o{k}" for k in range(len(order))]]
    at = chosen.repartitionByRange(*by).sortWithinPartitions(*by).select("key", F.monotonically_increasing_id().alias("at"), "piece")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([between.join(held)])], ["key", "first", "piece"])

        for batch in batches:
            for k, n, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (k != key or size >= PACKED):
                    yield put()
                    held, size = [], 0
                if not held:
                    key, first = k, n
                held.append(text or "")
                size += len(held[-1])
        if held:
            yield put()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def put() -> pa.RecordBatch:
            state.update(closes.encode())
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "sha256"])

        for batch in batches:
            for k, _, text in zip(*[c.to_pylist() for c in batch.columns]):
                if state is not None and k == key:
                    state.update((between + text).encode())
                    continue
                if state is not None:
                    yield put()
                key, state = k, hashlib.sha256((opens + text).encode())
        if state is not None:
            yield put()

    packed = at.mapInArrow(pack, "key string, first long, piece string")
    return packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, sha256 string").withColumnRenamed("key", key)
