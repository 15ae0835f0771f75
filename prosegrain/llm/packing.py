"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous best-fit. Documents (of fewer tokens than a sequence) and gaps
(the room left in open sequences) are range-sorted together by size, at least
``ranges`` ranges at every size of input; counts by size, of which there are no
more than ``2 * capacity``, give the ranges' bounds. A sweep over each range
fits every document, largest first, into the smallest gap of its range that
takes it. What a range cannot match meets the rest through the ranges' counts:
untouched gaps of a range take the largest documents left in the ranges below,
matched by rank, so no two want the same place. Gaps are updated and the round
is repeated until no document is left. Where no gap takes the smallest document
left, as at the start, as many sequences are opened as the rest needs at least.

Longer documents are cut into full sequences and a last piece.

A round reads the state that the round before wrote to the shared folder, so a
lost executor repeats at most a round. The driver sees the counts by size and
a few numbers for each range, of which there is one for ``per_range`` documents
and gaps.

Defined cases: a null text is an empty one, which is one end id; repeated rows
are documents of their own; equal sizes are taken in the order of the pieces'
numbers; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import operator
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, need, tidy
from .tokens import WordEncoder, default_path, encoder, lots

#: Most documents and gaps that one sweep takes, and the least number of ranges of a round.
PER_RANGE, RANGES = 50_000, 4


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; the end id belongs to the document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep_old=False)
        try:
            yield from encoded(enc, batches)
        finally:
            enc.forget()  # the rounds that follow need the memory

    def encoded(enc: WordEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lot in lots(batch.column(1)):
                of, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(enc.each(lot, end_id), at):
                    for n, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a : a + capacity]
                        of.append(k), piece.append(n), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part))
                at += len(lot)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    return need(docs, id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Gaps:
    """Gaps by size: the smallest that is large enough is found and updated in the logarithm of the number of sizes."""

    def __init__(self):
        self.sizes: list[int] = []
        self.of: dict[int, list[int]] = {}

    def add(self, size: int, gap: int) -> None:
        if size not in self.of:
            bisect.insort(self.sizes, size)
            self.of[size] = []
        self.of[size].append(gap)

    def fit(self, size: int) -> tuple[int, int] | None:
        k = bisect.bisect_left(self.sizes, size)
        if k == len(self.sizes):
            return None
        room = self.sizes[k]
        gap = self.of[room].pop()
        if not self.of[room]:
            del self.of[room], self.sizes[k]
        return room, gap


def best_fit(items: list[tuple[int, int]], gaps: list[tuple[int, int]]):
    """Best fit of (size, item), sorted, largest first, into (size, gap).

    Gives (placed: item -> gap, rest of items largest first, gap -> room left, gaps not touched in order of size).
    """
    open_ = Gaps()
    for size, gap in gaps:
        open_.add(size, gap)
    placed, rest, room_left = {}, [], {}
    least = items[0][0] if items else 0
    for size, item in reversed(items):
        got = open_.fit(size)
        if got is None:
            rest.append((size, item))
            continue
        room, gap = got
        placed[item] = gap
        room_left[gap] = room - size
        if room - size >= least:
            open_.add(room - size, gap)
    return placed, rest, room_left, [(s, g) for s, g in gaps if g not in room_left]


SWEPT = "part int, is_gap boolean, id long, size long, bin long, rank long"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges: rows (part, is_gap, id, size) in, rows of SWEPT out.

    A document has ``bin`` if it was placed, else ``rank`` (0: the largest). A
    gap has its room left; if nothing was put into it, ``rank`` (0: the smallest).
    """
    all_rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    for part, of_part in itertools.groupby(all_rows, operator.itemgetter(0)):
        items, gaps = [], []
        for _, is_gap, i, size in of_part:
            (gaps if is_gap else items).append((size, i))
        size_of = {i: s for s, i in items}
        placed, rest, room, untouched = best_fit(items, gaps)
        rows = [(part, False, i, size_of[i], g, None) for i, g in placed.items()]
        rows += [(part, False, i, s, None, k) for k, (s, i) in enumerate(rest)]
        rows += [(part, True, g, s, None, None) for g, s in room.items()] + [(part, True, g, s, None, k) for k, (s, g) in enumerate(untouched)]
        for k in range(0, len(rows), 20_000):
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000]), kinds)], ["part", "is_gap", "id", "size", "bin", "rank"])


def successors(parts: list) -> list[tuple[int, int, int, int, int, int]]:
    """Matches between ranges: (item range, first item rank, items, gap range, first gap rank, items a gap).

    ``parts``: (part, items left, largest item, gaps left, smallest gap) by
    range. Every gap of a range takes any document of a lower range. The
    nearest lower range comes first; what room the last gap certainly has then
    goes to the next one.
    """
    out, stack = [], []
    for part, n_items, largest, n_gaps, smallest in parts:
        at, spare = 0, 0
        while stack and (at < n_gaps or spare >= stack[-1][3]):
            of, first, left, top = stack.pop()
            if spare >= top:  # into the gap used last
                to, each = at - 1, spare // top
                n = min(left, each)
                spare -= n * top
            else:
                to, each = at, smallest // top
                n = min(left, (n_gaps - at) * each)
                at += -(-n // each)
                spare = smallest - (n - (at - to - 1) * each) * top
            out.append((of, first, n, part, to, each))
            if n < left:
                stack.append((of, first + n, left - n, top))
        if n_items:
            stack.append((part, 0, n_items, largest))
    return out


def crossed(swept: DataFrame, found: list[tuple]) -> DataFrame:
    """(is_gap, id, size, bin) after a round: ``swept`` with the ranges' matches carried out.

    Documents with a bin are placed, by the sweep or now. A document and the gap it goes to meet by
    the gap's range and rank, in one shuffle; a gap takes ``capacity`` documents at most.
    """
    loose, met = F.col("bin").isNull() & ~F.col("is_gap"), F.col("is_gap") & F.col("rank").isNotNull()
    hit = (F.col("part") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    want = F.col("at") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))
    names = ["of", "first", "n", "to", "at", "each"]
    pairs = local(swept, dict(zip(names, zip(*found) if found else [[]] * 6)))
    wanted = swept.where(loose).join(pairs, hit, "left").select("is_gap", "id", "size", "to", want.alias("want"))
    room = swept.where(met).select("is_gap", "id", "size", F.col("part").cast("long").alias("to"), F.col("rank").alias("want"))
    groups = wanted.where("to is not null").unionByName(room).groupBy("to", "want").agg(
        F.max(F.when(F.col("is_gap"), F.col("id"))).alias("gap"),
        F.sum(F.when(F.col("is_gap"), F.col("size")).otherwise(-F.col("size"))).alias("left"),
        F.collect_list(F.when(~F.col("is_gap"), F.struct("id", "size"))).alias("docs"),
    )
    no_bin = F.lit(None).cast("long")

    def row(is_gap: bool, id_: Column, size: Column, bin_: Column) -> Column:
        return F.struct(F.lit(is_gap).alias("is_gap"), id_.alias("id"), size.alias("size"), bin_.alias("bin"))

    put = F.transform("docs", lambda d: row(False, d["id"], d["size"], F.col("gap")))
    after = groups.select(F.inline(F.concat(put, F.array(row(True, F.col("gap"), F.col("left"), no_bin)))))
    same = swept.where(~loose & ~met).select("is_gap", "id", "size", "bin")
    unmet = wanted.where("to is null").select("is_gap", "id", "size", no_bin.alias("bin"))
    return same.union(unmet).union(after)


def local(like: DataFrame, columns: dict) -> DataFrame:
    """A small table of long columns whose size the planner knows."""
    return like.sparkSession.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}))


def dealt(state: DataFrame, held: dict[tuple[int, bool], int], ranges: int) -> DataFrame:
    """(part, is_gap, id, size) of ``state`` in ranges of like many rows, sorted by part and size.

    ``held``: rows by (size, is gap); others are left out. Equal rows are
    spread by hash over the ranges that their size and kind take up.
    """
    sizes, kinds = zip(*sorted(held))
    each = [held[k] for k in sorted(held)]
    total, before = sum(each), list(itertools.accumulate(each, initial=0))[:-1]
    classes = local(state, {"of_size": sizes, "of_gap": map(int, kinds), "before": before, "rows": each})
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("rows"))
    known = state.join(classes, (F.col("size") == F.col("of_size")) & (F.col("is_gap").cast("long") == F.col("of_gap")))
    rows = known.select(F.floor(place * ranges / total).cast("int").alias("part"), "is_gap", "id", "size")
    return rows.repartitionById(ranges, "part").sortWithinPartitions("part", "size", "is_gap", "id")


def pack(docs: DataFrame, capacity: int = 4096, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", per_range: int = PER_RANGE, ranges: int = RANGES) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    table = pieces(docs, tokenizer_path or default_path(), capacity, end_id, id_col, text_col)
    table = cut(table.withColumn("item", F.monotonically_increasing_id()), "pieces")  # written, so the numbers stay
    whole = table.where(F.col("length") >= capacity).select("item", (F.col("item") * 2 + 1).alias("sequence_id"))
    items = table.where(F.col("length") < capacity).select(F.col("item").alias("id"), F.col("length").alias("size"))

    def rows(df: DataFrame, is_gap: bool) -> DataFrame:
        return df.select(F.lit(is_gap).alias("is_gap"), "id", "size")

    state, opened, rounds = rows(items, False), 0, []  # documents and gaps before a round
    while True:
        held = {(r.size, r.is_gap): r.n for r in state.groupBy("size", "is_gap").agg(F.count("*").alias("n")).collect()}
        sizes = [size for size, is_gap in held if not is_gap]
        if not sizes:
            break
        held = {k: n for k, n in held.items() if k[0] >= min(sizes)}  # smaller gaps take nothing more
        if not any(is_gap for _, is_gap in held):  # nothing fits anywhere: open what the rest needs at least
            more = -(-sum(size * n for (size, _), n in held.items()) // capacity)
            new = spark.range(opened, opened + more).select("id", F.lit(capacity).cast("long").alias("size"))
            state, opened, held = state.unionByName(rows(new, True)), opened + more, held | {(capacity, True): more}
        in_ranges = dealt(state, held, max(ranges, -(-sum(held.values()) // per_range)))
        swept = cut(in_ranges.mapInArrow(tidy(sweep), SWEPT), "swept")
        left, gap = F.col("bin").isNull() & ~F.col("is_gap"), F.col("is_gap") & F.col("rank").isNotNull()
        of = [F.count_if(left), F.max(F.when(left, F.col("size"))), F.count_if(gap), F.min(F.when(gap, F.col("size")))]
        parts = sorted(tuple(p) for p in swept.groupBy("part").agg(*of).collect())
        rounds.append(cut(crossed(swept, successors(parts)), "packed"))
        state = rounds[-1].where("bin is null").select("is_gap", "id", "size")
        drop(swept)
    placed = whole
    if rounds:
        log = spark.read.schema("c0 boolean, c1 long, c2 long, c3 long").parquet(*[r.cut_path for r in rounds]).toDF("is_gap", "id", "size", "bin")
        placed = whole.unionByName(log.where("not is_gap and bin is not null").select(F.col("id").alias("item"), (F.col("bin") * 2).alias("sequence_id")))
    out = table.join(placed.withColumnRenamed("item", "of"), F.col("item") == F.col("of"))
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), "item").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
