"""N-gram Jaccard join by parity sketches, and the classes it forms.

A document's set is its distinct word shingles, as 64-bit hashes. Two sets with
Jaccard similarity t or more differ in at most (1 - t) / (1 + t) * (n1 + n2)
elements. A parity sketch gives each element a place and flips the bit, or
XORs the word, at that place; the Hamming distance of two sketches is at most
the number of elements in which the sets differ.

Candidates. Sizes fall into bands such that two sets that can be similar share
one. In a band, at most k elements may differ; the sketch has k + 1 + s words,
so at least s + 1 words of two similar sets are equal. Words are put in one
order, fullest first, and each set keeps its first k + 1: of s + 1 equal words
one is kept by both sets (the prefix principle). So no pair is lost, and the
words with next to no element, which unrelated sets share, are not keys.

Pairs. Equal sets are one node from the start. Among the nodes of a key, first
only the one with most neighbours is held against the others: in a group of
copies that is the copy nearest to all. What is verified forms classes.
Then nodes of a key that are still in different classes are held against each
other by their bit sketches, inside the task. Up to three times each class puts
out only its nearest pair to another class, as in Boruvka's algorithm, which joins
nearly all of a large group (the nearest of each pair of blocks, where a group
is larger than a block, so that no task holds a whole group); at last every pair of different classes that
passes and has not been tried is put out and verified. A pair inside a class
changes nothing and is never made.

Defined cases: a null or blank text has the empty set, which is linked with
nothing; repeated rows are equal sets; null ids are kept, and the smallest id
of a class is its smallest id that is not null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, drop, need, release, tidy, unpacked, with_row
from .components import components

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
LOT_BYTES = 1 << 20
#: Sketch bits for each element that may differ: so many that dissimilar sets seldom pass.
BITS_EACH = 16
#: Pairs a task holds before it puts them out.
MOST_HELD = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * MIX[0]
        x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in SPACES]] = True
INVERSE = U(pow(int(ODD), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, 2 * LOT_BYTES), base, U)
        steps[0] = 1
        held = np.cumprod(steps)
        if n <= 4 * LOT_BYTES:
            _POWERS[int(base)] = held
    return held[:n]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters are folded and ASCII white space parts words.

    A word's hash is a polynomial in its bytes, as the difference of two prefix
    sums brought back to place 0; a shingle's is a polynomial in its words.
    """
    data = np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8)
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))  # where words begin and end, in turn
    starts, stops = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[data] * powers(ODD, len(data)))])
        word = mix((run[stops] - run[starts]) * powers(INVERSE, len(data))[starts])
        shingle = np.zeros(len(word), U)
        for k in range(width):
            shingle[: len(word) - k] += word[k:] * powers(ODD, width)[k]
        shingle = mix(shingle + U(width))
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    out = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        if b - a >= width:
            out.append(np.unique(shingle[a : b - width + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(word[a:b] * powers(ODD, width)[: b - a]).sum(dtype=U) + U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def byte_lots(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts as bytes, null as none, in lots of about a megabyte."""
    lot, n = [], 0
    for t in texts.cast(pa.binary()):
        lot.append(t.as_py() or b"")
        n += len(lot[-1])
        if n >= LOT_BYTES:
            yield lot
            lot, n = [], 0
    if lot:
        yield lot


class Bands:
    """Bands of sizes for a similarity of ``percent`` / 100 or more; all bounds are whole numbers."""

    def __init__(self, percent: int, ratio: float = 1.35, spare: float = 0.3):
        self.percent, self.ratio, self.spare = percent, ratio, spare
        #: Sets smaller than this are only similar to equal ones.
        self.least = -(-percent // (100 - percent))
        self.starts = [self.least]

    def start(self, band: int) -> int:
        while len(self.starts) <= band:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.ratio)))
        return self.starts[band]

    def largest_partner(self, n: int) -> int:
        return n * 100 // self.percent

    def differ(self, total: int) -> int:
        """Most elements in which similar sets of ``total`` elements together can differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        """Bands of a set of size n: the one its size lies in, and those whose largest size has n as a partner."""
        if n < self.least:
            return []
        home = 0
        while self.start(home + 1) <= n:
            home += 1
        out = [home]
        while out[-1] > 0 and n <= self.largest_partner(self.start(out[-1]) - 1):
            out.append(out[-1] - 1)
        return out

    def bound(self, band: int) -> int:
        top = self.start(band + 1) - 1
        return self.differ(top + self.largest_partner(top))

    def bits(self, n: int) -> int:
        """Bits of the sketch of a set of size n: a power of two."""
        return 1 << max(6, math.ceil(math.log2(max(1, BITS_EACH * self.differ(2 * n)))))


def keys(u: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """The k + 1 keys of set ``u`` in a band."""
    keep = bands.bound(band) + 1
    places = keep + math.ceil(bands.spare * keep)
    with np.errstate(over="ignore"):
        place = (((u >> U(32)) * U(places)) >> U(32)).astype(np.int64)  # u is sorted, so the places are as well
        size = np.bincount(place, minlength=places)
        word = np.zeros(places, U)
        full = size > 0
        word[full] = np.bitwise_xor.reduceat(u, np.concatenate([[0], np.cumsum(size[full])[:-1]]))
        name = mix(mix(word + size.astype(U) * ODD) + (np.arange(places, dtype=U) << U(20)) + U(band))
    return name[np.lexsort((name, -size))[:keep]].view(np.int64)


def sketch(u: np.ndarray, bits: int) -> bytes:
    """Parity bits; a sketch of fewer bits is the XOR of the halves of a longer one."""
    return np.packbits(np.bincount((u & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def folded(data: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def name(u: np.ndarray, seed: int) -> int:
    """A set's name: a 64-bit hash of its sorted elements."""
    import xxhash

    return xxhash.xxh64_intdigest(u.tobytes(), seed) - (1 << 63)


def sets(docs: DataFrame, width: int, bands: Bands, seed: int) -> DataFrame:
    """docs (id, key, text) -> (id, key, n, node, check, sketch): node and check are names of the whole set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lot in byte_lots(batch.column(2)):
                n, node, check, bits = [], [], [], []
                for u in shingle_sets(lot, width):
                    n.append(len(u)), node.append(name(u, seed)), check.append(name(u, seed + 1)), bits.append(sketch(u, bands.bits(len(u))))
                ids = [batch.column(k).slice(at, len(lot)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(x, pa.int64()) for x in (n, node, check)], pa.array(bits, pa.binary())], ["id", "key", "n", "node", "check", "sketch"])
                at += len(lot)

    return docs.mapInArrow(tidy(run), f"id {kind}, key binary, n long, node long, check long, sketch binary")


def keyed(texts: DataFrame, width: int, bands: Bands, seed: int) -> DataFrame:
    """(text) -> (key, node), the keys of every text in every band of its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in byte_lots(batch.column(0)):
                found, node = [], []
                for u in shingle_sets(lot, width):
                    for b in bands.of(len(u)):
                        found.append(keys(u, b, bands)), node.append(np.full(len(found[-1]), name(u, seed)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(node))], ["key", "node"])

    return texts.mapInArrow(tidy(run), "key long, node long")


def in_runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[np.ndarray, pa.RecordBatch, int | None]]:
    """Batches cut so that rows of one value of the first column, which are neighbours, stay together.

    With ``most``, a run of so many rows is not held: it comes in parts, and its
    value is the third item of each tuple that holds some of it.
    """
    held: list[pa.RecordBatch] = []
    last = long = None

    def put() -> tuple[np.ndarray, pa.RecordBatch, int | None]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t.column(0).to_numpy(), t.to_batches()[0], long

    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if held and key[0] != last:  # the run ended with its batch
            yield put()
            held = []
        last = key[-1]
        others = np.flatnonzero(key != last)
        if len(others):
            held.append(batch.slice(0, int(others[-1]) + 1))
            yield put()
            held = [batch.slice(int(others[-1]) + 1)]
        else:
            held.append(batch)
        if most and sum(map(len, held)) >= most:
            long = int(last)
            yield put()
            held = []
    if held:
        yield put()


def shared_keys(most: int):
    """Sorted (key, node) -> (group, node, size): the sets of nodes, two or more, that share a key.

    A set is named by a hash of its nodes, so keys with the same nodes give the
    same rows. A key of ``most`` rows or more is not held: its rows go on as they
    come, and its set is named by the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, batch, long in in_runs(batches, most):
            node = batch.column(1).to_numpy()
            own = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[own], node[own]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            with np.errstate(over="ignore"):
                group = mix(np.add.reduceat(mix(node.view(U)), starts) + sizes.astype(U)).view(np.int64)
            if long is not None:
                part = key[starts] == long
                group = np.where(part, mix(key[starts].view(U)).view(np.int64), group)
            else:
                part = np.zeros(len(starts), bool)
            many = np.repeat((sizes > 1) | part, sizes)
            if many.any():
                rows = pa.table([np.repeat(group, sizes)[many], node[many], np.repeat(np.where(part, most, sizes), sizes)[many]], ["group", "node", "size"])
                yield from rows.group_by(["group", "node", "size"]).aggregate([]).combine_chunks().to_batches()

    return run


def sketch_filter(bands: Bands):
    """(u, v, n, sketch, n2, sketch2) -> (u, v) whose sketches allow similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, a, m, b in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 5)]):
                size = min(len(a), len(b))
                low, high = min(n, m), max(n, m)
                keep.append(high <= bands.largest_partner(low) and int(hamming(folded(a, size), folded(b, size))) <= bands.differ(n + m))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def in_blocks(left: DataFrame, block: int) -> DataFrame:
    """left (group, m, node, class, n, sketch) -> (lot, group, low, high, node, class, n, sketch), sorted by lot.

    A group of m nodes is dealt to about m / block blocks by hash, and a lot is
    a pair of blocks, so no task holds more than two blocks of a group and any
    two nodes of a group meet in a lot.
    """
    parts = F.ceil(F.col("m") / F.lit(block)).cast("long")
    dealt = left.select("*", F.pmod(F.xxhash64("node"), parts).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    pair = dealt.select("group", F.least("b", "other").alias("low"), F.greatest("b", "other").alias("high"), "b", "node", "class", "n", "sketch")
    lots = pair.select(F.xxhash64("group", "low", "high").alias("lot"), "group", "low", "high", (F.col("b") == F.col("low")).cast("long").alias("first"), "node", "class", "n", "sketch")
    return lots.repartition("lot").sortWithinPartitions("lot", "group", "low", "high", F.desc("first"), "node")


def across_classes(bands: Bands, nearest: bool):
    """Rows of :func:`in_blocks` -> (group, u, v): nodes of different classes whose sketches allow similarity.

    With ``nearest``, each class of a lot only puts out its pair of least distance.
    """

    def found_rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["group", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch, _ in in_runs(batches):
            group, low, high, first, node, of, n = (batch.column(k).to_numpy() for k in range(1, 8))
            bits = batch.column(8)
            found: list[tuple[int, int, int]] = []
            seen: set[tuple[int, int]] = set()  # pairs of this batch, which many groups share
            edge = (group[1:] != group[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.flatnonzero(np.concatenate([[True], edge, [True]]))
            for a, b in zip(starts[:-1], starts[1:]):
                own: set[tuple[int, int]] = set()
                least = min(len(bits[k].as_buffer()) for k in range(a, b))
                rows = np.stack([folded(bits[k].as_py(), least) for k in range(a, b)])
                best: dict[int, tuple[float, int, int]] = {}
                # Within one block all pairs; of two blocks the first's nodes, which come first, with the second's.
                between = low[a] != high[a]
                second = a + int(first[a:b].sum())
                for i in range(a, second if between else b - 1):
                    start = second if between else i + 1
                    m = n[start:b]
                    near = np.flatnonzero((of[start:b] != of[i]) & (np.maximum(m, n[i]) <= np.minimum(m, n[i]) * 100 // bands.percent))
                    if not len(near):
                        continue
                    away = hamming(rows[near + (start - a)], rows[i - a])
                    passed = away <= (m[near] + n[i]) * (100 - bands.percent) // (100 + bands.percent)
                    for j, far_away in zip((near[passed] + start).tolist(), away[passed].tolist()):
                        pair = (int(min(node[i], node[j])), int(max(node[i], node[j])))
                        if not nearest:
                            own.add(pair)
                            continue
                        far = (far_away / (n[i] + n[j]), *pair)
                        for c in (of[i], of[j]):
                            if c not in best or far < best[c]:
                                best[c] = far
                    if len(own) >= MOST_HELD:
                        yield found_rows([(int(group[a]), u, v) for u, v in own])
                        own = set()
                own.update(x[1:] for x in best.values())
                if not nearest:
                    fresh = own.difference(seen)
                    seen |= fresh
                    own = fresh
                found += [(int(group[a]), u, v) for u, v in own]
            if found:
                yield found_rows(found)

    return run


def verify(percent: int):
    """(u, v, set, set) -> (u, v) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def set_table(width: int):
    """(node, text) -> (node, set)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lot in byte_lots(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lot)), pa.array([u.tobytes() for u in shingle_sets(lot, width)], pa.binary())], ["node", "set"])
                at += len(lot)

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, seed: int = 0, block: int = 2048, most: int = 1 << 22) -> DataFrame:
    """One row a document: id, n_shingles, component_id, text_key (md5 of the text), class (null without a word).

    A task holds about two blocks of ``block`` nodes of a group, and fewer than
    ``most`` rows of a key and a batch; neither bound drops a pair.
    """
    bands = Bands(percent)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    table = cut(sets(rows, width, bands, seed), "sets")
    known = table.where("n > 0")
    nodes = cut(known.groupBy("node").agg(F.min("key").alias("text_key"), F.min("id").alias("least"), F.min("n").alias("n"), F.max("sketch").alias("sketch"), F.min("check").alias("c1"), F.max("check").alias("c2")), "nodes")
    if nodes.where("c1 <> c2").limit(1).count():  # two sets of one name: take other names
        return jaccard_classes(docs, id_col, text_col, width, percent, seed + 2, block, most)

    # Groups of nodes that share a key. One shuffle by key; repeats of a node in a key go in the task.
    dealt = keyed(rows.select("text"), width, bands, seed).repartition("key").sortWithinPartitions("key", "node")
    runs = cut(dealt.mapInArrow(tidy(shared_keys(most)), "group long, node long, size long").distinct(), "runs")
    release(docs.sparkSession)
    info = nodes.select(F.col("node").alias("of"), "n", "sketch")
    # The texts of the nodes that share a key; a text comes once, whatever its copies.
    wanted = runs.select(F.col("node").alias("of")).distinct().join(nodes, F.col("of") == F.col("node")).select("node", "text_key")
    once = rows.groupBy("key").agg(F.first("text").alias("text"))
    texts = cut(wanted.join(once, F.col("text_key") == F.col("key")).select("node", "text"), "texts")
    release(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs of a written table that are similar, by their whole sets."""
        ends = pairs.select(F.col("u").alias("of")).union(pairs.select("v")).distinct()
        held = cut(texts.join(ends, F.col("node") == F.col("of"), "left_semi").mapInArrow(tidy(set_table(width)), "node long, set binary"), "set-bytes")
        a, b = held.toDF("nu", "x"), held.toDF("nv", "y")
        out = cut(pairs.join(a, F.col("u") == F.col("nu")).join(b, F.col("v") == F.col("nv")).select("u", "v", "x", "y").mapInArrow(tidy(verify(percent)), "u long, v long"), "links")
        drop(held)
        return out

    weight = runs.groupBy(F.col("node").alias("of")).agg(F.sum("size").alias("weight"))
    weighed = runs.select("group", "node").join(weight, F.col("node") == F.col("of"))
    lead = weighed.groupBy(F.col("group").alias("g")).agg(F.max(F.struct("weight", "node"))["node"].alias("lead"))
    stars = runs.join(lead, F.col("group") == F.col("g")).where("node <> lead").select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v")).distinct()
    a, b = info.toDF("nu", "n1", "s1"), info.toDF("nv", "n2", "s2")
    stars = stars.join(a, F.col("u") == F.col("nu")).join(b, F.col("v") == F.col("nv")).select("u", "v", "n1", "s1", "n2", "s2")
    tried = cut(stars.mapInArrow(tidy(sketch_filter(bands)), "u long, v long"), "stars")
    links = verified(tried)
    first = cut(components(links), "classes")
    # A group of two has had its only pair tried. A group that puts out no pair once never will: classes only grow.
    active = runs.where("size > 2").select("group", "node")
    more = True
    for nearest in (True, True, True, False):
        if nearest and not more:
            continue
        by_class = active.join(first.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("group", "node", F.coalesce("component", "node").alias("class"))
        mixed = by_class.groupBy(F.col("group").alias("g")).agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("m")).where("a <> b").select("g", "m")
        left = by_class.join(mixed, F.col("group") == F.col("g")).join(info, F.col("node") == F.col("of")).select("group", "m", "node", "class", "n", "sketch")
        found = cut(in_blocks(left, block).mapInArrow(tidy(across_classes(bands, nearest)), "group long, u long, v long"), "found")
        pairs = found.select("u", "v").distinct().join(tried.toDF("su", "sv"), (F.col("u") == F.col("su")) & (F.col("v") == F.col("sv")), "left_anti")
        pairs = cut(pairs, "pairs")
        if more := bool(pairs.limit(1).count()):
            links, tried = links.union(verified(pairs)), tried.union(pairs)
            first = cut(components(links), "classes")
        if nearest and more:  # later rounds have other classes to hold against each other
            active = cut(active.join(found.select(F.col("group").alias("g")).distinct(), F.col("group") == F.col("g"), "left_semi"), "active")

    # Classes of nodes, then of documents: the least id of a class.
    named = nodes.select("node", "least").join(first.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    leasts = named.groupBy(F.col("class").alias("c")).agg(F.min("least").alias("component_id"))
    by_node = named.join(leasts, F.col("class") == F.col("c")).select(F.col("node").alias("of"), "class", "component_id")
    own = table.select("id", "key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))  # no word: no node
    out = own.join(by_node, F.col("node") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("key").alias("text_key"), "class")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, null ids last. Rows without a word all stay."""
    classes = jaccard_classes(docs, id_col, text_col, **options).where("n_shingles > 0")
    best = classes.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_key")).alias("b"))
    best = best.select(F.col("b.id").alias("of_id"), F.col("b.text_key").alias("of_key"))
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = with_row(docs, i=id_col, t=text_col).select("row", "i", F.unhex(F.md5(text)).alias("k"), (F.btrim(text, F.lit(SPACES)) == "").alias("blank"))
    same = F.col("i").eqNullSafe(F.col("of_id")) & (F.col("k") == F.col("of_key"))
    # Rows of one id and one text may differ in other columns: that of the least JSON form stays, so that reruns agree.
    kept = rows.where("not blank").join(best, same, "left_semi").groupBy("i", "k").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return unpacked(kept.select("row").union(rows.where("blank").select("row")), docs)
