"""Conversation prefix trie: every distinct sequence of first turns is a node with its rollups.

Names. A turn's label is the md5 of its role and text. A node's name is its depth
and two 64-bit words: the XOR over its turns of a hash of (label, place), so a
prefix's name follows from the one before, and long conversations are named
piece by piece: rows are range-sorted, a piece is what one range holds of one
conversation, and pieces are joined by running XORs over one row a piece.

Shards. A node's weight is the number of turns of its members from it on, which
no subtree's number of nodes exceeds. Nodes above ``limit`` are heavy; they are
closed under parents. The subtrees that hang below them are the shards: each is
bounded, is built in one task as a succinct level-order trie (LOUDS: a node's
children as ones, then a zero; names and counts as arrays in that order), and
is rolled up by adding every level to its parents, the last level first.

Upper levels. Each heavy node and each top of a shard belongs to its smallest
member. What it adds to its ancestors stands in that conversation's own rows,
as sums from the end, and a sum by name over rows yields the rollups of
all heavy nodes at once, with no loop over levels. Ids that end in a heavy node
are packed in range-sorted order; one task then passes a node's packed ids
through SHA-256, which only goes in order, and holds one piece at a time.

Defined cases: rows without a conversation id are in no conversation; null
turns come first, equal ones are ordered by their labels; null role and text are
empty; repeated rows are turns of their own; an empty table has no node at all;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, need, tidy
from .jaccard_join import in_runs

#: Turns under the top of a shard at most.
LIMIT = 1 << 14
#: Ids in one piece of text on their way to a digest.
PACKED = 1 << 13
NAME = ["depth", "x", "y"]
EMPTY = hashlib.sha256().hexdigest()


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, pos, label, words), a row a turn, written: places from 0 in each conversation; a part is a range of rows."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = need(turns, id_col, turn_col, role_col, text_col).where(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), label.alias("label"), n_words(F.col(text_col)).alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("label")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number holds the range in its upper bits and the row's place in the range in the lower 33.
    at = cut(ranged.select("conv", "label", "words", F.monotonically_increasing_id().alias("at")), "turns")
    at = at.withColumn("part", F.shiftright("at", 33))
    pieces = at.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = at.join(pieces.withColumn("before", before), ["conv", "part"])
    return cut(placed.select("conv", "part", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "label", "words"), "numbered")


def as_they_are(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (conv, part, depth, label, words) and lengths (conv, len) of the conversations as given."""
    return rows.select("conv", "part", (F.col("pos") + 1).alias("depth"), "label", "words"), rows.groupBy("conv").agg(F.count("*").alias("len"))


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Paths and lengths where a conversation c begins with the first h turns of c - c % group, then has its own after its first h.

    h is crc32 of c's decimal digits, modulo ``heads``.
    """
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % heads).alias("h")
    firsts = rows.where((F.col("conv") % group == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv").alias("base"))
    firsts = firsts.agg(F.sort_array(F.collect_list(F.struct("pos", "label", "words"))).alias("first"))  # heads - 1 at most
    each = rows.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", h, (F.col("conv") - F.col("conv") % group).alias("base"))
    plan = each.join(firsts, "base", "left").withColumn("first", F.expr("slice(coalesce(first, array()), 1, cast(h as int))"))
    plan = cut(plan.select("conv", "n", "h", F.size("first").cast("long").alias("k"), "first"), "plan")
    own = rows.join(plan.select("conv", "h", "k"), "conv").where("pos >= h").select("conv", "part", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "label", "words")
    lent = plan.select("conv", F.explode("first").alias("t")).select("conv", F.lit(-1).cast("long").alias("part"), (F.col("t.pos") + 1).alias("depth"), "t.label", "t.words")
    return own.union(lent), plan.select("conv", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def named(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, part, depth, x, y, px, py, words, rest): each member's nodes with their parents' names; a row a turn and the root."""
    hashed = paths.select("conv", "part", "depth", "words", F.xxhash64("label", "depth").alias("a"), F.xxhash64(F.lit("second"), "label", "depth").alias("b"))
    whole = hashed.groupBy("conv", "part").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    whole = whole.select("conv", "part", F.coalesce(F.bit_xor("ta").over(earlier), none).alias("ba"), F.coalesce(F.bit_xor("tb").over(earlier), none).alias("bb"))
    inside = W.partitionBy("conv", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    upto = hashed.join(whole, ["conv", "part"]).select("conv", "part", "depth", "words", "a", "b", F.col("ba").bitwiseXOR(F.bit_xor("a").over(inside)).alias("x"), F.col("bb").bitwiseXOR(F.bit_xor("b").over(inside)).alias("y"))
    nodes = upto.select("conv", "part", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"), F.col("y").bitwiseXOR(F.col("b")).alias("py"), "words")
    null = F.lit(None).cast("long")
    root = lengths.select("conv", F.lit(-2).cast("long").alias("part"), none.alias("depth"), none.alias("x"), none.alias("y"), null.alias("px"), null.alias("py"), none.alias("words"))
    return cut(nodes.union(root).join(lengths, "conv").select("*", (F.col("len") - F.col("depth") + 1).alias("rest")).drop("len"), "paths")


class Louds:
    """Tries in level order: bits (a node's children as ones, then a zero; first those of a root above all), levels' bounds, order."""

    def __init__(self, level: np.ndarray, parent: np.ndarray, label: np.ndarray):
        """Of nodes in any order: their levels from 0, their parents' numbers (-1: none) and labels."""
        n = len(level)
        by_level = np.argsort(level, kind="stable")
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(level))]) if n else np.zeros(1, np.int64)
        rank = np.full(n + 1, -1, np.int64)  # the last: no parent
        self.order = np.empty(n, np.int64)
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            own = by_level[a:b]
            own = own[np.lexsort((label[own], rank[parent[own]]))]
            self.order[a:b] = own
            rank[own] = np.arange(a, b)
        degree = np.bincount(rank[parent[self.order]] + 1, minlength=n + 1)
        bits = np.ones(n + n + 1, bool)
        bits[np.cumsum(degree) + np.arange(n + 1)] = False
        self.bits = np.packbits(bits)
        self.n = n

    def parents(self) -> np.ndarray:
        """Rank of each node's parent, -1 for tops: the zeros before the node's one, less the first root's."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n + 1))
        return ones - np.arange(self.n) - 1

    def rolled_up(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums over subtrees of values that stand in level order."""
        parent = self.parents()
        out = [v.astype(np.int64) for v in values]
        for a, b in zip(self.bounds[-2:0:-1].tolist(), self.bounds[:1:-1].tolist()):
            for v in out:
                np.add.at(v, parent[a:b], v[a:b])
        return out


OUT = "conv long, depth long, parent_conv long, px long, py long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def _numbers(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """The number of each node's parent among the nodes, -1 for none."""
    n = len(x)
    _, ids = np.unique(np.concatenate([np.stack([x, y], 1), np.stack([px, py], 1)]), axis=0, return_inverse=True)
    ids = ids.reshape(-1)
    where = np.full(ids.max(initial=0) + 1, -1, np.int64)
    where[ids[:n]] = np.arange(n)
    return where[ids[n:]]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (s, t, depth, x, y, px, py, conv, n_convs, words, ends), sorted by shard (s, t) and depth, with their rollups."""
    for s, batch, _ in in_runs(batches):
        t, depth, x, y, px, py, conv, n_convs, words = (batch.column(k).fill_null(0).to_numpy() for k in range(1, 10))
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
        level = depth - depth[np.flatnonzero(first)[np.cumsum(first) - 1]]
        parent = np.where(level > 0, _numbers(x, y, px, py), -1)
        trie = Louds(level, parent, x)
        at = trie.order
        up = trie.parents()
        children = np.bincount(up[up >= 0], minlength=trie.n)
        leaves, saved = trie.rolled_up(children == 0, ((n_convs - 1) * words)[at])
        ends = batch.column(10)
        digest = []
        for k in at.tolist():
            ids = np.sort(ends[k].values.to_numpy()) if len(ends[k]) else ()
            digest.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if len(ids) else EMPTY)
        top = pa.array(up < 0)
        cols = [conv[at], depth[at], pa.array(conv[at][np.maximum(up, 0)], mask=up < 0), batch.column(5).take(pa.array(at)), batch.column(6).take(pa.array(at)), n_convs[at], children, leaves, saved]
        del top
        yield pa.RecordBatch.from_arrays([*[pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], pa.array(digest)], [c.split()[0] for c in OUT.split(", ")])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, depth, conv) -> (x, y, depth, first, text): ids of one node as pieces of text, PACKED ids at most in each."""
    for batch in batches:
        x, y, depth, conv = (batch.column(k).to_numpy() for k in range(4))
        edge = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (depth[1:] != depth[:-1])])
        rows = []
        starts = np.flatnonzero(edge)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)]):
            rows += [(x[k], y[k], depth[k], conv[k], ",".join(map(str, conv[k : min(b, k + PACKED)].tolist()))) for k in range(a, b, PACKED)]
        yield pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.int64()) for c in list(zip(*rows))[:4]], pa.array([r[4] for r in rows])] if rows else [pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())], ["x", "y", "depth", "first", "text"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, depth, first, text) -> (x, y, depth, ends): the digest of each node's pieces, joined by commas."""
    key, state, out = None, None, []
    for batch in batches:
        for *name, _, text in zip(*[c.to_pylist() for c in batch.columns]):
            if name != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = name, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key:
        out.append((*key, state.hexdigest()))
    if out:
        x, y, depth, ends = zip(*out)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (x, y, depth)], pa.array(ends)], ["x", "y", "depth", "ends"])


def trie(paths: DataFrame, lengths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = named(paths, lengths)
    # Written, so that the planner knows how few they are and can send them to the rows, of which every one has the root's name.
    heavy = cut(rows.groupBy(*NAME).agg(F.sum("rest").alias("weight")).where(F.col("weight") > limit).select(*NAME), "heavy-names")
    upto = rows.join(heavy, NAME).groupBy("conv").agg(F.max("depth").alias("k"))
    marked = cut(rows.join(upto, "conv", "left").withColumn("k", F.coalesce("k", F.lit(-1))), "marked")

    # Shards: what hangs below the heavy nodes.
    tops = marked.where("depth = k + 1").select("conv", F.col("x").alias("s"), F.col("y").alias("t"))
    light = marked.where("depth > k").join(tops, "conv")
    nodes = light.groupBy("s", "t", *NAME, "px", "py").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.collect_list(F.when(F.col("rest") == 1, F.col("conv"))).alias("ends"))
    nodes = nodes.repartition("s", "t").sortWithinPartitions("s", "t", "depth").select("s", "t", *NAME, "px", "py", "conv", "n_convs", "words", "ends")
    low = cut(nodes.mapInArrow(tidy(shards), OUT), "shards")

    # Heavy nodes: what each of them and each top adds stands in the rows of its smallest member.
    over = marked.where("depth <= k")
    high = cut(over.groupBy(*NAME, "px", "py").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "heavy")
    hung = low.where("parent_conv is null and depth > 0")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    children = high.where("depth > 0").select(*parent).union(hung.select(*parent)).groupBy(*NAME).agg(F.count("*").alias("n_children"))
    high = high.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    adds = high.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    adds = adds.union(hung.select("conv", F.col("depth") - 1, "saved", "n_leaves")).groupBy("conv", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    adders = adds.select("conv").distinct()
    each = over.select("conv", "part", *NAME).join(adders, "conv", "left_semi").join(adds, ["conv", "depth"], "left").fillna(0, ["saved", "leaves"])
    later = W.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    after = each.groupBy("conv", "part").agg(F.sum("saved").alias("ts"), F.sum("leaves").alias("tl"))
    after = after.select("conv", "part", F.coalesce(F.sum("ts").over(later), F.lit(0)).alias("as"), F.coalesce(F.sum("tl").over(later), F.lit(0)).alias("al"))
    inside = W.partitionBy("conv", "part").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    sums = each.join(after, ["conv", "part"]).select(*NAME, (F.col("as") + F.sum("saved").over(inside)).alias("saved"), (F.col("al") + F.sum("leaves").over(inside)).alias("n_leaves"))
    sums = sums.groupBy(*NAME).agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))
    ended = over.where("rest = 1").select("x", "y", "depth", "conv")
    pieces = ended.repartitionByRange("x", "y", "depth", "conv").sortWithinPartitions("x", "y", "depth", "conv").mapInArrow(tidy(packed), "x long, y long, depth long, first long, text string")
    ends = pieces.repartition("x", "y", "depth").sortWithinPartitions("x", "y", "depth", "first").mapInArrow(tidy(digests), "x long, y long, depth long, ends string")

    known = high.select(F.col("depth").alias("pd"), F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("conv").alias("known"))
    above = (F.col("depth") - 1 == F.col("pd")) & (F.col("px") == F.col("hx")) & (F.col("py") == F.col("hy"))
    upper = high.join(sums, NAME).join(ends, NAME, "left").join(known, above, "left")
    upper = upper.select("conv", "depth", F.col("known").alias("parent_conv"), "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(EMPTY)).alias("ends"))
    tops = low.where("parent_conv is null").join(known, above, "left").withColumn("parent_conv", F.col("known"))
    lower = low.where("parent_conv is not null")
    out = upper.union(tops.select(*upper.columns)).union(lower.select(*upper.columns))
    return out.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(*as_they_are(numbered(turns, id_col, turn_col, role_col, text_col)), limit)


def rebuilt_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = LIMIT, group: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the conversations as :func:`rebuilt` makes them of each other's first turns."""
    return trie(*rebuilt(numbered(turns, id_col, turn_col, role_col, text_col), group, heads), limit)
