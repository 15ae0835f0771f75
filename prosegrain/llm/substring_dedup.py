"""Substring dedup: suffix automata of reference shards, matching statistics of the documents that share words with them.

A window is ``width`` words in a row. Words that a window covers go where the
window also stands in a document of smaller id.

Documents are dealt to chunks of about ``chunk_bytes``, written once, bucketed by
chunk, so that later passes over the texts need no shuffle of them.

1. Anchors. A window's anchor is the least hash of its ``gram``-word shingles, so
   equal windows have equal anchors, and few shingles are anchors. Each chunk
   sends its distinct ones; what comes from one chunk alone is dropped.
2. Owners. Chunks send the distinct hashes of windows whose anchors are shared,
   each with its smallest id; a window's owner is the chunk of the smallest
   id of all. A passage in any number of documents is one row for a chunk.
3. Shards. Owners turn the runs of windows that others ask for into reference
   pieces, so a shard is no larger than a chunk. The others send
   the runs of windows that a chunk owns to its shard.
4. Automata. A task builds the suffix automaton of a shard's pieces, in order of
   id, and streams the runs sent to it: the longest match that ends at each word,
   cut to ``width`` words, names the state of a window, and the state the first
   document that holds it. Shards that many runs ask for are dealt to
   several tasks, each with the automaton, which is bounded.

Real words decide in the automaton; hashes only say where to look. A window
that an owner promised and the automaton does not hold was a collision of
hashes; then the search is run again under another seed, until none is left.
To send every automaton to every document would cost the square of the data; a
shard's goes to the tasks that hold runs for it instead.

Defined cases: a null or empty text has no word; a null id is neither smaller
nor larger than another; rows of one id do not touch each other; repeated rows
are each answered; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, need, new_path, release, tidy
from .jaccard_join import BYTES, INVERSE, IS_SPACE, ODD, U, in_runs, mix, powers

CHUNK_BYTES = 1 << 20
#: Words of runs that one task streams through a shard's automaton, about.
STREAMED = 1 << 20
#: Words longer than this are hashed one by one.
LONG = 64


class Words:
    """The words of some texts: where they begin and end in ``data``, their hashes, and each text's first word."""

    def __init__(self, texts: list[bytes], seed: int):
        import xxhash

        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], IS_SPACE[raw]])))
        self.starts, self.stops = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[raw] * powers(ODD, len(raw)))])
            self.hash = mix((run[self.stops] - run[self.starts]) * powers(INVERSE, len(raw))[self.starts] + U(seed))
        for k in np.flatnonzero(self.stops - self.starts > LONG).tolist():
            self.hash[k] = xxhash.xxh64_intdigest(self.data[self.starts[k] : self.stops[k]], seed)
        ends = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t in texts]))
        self.first = np.concatenate([[0], ends]).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of ``n`` words from each word on; those past the end have no meaning."""
        out = np.zeros(len(self.hash), U)
        with np.errstate(over="ignore"):
            for k in range(n):
                out[: max(0, len(out) - k)] += self.hash[k:] * powers(ODD, n)[k]
            return mix(out + U(n))

    def whole(self, width: int) -> np.ndarray:
        """Numbers of the words at which a window begins that its text holds whole."""
        at = np.arange(len(self.hash))
        return at[at + width <= self.first[self.text + 1]]

    def anchors(self, width: int, gram: int) -> np.ndarray:
        """The anchor of the window at each word."""
        least, reach = self.grams(gram), 1
        while reach < width - gram + 1:
            step = min(reach, width - gram + 1 - reach)
            least = np.minimum(least, np.concatenate([least[step:], np.full(min(step, len(least)), ~U(0))]))
            reach += step
        return mix(least + U(1))

    def piece(self, a: int, b: int) -> bytes:
        """The words a to b, as they stand."""
        return self.data[self.starts[a] : self.stops[b - 1]]


def held(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is among sorted others, its place there or 0)."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at


def repeated(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The sorted distinct values that come with two different ids or more."""
    order = np.lexsort((ids, values))
    v, i = values[order], ids[order]
    return np.unique(v[1:][(v[1:] == v[:-1]) & (i[1:] != i[:-1])])


def runs(at: np.ndarray, *same: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of ``at`` that rise by one while the others stay the same."""
    new = np.diff(at, prepend=-9) != 1
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    edges = np.append(np.flatnonzero(new), len(at))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())


def blobs(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over sorted hashes."""
    bucket = (((hashes >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[a]), a, b


def texts_of(chunk: pa.Table, seed: int) -> tuple[Words, np.ndarray, list[int]]:
    """The chunk's texts that have an id: (their words, ids, rows)."""
    mine = chunk.filter(pc.is_valid(chunk.column("id"))).sort_by([("id", "ascending"), ("row", "ascending")])
    texts = [t or b"" for t in mine.column("text").cast(pa.binary()).to_pylist()]
    return Words(texts, seed), mine.column("id").to_numpy(), mine.column("row").to_pylist()


class Search:
    """The passes over a table of chunks; methods ending in ``_of`` are run in tasks."""

    def __init__(self, width: int, gram: int, buckets: int, seed: int, bits: int = 64):
        self.width, self.gram, self.buckets, self.seed, self.bits = width, gram, buckets, seed, bits

    def hashes(self, words: Words) -> np.ndarray:
        return words.grams(self.width) >> U(64 - self.bits) << U(64 - self.bits)

    def anchors_of(self, chunk: pa.Table) -> pa.Table:
        words, _, _ = texts_of(chunk, self.seed)
        every = words.anchors(self.width, self.gram)[words.whole(self.width)]
        own = np.unique(every)
        cuts = list(blobs(own, self.buckets))
        number = chunk.column("chunk")[0].as_py()
        return pa.table([pa.array([c[0] for c in cuts], pa.int64()), pa.array([number] * len(cuts), pa.int64()), pa.array([own[a:b].tobytes() for _, a, b in cuts], pa.binary())], ["bucket", "chunk", "hashes"])

    def shared_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors that more than one chunk sent, back to the chunks."""
        for bucket, batch, _ in in_runs(batches):
            values = [np.frombuffer(x.as_buffer(), U) for x in batch.column(2)]
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            every, chunk = np.concatenate(values), np.repeat(batch.column(1).to_numpy(), sizes)
            both = held(every, repeated(every, chunk))[0]  # a hash lies in one bucket
            out = [(int(c), x) for c, n, x in self._by_chunk(chunk[both], every[both])]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["chunk", "hashes"])

    @staticmethod
    def _by_chunk(chunk: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(chunk, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(chunk[order], prepend=np.iinfo(np.int64).min)), len(order)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield chunk[order[a]], b - a, *[c[order[a:b]].tobytes() for c in columns]

    def windows_of(self, chunk: pa.Table, shared: pa.Table) -> pa.Table:
        """Windows whose anchor another text has too, each once, with the smallest id that holds it."""
        hashes, ids, number = np.zeros(0, U), np.zeros(0, np.int64), 0
        if len(chunk):
            number = chunk.column("chunk")[0].as_py()
            words, of, _ = texts_of(chunk, self.seed)
            at = words.whole(self.width)
            anchor = words.anchors(self.width, self.gram)[at]
            told = np.unique(np.concatenate([np.zeros(0, U), *[np.frombuffer(x.as_buffer(), U) for x in shared.column("hashes").combine_chunks()]]))
            owner = of[words.text[at]]
            keep = held(anchor, told)[0] | held(anchor, repeated(anchor, owner))[0]
            hashes, first = np.unique(self.hashes(words)[at[keep]], return_index=True)  # texts are in order of id
            ids = owner[keep][first]
        cuts = list(blobs(hashes, self.buckets))
        return pa.table([pa.array([c[0] for c in cuts], pa.int64()), pa.array([number] * len(cuts), pa.int64()), pa.array([hashes[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([ids[a:b].tobytes() for _, a, b in cuts], pa.binary())], ["bucket", "chunk", "hashes", "ids"])

    def owners_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For windows that more than one chunk sent: the smallest id and its chunk, to all that sent them."""
        for bucket, batch, _ in in_runs(batches):
            values = [np.frombuffer(x.as_buffer(), U) for x in batch.column(2)]
            every, ids = np.concatenate(values), np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)])
            chunk = np.repeat(batch.column(1).to_numpy(), np.fromiter(map(len, values), np.int64, len(values)))
            order = np.lexsort((chunk, ids, every))
            every, ids, chunk = every[order], ids[order], chunk[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            sizes = np.diff(np.append(starts, len(every)))
            many = np.repeat(sizes > 1, sizes)
            first = np.repeat(starts, sizes)[many]
            out = list(self._by_chunk(chunk[many], every[many], ids[first], chunk[first]))
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in out], pa.int64()), *[pa.array([x[k] for x in out], pa.binary()) for k in (2, 3, 4)]], ["chunk", "hashes", "ids", "owners"])

    def pieces_of(self, chunk: pa.Table, owners: pa.Table) -> pa.Table:
        """Reference pieces for the chunk's own shard, and runs for the shards that own their windows."""
        out: list[tuple] = []
        if len(chunk):
            number = chunk.column("chunk")[0].as_py()
            words, ids, rows = texts_of(chunk, self.seed)
            at = words.whole(self.width)
            window, of = self.hashes(words)[at], ids[words.text[at]]
            told, told_id, told_chunk = (np.concatenate([np.zeros(0, t), *[np.frombuffer(x.as_buffer(), t) for x in owners.column(c).combine_chunks()]]) for c, t in (("hashes", U), ("ids", np.int64), ("owners", np.int64)))
            order = np.argsort(told)
            known, place = held(window, told[order])
            home, low = np.full(len(at), number), of.copy()
            if len(told):
                home[known], low[known] = told_chunk[order][place[known]], told_id[order][place[known]]
            # What no other chunk holds is the smallest id's here.
            distinct, first = np.unique(window, return_index=True)
            here = np.searchsorted(distinct, window)
            low[~known] = of[first[here[~known]]]
            many = known | held(window, repeated(window, of))[0]
            # The first place of a window stands for it in the reference.
            for own, role in ((many & (home == number) & (first[here] == np.arange(len(at))) & (low == of), 0), (many & (low < of), 1)):
                k = np.flatnonzero(own)
                for a, b in runs(at[k], words.text[at[k]], home[k]):
                    begin, text = int(at[k[a]]), int(words.text[at[k[a]]])
                    out.append((int(home[k[a]]), role, int(ids[text]), number, rows[text], begin - int(words.first[text]), b - a, words.piece(begin, begin + b - a + self.width - 1)))
        columns = list(zip(*out)) or [()] * 8
        return pa.table([*[pa.array(c, pa.int64()) for c in columns[:7]], pa.array(columns[7], pa.binary())], ["shard", "role", "id", "chunk", "row", "start", "windows", "data"])

    def matched_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (shard, salt, role, id, chunk, row, start, data) -> (chunk, row, start, stop, found): spans of words to
        remove, and places of single windows that were promised and are not there."""
        key, automaton = None, Automaton(self.width)
        for batch in batches:
            out = []
            for shard, salt, role, name, chunk, row, start, data in zip(*[c.to_pylist() for c in batch.columns]):
                if (shard, salt) != key:
                    key, automaton = (shard, salt), Automaton(self.width)
                if role == 0:
                    automaton.add(data.split(), name)
                    continue
                there, covered = automaton.ends(data.split(), name), 0
                spans, at = [], self.width - 1
                for end, ok in enumerate(there, at):
                    if not ok:
                        out.append((chunk, row, start + end - at, start + end + 1, False))
                    elif end - at < covered:
                        spans[-1][1], covered = end + 1, end + 1
                    else:
                        spans.append([end - at, end + 1])
                        covered = end + 1
                out += [(chunk, row, start + a, start + b, True) for a, b in spans]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.bool_())], ["chunk", "row", "start", "stop", "found"])


class Automaton:
    """A suffix automaton of several word sequences; each state knows the first document that came with its words."""

    def __init__(self, width: int):
        self.width = width
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, length: int, first: int, onward: dict[int, int], link: int) -> int:
        self.next.append(onward), self.link.append(link), self.length.append(length), self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the words of q that are no longer than p's and c."""
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], name: int) -> None:
        """Documents come in ascending order."""
        last = 0
        for w in words:
            c = self.number.setdefault(w, len(self.number))
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new = self._state(self.length[last] + 1, name, {}, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def ends(self, words: list[bytes], name: int) -> list[bool]:
        """For each window of ``words``: whether a document before ``name`` holds it."""
        onward, link, length, width = self.next, self.link, self.length, self.width
        state = size = 0
        out = []
        for c in map(self.number.get, words):
            while state and c not in onward[state]:
                state = link[state]
                size = length[state]
            if c in onward[state]:
                state, size = onward[state][c], size + 1
            while length[link[state]] >= width if state else False:
                state = link[state]
            size = min(size, length[state])
            out.append(size >= width and self.first[state] < name)
        return out[width - 1 :]


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int, str]:
    """(id, row, chunk, text), written in buckets by chunk; their number; its folder, whose last 32 letters end its name."""
    spark = docs.sparkSession
    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = max(1, -(-total // chunk_bytes))
    # The range of the scan has a part in the hash, so that rows of one id and text are not all in one chunk.
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.xxhash64("text"), F.spark_partition_id()), F.lit(number)))
    path = new_path(spark, "chunks")
    name = "chunks_" + path[-32:]
    placed = dealt.repartition(buckets, "chunk").withColumn("row", F.monotonically_increasing_id())
    placed.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", path).saveAsTable(name)
    return spark.table(name), buckets, path


def removed_spans(chunks: DataFrame, buckets: int, width: int, gram: int, seed: int, bits: int = 64) -> DataFrame:
    """(chunk, row, start, stop, found), written: see :meth:`Search.matched_of`."""
    s = Search(width, gram, 4 * buckets, seed, bits)
    by_chunk = lambda df: df.groupBy("chunk")
    # Functions, as Spark counts a method's ``self`` as an argument.

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    anchors = by_chunk(chunks).applyInArrow(lambda chunk: s.anchors_of(chunk), "bucket long, chunk long, hashes binary")
    shared = cut(by_bucket(anchors).mapInArrow(tidy(s.shared_of), "chunk long, hashes binary"), "shared")
    release(chunks.sparkSession)
    windows = by_chunk(chunks).cogroup(by_chunk(shared)).applyInArrow(lambda chunk, told: s.windows_of(chunk, told), "bucket long, chunk long, hashes binary, ids binary")
    owners = cut(by_bucket(windows).mapInArrow(tidy(s.owners_of), "chunk long, hashes binary, ids binary, owners binary"), "owners")
    release(chunks.sparkSession)
    kind = "shard long, role long, id long, chunk long, row long, start long, windows long, data binary"
    pieces = cut(by_chunk(chunks).cogroup(by_chunk(owners)).applyInArrow(lambda chunk, told: s.pieces_of(chunk, told), kind), "pieces")
    release(chunks.sparkSession)
    asked = pieces.where("role = 1").groupBy("shard").agg(F.ceil(F.sum("windows") / F.lit(STREAMED)).cast("long").alias("salts"))
    salted = pieces.join(asked, "shard")
    salt = F.when(F.col("role") == 0, F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row", "start"), F.col("salts"))))
    lots = salted.withColumn("salt", F.explode(salt)).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role", "id", "row", "start")
    return cut(lots.select("shard", "salt", "role", "id", "chunk", "row", "start", "data").mapInArrow(tidy(s.matched_of), "chunk long, row long, start long, stop long, found boolean"), "spans")


def kept(chunk: pa.Table, spans: pa.Table) -> pa.Table:
    """(id, n_words, n_removed, kept) for every text of a chunk, its spans of words taken out."""
    gone: dict[int, list[tuple[int, int]]] = {}
    for row, start, stop in zip(*[spans.column(c).to_pylist() for c in ("row", "start", "stop")]):
        gone.setdefault(row, []).append((start, stop))
    n_words, n_removed, texts = [], [], []
    for row, text in zip(chunk.column("row").to_pylist(), chunk.column("text").cast(pa.binary()).to_pylist()):
        words, left, at = (text or b"").split(), [], 0
        for a, b in sorted(gone.get(row, ())):
            left += words[at:a]
            at = max(at, b)
        left += words[at:]
        n_words.append(len(words)), n_removed.append(len(words) - len(left)), texts.append(b" ".join(left))
    return pa.table([chunk.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])


def digested(chunk: pa.Table, spans: pa.Table) -> pa.Table:
    out = kept(chunk, spans)
    return out.set_column(3, "kept", pa.array([hashlib.sha256(t.encode()).hexdigest() for t in out.column("kept").to_pylist()], pa.string()))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, gram: int = 7, chunk_bytes: int = CHUNK_BYTES, digests: bool = False, bits: int = 64) -> DataFrame:
    """One row a document: id, n_words, n_removed, and ``kept``, what is left joined by single blanks, or its SHA-256 in hex.

    ``bits`` of a window's hash are used in the first search; all of them in those that settle its collisions.
    """
    chunks, buckets, path = chunked(docs, id_col, text_col, chunk_bytes)
    spans, seed = removed_spans(chunks, buckets, width, gram, 0, bits), 0
    found, doubtful = spans.where("found"), spans.where("not found")
    while doubtful.limit(1).count():
        seed += 1
        spans = removed_spans(chunks, buckets, width, gram, seed)
        found = found.union(spans.where("found"))
        doubtful = cut(doubtful.join(spans.where("not found"), ["chunk", "row", "start", "stop", "found"], "left_semi"), "doubtful")
    out = chunks.groupBy("chunk").cogroup(found.select("chunk", "row", "start", "stop").groupBy("chunk")).applyInArrow(digested if digests else kept, "id long, n_words long, n_removed long, kept string")
    out = cut(out, "deduplicated")
    spark = docs.sparkSession
    spark.sql(f"DROP TABLE chunks_{path[-32:]}")
    delete(spark, path)
    return out.withColumnRenamed("id", id_col)
