"""Token ids in binary files, coded by a static range asymmetric numeral system.

Layout of a set of files: ``table`` holds the one frequency table, ``blocks``
the files. A file is a container of whole documents in order: header, document
index (id, number of tokens), blocks. A block is independent of others; it has
its checkpoints, and checksums of its bytes and of its ids. All numbers are
little-endian. Spark's text writer puts a container into each file, so the
files appear by its commit protocol on whatever store the path names; the fixed
line separator closes every file.

Documents are range-sorted by id, tokenized once into a table in the shared
folder, counted, and coded. Containers carry (range, first row); the number of
ids before a container comes from sums over containers.

Defined cases: a null text is an empty one, which is one end id; null ids come
first, equal ids are ordered by text; repeated rows are documents of their own;
an empty table gives no container and an empty result; other columns are
ignored. Ids are 64-bit integers or null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ans
from .common import cut, drop, need, new_path, release, tidy
from .tokens import default_path, encoder, lots

MAGIC, END = b"PGTOKEN1", "\nPGEND\n"
HEAD = struct.Struct("<8sqqqqq")  # magic, range, first row, documents, tokens, blocks
BLOCK = struct.Struct("<qqqIII")  # tokens, stretches, words, crc32 of the bytes, crc32 of the ids, crc32 of the table
BLOCK_TOKENS = 4 * ans.LANES * ans.STRIDE
CONTAINER_TOKENS = 1 << 22
#: Ids counted in one row of counts.
CHUNK = 1024


def sorted_ids(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(range, row, id, ids) in ascending order of ids within ranges and between them; rows below 0 have the range's counts of ids, by chunk."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = (F.asc_nulls_first("id"), F.asc("tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, enc, total = TaskContext.get().partitionId(), 0, encoder(path), np.zeros(0, np.int64)
        wide = max(enc.dtype.itemsize > 2, end_id >= 1 << 16)
        kind = "<u4" if wide else "<u2"
        names = ["range", "row", "id", "wide", "ids", "counts"]
        for batch in batches:
            at = 0
            for lot in lots(batch.column(1)):
                ids, ends = enc.lot(lot)
                flat = np.insert(ids.astype(kind), ends, end_id)  # behind each text
                seen = np.bincount(flat, minlength=len(total))
                seen[: len(total)] += total
                total, n = seen, len(lot)
                bounds = pa.py_buffer(np.concatenate([[0], (ends + np.arange(1, n + 1)) * flat.itemsize]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column(0).slice(at, n), pa.array([bool(wide)] * n, pa.bool_()), pa.BinaryArray.from_buffers(pa.binary(), n, [None, bounds, pa.py_buffer(flat)]), pa.nulls(n, pa.binary())], names
                )
                row, at = row + n, at + n
        chunks = [total[k : k + CHUNK].astype("<i8").tobytes() for k in range(0, len(total), CHUNK)]
        if chunks:
            n = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([-1 - k for k in range(n)], pa.int64()), pa.nulls(n, pa.int64()), pa.array([bool(wide)] * n), pa.array([b""] * n, pa.binary()), pa.array(chunks, pa.binary())], names)

    return rows.mapInArrow(tidy(run), "range int, row long, id long, wide boolean, ids binary, counts binary")


def tokens_of(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2")


def count_ids(table: DataFrame) -> np.ndarray:
    """How often each id occurs: the ranges' counts summed by chunk of the vocabulary, of which there is a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = np.frombuffer(data.as_buffer(), "<i8")
                held = total.setdefault(row, np.zeros(CHUNK, np.int64))
                held[: len(n)] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - k for k in total], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "n"])

    each = table.where("row < 0").select("row", "counts").repartition("row")
    rows = sorted(tuple(r) for r in each.mapInArrow(tidy(run), "chunk long, n binary").collect())
    return np.concatenate([np.frombuffer(n, "<i8") for _, n in rows]) if rows else np.zeros(0, np.int64)


def write_block(tokens: np.ndarray, table: ans.Table, table_crc: int) -> bytes:
    states, before, words = ans.encode(tokens, table)
    body = states.astype("<u8").tobytes() + before.astype("<i8").tobytes() + words.astype("<u4").tobytes()
    return BLOCK.pack(len(tokens), len(states), len(words), zlib.crc32(body), zlib.crc32(tokens.astype("<u4").tobytes()), table_crc) + body


def read_block(data: memoryview, at: int, table: ans.Table, table_crc: int) -> tuple[np.ndarray, int]:
    n, stretches, n_words, crc, ids_crc, of = BLOCK.unpack_from(data, at)
    a = at + BLOCK.size
    b = a + 8 * stretches * (ans.LANES + 1) + 4 * n_words
    if of != table_crc or zlib.crc32(data[a:b]) != crc:
        raise ValueError("a block's bytes, or its table, are not what was written")
    c = a + 8 * stretches * ans.LANES
    d = c + 8 * stretches
    states = np.frombuffer(data[a:c], "<u8").reshape(stretches, ans.LANES).astype(np.uint64)
    tokens = ans.decode(n, states, np.frombuffer(data[c:d], "<i8").copy(), np.frombuffer(data[d:b], "<u4"), table)
    if zlib.crc32(tokens.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids are not what was written")
    return tokens, b


def container(part: int, row: int, ids: list[int | None], lengths: list[int], tokens: np.ndarray, table: ans.Table, table_crc: int) -> bytes:
    null = np.array([x is None for x in ids], dtype=np.uint8).tobytes()
    index = np.array([x or 0 for x in ids], dtype="<i8").tobytes() + null + np.array(lengths, dtype="<i8").tobytes()
    blocks = [write_block(tokens[k : k + BLOCK_TOKENS], table, table_crc) for k in range(0, len(tokens), BLOCK_TOKENS)]
    return HEAD.pack(MAGIC, part, row, len(ids), len(tokens), len(blocks)) + index + struct.pack("<I", zlib.crc32(index)) + b"".join(blocks)


def read_container(data: bytes, table: ans.Table, table_crc: int) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(range, first row, document ids, their numbers of tokens, all tokens)."""
    view = memoryview(data)
    magic, part, row, docs, n, blocks = HEAD.unpack_from(view, 0)
    a = HEAD.size
    b = a + 17 * docs
    if magic != MAGIC or zlib.crc32(view[a:b]) != struct.unpack_from("<I", view, b)[0]:
        raise ValueError("not a container, or its index is damaged")
    ids, null = np.frombuffer(view[a : a + 8 * docs], "<i8").tolist(), bytes(view[a + 8 * docs : a + 9 * docs])
    lengths = np.frombuffer(view[a + 9 * docs : b], "<i8")
    at, parts = b + 4, []
    for _ in range(blocks):
        tokens, at = read_block(view, at, table, table_crc)
        parts.append(tokens)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if bytes(view[at:]) != END.encode() or len(tokens) != n:
        raise ValueError("a container does not end where it should")
    return part, row, [None if z else x for x, z in zip(ids, null)], lengths, tokens


def save_binary(rows: DataFrame, path: str) -> None:
    """Each row's bytes as a file of its own, closed by END."""
    rows.select(F.col(rows.columns[0]).cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every document's ids, in ascending order of id, to ``path``/table and ``path``/blocks."""
    spark = docs.sparkSession
    ids = cut(sorted_ids(docs, tokenizer_path or default_path(), end_id, id_col, text_col), "token-ids")
    release(spark)  # the sort's shuffle files are not needed again
    freq = ans.Table.of_counts(count_ids(ids)).freq.astype("<u4").tobytes()
    save_binary(spark.createDataFrame([(bytearray(freq),)], "data binary"), f"{path}/table")
    table_crc, shared = zlib.crc32(freq), spark.sparkContext.broadcast(freq)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.Table(np.frombuffer(shared.value, "<u4"))
        key, names, lengths, held, total = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = container(*key, names, lengths, np.concatenate(held), table, table_crc)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        expected = None
        for batch in batches:
            for part, row, name, wide, data in zip(*[c.to_pylist() for c in batch.columns]):
                if key and ((part, row) != expected or total >= CONTAINER_TOKENS):
                    yield flush()
                    key, names, lengths, held, total = None, [], [], [], 0
                key = key or (part, row)
                tokens = tokens_of(data, wide)
                names.append(name), lengths.append(len(tokens)), held.append(tokens)
                total, expected = total + len(tokens), (part, row + 1)
        if key:
            yield flush()

    save_binary(ids.where("row >= 0").drop("counts").mapInArrow(tidy(run), "data binary"), f"{path}/blocks")
    drop(ids)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ``ids`` if asked for."""
    freq = bytes(spark.read.format("binaryFile").load(f"{path}/table").first()["content"])[: -len(END)]
    table_crc, shared = zlib.crc32(freq), spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.Table(np.frombuffer(shared.value, "<u4"))
        for batch in batches:
            for data in batch.column(0):
                part, row, names, lengths, tokens = read_container(data.as_py(), table, table_crc)
                stops = np.cumsum(lengths)
                raw = tokens.astype("<u4").tobytes()
                each = [raw[4 * (b - n) : 4 * b] for b, n in zip(stops.tolist(), lengths.tolist())]
                n = len(names)
                cols = [pa.array([part] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(names, pa.int64()), pa.array(stops - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(each, pa.binary())] if with_ids else [])], ["range", "row", "doc_id", "local", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    schema = "range long, row long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = cut(files.mapInArrow(tidy(run), schema), "tokens-read")
    sizes = docs.groupBy("range", "row").agg(F.sum("n_tokens").alias("n"))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("all"))  # a row a range
    before = ranges.withColumn("base", F.coalesce(F.sum("all").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("all")
    inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("inside", inside).join(before, "range").select("range", "row", (F.col("base") + F.col("inside")).alias("base"))
    return docs.join(at, ["range", "row"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write to a new folder in the shared folder and read back."""
    path = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
