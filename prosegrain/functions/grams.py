"""Terms of many token lists at once, as numbers: words are coded, phrases are tuples of codes, and only distinct terms
of a lot become text. The same terms as :func:`text.grams`, for use inside a task over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import STOPWORDS

#: Tokens that are looked at together; a longer list is a lot of its own.
LOT = 1_000_000
#: Terms travel in blocks: those of a lot whose text has the same digest modulo this number.
BUCKETS = 2048
BASE = np.uint64(0x5851F42D4C957F2D)
ZSTD = pa.Codec("zstd", 1)


class Found(NamedTuple):
    """Distinct terms of each list of a lot: place of the list and of the term in ``terms``, and how often it is there; the
    digest of each of ``terms``."""

    size: int
    row: np.ndarray
    which: np.ndarray
    n: np.ndarray
    terms: pa.Array
    digest: np.ndarray


def lots(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``tokens``, joined and cut by rows to about ``most`` tokens (``LOT``)."""
    most = LOT if most is None else most
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + most - size, "right"))
            if stop == at and held:
                yield joined(held)
                held, size = [], 0
                continue
            stop = max(at + 1, stop)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - before)
            at = stop
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], batches[0].schema.names)


def coded(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the lists, the number of each token's word, and the length of each list."""
    flat = pc.list_flatten(tokens).dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    return flat.dictionary.cast(pa.string()), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)


def content(words: pa.Array) -> np.ndarray:
    """Whether a word is none of the stopwords."""
    return ~pc.is_in(words, value_set=pa.array(STOPWORDS, words.type)).to_numpy(zero_copy_only=False).astype(bool)


def distinct(tokens: pa.Array, sizes: Iterable[int]) -> Iterator[Found]:
    """The terms of the lists, of each of ``sizes``; a term neither opens nor closes on a stopword."""
    yield from distinct_coded(*coded(tokens), sizes)


def distinct_coded(words: pa.Array, code: np.ndarray, lengths: np.ndarray, sizes: Iterable[int]) -> Iterator[Found]:
    """:func:`distinct` of lists that are coded."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    plain = content(words)[code] if len(code) else np.zeros(0, bool)
    by_word, shift = digests(words)
    for size in sizes:
        most = max(len(code) - size + 1, 0)
        at = np.flatnonzero(plain[:most] & plain[size - 1 :][:most] & (row[:most] == row[size - 1 :][:most]))
        if not len(at):
            continue
        key = code[at]
        for k in range(1, size):
            if len(words) ** size >= 1 << 62:  # numbers would not fit: name what there is so far anew
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(words) + code[at + k]
        named, which = np.unique(key, return_inverse=True)
        begins = np.empty(len(named), np.int64)
        begins[which] = at
        pairs, n = np.unique(row[at] * len(named) + which, return_counts=True)
        parts = [words.take(pa.array(code[begins + k])) for k in range(size)]
        digest = by_word[code[begins]]
        for k in range(1, size):
            w = code[begins + k]
            digest = (digest * BASE + np.uint64(32)) * shift[w] + by_word[w]
        yield Found(size, pairs // len(named), pairs % len(named), n, parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " "), digest)


def digests(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A digest of each text, the polynomial of its bytes modulo 2**64, and the power that a text in front of it is shifted by.
    It tells buckets apart, never terms."""
    text, lengths = _text(terms)
    ends = np.cumsum(lengths, dtype=np.int64)
    power = np.full(int(lengths.max(initial=0)) + 1, BASE)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.empty(len(lengths), np.uint64)
    for lo in range(0, len(lengths), 1 << 17):  # bounds what is held for each byte
        own = lengths[lo : lo + (1 << 17)].astype(np.int64)
        start, stop = (int(ends[lo - 1]) if lo else 0), int(ends[min(lo + (1 << 17), len(lengths)) - 1])
        behind = np.repeat(ends[lo : lo + (1 << 17)], own) - 1 - np.arange(start, stop)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text[start:stop].astype(np.uint64) * power[behind])])
        stops = ends[lo : lo + (1 << 17)] - start
        sums[lo : lo + (1 << 17)] = run[stops] - run[stops - own]
    return sums, power[lengths.astype(np.int64)]


def _text(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of texts."""
    at = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int32)
    text = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return text, np.diff(at).astype("<u4")


def in_buckets(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, start): the order that puts terms by bucket, the buckets there are, and where each starts and the last ends."""
    mixed = (digest ^ (digest >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    there, start = np.unique(bucket[order], return_index=True)
    return order, there, np.append(start, len(bucket))


def squeezed(raw: bytes) -> bytes:
    return ZSTD.compress(raw, asbytes=True)


def expanded(block: bytes, size: int) -> bytes:
    return ZSTD.decompress(block, size, asbytes=True)


def _block(text: np.ndarray, lengths: np.ndarray, numbers: np.ndarray | None) -> bytes:
    raw = lengths.tobytes() + (b"" if numbers is None else numbers.astype("<i8").tobytes()) + text.tobytes()
    return np.array([len(lengths), len(raw)], "<i8").tobytes() + squeezed(raw)


def pack(terms: pa.Array) -> bytes:
    """Terms as a block of bytes."""
    return _block(*_text(terms), None)


def unpack(block: bytes, columns: int = 0) -> tuple[pa.Array, np.ndarray]:
    """Terms of a block, and its rows of numbers."""
    n, size = (int(x) for x in np.frombuffer(block, "<i8", 2))
    raw = expanded(block[16:], size)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.frombuffer(raw, "<u4", n), out=ends[1:])
    numbers = np.frombuffer(raw, "<i8", n * columns, 4 * n).reshape(columns, n)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw).slice(4 * n + 8 * n * columns)), numbers


def blocks(terms: pa.Array, digest: np.ndarray, numbers: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of terms and their numbers."""
    order, there, start = in_buckets(digest)
    text, lengths = _text(terms.take(pa.array(order)))
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    numbers = None if numbers is None else numbers[:, order]
    for b, lo, hi in zip(there.tolist(), start[:-1].tolist(), start[1:].tolist()):
        yield b, _block(text[ends[lo] : ends[hi]], lengths[lo:hi], None if numbers is None else numbers[:, lo:hi])


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(value, rows) of each stretch of rows in a batch that have the same value of ``key``."""
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(values)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
            if hi > lo:
                yield int(values[lo]), batch.slice(lo, hi - lo)
