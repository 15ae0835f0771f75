"""Token ids of whole texts with a public tokenizer file, quickly and exactly."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept with their ids. A full cache becomes the old one, whose words are taken over when they come again, or is
#: emptied where no old one is kept; so a worker's memory is bounded by twice this number, or by this number.
CACHE_WORDS = 600_000
#: Texts are handled in lots of about this many bytes.
LOT_BYTES = 1 << 20
#: Bytes as the pieces see them: ASCII letters folded; tabs and line ends as blanks.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[[ord(c) for c in "\t\n\r"]] = ord(" ")
#: Words of ASCII and Latin-1 letters go to the model at once, as their other steps change nothing but case and alphabet;
#: ASCII symbols behind them, if there are any, are a piece of their own.
LETTERS = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z")
#: Stands between words that are encoded together; one token, and never part of another as blanks surround it.
BETWEEN = "\x01"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def lots(texts: pa.Array, size: int = LOT_BYTES) -> Iterator[pa.Array]:
    """``texts`` in slices of about ``size`` bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size)))
        yield texts.slice(a, b - a)
        a = b


def byte_alphabet() -> dict[int, str]:
    """Code points from 128 to 255 as the characters that stand for their UTF-8 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordEncoder:
    """Ids of texts, word by word through a cache.

    Only for a tokenizer that folds case, drops white space and keeps letters
    and punctuation in separate tokens, as ``word_bpe_49k`` does: then the ids
    of a text are those of its pieces between blanks, tabs and line ends, in
    order, a full stop or comma that ends a piece after a letter or digit is a
    token of its own, and so are the ids of symbols that end a piece of
    letters. Anything else inside a piece is left to the tokenizer.
    """

    def __init__(self, path: str, keep_old: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids are kept in as few bytes as the vocabulary needs.
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: Writes so many ids; longer words are few.
        self.pack = [struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(32)]
        self.keep_old = keep_old
        self.forget()
        (self.between,) = self._ids(BETWEEN)
        self.ends = {c: self._bytes(self._ids(c)) for c in ".,"}
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        probes = ["the", "unheard", "zqxj", "été", "ÿß", "straße"]
        self.direct = all(self._letters(w) == self._bytes(self._ids(w)) for w in probes)

    def forget(self) -> None:
        """Empty the caches."""
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _bytes(self, ids: list[int]) -> bytes:
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, self.dtype).tobytes()

    def _letters(self, word: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.alphabet))])

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are encoded as one text, with a token between them."""
        plain = [w for w in words if BETWEEN not in w and "<|" not in w]
        out = {w: self._bytes(self._ids(w)) for w in set(words).difference(plain)}
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = np.array(self._ids(f" {BETWEEN} ".join(some)), self.dtype)
            cuts = np.flatnonzero(ids == self.between) * ids.itemsize
            data, stops = ids.tobytes(), [*cuts.tolist(), ids.nbytes]
            if len(stops) != len(some):
                raise ValueError("the tokenizer joins words across blanks")
            out.update(zip(some, map(data.__getitem__, map(slice, [0, *(cuts + ids.itemsize).tolist()], stops))))
        return out

    def _learn(self, names: list[str], held: list[bytes | None]) -> None:
        """Fill in the ids of the names that the cache does not hold."""
        cache, old, later, match = self.cache, self.old, [], LETTERS.match if self.direct else lambda w: None
        for k, w in enumerate(names):
            if held[k] is not None:
                continue
            ids = old.get(w) if old else None
            if ids is None and (found := match(w)):
                stem, tail = found.groups()
                if not stem.isascii():
                    # Case is folded here only where it is the same for every reader: no Latin-1 letter's case depends on its neighbours.
                    stem = stem.lower()
                if stem != w:
                    ids = cache.get(stem) or (old.get(stem) if old else None)
                if ids is None:
                    ids = cache[stem] = self._letters(stem)
                if tail:
                    end = cache.get(tail)
                    if end is None:
                        end = cache[tail] = self._bytes(self._ids(tail))
                    ids += end
            elif ids is None:
                stem, end = w if w.isascii() or max(w) > "\xff" else w.lower(), b""
                if stem[-1] in ".," and stem[-2:-1].isalnum() and stem[-2] <= "\xff":
                    stem, end = stem[:-1], self.ends[stem[-1]]
                ids = cache.get(stem) or (old.get(stem) if old else None)
                if ids is None:
                    later.append((k, stem, end))
                    continue
                ids += end
            held[k] = cache[w] = ids
        if later:
            found = self._together(list({stem for _, stem, _ in later}))
            for k, stem, end in later:
                held[k] = cache[names[k]] = found[stem] + end

    def lot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids end); a null text has none."""
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
        data = FOLD[np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]]
        folded = pa.StringArray.from_buffers(n, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data))
        pieces = pc.split_pattern(folded, " ")
        words = pieces.flatten().dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self.cache) + len(names) > CACHE_WORDS:
            full = self.cache
            self.forget()
            self.old = full if self.keep_old else {}
        held = list(map(self.cache.get, names))
        self._learn(names, held)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(held), self.dtype)
        index = words.indices.to_numpy()
        each = sizes[index]
        upto = np.cumsum(each)
        place = np.repeat((np.cumsum(sizes) - sizes)[index] - (upto - each), each) + np.arange(upto[-1])
        ends = np.concatenate([[0], upto])[np.asarray(pieces.offsets)[1:] - pieces.offsets[0].as_py()]
        return ids[place], ends

    def each(self, texts: pa.Array, end: int | None = None) -> list[np.ndarray]:
        """Ids of each text, as 32-bit numbers, with an end id if there is one."""
        ids, ends = self.lot(texts)
        ids = ids.astype("<u4")
        more = np.array([] if end is None else [end], "<u4")
        return [np.concatenate([ids[a:b], more]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, keep_old: bool = True) -> WordEncoder:
    """One encoder a worker process."""
    key = (path, keep_old)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, keep_old)
    return _ENCODERS[key]
