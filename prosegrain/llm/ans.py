"""Static range asymmetric numeral system over interleaved lanes, in numpy.

State 64 bits, renormalised by 32-bit words; frequencies sum to 2**SCALE. A
block is coded by ``LANES`` states that take turns over its tokens. Every
``STRIDE`` steps the states and the place in the word stream are kept: a
checkpoint, from which decoding can start. All stretches between checkpoints
are decoded side by side.
"""

from __future__ import annotations

import numpy as np

SCALE, LANES, STRIDE = 20, 1024, 256
LOW = np.uint64(1 << 31)
WORD_BITS, MASK = np.uint64(32), np.uint64((1 << SCALE) - 1)


class Table:
    """Frequencies of symbols 0 .. n-1, scaled so that they sum to 2**SCALE and each one that occurs has 1 at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total = 1 << SCALE
        counts = counts.astype(np.int64)
        if not counts.sum():
            return cls(np.zeros(len(counts), dtype=np.int64))
        if (counts > 0).sum() > total:
            raise ValueError("more symbols than slots")
        freq = np.where(counts > 0, np.maximum(1, counts * (total / counts.sum())).astype(np.int64), 0)
        off = total - int(freq.sum())
        for k in np.argsort(-freq, kind="stable"):  # what rounding left goes to, or comes from, the most frequent
            step = off if off > 0 else max(off, 1 - int(freq[k]))
            freq[k] += step
            off -= step
            if not off:
                break
        return cls(freq)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(tokens: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states at checkpoints: stretches x LANES, words before each checkpoint, word stream)."""
    n = len(tokens)
    steps = -(-n // LANES)
    f_all, c_all = table.freq[tokens], table.cum[tokens]
    limit_all = f_all << np.uint64(63 - SCALE)
    x = np.full(LANES, LOW, dtype=np.uint64)
    stream, states, counts = [], [], np.zeros(steps + 1, dtype=np.int64)
    scale = np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, t * LANES + LANES)
        f, c, y = f_all[a:b], c_all[a:b], x[: b - a]
        over = y >= limit_all[a:b]
        words = y[over]
        stream.append(words.astype(np.uint32))
        counts[t] = len(words)
        np.right_shift(y, WORD_BITS, out=y, where=over)
        q, r = np.divmod(y, f)
        y[:] = (q << scale) + r + c
        if t % STRIDE == 0:
            states.append(x.copy())
    stream.reverse()
    states.reverse()
    before = np.concatenate([[0], np.cumsum(counts)])[:steps:STRIDE]
    return np.array(states).reshape(-1, LANES), before.astype(np.int64), np.concatenate(stream) if stream else np.zeros(0, np.uint32)


def decode(n: int, states: np.ndarray, before: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """The ``n`` tokens of a block; every stretch is decoded from its own checkpoint, all at once."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    stretches = len(states)
    x, at = states.copy(), before.copy()
    out = np.zeros((stretches, STRIDE, LANES), dtype=np.uint32)
    words = np.concatenate([words, np.zeros(1, np.uint32)]).astype(np.uint64)
    tail = n - (stretches - 1) * STRIDE * LANES
    scale, slots, freq, cum = np.uint64(SCALE), table.slots, table.freq, table.cum
    for t in range(STRIDE):
        last = min(LANES, max(0, tail - t * LANES))
        live = stretches if last else stretches - 1
        if not live:
            break
        y = x[:live]
        slot = y & MASK
        s = slots[slot]
        z = freq[s] * (y >> scale) + slot - cum[s]
        low = z < LOW
        if last and last < LANES:
            z[-1, last:] = y[-1, last:]
            low[-1, last:] = False
            s[-1, last:] = 0
        take = np.cumsum(low, axis=1)
        place = np.minimum(at[:live, None] + take - 1, len(words) - 1)
        x[:live] = np.where(low, (z << WORD_BITS) | words[place], z)
        at[:live] += take[:, -1]
        out[:live, t] = s
    return out.reshape(-1)[:n]
