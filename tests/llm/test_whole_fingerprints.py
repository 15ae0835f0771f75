"""Fingerprints against a plain parse, one text and one name at a time."""

import random

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import parsing

MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def toss(left, right, bits):
    d = left ^ right
    low = (d & -d).bit_length() - 1 if d else bits - 1
    return 2 * low + (right >> low & 1)


def plain_parse(data):
    """Levels of (names, spans)."""
    names, spans, out = list(data), [1] * len(data), []
    while names and not (out and len(names) == 1):
        level, folded = len(out) + 1, []
        for x, span in zip(names, spans):
            if folded and folded[-1][0] == x:
                folded[-1] = [x, folded[-1][1] + 1, folded[-1][2] + span]
            else:
                folded.append([x, 1, span])
        label = [x for x, *_ in folded]
        for bits in [8] * 3 if level == 1 else [64] + [8] * 3:
            label = [toss(label[i - 1] if i else 0, label[i], bits) for i in range(len(label))]
        n = len(label)
        begin = [i for i in range(n) if i == 0 or i > 1 and label[i] > label[i - 1] and (i == n - 1 or label[i] >= label[i + 1])]
        names, spans = [], []
        for a, b in zip(begin, [*begin[1:], n]):
            total = 0
            for i in range(a, b):
                x, run, _ = folded[i]
                place = (i - a) % 16
                value = mix((place << 8 | x) + 1) if level == 1 else mix(x) * (mix(place + 0xABCDEF) | 1) & MASK
                total += value if run == 1 else mix(value + run & MASK)
            names.append(mix(total + (b - a) + (level << 40) & MASK))
            spans.append(sum(folded[i][2] for i in range(a, b)))
        out.append((names, spans))
    return out


def plain_fingerprint(data):
    keys = sorted({mix(x) // span >> 16 for names, spans in plain_parse(data) for x, span in zip(names, spans)})
    kept = keys[: max(96, -(-len(keys) // 8))]
    return bytes([len(kept) < len(keys)]) + b"".join(k.to_bytes(6, "big") for k in kept)


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 10))) for _ in range(300)]
    return [b"", b"a", b"ab", b"aaaa", b"abababab" * 9, "é🎉 é🎉".encode(), b"\x00\x00\xff" * 20] + [" ".join(rng.choices(words, k=n)).encode() for n in (1, 3, 10, 60, 400, 3000)]


def test_as_a_plain_parse():
    data = texts()
    for one in data:
        got, want = parsing.parse([one]), plain_parse(one)
        assert [(n.tolist(), s.tolist()) for n, s, _ in got] == want
        assert not one or sum(want[-1][1]) == len(one) and len(want[-1][0]) == 1
    assert parsing.fingerprints(data) == [plain_fingerprint(x) for x in data]


def test_likeness_estimates_the_share_of_phrases_by_bytes():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 10))) for _ in range(5000)]
    for _ in range(10):
        a = " ".join(rng.choices(words, k=1500))
        b = a[: 3 * len(a) // 4] + " ".join(rng.choices(words, k=375))
        x, y = ({(n, s) for names, spans in plain_parse(t.encode()) for n, s in zip(names, spans)} for t in (a, b))
        marks = parsing.fingerprints([a.encode(), b.encode()])
        most = (1 << 48) / min(int.from_bytes(m[-6:], "big") for m in marks)  # phrases that span more are in any sample
        exact = sum(min(s, most) for _, s in x & y) / sum(min(s, most) for _, s in x | y)
        assert abs(parsing.likeness(*marks) - exact) < 0.12


def test_a_shared_passage_is_seen_in_a_long_text():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 10))) for _ in range(5000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    seen = 0
    for _ in range(20):
        passage = text(100)
        long, other = (f"{text(n)} {passage} {text(n)}".encode() for n in (10_000, 400))
        a, b = map(parsing._keys, parsing.fingerprints([long, other]))
        seen += bool({*a} & {*b})
    assert seen >= 19
