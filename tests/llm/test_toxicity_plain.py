"""The fit's gradient and the noisy-or against plain versions."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import toxicity


def corpus(n=120):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(60)}"
    texts, labels = [], []
    for k in range(n):
        lines = [" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(1, 6))]
        if k % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), f"you {rng.choice(['grobian', 'lackwit'])} go")
        texts.append(". ".join(lines) + "."), labels.append(int(k % 3 == 0))
    return texts, labels


def plain_loss(texts, labels, names, w, bias, leak=0.02, decay=2e-4):
    """Negative log-likelihood, classes weighing the same, one sentence at a time."""
    n, ones = len(labels), sum(labels)
    total = decay / 2 * sum(x * x for x in w)
    for t, y in zip(texts, labels):
        none = 1 - leak
        for a, b in toxicity.sentences(t):
            known = [w[names[f]] for word in t[a:b].split() for f in toxicity.features(word) if f in names]
            none *= 1 - (1 / (1 + math.exp(-sum(known) - bias)) if known else 0)
        total -= (n / (2 * ones) if y else n / (2 * (n - ones))) / n * math.log(1 - none if y else none)
    return total


def test_the_fit_goes_down_the_plain_gradient():
    texts, labels = corpus()
    names = {f: k for k, f in enumerate(toxicity.choose(texts, np.array(labels)))}
    assert names
    # One step of Adam moves every parameter by the rate against its gradient's sign.
    model = toxicity.fit(texts, labels, steps=1, rate=0.01)
    w, start = [0.0] * len(names), -2.0
    loss = lambda w, bias: plain_loss(texts, labels, names, w, bias)
    eps = 1e-5
    slope = (loss(w, start + eps) - loss(w, start - eps)) / (2 * eps)
    assert (model.bias - start) * slope < 0
    for f, k in names.items():
        up, down = list(w), list(w)
        up[k], down[k] = w[k] + eps, w[k] - eps
        slope = (loss(up, start) - loss(down, start)) / (2 * eps)
        assert abs(slope) < 1e-7 or (model.weights[f] - w[k]) * slope < 0
    fitted = toxicity.fit(texts, labels)
    assert loss([fitted.weights.get(f, 0.0) for f in names], fitted.bias) < 0.2 * loss(w, start)


def test_the_score_is_the_noisy_or_of_all_sentences():
    model = toxicity.Model({"grobian": 3.0, "grob*": 1.0, "kind": -2.0}, -3.0, 0.02)
    for text in ("", "a b. c d!", "Grobian! kind grobian? nothing here\nkind", "x. " * 500, "grobian " * 50):
        none = 1 - model.leak
        for a, b in toxicity.sentences(text):
            known = [model.weights[f] for w in text[a:b].split() for f in toxicity.features(w) if f in model.weights]
            none *= 1 - (1 / (1 + math.exp(-min(30, model.bias + sum(known)))) if known else 0)
        score, found = toxicity.Scorer(model)(text)
        assert score == pytest.approx(1 - none, abs=1e-12)
        assert all(text[a:b].strip() and p >= 0.5 for a, b, p in found)


def test_length_makes_no_text_toxic():
    score = toxicity.Scorer(toxicity.Model({"grobian": 4.0}, -2.0, 0.02))
    clean, one = "a harmless line\n", "you grobian\n"
    assert score(clean)[0] == score(clean * 1_000_000)[0] == pytest.approx(0.02)
    assert score(clean * 500_000 + one + clean * 500_000)[0] == score(one)[0] > 0.85
    assert score(clean * 500_000 + one)[1][0][:2] == (len(clean) * 500_000, len(clean) * 500_000 + len(one) - 1)
