"""All sentences that reach the threshold are put out, however many, and none that does not."""

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import toxicity


def test_no_cap_on_offending_sentences():
    score = toxicity.Scorer(toxicity.Model({"lout": 4.0, "meh": 0.5}, -2.0, 0.02))
    text = " ".join(f"you lout {k}." if k % 3 else f"meh {k}." for k in range(60))
    _, found = score(text)
    assert [text[a:b].strip() for a, b, _ in found] == [f"you lout {k}." for k in range(60) if k % 3]
    assert all(p >= toxicity.OFFENDING for *_, p in found) and score("meh. calm.")[1] == []
