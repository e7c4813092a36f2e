import numpy as np
import pytest

from tallymark.llm import toxicity

from .test_operators import corpus


@pytest.mark.parametrize("piece", [1, 7, 50, 1000])
def test_pieces_of_a_long_text_change_nothing(monkeypatch, piece):
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.LETTERS**3), 0.1, 1.0, 0.0)
    texts = [t or "" for _, t in corpus(3, 40)] + ["", " ", "a" * 3000, "i d i o t. " * 40]
    assert all(len(model.texts([t])) == 1 for t in ("", "a", "ab", "abc", "abcd", "ab c"))  # alone, too
    whole = model.texts(texts)
    monkeypatch.setattr(toxicity, "PIECE", piece)
    assert np.array_equal(model.texts(texts), whole)
