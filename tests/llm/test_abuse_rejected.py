import random

import numpy as np

from sievework.llm import abuse as A
from tests.llm.test_abuse import corpus


def test_rejected_candidates_are_no_negatives(monkeypatch):
    learned, plain = [], A.Ftrl.learn
    monkeypatch.setattr(A.Ftrl, "learn", lambda self, i, y, weight: (learned.append((tuple(i), y)), plain(self, i, y, weight))[1])
    monkeypatch.setattr(A.Ftrl, "score", lambda self, i: 0.0)  # every candidate is rejected
    odd = "those zorbs are vermin and belong in cages"
    texts, labels = corpus(random.Random(6), 120)
    A.train([*texts, f"{odd}."], [*labels, 1])
    (words,) = A.sentences(odd)
    code = tuple(A.grams(np.array([A.Hashes()[w] for w in words], dtype=np.uint64)))
    assert (code, 1.0) in learned and (code, 0.0) not in learned
