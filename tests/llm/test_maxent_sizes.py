"""The language model's sizes follow the corpus."""

import numpy as np
import pytest

from aeolia.llm import maxent


def test_sizes_grow_with_the_corpus():
    sizes = [maxent.Sizes.of(n) for n in (0, 10**8, 10**10, 10**12)]
    for a, b in zip(sizes, sizes[1:]):
        assert a.word_classes < b.word_classes and a.rest_classes < b.rest_classes and a.contexts < b.contexts
        assert a.pairs <= b.pairs and a.inner <= b.inner and b.word_classes**2 == b.vocabulary
    assert sizes[0].vocabulary == maxent.VOCABULARY and sizes[-1].pairs > maxent.PAIRS


def test_grown_model_sums_to_one():
    s = maxent.Sizes.of(10**10)
    rng = np.random.default_rng(1)
    w = maxent.Weights.start(np.ones(s.k), np.ones(s.vocabulary), s)
    w.outer[:] = rng.normal(size=w.outer.shape)
    w.inner[:] = rng.normal(size=w.inner.shape)
    place = np.r_[np.arange(s.vocabulary), np.full(s.rest_classes, -1)]
    rest = np.r_[np.zeros(s.vocabulary, int), np.arange(s.rest_classes)]
    made = maxent.features(place, rest, np.arange(len(place)), s)
    assert np.exp(maxent.log_probability(w, made[0], place, *made[1:])).sum() == pytest.approx(1.0, rel=1e-4)
