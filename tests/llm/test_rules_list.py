"""Learning decision lists: one acceptance rule at all sizes."""

import numpy as np
import pytest

from tessera.llm import rules


def sample(n, junk, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(rules.FEATURES)))
    bad = np.zeros(n, bool)
    bad[:junk] = True
    x[bad, 3] = 2 + x[bad, 3]
    return x, bad


@pytest.mark.parametrize("n, junk", [(200, 12), (2000, 12), (2000, 400), (20000, 12)])
def test_rare_junk_is_learnt_at_every_size(n, junk):
    x, bad = sample(n, junk)
    (rule,) = rules.learn(x, bad)
    assert (rule.holds(x) == bad).all()


def test_copies_prove_nothing():
    x, bad = sample(300, 20)
    once = rules.learn(x, bad)
    assert once and rules.learn(np.repeat(x, 10, 0), np.repeat(bad, 10)) == once
    x, bad = sample(300, 2)
    assert rules.learn(x, bad) == [] == rules.learn(np.repeat(x, 1000, 0), np.repeat(bad, 1000))


def test_nothing_is_learnt_from_noise():
    rng = np.random.default_rng(5)
    for n in (30, 300, 3000):
        for share in (0.1, 0.5):
            assert rules.learn(rng.random((n, len(rules.FEATURES))), rng.random(n) < share) == []


def test_chance_is_a_bound():
    from math import comb

    for n in (1, 5, 20):
        for k in range(1, n + 1):
            for p in (0.05, 0.3, 0.7):
                assert rules.by_chance(n, k, p) >= sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) - 1e-12


def test_empty_and_single_class():
    assert rules.learn(np.zeros((0, len(rules.FEATURES))), np.zeros(0, bool)) == []
    assert rules.learn(np.ones((9, len(rules.FEATURES))), np.ones(9, bool)) == []
