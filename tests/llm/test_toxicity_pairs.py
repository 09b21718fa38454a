from __future__ import annotations

import numpy as np

from tidemark.llm import toxicity as T


def test_pairs_met_by_documents_are_those_of_products():
    rng = np.random.default_rng(3)
    x = rng.random((60, 40)) < rng.random(40)
    col, row = np.nonzero(x.T)
    y, p = (rng.random(60) < 0.5).astype(float), rng.random(60)

    def pairs(parts):
        return {(min(a, b), max(a, b)): (n, k, round(float(q), 3)) for part in parts for a, b, n, k, q in zip(*part, strict=True)}

    for fewest in (0.0, 6.4):
        want = {(a, b): (m.sum(), y[m].sum(), round(float(p[m].sum()), 3)) for a in range(40) for b in range(a + 1, 40) if (m := x[:, a] & x[:, b]).sum() >= max(fewest, 1)}
        for meet in (T._products, T._met):
            got = pairs(meet(row, col, 40, y, p, fewest, 16))
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-3) for k in want)


def test_many_rare_terms_do_not_cost_their_square(monkeypatch):
    """A document that is mispredicted leaves all its terms; those are met document by document."""
    monkeypatch.setattr(T, "_products", lambda *a: (_ for _ in ()).throw(AssertionError("a product over all pairs of terms")))
    docs = [np.concatenate([[0], np.arange(1 + 9 * (i // 8), 10 + 9 * (i // 8))]) for i in range(4000)]
    y = np.tile([0.0] * 8 + [1.0] * 8, 250)
    T.interacting(docs, y, np.where(np.arange(4000) % 2, 0.01, 0.99))


def test_the_fit_takes_a_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 40_000, 600)).astype(np.int32) for _ in range(1500)]
    y = (np.arange(1500) % 2).astype(float)
    tracemalloc.start()
    T.interacting(docs, y, np.where(np.arange(1500) % 50 == 0, 1 - y, y))
    T.telling(docs, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6, most
