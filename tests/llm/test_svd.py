"""The latent space against NumPy's SVD of the whole matrix."""

import numpy as np
import pytest

from lexmill.llm import decontaminate as D


def matrix(items, known, idf):
    rows = []
    for words in items:
        for p in D.passages(words):
            row = np.zeros(len(known))
            np.add.at(row, np.searchsorted(known, p), idf[np.searchsorted(known, p)])
            rows.append(row)
    return np.array(rows)


@pytest.mark.parametrize(("vocabulary", "n", "size"), [(60, 40, 37), (900, 150, 80), (5, 3, 4)])
def test_leading_singular_values_and_directions(spark, vocabulary, n, size):
    rng = np.random.default_rng(vocabulary)
    known = np.unique(rng.integers(1, 2**63, vocabulary).astype(np.uint64))
    share = 1.0 / (1 + np.arange(len(known)))  # Zipf-like: a spectrum that falls
    items = [rng.choice(known, size, p=share / share.sum()) for _ in range(n)]
    idf = rng.uniform(0.1, 3.0, len(known))
    a = matrix(items, known, idf)
    want = np.linalg.svd(a, compute_uv=False)
    values, vectors = D.singular_space(spark.createDataFrame([(w.tobytes(),) for w in items], "words binary").repartition(3), known, idf)
    rank = min(D.RANK, int((want > 1e-6 * want[0]).sum()))
    assert len(values) == rank and vectors.shape == (len(known), rank) and (np.diff(values) <= 1e-9).all()
    exact = rank if len(known) <= D.RANK + D.OVERSAMPLE else 60
    assert np.allclose(values[:exact], want[:exact], rtol=1e-6 if exact == rank else 0.005)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-8)
    assert np.allclose(np.linalg.norm(a @ vectors, axis=0)[:exact], values[:exact], rtol=1e-6)
    best = np.sqrt((want[rank:] ** 2).sum())  # what any space of this rank leaves out at least
    assert np.linalg.norm(a - a @ vectors @ vectors.T) <= 1.02 * best + 1e-6 * want[0]
