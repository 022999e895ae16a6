"""Recall of the pivot index on vectors that have many true pairs."""

import numpy as np
import pytest

from pitchline.llm import embeddings


def pairs_at(rng, n, cosine):
    """Unit vectors x and y, x @ y = cosine row by row."""
    x = embeddings.unit(rng.standard_normal((n, 64)))
    z = rng.standard_normal((n, 64))
    z = embeddings.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("count", [embeddings.MIN_PIVOTS, embeddings.MAX_PIVOTS])
@pytest.mark.parametrize("cosine", [0.951, 0.96, 0.97])
def test_recall_at_pivot_counts(count, cosine):
    rng = np.random.default_rng(count)
    pivots = embeddings.spread(rng.standard_normal((2 * count, 64)), count)
    x, y = pairs_at(rng, 4000, cosine)
    assert len(pivots) == count
    near = [embeddings.nearest(v, pivots) for v in (x, y)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).any(axis=2).sum(axis=1)
    recall = (shared >= embeddings.LEAST_SHARED).mean()
    print(f"recall at {count} pivots, cosine {cosine}: {recall:.4f}")
    assert recall >= 0.9


def test_query_finds_true_pairs(spark):
    x, y = (np.concatenate(v) for v in zip(*(pairs_at(np.random.default_rng(k), 300, c) for k, c in enumerate((0.951, 0.96, 0.97)))))
    rows = np.concatenate([x, y]).astype(np.float32)
    u = embeddings.unit(rows)
    true = (u @ u.T >= 0.95).sum() - len(rows)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id long, embedding array<float>")
    found = sum(r.n_links for r in embeddings.near_vectors(df).collect())
    print(f"links found {found} of {true}")
    assert true >= 1800 and found >= 0.9 * true
