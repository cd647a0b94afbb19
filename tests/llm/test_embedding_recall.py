"""Embedding near-dedup on vectors whose variance lies in few directions, and on vectors of several lengths."""

import numpy as np
from mapstone.llm.embedding_dedup import near_embeddings

from .test_dedup import brute_components


def frame(spark, rows):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")


def links(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    return g


def test_recall_where_variance_lies_in_few_directions(spark):
    rng = np.random.default_rng(8)
    d = 256
    x = (rng.normal(size=(4000, d)) * np.exp(-np.arange(d) / 5)).astype(np.float32)
    g = links(x)
    got = {r.vec_id: r.n_links for r in near_embeddings(frame(spark, enumerate(x))).collect()}
    assert g.sum() > 1000 and all(got[i] <= n for i, n in enumerate(g.sum(1)))
    assert sum(got.values()) >= 0.99 * g.sum()


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(9)
    parts = [rng.normal(size=(n, d))[rng.integers(0, n, 2 * n)] + rng.normal(size=(2 * n, d)) * 0.05 for n, d in ((60, 24), (40, 16))]
    x = [v.astype(np.float32) for v in parts]
    got = {r.vec_id: r for r in near_embeddings(frame(spark, [*enumerate(x[0]), *((1000 + i, v) for i, v in enumerate(x[1])), (5000, np.ones(3))])).collect()}
    for first, v in zip((0, 1000), x, strict=True):
        g = links(v)
        comp = brute_components(range(len(v)), lambda a, b, g=g: g[a, b])
        assert g.any()
        for i in range(len(v)):
            assert (got[first + i].n_links, got[first + i].component_id) == (g[i].sum(), first + comp[i])
    assert got[5000].n_links == 0 and got[5000].kept and len(got) == 201


def test_double_components_keep_their_range(spark):
    rows = [(1, [1e39, 2e39, 0.0]), (2, [1e39, 2e39, 0.0]), (3, [1e-60, 0.0, 1e-60]), (4, [1e-60, 0.0, 1.1e-60]), (5, [1e200, -1e200, 1e200]), (6, [1e-200, -1e-200, 1e-200])]
    odd = [(7, [1.0, None, 1.0]), (8, [1.0, float("nan"), 1.0]), (9, [0.0, 0.0, 0.0]), (10, None), (11, []), (12, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_embeddings(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5)} | {i: (0, i) for i in range(7, 13)}
