"""Neighbour search and silhouettes over blocks: close values, equal vectors, and what is sent."""

import numpy as np
import pytest

from tessera.operators import graph as G
from tessera.operators import metrics as M


def sent(spark) -> int:
    """Bytes written by shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def frame(spark, m, c=None):
    return spark.createDataFrame([(i, [float(v) for v in row], c[i] if c else "x") for i, row in enumerate(m)],
                                 "spot_id long, emb array<double>, c string")


def test_neighbours_closer_than_single_precision(spark):
    rng = np.random.default_rng(5)
    m = 1000.0 + rng.normal(size=(300, 5)) * np.repeat([1.0, 1e-4, 1e-8], 100)[:, None]
    got = {}
    for r in G.vector_knn(frame(spark, m), 6, pivots=3, block=40).collect():
        got.setdefault(r["src"], {})[r["rank"]] = (r["dst"], r["dist2"])
    for i in range(len(m)):
        diff = m - m[i]
        d2 = np.einsum("ij,ij->i", diff, diff)
        want = [(j, d2[j]) for j in sorted(set(range(len(m))) - {i}, key=lambda j: (d2[j], j))[:6]]
        assert [got[i][k] for k in range(1, 7)] == want


def test_neighbours_among_more_queries_than_candidates(spark):
    q = frame(spark, [[float(i % 7), 0.0] for i in range(60)])
    got = {}
    for r in G.vector_knn(frame(spark, [[0.0, 0.0], [5.0, 0.0], [5.0, 0.0]]), 2, queries=q, exclude_self=False, block=4).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist2"]))
    for i in range(60):
        want = sorted(((i % 7 - x) ** 2, j) for j, x in enumerate([0.0, 5.0, 5.0]))[:2]
        assert sorted(got[i]) == [(n + 1, j, float(d)) for n, (d, j) in enumerate(want)]


def test_silhouette_of_close_and_equal_points(spark):
    rng = np.random.default_rng(6)
    m = 1000.0 + np.vstack([rng.normal(size=(30, 4)), np.repeat(rng.normal(size=(2, 4)), 20, axis=0), rng.normal(size=(20, 4)) * 1e-7])
    c = ["a" if i % 3 else "b" for i in range(30)] + ["c"] * 20 + ["d"] * 20 + ["e", "f"] * 10
    got = {r["spot_id"]: r["silhouette"] for r in M.silhouette_values(frame(spark, m, c), "c", block=16).collect()}
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    for i in range(len(m)):
        own = [j for j in range(len(m)) if c[j] == c[i] and j != i]
        b = min(np.mean([d[i, j] for j in range(len(m)) if c[j] == k]) for k in set(c) - {c[i]})
        a = d[i, own].mean()
        assert got[i] == pytest.approx((b - a) / max(a, b), rel=1e-9, abs=1e-9)


def test_equal_vectors_are_sent_once(spark):
    rng = np.random.default_rng(7)
    m = np.tile(rng.normal(size=(30, 32)), (200, 1))
    df = frame(spark, m, [str(i % 4) for i in range(len(m))]).repartition(4).cache()
    raw = m.nbytes
    before = sent(spark)
    assert M.silhouette_values(df, "c").count() == len(m)
    assert sent(spark) - before < 5 * raw
    before = sent(spark)
    assert G.vector_knn(df, 3).count() == 3 * len(m)
    assert sent(spark) - before < 8 * raw


def test_vectors_are_sent_once_per_block(spark):
    m = np.random.default_rng(8).normal(size=(3000, 16))
    df = frame(spark, m).repartition(4).cache()
    before = sent(spark)
    assert G.vector_knn(df, 2).count() == 2 * len(m)
    assert sent(spark) - before < 50 * m.nbytes
