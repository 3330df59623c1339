"""Distance sums in a plane against all pairs, and that their work does not grow with the square."""

import numpy as np
import pytest

from tessera.operators import far
from tessera.operators import metrics as M


def rows_of(x, c, w=None):
    return [(0, i, c[i], int(w[i]) if w is not None else 1, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind", ["grid", "clumps", "line", "large"])
def test_sums_match_all_pairs(spark, kind):
    r = np.random.default_rng(3)
    n = 1500
    x = {"grid": np.column_stack([np.arange(n) % 40, np.arange(n) // 40]).astype(float),
         "clumps": np.vstack([r.normal(size=(700, 2)) * 1e-4, 5 + r.normal(size=(500, 2)), np.array([[9.0, 1e4]]), r.normal(size=(299, 2)) * [1e3, 1e-6]]),
         "line": r.normal(size=(n, 1)), "large": 1e9 + r.normal(size=(n, 2)) * 100}[kind]
    c, w = [str(v) for v in r.integers(0, 4, n)], r.integers(1, 5, n)
    c[7] = "alone"
    points = spark.createDataFrame(rows_of(x, c, w), "_g int, one long, c string, w long, emb array<double>").repartition(5)
    got = {(t["one"], t["k"]): t["total"] for t in far.plane_sums(points, ["_g"], least=1, leaf=20).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for k in set(c):
        want = d @ (w * np.array([v == k for v in c]))
        mine = np.array([got[i, k] for i in range(n)])
        assert np.abs(mine - want).max() <= 1e-10 * np.abs(want).max()
    assert len(got) == n * len(set(c))


def test_boxes_that_meet_do_not_grow_with_the_points():
    r = np.random.default_rng(4)
    near, others = [], []
    for depth in (6, 10):
        x = r.random((2 ** depth * 8, 2))
        leaf = far.tree_of(x, depth).leaves(x)
        rows = [{"leaf": i, "low": x[leaf == i].min(0).tobytes(), "high": x[leaf == i].max(0).tobytes(), "weight": np.zeros((far.NODES ** 2, 1)).tobytes()} for i in np.unique(leaf)]
        boxes = far.boxes_of(2 ** depth, rows, 1)
        met = [boxes.met(i) for i in range(0, 2 ** depth, 7)]
        near.append(np.mean([len(n) for _, n in met]))
        others.append(np.mean([len(f) for f, _ in met]))
    assert near[1] < 2 * near[0] and others[1] < 4 * others[0]


def test_large_planes_take_the_boxes(spark, monkeypatch):
    """Silhouettes of many points in a plane are the same as by pairs, and come from boxes."""
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 2))
    df = spark.createDataFrame([(i, str(i % 3), [float(a), float(b)]) for i, (a, b) in enumerate(x)], "spot_id long, c string, emb array<double>")
    pairs = {t["spot_id"]: t["silhouette"] for t in M.silhouette_values(df, "c").collect()}
    used = []
    monkeypatch.setattr(M, "plane_sums", lambda p, k: used.append(far.plane_sums(p, k, least=100, leaf=20)) or used[-1])
    boxes = {t["spot_id"]: t["silhouette"] for t in M.silhouette_values(df, "c").collect()}
    assert used[0] is not None and boxes.keys() == pairs.keys()
    assert max(abs(boxes[i] - pairs[i]) for i in pairs) < 1e-10


def test_other_points_are_left_to_pairs(spark):
    wide = spark.createDataFrame([(0, i, "a", 1, [1.0, 2.0, float(i)]) for i in range(9)], "_g int, one long, c string, w long, emb array<double>")
    assert far.plane_sums(wide, ["_g"], least=1) is None
    assert far.plane_sums(wide.selectExpr("_g", "one", "c", "w", "slice(emb, 1, 2) as emb"), ["_g"], least=10) is None
    odd = spark.createDataFrame([(0, i, "a", 1, [1.0, float("nan")] if i else None) for i in range(9)], "_g int, one long, c string, w long, emb array<double>")
    assert far.plane_sums(odd, ["_g"], least=1) is None
