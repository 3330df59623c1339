"""Operators on small hand-made frames, checked against known results or brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import ranks as RK
from tessera.model import SpatialData
from tessera.operators import blocks as B
from tessera.operators import graph as G
from tessera.operators import matrices as MA
from tessera.operators import metrics as M
from tessera.operators import prepare as P
from tessera.operators import ranking as R
from tessera.operators import robust as J
from tessera.operators import scoring as S
from tessera.operators import spatial as SP
from tessera.operators import validate as V
from tessera.operators import variable as HV


def names(spark, *genes):
    return spark.createDataFrame([(g, i + 1) for i, g in enumerate(genes)], "gene string, rank int")


def test_count_contract(spark):
    raw = spark.createDataFrame([("s", "a", "g1", 1.0, 0.7), ("s", "b", "g1", 2.0, 1.1), ("s", "b", "g2", 3.0, 1.4)],
                                "slice string, spot_id string, gene string, raw_count double, x double")
    assert sorted(r["count"] for r in P.resolve_counts(raw).collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        P.resolve_counts(raw, "missing")
    with pytest.raises(ValueError):
        P.require_counts(P.resolve_counts(raw, "X"))
    assert P.is_count_like(P.resolve_counts(raw).limit(0)).first()["count_like"]


def test_slice_graph(spark):
    rows = [(f"{s}{i}", s, float(i), 0.0) for s in "ab" for i in range(3)]
    spots = spark.createDataFrame(rows, "spot_id string, slice string, x double, y double")
    directed, both = G.slice_graph(spots, 1)
    assert directed.count() == 6
    assert all(r["src"][0] == r["dst"][0] for r in both.collect())
    edges = {(r["src"], r["dst"]) for r in both.collect()}
    assert edges == {(b, a) for a, b in edges}


def test_single_spot_slice(spark):
    spots = spark.createDataFrame([("x", "single", 0.0, 0.0), ("y", "pair", 0.0, 0.0), ("z", "pair", 1.0, 0.0)],
                                  "spot_id string, slice string, x double, y double")
    assert sorted((r["src"], r["dst"]) for r in G.knn_join(spots, 3).collect()) == [("y", "z"), ("z", "y")]


def test_knn_and_radius_on_skewed_points(spark):
    """A third of all spots at one place, a dense clump, a lattice and an outlier."""
    rng = np.random.default_rng(1)
    xy = [(5.0, 5.0)] * 120 + [tuple(v) for v in rng.normal(0, 0.01, (80, 2))] + [(i % 20, i // 20) for i in range(150)] + [(900.0, -300.0)]
    pts = [(i, "a" if i % 4 else "b", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    spots = spark.createDataFrame(pts, "spot_id long, slice string, x double, y double")
    got = {}
    for r in G.knn_join(spots, 5).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    degree = {r["spot_id"]: r["degree"] for r in G.radius_degree(spots, 3.0).collect()}
    for i, s, x, y in pts:
        d = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, t, u, v in pts if t == s and j != i)
        assert [got[i][k] for k in range(1, 6)] == [j for _, j in d[:5]]
        assert degree[i] == sum(v <= 9.0 for v, _ in d)


def test_vector_knn_blocks(spark):
    rng = np.random.default_rng(2)
    m = np.vstack([rng.normal(size=(60, 6)), np.tile(rng.normal(size=(1, 6)), (30, 1))])
    emb = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "spot_id long, emb array<double>")
    got = {}
    for r in G.vector_knn(emb, 4, pivots=5, block=8).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i in range(len(m)):
        d = sorted((float(((m[i] - m[j]) ** 2).sum()), j) for j in range(len(m)) if j != i)
        assert [got[i][k] for k in range(1, 5)] == [j for _, j in d[:4]]


def test_ranges_of_large_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 400, 900)] + [("cold", float(v)) for v in range(7)]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v double")
    ranked = {r["id"]: r["r"] for r in RK.spread_rank(df, "v", ["g"], "r", rows_per_range=40).collect()}
    for i, (g, v) in enumerate(rows):
        same = [w for h, w in rows if h == g]
        assert ranked[i] == sum(w < v for w in same) + (sum(w == v for w in same) + 1) / 2
    q = {r["g"]: r for r in RK.exact_quantiles(df, "v", ["g"], {"m": 0.5, "p": 0.95}, rows_per_range=40).collect()}
    for g in ("hot", "cold"):
        same = [w for h, w in rows if h == g]
        assert q[g]["m"] == pytest.approx(np.quantile(same, 0.5)) and q[g]["p"] == pytest.approx(np.quantile(same, 0.95))


def test_pvalue_sanitizing(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([-1e-12, 0.2, 1 + 1e-12, float("nan"), float("inf")])], "i int, p double")
    got = [r["p"] for r in df.select("i", R.sanitize_pvalue("p").alias("p")).orderBy("i").collect()]
    assert got == [0.0, 0.2, 1.0, 1.0, 1.0]


def test_moran_gradient_first(spark):
    rng = np.random.default_rng(0)
    spots, expr = [], []
    for s in ("s1", "s2"):
        for i in range(30):
            spots.append((f"{s}-{i}", s, float(i), 0.0, "l"))
            expr += [(s, f"{s}-{i}", "gradient", float(i + 1)), (s, f"{s}-{i}", "noise", float(rng.random() + 0.1)), (s, f"{s}-{i}", "constant", 1.0)]
    ds = SpatialData(spark.createDataFrame(spots, "spot_id string, slice string, x double, y double, label string"),
                     spark.createDataFrame([("constant", 0), ("gradient", 1), ("noise", 2)], "gene string, gene_index long"),
                     spark.createDataFrame(expr, "slice string, spot_id string, gene string, value double"))
    ranked = R.top_features(SP.morans_i(ds, 4), None).orderBy("rank").collect()
    assert ranked[0]["gene"] == "gradient"
    assert {r["gene"]: r["score"] for r in ranked}["constant"] == 0.0


def test_list_combinations(spark):
    hvg, svg = names(spark, *"abcdef"), names(spark, *"abxyzq")
    union = [r["gene"] for r in R.balanced_union(hvg, svg, 6).orderBy("rank").collect()]
    assert len(set(union)) == 6 and {"a", "b", "c", "x"} <= set(union)
    both = R.rank_intersection(names(spark, *"abcd"), names(spark, *"cbxa"), 4).orderBy("rank").collect()
    assert [r["gene"] for r in both] == ["b", "c", "a"]
    with pytest.raises(ValueError):
        R.retain_targets("HVG", 1, hvg, svg, names(spark, "a", "b"), 2)
    kept = R.retain_targets("hybrid", 5, hvg, svg, names(spark, "q", "f"), 2).collect()
    assert len(kept) == 5 and {"q", "f"} <= {r["gene"] for r in kept}


def test_alignment_pairs(spark):
    rows = list(zip(range(6), [0.0, 10.0, 100.0, 110.0, 0.1, 10.1], "abxyab", ["left", "left", "unrelated", "unrelated", "right", "right"]))
    emb = spark.createDataFrame([(i, [v], l, s) for i, v, l, s in rows], "spot_id long, emb array<double>, label string, slice string")
    r = M.alignment_scores(emb, [("left", "right")]).first()
    assert (r["accuracy"], r["ratio"]) == (1.0, 0.0)
    with pytest.raises(ValueError):
        M.alignment_scores(emb, [("left", "absent")])
    assert M.alignment_scores(emb, []).first()["accuracy"] is None


def test_silhouette_over_blocks(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 3))
    c = [str(i % 3) for i in range(49)] + ["lone"]
    emb = spark.createDataFrame([(i, [float(v) for v in m[i]], c[i]) for i in range(50)], "spot_id long, emb array<double>, c string")
    got = {r["spot_id"]: r["silhouette"] for r in M.silhouette_values(emb, "c", block=9).collect()}
    for i in range(50):
        d = np.sqrt(((m - m[i]) ** 2).sum(1))
        own = [j for j in range(50) if c[j] == c[i] and j != i]
        b = min(np.mean([d[j] for j in range(50) if c[j] == k]) for k in set(c) - {c[i]})
        want = (b - d[own].mean()) / max(b, d[own].mean()) if own else 0.0
        assert got[i] == pytest.approx(want)


def test_components_and_linkage(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 100, 101, 200]], "node long")
    c = {r["node"]: r["component"] for r in G.connected_components(e, nodes).collect()}
    assert {c[i] for i in range(1, 41)} == {1} and c[101] == 100 and c[200] == 200
    ab = spark.createDataFrame([("s1", "a", 1.0), ("s2", "a", 0.9), ("s2", "b", 0.1), ("s3", "b", 1.0)], "slice string, domain string, share double")
    k = {r["slice"]: r["cluster"] for r in M.slice_clusters(ab, 2).collect()}
    assert k["s1"] == k["s2"] != k["s3"]


def test_local_fit_recovers_a_parabola(spark):
    rows = [("s", f"g{i:02d}", i / 10, 2 + i / 10 - (i / 10) ** 2) for i in range(40)]
    fit = HV.local_fit(spark.createDataFrame(rows, "slice string, gene string, x double, y double"), "x", "y", 0.3).collect()
    assert all(r["fitted"] == pytest.approx(r["y"], abs=1e-8) for r in fit)


def sparse(spark, m):
    """A matrix as packed rows, a third of its entries dropped by the caller."""
    rows = [("a" if i % 3 else "b", i, [(int(j), float(v)) for j, v in enumerate(r) if v]) for i, r in enumerate(m)]
    return spark.createDataFrame([(s, i, r or None) for s, i, r in rows], "slice string, spot_id long, row array<struct<g:int,v:double>>").repartition(3)


def test_correlation_tiles(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 11)) * (rng.random((60, 11)) < 0.6)
    m[:, 4] = 0
    got = {}
    for r in MA.correlation_tiles(sparse(spark, m).drop("slice"), 11, 60, m.sum(0), (m * m).sum(0), band=4).collect():
        got[r["i"], r["j"]] = np.frombuffer(r["r"], "<i4").reshape(4, 4)
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(m.T)
    for i in range(11):
        for j in range(11):
            v = got[min(i, j) // 4, max(i, j) // 4]
            v = v[i % 4, j % 4] if i // 4 <= j // 4 else v[j % 4, i % 4]
            assert v == MA.NONE if i == j or 4 in (i, j) else abs(v - want[i, j] * 1e6) <= 1
    tiles = MA.correlation_tiles(sparse(spark, m).drop("slice"), 11, 60, m.sum(0), (m * m).sum(0), band=4)
    hits = {r["_p"]: r["hits"] for r in MA.partners_below(tiles, -50_000, band=4).collect()}
    assert all(hits.get(i, 0) == sum(np.rint(want[i, j] * 1e6) < -50_000 for j in range(11) if j != i and 4 not in (i, j)) for i in range(11))
    assert sum(r["c"] for r in MA.low_counts(tiles).collect()) == 90


@pytest.mark.parametrize("genes,k", [(7, 3), (90, 5)])
def test_components_equal_a_dense_decomposition(spark, genes, k):
    rng = np.random.default_rng(7)
    m = (rng.normal(size=(150, 4)) @ rng.normal(size=(4, genes)) + rng.normal(size=(150, genes))) * (rng.random((150, genes)) < 0.5)
    m[5] = 0
    slices = np.array(["a" if i % 3 else "b" for i in range(150)])
    offsets = {"a": rng.normal(size=genes), "b": np.zeros(genes)}
    whole = m + np.stack([offsets[s] for s in slices])
    v, theta = MA.components(sparse(spark, m), offsets, genes, k)
    u, s, vt = np.linalg.svd(whole)
    assert np.allclose(theta, s[:k] ** 2, rtol=1e-8)
    assert np.allclose(np.abs((v * vt[:k].T).sum(0)), 1, atol=1e-6)
    emb = {r["spot_id"]: r["emb"] for r in MA.projected(sparse(spark, m), offsets, v).collect()}
    assert np.allclose(np.stack([emb[i] for i in range(150)]), whole @ v)


def test_local_fit_over_ranges(spark):
    """Several ranges with halos give what one loop over the genes gives, ties and singular windows included."""
    rng = np.random.default_rng(1)
    rows = [(s, f"g{i:04d}", float(x), float(np.sin(x))) for s, n, digits in (("a", 700, 2), ("b", 30, 1), ("c", 2, 1), ("d", 90, 0))
            for i, x in enumerate(rng.normal(size=n).round(digits))]
    df = spark.createDataFrame(rows, "slice string, gene string, x double, y double")
    got = HV.local_fit(df, "x", "y", 0.2, rows_per_range=40).toPandas()
    assert len(got) == len(rows)
    for _, f in got.groupby("slice"):
        f = f.sort_values(["x", "gene"])
        x, y, n = f.x.to_numpy(), f.y.to_numpy(), len(f)
        q = min(n, max(3, int(0.2 * n + 1e-5)))
        for at, fitted in zip(x, f.fitted):
            near = np.argsort(np.abs(x - at), kind="stable")[:q]
            h = np.abs(x[near] - at).max()
            w = (1 - np.minimum(np.abs(x[near] - at) / h, 1) ** 3) ** 3 if h > 0 else np.ones(q)
            a = np.stack([(x[near] - at) ** k for k in range(3)], 1)
            if np.linalg.matrix_rank((a.T * w) @ a) == 3:
                assert fitted == pytest.approx(np.linalg.solve((a.T * w) @ a, (a.T * w) @ y[near])[0], abs=1e-7)
            else:
                assert np.isnan(fitted)


def test_partition_tree_is_bounded_and_exact(spark):
    """More cells than one level holds, a hot place and a dense clump: leaves stay small and neighbours exact."""
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.normal(0, 1e-4, (700, 2)), rng.random((500, 2)) * 100, np.tile([[7.0, 7.0]], (600, 1))])
    spots = spark.createDataFrame([(i, "a", float(x), float(y)) for i, (x, y) in enumerate(xy)], "spot_id long, slice string, x double, y double")
    tree = G.partition_tree(spots.select("slice", "x", "y").distinct(), ["slice"], 1).collect()
    assert len(tree) == 1201 and max(len(r["_path"]) for r in tree) > 2
    leaves = {}
    for r in tree:
        leaves.setdefault(r["_cell"], []).append((r["x"], r["y"]))
    assert max(map(len, leaves.values())) <= 2
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = {(r["src"], r["rank"]): r["dst"] for r in G.knn_join(spots, 3).collect()}
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert all(got[i, k + 1] == order[i, k] for i in range(len(xy)) for k in range(3))
    index = G.CellIndex(spots, ["slice"], 2, None)
    assert index.levels > 1
    degree = {r["spot_id"]: r["degree"] for r in G.radius_degree(spots, 3.0).collect()}
    assert all(degree[i] == (d[i] <= 9.0).sum() for i in range(len(xy)))


def test_edge_sums_over_blocks(spark):
    """Blocks with halos, a hub with many neighbours and spots without entries."""
    rng = np.random.default_rng(4)
    n, genes = 130, 7
    m = rng.integers(0, 3, (n, genes)) * (rng.random((n, genes)) < 0.5)
    m[:, 6], m[9] = 0, 0
    spots = spark.createDataFrame([(i, "a", float(i % 12), float(i // 12)) for i in range(n)], "spot_id long, slice string, x double, y double")
    edges = {(i, int(j)) for i in range(n) for j in rng.integers(0, n, 3)} | {(i, 50) for i in range(n)}
    graph = spark.createDataFrame([("a", i, j) for i, j in edges], "slice string, src long, dst long")
    dictionary = spark.createDataFrame([(f"g{j}", j) for j in range(genes)], "gene string, gene_index long")
    entries = spark.createDataFrame([("a", i, f"g{j}", float(m[i, j])) for i in range(n) for j in range(genes) if m[i, j]], "slice string, spot_id long, gene string, count double")
    w = spark.createDataFrame([("a", i, float(i)) for i in range(n) if i % 5], "slice string, spot_id long, w double")
    pairs = {(min(p), max(p)) for p in edges if p[0] != p[1]}
    owned = B.owned_pairs(graph, ["slice"])
    assert {tuple(sorted((r["src"], r["dst"]))) for r in owned.collect()} == pairs
    blocks = B.spot_blocks(spots, 16)
    assert blocks.select("block").distinct().count() > 4
    got = {r["gene"]: r for r in B.edge_sums(entries, dictionary, w, owned, blocks, "count", ["slice"]).collect()}
    for j in range(6):
        x = m[:, j]
        assert got[f"g{j}"]["s"] == x.sum() and got[f"g{j}"]["q"] == (x * x).sum() and got[f"g{j}"]["wx"] == sum(i * x[i] for i in range(n) if i % 5)
        assert got[f"g{j}"]["cross"] == sum(x[a] * x[b] for a, b in pairs)
    perm = rng.permutation(n)
    moved = spark.createDataFrame([(i, int(p)) for i, p in enumerate(perm)], "from long, to long")
    want = {}
    for i in range(n):
        near = [b for a, b in edges if a == i]
        for j in range(genes):
            for s, c in ((m[near, j].sum(), 1), (m[perm[near], j].sum(), -1)):
                want[f"g{j}", float(s)] = want.get((f"g{j}", float(s)), 0) + c
    out = B.neighbour_sum_counts(entries, dictionary, graph, blocks, moved, "count")
    assert {(r["gene"], r["s"]): r["c"] for r in out.collect() if r["c"]} == {k: c for k, c in want.items() if c and k[1]}


def test_draws_as_vectors_equal_drawn_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i % 9}", float(rng.integers(0, 12)), float(rng.integers(0, 12))) for i in range(40)]
    out = J.bootstrap_spearman(spark.createDataFrame(rows, "c string, x double, y double"), "x", "y", "c", 700, 5).first()
    names = sorted({r[0] for r in rows})
    seen = []
    for d in range(700):
        pick = [names[int(int(hashlib.md5(f"5|{d}|{k}".encode()).hexdigest()[:13], 16) / 2 ** 52 * 9)] for k in range(9)]
        x, y = zip(*[(r[1], r[2]) for p in pick for r in rows if r[0] == p])
        seen.append(pd.Series(x).rank().corr(pd.Series(y).rank()))
    assert out["n_draws"] == 700 and out["lower"] == pytest.approx(np.quantile(seen, 0.025)) and out["upper"] == pytest.approx(np.quantile(seen, 0.975))


def test_squared_silhouette(spark):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(70, 3)), np.array(["a", "b", "c", "d"])[np.r_[np.zeros(1, int), rng.integers(1, 4, 69)]]
    df = spark.createDataFrame([(i, str(k), [float(v) for v in e]) for i, (k, e) in enumerate(zip(c, x))], "spot_id long, k string, emb array<double>")
    got = {r["spot_id"]: r["silhouette"] for r in M.squared_silhouette_values(df, "k", block=16).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(70):
        mine = c == c[i]
        if mine.sum() == 1:
            assert got[i] == 0
            continue
        a, b = d[i, mine].sum() / (mine.sum() - 1), min(d[i, c == k].mean() for k in set(c) - {c[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_pooling_conserves_totals(spark):
    spots = spark.createDataFrame([(i, "a", float(i % 12), float(i // 12), "l") for i in range(144)], "spot_id long, slice string, x double, y double, label string")
    expr = spark.createDataFrame([("a", i, f"g{i % 3}", float(1 + i % 5)) for i in range(144)], "slice string, spot_id long, gene string, count double")
    genes = spark.createDataFrame([(f"g{i}", i) for i in range(3)], "gene string, gene_index long")
    mapping, pseudo, _ = P.hex_pool(SpatialData(spots, genes, expr), 4.0, 2.0, check=True)
    assert mapping.count() == pseudo.agg(F.sum("n_beads")).first()[0] > 0


def test_scaling_and_ranks(spark):
    rows = [("d", m, "10", "i", "Integration", "bASW", v, 0) for m, v in (("a", 0.1), ("b", 0.4), ("c", None), ("e", 0.4))]
    r = spark.createDataFrame(rows, "dataset string, fs_method string, n_features string, integration_method string, task string, metric_name string, metric_value double, random_seed long")
    o = S.orient(r, check=True).withColumns({"effective_n_features": F.lit(1), "runtime": F.lit(1.0)})
    ranges = S.frozen_ranges(S.seed_average(o))
    got = {x["fs_method"]: x["scaled"] for x in S.apply_ranges(o, ranges, "oriented", check=True).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": None, "e": 1.0}
    ranks = {x["fs_method"]: x["rank"] for x in S.within_task_rank(r).collect()}
    assert ranks == {"a": 3.0, "b": 1.5, "c": None, "e": 1.5}
    with pytest.raises(ValueError):
        S.orient(r.withColumn("metric_name", F.lit("other")), check=True)


def test_heldout_split(spark):
    spots = spark.createDataFrame([(1, "a"), (2, "b")], "spot_id long, slice string")
    expr = spark.createDataFrame([("a", 1, "g", 1.0), ("b", 2, "g", 1.0)], "slice string, spot_id long, gene string, count double")
    ds = SpatialData(spots, spark.createDataFrame([("g", 0)], "gene string, gene_index long"), expr)
    train, held = V.split_slice(ds, "b")
    assert [r["spot_id"] for r in train.spots.collect()] == [1] and [r["spot_id"] for r in held.expr.collect()] == [2]
    with pytest.raises(ValueError):
        V.split_slice(held, "b")


def test_exact_bootstrap_refuses_too_many_datasets(spark):
    from tessera.operators.robust import exact_bootstrap_ranks

    rows = [("run", f"d{d}", f"m{m}", float(d * m % 5)) for d in range(7) for m in range(3)]
    scores = spark.createDataFrame(rows, "integration_method string, dataset string, fs_method string, CoreOverallMean double")
    with pytest.raises(ValueError, match="7 datasets"):
        exact_bootstrap_ranks(scores)
    assert exact_bootstrap_ranks(scores.filter("dataset < 'd3'")).count() == 3


def test_run_without_records_is_incomplete(spark):
    from tessera.operators.audit import complete_methods, run_coverage

    records = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 1, "x", 1.0), ("b", 0, "x", 1.0)], "fs_method string, random_seed long, metric_name string, metric_value double")
    grid = spark.createDataFrame([(m, s) for m in "ab" for s in (0, 1)], "fs_method string, random_seed long")
    got = complete_methods(run_coverage(records, ["x"], ["fs_method", "random_seed"], grid)).collect()
    assert {r.fs_method: (r.complete, r.n_runs) for r in got} == {"a": (True, 2), "b": (False, 2)}


def test_line_numbers_across_splits(spark, tmp_path):
    from tessera.sources.tables import numbered_lines, read_matrix_market

    names = [f"gene-{i}" * (1 + i % 3) for i in range(900)]
    (tmp_path / "genes.txt").write_text("\n".join(names) + "\n")
    (tmp_path / "spots.txt").write_text("s1\r\ns2\n\ns4")
    body = [(1 + i * 7 % 900, 1 + i % 4, i + 1) for i in range(2000)]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% more\n900 4 2000\n" + "\n".join(f"{a} {b} {c}" for a, b, c in body))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = numbered_lines(spark, str(tmp_path / "genes.txt"))
        assert rows.rdd.getNumPartitions() > 1 and {r["line"]: r["value"] for r in rows.collect()} == {i + 1: n for i, n in enumerate(names)}
        got = read_matrix_market(spark, *(str(tmp_path / f) for f in ("m.mtx", "genes.txt", "spots.txt"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    spots = {1: "s1", 2: "s2", 3: "", 4: "s4"}
    assert sorted(tuple(r) for r in got) == sorted((names[a - 1], spots[b], float(c)) for a, b, c in body)


def test_stream_sink_goes_on_after_a_stop(spark, tmp_path):
    from tessera.streaming import records as N

    schema = "dataset string, task string, metric_name string, metric_value double, k int"
    base, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def more(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)
        N.write_latest(N.running_ranges(stream), out, cp)
        return {r["dataset"]: (r["lower"], r["upper"], r["mean"], r["n_finite"]) for r in N.read_latest(spark, out, ["dataset", "task", "metric_name"]).collect()}

    assert more([("d", "t", "m", 2.0, 0), ("e", "t", "m", 5.0, 0)]) == {"d": (2.0, 2.0, 2.0, 1), "e": (5.0, 5.0, 5.0, 1)}
    assert more([("d", "t", "m", 4.0, 1), ("f", "t", "m", None, 1)]) == {"d": (2.0, 4.0, 3.0, 2), "e": (5.0, 5.0, 5.0, 1), "f": (None, None, None, 0)}
    assert more([("d", "t", "m", 0.0, 2)])["d"] == (0.0, 4.0, 2.0, 3)


def test_covariance_test_is_the_mixture_of_its_kernels(spark):
    """p of every kernel from the eigenvalues of the projected form and matched moments, in a plain double loop."""
    rng = np.random.default_rng(11)
    n, xy = 60, np.stack([np.arange(60) % 8, np.arange(60) // 8], 1).astype(float)
    m = rng.poisson(1.0, (n, 4)) + (xy[:, :1] > 4) * rng.poisson(2.0, (n, 4)) * [1, 0, 0, 0]
    spots = spark.createDataFrame([(i, "a", "l", "A", *map(float, xy[i])) for i in range(n)], "spot_id long, slice string, label string, slice_class string, x double, y double")
    genes = spark.createDataFrame([(f"g{j}", j) for j in range(4)], "gene string, gene_index long")
    expr = spark.createDataFrame([("a", i, f"g{j}", float(m[i, j]), float(m[i, j])) for i in range(n) for j in range(4) if m[i, j]], "slice string, spot_id long, gene string, count double, value double")
    got = {r["gene"]: r["p_value"] for r in SP.kernel_projection_test(SpatialData(spots, genes, expr)).collect()}
    c = xy - xy.mean(0)
    kernels = [c]
    for q in range(1, 6):
        scale = np.quantile(np.abs(c), q / 5, axis=0)
        kernels += [np.exp(-c ** 2 / (2 * scale ** 2)), np.cos(2 * np.pi * c / scale)]
    for j in range(4):
        y, t = m[:, j].astype(float), []
        for k in kernels:
            x = k - k.mean(0)
            inverse = np.linalg.inv(x.T @ x)
            stat = n * (y @ x) @ inverse @ (x.T @ y) / (y @ y)
            weights = np.linalg.eigvals(x.T @ x @ inverse).real * (1 - n * y.mean() ** 2 / (y @ y))
            scale, df = (weights ** 2).sum() / weights.sum(), weights.sum() ** 2 / (weights ** 2).sum()  # matched mean and variance
            assert df == pytest.approx(2)
            p = np.clip(np.exp(-stat / (2 * scale)), 1e-300, 1 - 1e-9)
            t.append(1 / (p * np.pi) if p < 1e-8 else np.tan((0.5 - p) * np.pi))
        assert got[f"g{j}"] == pytest.approx(0.5 - np.arctan(np.mean(t)) / np.pi, rel=1e-6)
    assert got["g0"] < 0.01


def test_table_rules_count_what_breaks_them(spark):
    from tessera.operators.audit import Expect, audit_tables

    t = spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (2, "z", 1.5), (None, None, -0.1)], "k int, c string, v double")
    other = spark.createDataFrame([(1,), (3,), (3,)], "k int")
    got = audit_tables({"t": Expect(t, key=["k"], filled=["v"], between={"v": (0, 1)}, among={"c": ["a", "b"]}, only_where={"v": "c <> 'z'"}, covers={"o": (other, ["k"])}),
                        "none": Expect(t.filter("false"), key=["k"], filled=["v"])}).collect()
    assert {(r["table_name"], r["rule"], r["subject"]): (r["n_rows"], r["n_bad"], r["passed"]) for r in got} == {
        ("t", "key", "k"): (4, 1, False), ("t", "filled", "v"): (4, 1, False), ("t", "between", "v"): (4, 2, False), ("t", "among", "c"): (4, 1, False),
        ("t", "only_where", "v"): (4, 2, False), ("t", "covers", "o:k"): (2, 1, False), ("none", "key", "k"): (0, 0, True), ("none", "filled", "v"): (0, 0, True)}
