"""All pairs of many series: kernels over two stacks, tiles of blocks, and what is made of pairs without keeping them."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from chronoloom.functions import kernels as K
from chronoloom.operators import blocks as B, centroids as C, clustering as CL, distances as D, peaks as P, trees

RNG = np.random.default_rng(5)
X, Y = RNG.normal(size=(70, 12)), RNG.normal(size=(300, 12))
X[3] = 0
BOUNDS = [{"window": w, "norm": n, "force_symmetry": s} for w in (0, 2, 12) for n in ("L1", "L2") for s in (False, True)]
CASES = [("manhattan", {}), ("euclidean", {}), ("sbd", {}), ("sbd", {"znorm": True}), ("dtw", {}), ("dtw", {"window": 2, "norm": "L2", "step": "symmetric1"}), ("dtw", {"window": 0, "norm": "L2", "root": False}), ("dtw", {"normalize": True})]


@pytest.mark.parametrize("name,args", [*CASES, *[(n, b) for n in ("lb_keogh", "lb_improved") for b in BOUNDS]])
def test_kernels_of_two_stacks_are_those_of_pairs(name, args):
    i, j = (v.ravel() for v in np.indices((len(X), len(Y))))
    want = getattr(K, name)(X[i], Y[j], **args).reshape(len(X), len(Y))
    assert getattr(K, f"{name}_outer")(X, Y, **args) == pytest.approx(want, abs=1e-12)


def test_kernels_of_two_stacks_of_other_lengths_and_variables(monkeypatch):
    i, j = (v.ravel() for v in np.indices((len(X), len(Y))))
    for args in ({}, {"window": 3}, {"window": 1}):
        assert np.array_equal(K.dtw_outer(X, Y[:, :9], **args), K.dtw(X[i], Y[j, :9], **args).reshape(len(X), -1))
    assert K.sbd_outer(X, Y[:, :9]) == pytest.approx(K.sbd(X[i], Y[j, :9]).reshape(len(X), -1), abs=1e-12)
    a, b = (RNG.integers(0, 4, (n, 12, 3)).astype(float) for n in (20, 30))
    i, j = (v.ravel() for v in np.indices((20, 30)))
    assert np.array_equal(K.dtw_outer(a, b, window=2), K.dtw(a[i], b[j], window=2).reshape(20, 30))
    monkeypatch.setattr(K, "LONG", 1)
    assert K.sbd_outer(a[:, :, 0], b[:, :, 0]) == pytest.approx(K.sbd(a[i, :, 0], b[j, :, 0]).reshape(20, 30), abs=1e-12)


@pytest.mark.parametrize("name", ["manhattan", "euclidean", "dtw"])
@pytest.mark.parametrize("m,n,most", [(2000, 0, 0), (2000, 1, 1), (2000, 10, 2), (200, 300, 8)])
def test_tiles_of_few_columns_are_as_large_by_more_rows(monkeypatch, name, m, n, most):
    x, y, seen, tiles = RNG.normal(size=(m, 4)), RNG.normal(size=(n, 4)), [], K._tiles
    monkeypatch.setattr(K, "_tiles", lambda f, u, v: tiles(lambda p, q: seen.append(p[0].shape[-2] * q[0].shape[-1]) or f(p, q), u, v))
    got = getattr(K, f"{name}_outer")(x, y)
    assert sum(seen) == m * n and len(seen) == most and max(seen, default=0) <= K.TILE[0] * K.TILE[1]
    i, j = (v.ravel() for v in np.indices((m, n)))
    assert got == pytest.approx(getattr(K, name)(x[i], y[j]).reshape(m, n), abs=1e-12)


@pytest.mark.parametrize("args", [{}, {"window": 2}, {"step": "symmetric1"}, {"norm": "L2"}, {"norm": "L2", "root": False, "window": 3}, {"normalize": True}])
@pytest.mark.parametrize("size,kind", [(3, np.int16), (5000, np.int32), (10**9, None)])
def test_whole_numbers_are_warped_in_narrow_integers(monkeypatch, args, size, kind):
    """Counts as dtw_multivariate has: the same distances, in as many bits as the greatest sum needs; other values stay doubles."""
    a, b = (RNG.integers(-size, size, (n, 12, 2)).astype(float) for n in (20, 30))
    used, rows = [], K._dtw_rows
    monkeypatch.setattr(K, "_dtw_rows", lambda x, *rest: used.append(x.dtype) or rows(x, *rest))
    i, j = (v.ravel() for v in np.indices((20, 30)))
    kind = {np.int16: np.int16, np.int32: np.int32 if args.get("norm") != "L2" else None}.get(kind)
    assert np.array_equal(K.dtw_outer(a, b, **args), K.dtw(a[i], b[j], **args).reshape(20, 30)) and set(used) == {np.dtype(kind or float)}
    used.clear()
    assert np.array_equal(K.dtw_outer(a + 0.5, b, **args), K.dtw(a[i] + 0.5, b[j], **args).reshape(20, 30)) and set(used) == {np.dtype(float)}
    assert np.isinf(K.dtw_outer(a, b[:, :5], window=2)).all() == np.isinf(K.dtw(a[:1], b[:1, :5], window=2)).all()


def frame(spark, x):
    return spark.createDataFrame([(k + 1, v.tolist()) for k, v in enumerate(x)], "series_id long, values array<double>").repartition(5)


@pytest.mark.parametrize("method,args,pairs", [("sbd", {}, 70 * 69 // 2), ("lbk", {"window": 2}, 70 * 70), ("sdtw", {"gamma": 1.0}, 70 * 71 // 2)])
def test_blocks_are_gone_through_by_tiles(spark, monkeypatch, method, args, pairs):
    """A series is sent once for each block it meets; what a task makes at once is a tile."""
    monkeypatch.setattr(D, "BLOCK_SERIES", 5)
    monkeypatch.setattr(D, "BLOCK_TILES", 6)
    plan = D.plan(frame(spark, X), None, method, **args)
    body = lambda key, a, b, wanted: pd.DataFrame({"p": [key[0]], "q": [key[1]], "a": [len(a)], "b": [len(b)], "n": [int(wanted.sum())]})
    tiles = plan.meet(body, "p int, q int, a long, b long, n long", 3, 3).toPandas()
    assert tiles["n"].sum() == pairs and tiles[["a", "b"]].max().max() <= 5
    assert len(tiles.drop_duplicates(["p", "q"])) == (6 if plan.lower else 9) < len(tiles)
    rows = D.distances(frame(spark, X), method=method, **args).toPandas()
    assert len(rows) == pairs == len(rows.drop_duplicates(["i", "j"]))


@pytest.mark.parametrize("x", [X, np.repeat(X[:9], 7, 0), np.round(X), X * 1e6 + 1e8])
@pytest.mark.parametrize("args", [{}, {"window": 3, "step": "symmetric1"}])
@pytest.mark.parametrize("digits", [None, 6])
def test_nearest_neighbours_by_single_precision_first(spark, monkeypatch, x, args, digits):
    """Those of all distances in double precision, smallest id on ties, of which few are computed."""
    monkeypatch.setattr(D, "BLOCK_SERIES", 5)
    monkeypatch.setattr(D, "BLOCK_TILES", 6)
    i, j = (v.ravel() for v in np.indices((len(x), len(x))))
    d = K.dtw(x[i], x[j], **args).reshape(len(x), -1)
    np.fill_diagonal(d, np.inf)
    d = d if digits is None else np.round(d, digits)
    got = D.nearest_neighbours(frame(spark, x), digits=digits, **args).orderBy("i").toPandas()
    assert got["j"].tolist() == (d.argmin(1) + 1).tolist() and got["d"].to_numpy() == pytest.approx(d.min(1), rel=1e-12)
    other = D.nearest_neighbours(frame(spark, x[:20]), frame(spark, x[20:]), digits=digits, **args).orderBy("i").toPandas()
    assert other["j"].tolist() == (d[:20, 20:].argmin(1) + 1).tolist()


def test_products_of_shapes_stay_small(monkeypatch):
    """Products of a lag are made for so many rows at a time, with the same distances."""
    sizes, product = [], np.matmul
    monkeypatch.setattr(K, "PRODUCTS", 3000)
    monkeypatch.setattr(np, "matmul", lambda a, b, out: sizes.append(out.size) or product(a, b, out=out))
    i, j = (v.ravel() for v in np.indices((len(X), len(Y))))
    assert K.sbd_outer(X, Y) == pytest.approx(K.sbd(X[i], Y[j]).reshape(len(X), -1), abs=1e-12)
    assert max(sizes) <= 3000 and sum(sizes) == 23 * len(X) * len(Y)


def test_rows_of_warping_leave_nothing_to_the_next_tile():
    """Of three tiles the last cell lies outside the band: infinite whatever the tile before left in the rows."""
    for x, y in ((X, Y[:, :9]), (X[:, :9], Y), (np.round(X), np.round(Y[:, :9])), (np.round(X[:, :9]), np.round(Y))):
        for w in (0, 1, 2, 3):
            i, j = (v.ravel() for v in np.indices((len(x), len(y))))
            want = K.dtw(x[i], y[j], window=w).reshape(len(x), -1)
            assert np.array_equal(K.dtw_outer(x, y, window=w), want) and np.array_equal(K.dtw_banded(x[i], y[j], window=w, most=700), want.ravel())


def test_single_precision_is_off_by_less_than_told():
    i, j = (v.ravel() for v in np.indices((len(X), len(Y))))
    for x, y in ((X, Y), (X * 1e-3 + 1e4, Y * 1e3), (X * 0, Y)):
        for args, norm in (({}, {}), ({"step": "symmetric1", "window": 2, "power": 2}, {"step": "symmetric1", "window": 2, "norm": "L2", "root": False})):
            d, off = K.dtw_single(x, y, **args)
            assert (np.abs(d - K.dtw(x[i], y[j], **norm).reshape(d.shape)) <= off).all()


@pytest.mark.parametrize("window,dc", [(2, 2.5), (4, 3.0)])
def test_density_peaks_by_single_precision_first(spark, monkeypatch, window, dc):
    """As with all warping in double precision."""
    series, parts = frame(spark, np.vstack([X, X[:9]])), []
    for dense in (0.0, 2.0):  # single precision first wherever there is a pair, and never
        monkeypatch.setattr(P, "DENSE", dense)
        parts.append(P.search(series, D.plan(series, None, "dtw_basic").known, dc, window).rows.toPandas().sort_values("series_id", ignore_index=True))
    pd.testing.assert_frame_equal(*parts, check_exact=False, rtol=1e-12)


def labelled(spark, x):
    return spark.createDataFrame([(k + 1, k % 4) for k in range(len(x))], "series_id long, cluster int")


@pytest.mark.parametrize("method,args", [("L2", {}), ("sbd", {}), ("lbk", {"window": 2})])
def test_sums_are_made_where_distances_are(spark, monkeypatch, method, args):
    """As from stored blocks, without any."""
    monkeypatch.setattr(D, "BLOCK_SERIES", 5)
    monkeypatch.setattr(D, "BLOCK_TILES", 3)
    series, labels = frame(spark, X), labelled(spark, X)
    matrix = B.block_matrix(series, method, **args)
    got, want = (m.by_cluster(labels).toPandas().sort_values(["i", "other"], ignore_index=True) for m in (replace(matrix, frame=None), matrix.kept()))
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("method,args", [("L2", {}), ("lbk", {"window": 2})])
def test_sums_within_clusters_compute_no_others(spark, monkeypatch, tmp_path, method, args):
    monkeypatch.setattr(D, "BLOCK_SERIES", 5)
    monkeypatch.setattr(D, "BLOCK_TILES", 3)
    series, labels = frame(spark, X), labelled(spark, X)
    plan = D.plan(series, None, method, **args)
    want = B.sums_by_cluster(plan, labels).where("cluster = other").toPandas().sort_values("i", ignore_index=True)
    pairs = spark.sparkContext.accumulator(0)
    kernel = D.Plan.sums_kernel

    def counted(self):
        f = kernel(self)

        def run(x, y):
            pairs.add(len(x) * len(y))
            return f(x, y)

        return run

    monkeypatch.setattr(D.Plan, "sums_kernel", counted)
    got = B.sums_by_cluster(plan, labels, within=True).toPandas().sort_values("i", ignore_index=True)
    pd.testing.assert_frame_equal(got, want)
    assert pairs.value < len(X) ** 2 / 2 / (1 if method == "lbk" else 2)


def test_blocks_of_sums_are_bounded_by_bytes_and_clusters(spark):
    """615,384 embeddings: each is sent to some 20 blocks instead of 76."""
    plan = replace(D.plan(frame(spark, X), None, "L2"), known={"n": 615_384, "values": 615_384 * 64})
    assert B._blocks_of_sums(plan, 10)[0] <= 20 and B._blocks_of_sums(plan, 1000)[0] > 76


@pytest.mark.parametrize("shift", [0.0, 1e3, 1e9])
def test_distances_by_products_of_matrices(shift):
    x, y = X + shift, np.vstack([Y, X[:5], X[:5] + 1e-9]) + shift
    want = K.euclidean_outer(x, y)
    assert K.euclidean_products(x, y) == pytest.approx(want, rel=1e-10, abs=0)
    y[0, 0] = np.inf
    with np.errstate(invalid="ignore"):
        assert np.array_equal(np.isinf(K.euclidean_products(x, y)), np.isinf(K.euclidean_outer(x, y)))


@pytest.mark.parametrize("method,args", [("L2", {}), ("lbk", {"window": 2})])
def test_fuzzy_medoids_without_a_relation(spark, monkeypatch, method, args):
    monkeypatch.setattr(D, "BLOCK_SERIES", 5)
    monkeypatch.setattr(D, "BLOCK_TILES", 3)
    series = frame(spark, X)
    u = CL.memberships(D.to_centroids(series, frame(spark, X[4:7]).withColumnRenamed("series_id", "cluster").selectExpr("int(cluster) cluster", "values"), "L2"))
    sums = B.weighted_sums(series, method, u, **args)
    assert sums.count() == 3 * len(X)
    assert sorted(C.least_sums(sums).collect()) == sorted(C.fcmdd(u, D.symmetric_relation(series, method, **args)).collect())


@pytest.mark.parametrize("x", [X, np.repeat(X[:9], 7, 0), np.round(X)])
def test_spanning_tree_by_forests_of_blocks(spark, monkeypatch, x):
    """Kruskal's edges, in order of (d, i, j), with ties as well, and no stored matrix."""
    monkeypatch.setattr(D, "BLOCK_SERIES", 5)
    monkeypatch.setattr(D, "BLOCK_TILES", 3)
    d = K.euclidean_outer(x, x)
    root, want = list(range(len(x))), []
    for v, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i)):
        a, b = root[i], root[j]
        if a != b:
            root = [a if r == b else r for r in root]
            want.append((i + 1, j + 1, v))
    series = frame(spark, x)
    tree = trees.spanning_tree(replace(B.block_matrix(series, "L2"), frame=None), series.select("series_id"))
    assert sorted(tuple(r) for r in tree.collect()) == sorted(want)
