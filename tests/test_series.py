import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import kernels as K, series as S
from chronoloom.plans import queries as Q
from chronoloom.operators import centroids as C, clustering as CL, compare, distances as D, validity as V
from chronoloom.operators.constraints import CANNOT, MUST, PairTracker, search_window, window_partitions
from chronoloom.sources import series as src

RNG = np.random.default_rng(3)


def slow_dtw(x, y, power, s, window=None):
    n, m = len(x), len(y)
    d = np.full((n + 1, m + 1), np.inf)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if window is not None and not np.ceil(i * m / n - window) <= j <= np.floor(i * m / n + window):
                continue
            c = np.sum(np.abs(np.asarray(x[i - 1]) - np.asarray(y[j - 1])) ** power)
            d[i, j] = c if i == j == 1 else min(d[i - 1, j - 1] + s * c, d[i, j - 1] + c, d[i - 1, j] + c)
    return d[n, m]


@pytest.mark.parametrize("window", [None, 2, 5])
@pytest.mark.parametrize("norm", ["L1", "L2"])
@pytest.mark.parametrize("step", ["symmetric1", "symmetric2"])
@pytest.mark.parametrize("variables", [0, 3])
def test_dtw_equals_the_plain_recurrence(window, norm, step, variables):
    shape = (lambda n: (4, n, variables)) if variables else (lambda n: (4, n))
    x, y = RNG.normal(size=shape(9)), RNG.normal(size=shape(11))
    power, s = (1 if norm == "L1" else 2), int(step[-1])
    want = [slow_dtw(a, b, power, s, window) ** (1 / power) for a, b in zip(x, y)]
    assert K.dtw(x, y, window, norm, step) == pytest.approx(want)
    d, paths = K.dtw_paths(x, y, window, norm, step)
    assert d == pytest.approx(want)
    assert all(tuple(p[0]) == (0, 0) and tuple(p[-1]) == (8, 10) and (np.diff(p, axis=0) >= 0).all() for p in paths if np.isfinite(want[0]))


@pytest.mark.parametrize("ends", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("window", [None, 3])
def test_asymmetric_dtw_equals_the_plain_recurrence(ends, window):
    x, y = RNG.normal(size=(3, 7, 2)), RNG.normal(size=(3, 9, 2))

    def slow(p, q):
        d = np.full((7, 11), np.inf)  # two columns before the first
        for i in range(7):
            for j in range(9):
                if window is None or np.ceil((i + 1) * 9 / 7 - window) <= j + 1 <= np.floor((i + 1) * 9 / 7 + window):
                    start = 0 if i == 0 and (j == 0 or ends[0]) else np.inf
                    d[i, j + 2] = np.sum((p[i] - q[j]) ** 2) + (min(d[i - 1, j : j + 3]) if i else start)
        return np.sqrt(min(d[6, 2:]) if ends[1] else d[6, 10])

    found = K.dtw(x, y, window, "L2", "asymmetric", open_begin=ends[0], open_end=ends[1])
    assert found == pytest.approx([slow(p, q) for p, q in zip(x, y)])
    assert K.dtw(x, y, window, "L2", "asymmetric", True, open_begin=ends[0], open_end=ends[1]) == pytest.approx(found / 7)


@pytest.mark.parametrize("step", sorted(K.SLOPES))
@pytest.mark.parametrize("window", [None, 3])
def test_sloped_dtw_equals_all_paths(step, window):
    """By the recurrence over cells, from the pattern's ways; a series that is too long for the slope is out of reach."""
    x, y = RNG.normal(size=(3, 8)), RNG.normal(size=(3, 10))

    def slow(p, q):
        c, d = np.abs(p[:, None] - q[None]), np.full((len(p), len(q)), np.inf)
        for i in range(len(p)):
            for j in range(len(q)):
                if window is None or np.ceil((i + 1) * len(q) / len(p) - window) <= j + 1 <= np.floor((i + 1) * len(q) / len(p) + window):
                    ways = [d[i - a, j - b] + sum(w * c[i - u, j - v] for u, v, w in terms) for a, b, terms in K.SLOPES[step] if i >= a and j >= b]
                    d[i, j] = c[0, 0] if i == j == 0 else min(ways, default=np.inf)
        return d[-1, -1]

    want = [slow(p, q) for p, q in zip(x, y)]
    assert K.dtw(x, y, window, step=step) == pytest.approx(want)
    assert step == "rigid" or np.isfinite(want).all()
    if step in K.PATH_WEIGHT:
        weight = {"s": 18, "a": 8, "r": 8, "m": 10}.get(step[0]) or {"c": 8, "d": 18}[step.rstrip("s")[-1]]
        assert K.dtw(x, y, window, step=step, normalize=True) == pytest.approx(np.array(want) / weight)
    else:
        assert step.rstrip("s")[-1] in "ab"
        with pytest.raises(ValueError, match="no common weight"):
            K.dtw(x, y, window, step=step, normalize=True)
    assert step == "asymmetricP0" or np.isinf(K.dtw(x[:, :3], y, step=step)).all()


def test_types_of_local_constraints():
    """Known values: the first type weighed by both lengths is symmetricP1, by min it counts a bend once; every path of a normalizable pattern weighs the same."""
    assert sorted(K.SLOPES["typeId"]) == sorted(K.SLOPES["symmetricP1"])
    assert K.SLOPES["typeIa"] == [(2, 1, [(1, 0, 1.0), (0, 0, 0.0)]), (1, 1, [(0, 0, 1.0)]), (1, 2, [(0, 1, 1.0), (0, 0, 0.0)])]
    assert K.SLOPES["typeIcs"][2] == (1, 2, [(0, 1, 0.5), (0, 0, 0.5)])
    assert [w[2] for w in K.SLOPES["typeIIb"]] == [[(0, 0, 2.0)], [(0, 0, 1.0)], [(0, 0, 2.0)]]
    assert len(K.SLOPES["typeIVc"]) == 9 and (3, 2, [(2, 0, 1.0), (1, 0, 1.0), (0, 0, 1.0)]) in K.SLOPES["typeIVc"]
    for step, (p, q) in K.PATH_WEIGHT.items():
        for u, v, terms in K.SLOPES.get(step, []):
            assert sum(w for _, _, w in terms) == pytest.approx(p * u + q * v) or step == "mori2006"
    x, y = RNG.normal(size=(3, 8)), RNG.normal(size=(3, 10))
    assert K.dtw(x, y, step="symmetricP0", normalize=True) == pytest.approx(K.dtw(x, y) / 18)


def test_unreachable_band_is_infinite():
    assert np.isinf(K.dtw(np.zeros((1, 4)), np.ones((1, 2)), 0))


def test_bounds_hold_and_kernels_agree_with_expressions(spark):
    x, y = RNG.normal(size=(50, 12)), RNG.normal(size=(50, 12))
    for norm in ("L1", "L2"):
        a, b, c = K.lb_keogh(x, y, 3, norm), K.lb_improved(x, y, 3, norm), K.dtw(x, y, 3, norm, "symmetric1")
        assert (a <= b + 1e-9).all() and (b <= c + 1e-9).all()
        df = spark.createDataFrame([(p.tolist(), q.tolist()) for p, q in zip(x, y)], "x array<double>, y array<double>")
        got = df.select(D.lbk_expression(F.col("x"), F.col("y"), 3, norm), D.lbi_expression(F.col("x"), F.col("y"), 3, norm), S.sbd_expression(F.col("x"), F.col("y"))).collect()
        assert np.array(got) == pytest.approx(np.c_[a, b, K.sbd(x, y)])


def test_soft_dtw_and_its_gradient():
    x, y = RNG.normal(size=(1, 6)), RNG.normal(size=(1, 7))
    assert K.sdtw(x, y, 1e-4)[0] == pytest.approx(slow_dtw(x[0], y[0], 2, 1), abs=1e-2)
    (v,), (g,) = K.sdtw_gradients(x[0], y, 0.5)
    e = np.zeros((1, 6))
    e[0, 2] = 1e-5
    assert v == pytest.approx(K.sdtw(x, y, 0.5)[0])
    assert g[2] == pytest.approx((K.sdtw(x + e, y, 0.5)[0] - K.sdtw(x - e, y, 0.5)[0]) / 2e-5, rel=1e-4)
    assert K.sdtw(np.array([[0.0, 1, 2]]), np.array([[0.0, 1, 2]]), 1.0)[0] < 0
    with pytest.raises(ValueError):
        K.sdtw(x, y, 0)


def test_hand_vectors():
    h = np.array([[0.0, 1, 2]])
    assert K.dtw(h, h)[0] == 0 and K.sbd(h, h)[0] == pytest.approx(0)
    assert K.sbd(np.zeros((1, 3)), h)[0] == 1
    gak = lambda a, b: K.log_gak(a, b, 1.0)[0]
    assert 1 - np.exp(gak(h, h) - gak(h, h)) == 0
    assert K.log_gak(h, np.array([[0.0, 1, 2, 3, 4, 5]]), 1.0, 2)[0] == -np.inf


def test_coercion_and_validation(spark):
    assert src.as_series(spark, [1, 2, 3]).count() == 1
    assert src.as_series(spark, np.ones((4, 3))).count() == 4
    assert src.is_multivariate(src.as_series(spark, [np.ones((3, 2)), np.ones((5, 2))]))
    for bad in ("1", None, [], [[]], [[1, None]], [["a"]], [[True]], [[float("nan")]]):
        with pytest.raises(src.SeriesError):
            src.as_series(spark, bad)
    x = src.as_series(spark, [[1, 2, 3], [1, 2]])
    with pytest.raises(src.SeriesError):
        D.distances(x, method="L2")
    with pytest.raises(src.SeriesError):
        D.distances(x, method="nope")
    with pytest.raises(src.SeriesError):
        src.check_window(-1)
    assert D.distances(x, method="sbd").count() == 1
    assert [r["values"] for r in src.from_long(src.to_long(x)).orderBy("series_id").collect()] == [[1, 2, 3], [1, 2]]


def test_csv_round_trip(spark, tmp_path):
    x = src.as_series(spark, [[1, 2.5, 3], [4, 5]])
    src.write_csv(x.coalesce(1), str(tmp_path / "out"))
    back = src.read_csv_directory(spark, [str(tmp_path / "out")])
    assert [r["values"] for r in back.orderBy("series_id").collect()] == [[1, 2.5, 3], [4, 5]]


@pytest.fixture(scope="module")
def bumps(spark):
    """Three shapes, eight noisy copies of each."""
    t = np.linspace(0, 1, 20)
    rows = [(int(8 * k + i), k, (np.sin((k + 1) * 2 * np.pi * t) + RNG.normal(size=20) * 0.05).tolist()) for k in range(3) for i in range(8)]
    return spark.createDataFrame(rows, "series_id long, label int, values array<double>").persist()


def agrees(clustering, bumps):
    return V.external(clustering.labels, bumps.select("series_id", F.col("label").alias("cluster"))).first()["ARI"]


def test_clusterings_find_the_shapes(spark, bumps):
    ids, x = [0, 8, 16], bumps.select("series_id", "values")
    pam = CL.cluster(x, k=3, args={"window": 3}, init_ids=ids)
    assert pam.converged and agrees(pam, bumps) == 1
    lazy = CL.cluster(x, k=3, args={"window": 3}, init_ids=ids, control=CL.Partitional(precompute=False))
    assert sorted(lazy.labels.select("series_id", "cluster").collect()) == sorted(pam.labels.select("series_id", "cluster").collect())
    assert agrees(CL.cluster(x, k=3, centroid="dba", args={"window": 3}, init_ids=ids, control=CL.Partitional(iterations=3)), bumps) == 1
    assert agrees(CL.k_shape(x, 3, init_ids=ids), bumps) == 1
    soft = CL.cluster(x, "fuzzy", 3, init_ids=ids)
    assert agrees(soft, bumps) == 1 and soft.membership.groupBy("series_id").agg(F.sum("u").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert agrees(CL.cluster(x, "fuzzy", 3, centroid="fcmdd", init_ids=ids), bumps) == 1
    trees = CL.cluster(x, "hierarchical", 3, distance="sbd", control=CL.Hierarchical("all"))
    assert len(trees) == len(CL.LINKAGES) and all(agrees(c, bumps) == 1 for c in trees)
    peaks = CL.cluster(x, "tadpole", 3, control=CL.Tadpole(1.5, 3))
    assert agrees(peaks, bumps) == 1 and 0 <= peaks.extra["percent"] <= 100
    assert pam.predict(x).select("series_id", "cluster").exceptAll(pam.labels.select("series_id", "cluster")).count() == 0
    assert pam.clusters().agg(F.sum("size")).first()[0] == 24
    found = V.indices(pam, x, "internal")
    assert set(found) == set(V.INTERNAL) and found["Sil"] > 0.5
    for k in (1, 24):
        with pytest.raises(src.SeriesError):
            CL.cluster(x, k=k)


def test_linkage_by_hand():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0.0]])
    assert [h for _, _, h in CL.linkage(d, "single")] == [1, 2, 3]
    assert [h for _, _, h in CL.linkage(d, "complete")] == [1, 2, 6]
    assert [h for _, _, h in CL.linkage(d, "average")] == [1, 2, 4.5]
    assert CL.linkage(d, "average")[0][:2] == (-1, -2) and CL.linkage(d, "average")[2][:2] == (1, 2)
    assert CL.cut(CL.linkage(d, "average"), 4, 2).tolist() == [1, 1, 2, 2]


def test_shapes_and_barycenters(spark, bumps):
    one = bumps.where("label = 1").select("series_id", "values").withColumn("cluster", F.lit(1))
    x = np.array([r["values"] for r in one.collect()])
    shape = np.array(C.shape(one).first()["values"])
    assert abs(shape.mean()) < 1e-9 and np.corrcoef(shape, x.mean(0))[0, 1] > 0.98
    before = C.mean(one)
    soft = np.array(C.sdtw_centroid(one, before, 0.1, iterations=5).first()["values"])
    cost = lambda z: sum(K.sdtw(z[None], v[None], 0.1)[0] for v in x)
    assert cost(soft) <= cost(np.array(before.first()["values"]))
    assert len(C.dba(one, before, 3).first()["values"]) == 20


def test_dtw_lb_gives_true_neighbours(spark, bumps):
    x = bumps.select("series_id", "values")
    y = x.where("series_id % 4 = 0")
    full = D.nearest(D.distances(x, y, window=3)).select("i", F.round("d", 9)).collect()
    assert sorted(D.dtw_lb(x, y, 3).select("i", F.round("d", 9)).collect()) == sorted(full)


def test_blocks_meet_like_a_broadcast(spark, bumps, monkeypatch):
    x = bumps.select("series_id", "values")
    want = sorted(D.distances(x, method="L1").collect())
    monkeypatch.setattr(D, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(D, "BLOCK_SERIES", 5)
    assert sorted(D.distances(x, method="L1").collect()) == want


def test_comparison(spark, bumps):
    x = bumps.select("series_id", "values")
    grid = compare.config_grid(("partitional",), [3], {}, {}, compare.pdc_configs("distance", {"sbd": {}, "L2": {}}), compare.pdc_configs("centroid", {"pam": {}}))
    score, pick = compare.evaluators(["ARI", "Sil"], bumps.select("series_id", F.col("label").alias("cluster")))
    out = compare.compare(x, grid, score, pick, errors="pass")
    assert set(out["scores"]) == {"config1_1", "config2_1"} and out["pick"] in out["scores"]
    again = compare.repeat(x, grid, out["pick"])
    assert sorted(again.labels.collect()) == sorted(out["objects"][out["pick"]].labels.collect())


def test_pair_tracker():
    t = PairTracker(3)
    assert not t.link(1, 2, MUST) and t.link(2, 3, MUST) and t.unseen_pair() is None
    t = PairTracker(3)
    assert not t.link(1, 2, CANNOT) and not t.link(1, 3, CANNOT) and t.unseen_pair() == (2, 3) and t.link(2, 3, CANNOT)


def test_stream_predicts_like_a_batch(spark, bumps, tmp_path):
    from chronoloom.streaming.predict import predict

    x = bumps.select("series_id", "values")
    cents = [(k, r["values"]) for k, r in enumerate(x.where("series_id IN (0, 8, 16)").orderBy("series_id").collect(), 1)]
    x.write.parquet(str(tmp_path / "in"))
    q = predict(spark.readStream.schema(x.schema).parquet(str(tmp_path / "in")), cents).writeStream.format("memory").queryName("predicted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("predicted").collect()) == sorted(predict(x, cents).collect())


def test_kernels_run_once_in_blocks(spark, bumps):
    plan = D.mirrored(D.distances(bumps.select("series_id", "values"), method="dtw_basic"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_window_search_takes_the_window_that_keeps_the_links(spark):
    """Series 1 and 2 differ by a shift of three steps, 3 and 4 by their height: only a window of three or more puts the shifted together."""
    flat = [0.0] * 12
    at = lambda p, v: flat[:p] + [v] + flat[p + 1 :]
    x = spark.createDataFrame([(1, at(3, 5.0)), (2, at(6, 5.0)), (3, at(3, 1.0)), (4, at(3, 0.5))], "series_id long, values array<double>")
    links = spark.createDataFrame([(1, 2, MUST), (1, 3, CANNOT), (1, 4, -1)], "i long, j long, type int")
    how = {"type": "hierarchical", "k": 2, "control": CL.Hierarchical("average")}
    assert search_window(x, [1, 4], links, **how).first()["window"] == 4


def test_window_partitions_are_the_consensus_of_repetitions(spark, monkeypatch):
    part = lambda *c: CL.Clustering({}, spark.createDataFrame(list(enumerate(c, 1)), "series_id long, cluster int"), None)
    monkeypatch.setattr("chronoloom.operators.constraints.cluster", lambda series, type, k, args, **_: [part(1, 2, 1, 2), part(1, 1, 2, 2), part(1, 1, 2, 2)] if args["window"] == 3 else part(1, 1, 1, 2))
    got = {(r["window"], r["series_id"]): r["cluster"] for r in window_partitions(None, [3, 5]).collect()}
    assert [got[3, i] for i in range(1, 5)] == [1, 1, 2, 2] and [got[5, i] for i in range(1, 5)] == [1, 1, 1, 2]


def test_bandwidth_takes_the_lengths_of_all_series(spark):
    """Points that are all at distance 0 or 1 a coordinate: with few draws the lengths still come from every series."""
    rows = [(i, [float(j % 2) for j in range(4 if i == 7 else 40 + i)]) for i in range(30)]
    series = spark.createDataFrame(rows, "series_id long, values array<double>")
    lengths = [len(v) for _, v in rows]
    for points in (40, 200):
        d = D.estimate_sigma(series, points=points) / np.sqrt(np.median(lengths))
        assert d <= np.sqrt(round(min(lengths) / 2))


SF = "/root/testdata/sf0.001"


def values_of(df):
    return {r[0]: np.array(r["values"]) for r in df.collect()}


def test_k_shape_by_brute_force(spark):
    """Assignment by cross-correlation and eigenvectors of aligned members by turns, in numpy, from the same first series."""
    x = values_of(Q.daily_z(spark, SF).select("series_id", "values"))
    z = lambda v: (v - v.mean()) / v.std(ddof=1) if v.std() > 0 else v * 0

    def correlations(a, b):  # at lags from -(len(b) - 1): a shifted back by the lag meets b
        n = len(b)
        return np.array([sum(a[t + k] * b[t] for t in range(n) if 0 <= t + k < len(a)) for k in range(1 - n, len(a))]) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)

    def shape(members, before):
        rows = []
        for i in sorted(members):
            lag = correlations(before, x[i]).argmax() - (len(x[i]) - 1)
            rows.append(np.array([x[i][t - lag] if 0 <= t - lag < len(x[i]) else 0 for t in range(len(x[i]))]))
        y, n = np.array([z(r) for r in rows]), len(before)
        p = np.eye(n) - 1 / n
        top = np.linalg.eigh(p @ y.T @ y @ p)[1][:, -1]
        return z(top if rows[0] @ top > 0 else -top)

    cents = {c: x[i] for c, i in enumerate(CL.initial(Q.daily_z(spark, SF), 4, 1), 1)}
    old = None
    for _ in range(100):
        label = {i: min((1 - correlations(v, cents[c]).max(), c) for c in cents)[1] for i, v in x.items()}
        if label == old:
            break
        old = label
        cents |= {c: shape([i for i in x if label[i] == c], cents[c]) for c in set(label.values())}
    assert {r["series_id"]: r["cluster"] for r in Q.QUERIES["kshape_clustering"](spark, SF).collect()} == label


def test_soft_prototype_is_a_minimum(spark):
    """Of the registered query: no better than a small step in any direction, far better than the mean."""
    x = np.array(list(values_of(Q.daily_z(spark, SF).select("series_id", "values")).values()))
    z = np.array([r["value"] for r in Q.QUERIES["sdtw_centroid"](spark, SF).orderBy("t").collect()])
    cost = lambda p: K.sdtw(np.broadcast_to(p, x.shape).copy(), x, 1.0).sum()
    assert cost(z) < cost(x.mean(0))
    _, g = K.sdtw_gradients(z, x, 1.0)
    _, start = K.sdtw_gradients(x.mean(0), x, 1.0)
    assert np.linalg.norm(g.sum(0)) < 0.1 * np.linalg.norm(start.sum(0))


def test_soft_prototypes_of_clusters_are_found_together(spark, bumps):
    x = bumps.select("series_id", F.col("label").alias("cluster"), "values")
    together = values_of(C.sdtw_centroid(x, C.mean(x), 0.1, iterations=4))
    for k in range(3):
        alone = x.where(F.col("cluster") == k)
        assert together[k] == pytest.approx(values_of(C.sdtw_centroid(alone, C.mean(alone), 0.1, iterations=4))[k])


def test_paths_that_the_band_cuts_off_are_empty():
    d, p = K.dtw_paths(np.zeros((2, 3)), np.ones((2, 12)), 0)
    assert np.isinf(d).all() and [len(q) for q in p] == [0, 0]


def test_alignment_kernel_is_one_distance_on_every_path(spark, bumps):
    x = bumps.select("series_id", "values").where("series_id < 6")
    want = {(r["i"], r["j"]): r["d"] for r in D.distances(x, method="gak", sigma=1.5).collect()}
    ids = x.select("series_id")
    pairs = ids.select(F.col("series_id").alias("i")).join(ids.select(F.col("series_id").alias("j")), F.col("i") > F.col("j"))
    memo = {(r["i"], r["j"]): r["d"] for r in D.memoised(None, pairs, x, "gak", sigma=1.5).collect()}
    pairwise = {r["i"]: r["d"] for r in D.distances(x, x.withColumn("values", F.reverse("values")), "gak", pairwise=True, sigma=1.5).collect()}
    cents = x.where("series_id < 2").select(F.col("series_id").cast("int").alias("cluster"), "values")
    near = {(r["series_id"], r["cluster"]): r["d"] for r in D.to_centroids(x, cents, "gak", sigma=1.5).collect()}
    assert memo == pytest.approx(want) and all(0 <= d <= 1 for d in [*want.values(), *pairwise.values()])
    assert all(near[i, j] == pytest.approx(d) for (i, j), d in want.items() if j < 2)
    guessed = D.distances(x, method="gak").collect()  # the bandwidth is estimated
    assert len(guessed) == 15 and all(0 <= r["d"] <= 1 for r in guessed)
    ids = [0, 8, 16]
    lazy, eager = (CL.cluster(bumps.select("series_id", "values"), k=3, distance="gak", dist_args={"sigma": 2.0}, init_ids=ids, control=CL.Partitional(precompute=p)) for p in (False, True))
    assert agrees(lazy, bumps) == agrees(eager, bumps) == 1


def test_prepared_series_change_no_distance():
    rng = np.random.default_rng(9)
    x, y = [rng.normal(size=n) for n in (9, 9, 12)], [rng.normal(size=n) for n in (12, 9)]
    wanted = np.array([[True, False], [True, True], [False, True]])
    got = K.of_blocks(K.sbd, x, y, wanted, K.spectrum)
    assert np.isnan(got[~wanted]).all()
    for i, j in zip(*np.nonzero(wanted)):
        assert got[i, j] == pytest.approx(K.sbd(x[i][None], y[j][None])[0])
    same = [rng.normal(size=10) for _ in range(4)]
    for kernel in (K.lb_keogh, K.lb_improved):
        for both in (False, True):
            a = dict(window=2, norm="L2", force_symmetry=both)
            got = K.of_blocks(lambda p, q, **k: kernel(p, q, **a, **k), same, same, np.ones((4, 4), bool), lambda v, n: K.envelopes(v, n, **a))
            assert got[1, 3] == pytest.approx(kernel(same[1][None], same[3][None], **a)[0]) and got[2, 2] == 0
    z = lambda v: (v - v.mean()) / v.std(ddof=1)
    assert K.sbd(x[0][None], x[1][None], znorm=True)[0] == pytest.approx(K.sbd(z(x[0])[None], z(x[1])[None])[0])


def test_matrix_and_distributed_medoids_agree(spark, bumps, monkeypatch):
    x = bumps.select("series_id", "values")
    small = CL.cluster(x, k=4, distance="sbd", init_ids=[0, 1, 8, 17])
    monkeypatch.setattr(CL, "MATRIX_SERIES", 0)
    large = CL.cluster(x, k=4, distance="sbd", init_ids=[0, 1, 8, 17])
    rows = lambda c: sorted((r["series_id"], r["cluster"], round(r["d"], 9)) for r in c.labels.collect())
    assert rows(small) == rows(large) and small.iterations == large.iterations


def test_barycenters_by_variable_and_by_series(spark):
    """One step by hand: paths of each variable, or one of both, and means of what meets a point."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 7, 2))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "series_id long, cluster int, values array<array<double>>")
    z = values_of(C.mean(df))
    assert z[0] == pytest.approx(x[[0, 2]].mean(0)) and values_of(C.median(df))[1] == pytest.approx(np.median(x[[1, 3]], 0))
    for mv, parts in (("by-variable", [[0], [1]]), ("by-series", [[0, 1]])):
        got = values_of(C.dba_step(df, C.mean(df), mv, window=3))
        for c in (0, 1):
            for part in parts:
                met = [[] for _ in range(7)]
                for v in x[c::2]:
                    for i, j in K.dtw_paths(v[None][:, :, part], z[c][None][:, :, part], 3)[1][0]:
                        met[j].append(v[i, part])
                assert got[c][:, part] == pytest.approx(np.array([np.mean(m, axis=0) for m in met]))


def test_multivariate_series_by_the_front_door(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=(12, 2)) * 0.1 + (i % 2) * np.linspace(0, 4, 12)[:, None]).tolist()) for i in range(10)]
    x = spark.createDataFrame(rows, "series_id long, values array<array<double>>")
    for how in (dict(centroid="mean"), dict(centroid="median"), dict(centroid="dba", cent_args={"iterations": 2}), dict(type="fuzzy")):
        c = CL.cluster(x, k=2, distance="dtw_basic", init_ids=[0, 1], dist_args={"window": 3}, **how)
        assert {r["cluster"] for r in c.labels.where("series_id % 2 = 0").collect()} == {1}
    z = values_of(CL.preprocess(x, "zscore"))
    assert z[3].mean(0) == pytest.approx([0, 0], abs=1e-12) and z[3].std(0, ddof=1) == pytest.approx([1, 1])
    assert values_of(CL.preprocess(x, "reinterpolate", length=5))[2][-1] == pytest.approx(rows[2][1][-1])


def test_arguments_reach_their_function(spark, bumps):
    x, seen = bumps.select("series_id", "values"), []

    def centroid(members, before, scale):
        seen.append((scale, before.count()))
        return C.mean(members)

    def halved(series, by):
        return series.withColumn("values", F.transform("values", lambda v: v / by))

    CL.cluster(x, k=3, preproc=halved, preproc_args={"by": 2}, centroid=centroid, cent_args={"scale": 7}, dist_args={"window": 3}, init_ids=[0, 8, 16], control=CL.Partitional(iterations=2))
    assert seen and set(seen) == {(7, 3)}
    with pytest.raises(TypeError):
        CL.cluster(x, k=3, contrl=CL.Partitional())
    with pytest.raises(src.SeriesError):
        CL.cluster(x, "fuzzy", 3, control=CL.Partitional())
    tree = CL.cluster(x, "hierarchical", 3, distance="L2", control=CL.Hierarchical("average"))
    assert [m[2] for m in tree.update(x, control=CL.Hierarchical("single")).merges] != [m[2] for m in tree.merges]
    with pytest.raises(TypeError):
        tree.update(x, method="single")
    heavy = CL.cluster(x, "hierarchical", 3, distance="L2", control=CL.Hierarchical("average", members=(50, *[1] * 23)))
    assert [m[2] for m in heavy.merges] != [m[2] for m in tree.merges]
    peaks = CL.cluster(x, "tadpole", 3, control=CL.Tadpole(1.5, 3), centroid="mean")
    assert agrees(peaks, bumps) == 1 and peaks.centroids.where("series_id IS NULL").count() == 3


def test_bounds_serve_a_clustering(spark, bumps):
    x = bumps.select("series_id", "values")
    plain, bounded = (CL.cluster(x, k=3, distance=d, dist_args={"window": 3}, init_ids=[0, 8, 16]) for d in ("dtw_basic", "dtw_lb"))
    rows = lambda c: sorted((r["series_id"], r["cluster"]) for r in c.labels.collect())
    assert rows(plain) == rows(bounded) and agrees(bounded, bumps) == 1
    own = {r["i"]: r["j"] for r in D.dtw_lb(x, None, 3).collect()}
    full = {r["i"]: r["j"] for r in D.nearest(D.mirrored(D.distances(x, window=3))).collect()}
    assert own == full


def test_clusterings_from_parts_saved_and_loaded(spark, bumps, tmp_path):
    x = bumps.select("series_id", "values")
    soft = CL.cluster(x, "fuzzy", 3, distance="L2", init_ids=[0, 8, 16])
    tree = CL.cluster(x, "hierarchical", 3, distance="sbd")
    for c in (soft, tree):
        c.save(str(tmp_path / c.config["type"]))
        back = CL.load(spark, str(tmp_path / c.config["type"]))
        assert back.config["k"] == 3 and back.merges == c.merges and back.is_hard() == c.is_hard()
        plain = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
        assert plain(back.predict(x)) == plain(c.predict(x)) and plain(back.labels) == plain(c.labels)
    given = CL.from_parts(tree.labels.select("series_id", "cluster"), tree.centroids, "sbd")
    assert given.predict(x).select("series_id", "cluster").exceptAll(tree.labels.select("series_id", "cluster")).count() == 0
    with pytest.raises(src.SeriesError):
        CL.from_parts(tree.labels, tree.centroids.where("cluster < 3"), "sbd")
    with pytest.raises(src.SeriesError):
        CL.from_parts(tree.labels, tree.centroids.drop("values"), "sbd")
    assert "k = 3" in str(tree) and "distance sbd" in str(tree)
    assert tree.n_classes() == 3 and tree.n_objects() == 24 and tree.is_hierarchy() and not soft.is_hierarchy()


def test_indices_take_the_clustering_s_own_prototype(spark, bumps):
    """CH and SF from distances to the mean of all series, by numpy."""
    x = bumps.select("series_id", "values")
    c = CL.cluster(x, k=3, distance="L2", centroid="mean", init_ids=[0, 8, 16])
    found = V.indices(c, x, ["CH", "SF"])
    rows, label, cents = values_of(x), {r["series_id"]: r["cluster"] for r in c.labels.collect()}, values_of(c.centroids.select("cluster", "values"))
    center = np.mean(list(rows.values()), axis=0)
    between = sum(np.linalg.norm(cents[label[i]] - center) for i in rows)
    within = sum(np.linalg.norm(v - cents[label[i]]) for i, v in rows.items())
    assert found["CH"] == pytest.approx((24 - 3) / (3 - 1) * between / within) and set(found) == {"CH", "SF"}


def test_grid_arguments_reach_their_functions(spark, bumps):
    x, seen = bumps.select("series_id", "values"), []

    def centroid(members, before, weight):
        seen.append(weight)
        return C.mean(members)

    def scaled(series, by):
        seen.append(("by", by))
        return series.withColumn("values", F.transform("values", lambda v: v * by))

    grid = {"partitional": [{"k": [3], "preproc": scaled, "by_preproc": b, "distance": "L2", "centroid": centroid, "weight_centroid": w, "iterations": 2} for b in (1, 2) for w in (5, 6)], "fuzzy": [{"k": [3], "distance": "L2", "fuzziness": 3.0, "iterations": 2}]}
    out = compare.compare(x, grid, parallel=1)
    assert {5, 6} < set(s for s in seen if isinstance(s, int)) | {0} and seen.count(("by", 1)) == seen.count(("by", 2)) == 1
    assert out["objects"]["config5_1"].config["control"].fuzziness == 3.0 and out["objects"]["config1_1"].iterations <= 2


def test_sums_keep_small_terms(spark):
    row = spark.range(1).select(S.total(F.array(F.lit(1e16), F.lit(1.0), F.lit(-1e16), F.lit(1.0))).alias("s"), S.zscore_parameters(F.array(F.lit(1.0), F.lit(3.0))).alias("p")).first()
    assert row["s"] == 2 and row["p"]["center"] == 2 and row["p"]["scale"] == pytest.approx(np.sqrt(2))


def test_envelopes_must_fit(spark, bumps):
    with pytest.raises(ValueError):
        CL.cluster(bumps.select("series_id", "values"), "tadpole", 3, control=CL.Tadpole(1.5, 20))
