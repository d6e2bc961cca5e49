"""Rules at the front door, packed blocks, trees without a matrix, search by bounds and several clusterings at once, by brute force."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from chronoloom.functions import kernels as K
from chronoloom.operators import blocks as B, centroids as C, clustering as CL, distances as D, rules, trees, validity as V
from chronoloom.sources import series as src
from chronoloom.sources.series import SeriesError
from test_series import slow_dtw

RNG = np.random.default_rng(11)
MATRIX = RNG.normal(size=(30, 9)).cumsum(1)
RAGGED = [[0.0, 0.0, 0.0], [9.0, 9.0, 9.0], [0.0, 0.0, 0.0, 0.0], [9.0, 9.0, 9.0, 9.0], [1.0, 2.0, 3.0]]
MULTI = RNG.normal(size=(8, 6, 2))


@pytest.fixture(scope="module")
def series(spark):
    return src.as_series(spark, MATRIX).repartition(3).persist()


@pytest.fixture(scope="module")
def ragged(spark):
    return src.as_series(spark, RAGGED).persist()


@pytest.fixture(scope="module")
def multi(spark):
    return src.as_series(spark, MULTI).persist()


# Rules
@pytest.mark.parametrize(
    "type,more,what",
    [
        ("partitional", {"distance": "L2", "centroid": "mean"}, "L2 takes series of one length"),
        ("partitional", {"distance": "L1", "centroid": "pam"}, "L1 takes series of one length"),
        ("partitional", {"distance": "lbk", "args": {"window": 1}}, "lbk takes series of one length"),
        ("partitional", {"distance": "dtw_lb", "args": {"window": 1}}, "dtw_lb takes series of one length"),
        ("partitional", {"distance": "dtw_basic", "centroid": "mean"}, "prototype mean takes series of one length"),
        ("partitional", {"distance": "dtw_basic", "centroid": "median"}, "prototype median takes series of one length"),
        ("hierarchical", {"distance": "sbd", "centroid": "mean"}, "prototype mean takes series of one length"),
        ("hierarchical", {"distance": "L2"}, "L2 takes series of one length"),
        ("fuzzy", {"distance": "sbd", "centroid": "fcm"}, "prototype fcm takes series of one length"),
        ("tadpole", {"control": CL.Tadpole(1.0, 1)}, "lbk takes series of one length"),
    ],
)
def test_ragged_series_are_refused_where_points_must_meet(ragged, type, more, what):
    with pytest.raises(SeriesError, match=what):
        CL.cluster(ragged, type, 2, **more)


@pytest.mark.parametrize("type,centroid", [("fuzzy", "dba"), ("fuzzy", "nonsense"), ("fuzzy", "pam"), ("partitional", "fcmdd"), ("partitional", "fcm"), ("partitional", "nonsense"), ("hierarchical", "fcm"), ("hierarchical", "nonsense")])
def test_prototypes_belong_to_types(series, type, centroid):
    with pytest.raises(SeriesError, match=f"no prototype '{centroid}'"):
        CL.cluster(series, type, 2, distance="L2", centroid=centroid)


@pytest.mark.parametrize("distance,more,what", [("sbd", {}, "one variable"), ("L2", {"centroid": "mean"}, "one variable"), ("lbk", {"args": {"window": 1}}, "one variable"), ("dtw_basic", {"centroid": "shape", "preproc": "zscore"}, "one variable")])
def test_multivariate_series_are_refused_by_distances_of_one_variable(multi, distance, more, what):
    with pytest.raises(SeriesError, match=what):
        CL.cluster(multi, "partitional", 2, distance=distance, **more)


@pytest.mark.parametrize("method", ["lbk", "lbi"])
def test_bounds_refuse_windows_wider_than_the_series(series, method):
    with pytest.raises(SeriesError, match="wider"):
        D.distances(series, method=method, window=9)
    with pytest.raises(SeriesError, match="needs a window"):
        D.distances(series, method=method)
    assert D.distances(series, method=method, window=8).count() == 900


def test_sizes_and_numbers_of_clusters(series):
    for k, what in ((1, "two clusters"), (30, "more series")):
        with pytest.raises(SeriesError, match=what):
            CL.cluster(series, "partitional", k, distance="L2", centroid="mean")


def test_predictions_of_other_lengths_and_variables_are_refused(spark, series, multi, ragged):
    c = CL.cluster(series, "partitional", 3, distance="L2", centroid="mean", init_ids=[1, 2, 3])
    for other in (src.as_series(spark, MATRIX[:4, :5]), ragged, multi):
        with pytest.raises(SeriesError):
            c.predict(other)
    assert {r["series_id"]: r["cluster"] for r in c.predict(series).collect()} == {r["series_id"]: r["cluster"] for r in c.labels.collect()}


def test_prototype_functions_are_checked(spark, series):
    short = lambda members, before: before.selectExpr("cluster", "slice(values, 1, 4) values")
    with pytest.raises(SeriesError, match="one length"):
        CL.cluster(series, "partitional", 2, distance="L2", centroid=short)


def test_means_of_ragged_members_end_the_job(ragged):
    with pytest.raises(PySparkException, match="several lengths"):
        C.mean(ragged.selectExpr("series_id", "values", "1 cluster")).collect()


def test_fuzzy_takes_functions(series):
    from pyspark.sql import functions as F

    def heaviest(u, rows, before):
        return u.groupBy("cluster").agg(F.max_by("series_id", F.struct("u", F.col("series_id"))).alias("series_id")).join(rows, "series_id").select("cluster", "values")

    c = CL.cluster(series, "fuzzy", 3, distance="L2", centroid=heaviest, init_ids=[1, 2, 3])
    points = {tuple(r["values"]) for r in c.centroids.collect()}
    assert points <= {tuple(x) for x in MATRIX.tolist()} and c.membership.count() == 90


# Blocks
@pytest.mark.parametrize("method,args", [("L1", {}), ("L2", {}), ("sbd", {}), ("dtw_basic", {"window": 3}), ("sdtw", {"gamma": 1.0}), ("lbk", {"window": 2}), ("dtw_basic", {"step": "asymmetric"})])
def test_packed_blocks_hold_the_relation(spark, series, monkeypatch, tmp_path, method, args):
    monkeypatch.setattr(D, "BLOCK_SERIES", 7)
    matrix = B.block_matrix(series, method, **args)
    matrix.save(f"file://{tmp_path}/m")
    matrix = B.load(spark, f"file://{tmp_path}/m")
    got = matrix.to_numpy(np.arange(1, 31))
    want = np.zeros((30, 30))
    rows = D.distances(series, method=method, **args)
    for i, j, d in rows.collect():
        want[i - 1, j - 1] = d
        if matrix.lower:
            want[j - 1, i - 1] = d
    assert got == pytest.approx(want, abs=1e-9)
    back = {(r["i"], r["j"]): r["d"] for r in matrix.relation().collect()}
    assert back == pytest.approx({(r["i"], r["j"]): r["d"] for r in rows.collect()})


@pytest.mark.parametrize("method,args", [("L2", {}), ("lbk", {"window": 2})])
def test_sums_by_cluster_within_blocks(spark, series, monkeypatch, method, args):
    monkeypatch.setattr(D, "BLOCK_SERIES", 7)
    labels = spark.createDataFrame([(i + 1, 1 + i % 4 if i else 9) for i in range(30)], "series_id long, cluster int")
    matrix = B.block_matrix(series, method, **args)
    one = {(r["i"], r["cluster"], r["other"]): (r["s"], r["n"], r["least"], r["most"]) for r in matrix.by_cluster(labels).collect()}
    relation = D.symmetric_relation(series, method, **args)
    two = {(r["i"], r["cluster"], r["other"]): (r["s"], r["n"], r["least"], r["most"]) for r in V.by_cluster(relation, labels).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    best = {r["cluster"]: r["medoid"] for r in C.medoids_of(matrix.by_cluster(labels), labels).collect()}
    assert best == {r["cluster"]: r["series_id"] for r in C.medoids(relation, labels).collect()} and best[9] == 1


# Trees
def slow_linkage(d, method, members=None):
    """Always the nearest two, looked for among all."""
    d, n = d.astype(float).copy(), len(d)
    d = d * d if method == "ward.D2" else d
    np.fill_diagonal(d, np.inf)
    size, live, out = np.ones(n) if members is None else np.array(members, float), list(range(n)), []
    for _ in range(n - 1):
        i, j = min(((i, j) for i in live for j in live if i < j), key=lambda p: (d[p], p))
        h = d[i, j]
        others = [k for k in live if k not in (i, j)]
        for k in others:
            d[i, k] = d[k, i] = trees._merged(method, d[i, k], d[j, k], h, size[i], size[j], size[k])
        size[i] += size[j]
        live.remove(j)
        out.append((i, j, float(np.sqrt(h)) if method == "ward.D2" else h))
    return trees.name_merges(out, n)


@pytest.mark.parametrize("method", trees.LINKAGES)
def test_linkages_by_brute_force(method):
    rng = np.random.default_rng(12)
    for n in (2, 3, 9, 30):
        for members in (None, rng.integers(1, 6, n)):
            p = rng.normal(size=(n, 3))
            d = np.linalg.norm(p[:, None] - p[None], axis=2)
            got, want = trees.linkage(d, method, members), slow_linkage(d, method, members)
            assert [m[:2] for m in got] == [m[:2] for m in want] and [m[2] for m in got] == pytest.approx([m[2] for m in want])


@pytest.mark.parametrize("method", ["average", "single", "complete", "ward.D2", "centroid", "median"])
def test_linkages_with_ties_end_and_are_trees(method):
    d = np.abs(np.subtract.outer(np.arange(40) // 4, np.arange(40) // 4)).astype(float)
    merges = trees.linkage(d, method)
    assert len(merges) == 39 and sorted(x for a, b, _ in merges for x in (a, b)) == [*range(-40, 0), *range(1, 39)]
    assert len(set(trees.cut(merges, 40, 10))) == 10 and trees.cut(merges, 40, 10).tolist() == (1 + np.arange(40) // 4).tolist()


def test_thousands_of_series_make_a_tree_soon():
    import time

    p = np.random.default_rng(13).normal(size=(4000, 4))
    d = np.sqrt(np.maximum((p**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * p @ p.T, 0))
    began = time.time()
    assert len(trees.linkage(d, "average")) == 3999 and time.time() - began < 30


def test_layout_has_no_crossing_lines():
    p = np.random.default_rng(14).normal(size=(25, 2))
    merges = trees.linkage(np.linalg.norm(p[:, None] - p[None], axis=2), "average")
    place, boxes = trees.layout(merges, 25)
    assert sorted(place) == list(range(1, 26)) and (boxes[:, 0] < boxes[:, 1]).all() and (boxes[:, 4] >= boxes[:, 2:4].max(1)).all()
    leaves = {-i - 1: {i} for i in range(25)}
    for step, (a, b, _) in enumerate(merges, 1):
        leaves[step] = leaves[a] | leaves[b]
        own = sorted(place[list(leaves[step])])
        assert own == list(range(int(own[0]), int(own[0]) + len(own)))  # a branch is side by side
    assert trees.layout([], 1)[0].tolist() == [1]


@pytest.mark.parametrize("block", [8])
def test_spanning_tree_and_single_linkage_by_brute_force(spark, series, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_SERIES", block)
    d = np.linalg.norm(MATRIX[:, None] - MATRIX[None], axis=2)
    edges, root = [], list(range(30))
    for w, i, j in sorted((d[i, j], i, j) for i in range(30) for j in range(i)):
        if root[i] != root[j]:
            edges.append((i + 1, j + 1, w))
            root = [root[j] if x == root[i] else x for x in root]
    tree = trees.spanning_tree(B.block_matrix(series, "L2").kept(), series.select("series_id"))
    got = sorted(map(tuple, tree.collect()))
    assert [g[:2] for g in got] == sorted(e[:2] for e in edges) and [g[2] for g in got] == pytest.approx([e[2] for e in sorted(edges)])
    for k in (4,):
        far = CL.single_linkage(series, k, "L2")
        near = CL.cluster(series, "hierarchical", k, distance="L2", control=CL.Hierarchical("single"))
        assert {r["series_id"]: (r["cluster"], round(r["d"], 9)) for r in far.labels.collect()} == {r["series_id"]: (r["cluster"], round(r["d"], 9)) for r in near.labels.collect()}
        assert far.extra["tree"].count() == 29


def test_spanning_tree_with_ties_and_apart(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_SERIES", 4)
    same = src.as_series(spark, [[float(i // 3), 0.0] for i in range(12)])
    tree = trees.spanning_tree(B.block_matrix(same, "L2").kept(), same.select("series_id"))
    assert tree.count() == 11 and tree.agg({"d": "sum"}).first()[0] == pytest.approx(3.0)
    labels = {r["series_id"]: r["cluster"] for r in trees.single_labels(tree, same.select("series_id"), 4).collect()}
    assert labels == {i + 1: 1 + i // 3 for i in range(12)}


def test_beyond_the_driver_s_limit_only_single_linkage(series, monkeypatch):
    monkeypatch.setattr(CL, "TREE_SERIES", 20)
    with pytest.raises(SeriesError, match="single"):
        CL.cluster(series, "hierarchical", 3, distance="L2")
    c = CL.cluster(series, "hierarchical", 3, distance="L2", control=CL.Hierarchical("single"), centroid="mean")
    assert c.labels.count() == 30 and c.centroids.count() == 3 and not c.merges


# Search by bounds
@pytest.mark.parametrize("norm", ["L1", "L2"])
@pytest.mark.parametrize("step", ["symmetric1", "symmetric2"])
def test_search_by_bounds_finds_the_nearest(spark, series, monkeypatch, norm, step):
    monkeypatch.setattr(D, "BLOCK_SERIES", 8)
    others = src.as_series(spark, np.vstack([MATRIX[:5] + 0.3, RNG.normal(size=(14, 9)).cumsum(1), MATRIX[:2]]))
    power, s = (1 if norm == "L1" else 2), int(step[-1])
    d = np.array([[slow_dtw(a, b["values"], power, s, 2) ** (1 / power) for b in others.orderBy("series_id").collect()] for a in MATRIX])
    got = {r["i"]: (r["j"], r["d"], r["computed"], r["pairs"]) for r in D.dtw_lb(series, others, 2, norm, step=step, counts=True).collect()}
    assert all(got[i + 1][0] == d[i].argmin() + 1 and got[i + 1][1] == pytest.approx(d[i].min()) for i in range(30))
    assert sum(g[3] for g in got.values()) == d.size and sum(g[2] for g in got.values()) < 0.6 * d.size
    back = {r["j"]: (r["i"], r["d"]) for r in D.dtw_lb(series, others, 2, norm, margin=2, step=step).collect()}
    assert all(back[j + 1] == (d[:, j].argmin() + 1, pytest.approx(d[:, j].min())) for j in range(d.shape[1]))


def test_search_among_one_set_leaves_out_the_series_itself(series, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_SERIES", 8)
    d = np.array([[slow_dtw(a, b, 1, 2, 2) for b in MATRIX] for a in MATRIX])
    np.fill_diagonal(d, np.inf)
    got = {r["i"]: (r["j"], r["d"]) for r in D.dtw_lb(series, None, 2).collect()}
    assert got == {i + 1: (d[i].argmin() + 1, pytest.approx(d[i].min())) for i in range(30)}


def test_pairwise_search_is_plain_distances(spark, series):
    back = src.as_series(spark, MATRIX[:, ::-1].copy())
    got = {r["i"]: r["d"] for r in D.dtw_lb(series, back, 3, "L2", pairwise=True).collect()}
    assert got == pytest.approx({i + 1: slow_dtw(a, a[::-1], 2, 2, 3) ** 0.5 for i, a in enumerate(MATRIX)})
    with pytest.raises(SeriesError):
        D.dtw_lb(series, back, 3, method="sbd")


def test_abandoned_distances_are_beyond_their_limits():
    x, y = RNG.normal(size=(60, 40)).cumsum(1), RNG.normal(size=(60, 40)).cumsum(1)
    for norm in ("L1", "L2"):
        for step in ("symmetric1", "symmetric2"):
            d = K.dtw(x, y, 6, norm, step)
            got = K.dtw(x, y, 6, norm, step, limit=d * np.where(np.arange(60) % 2, 1.0, 0.5))
            assert (got[1::2] == d[1::2]).all() and (np.isinf(got[::2]) | (got[::2] == d[::2])).all() and np.isinf(got[::2]).sum() > 20


@pytest.mark.parametrize("method,args", [("dtw_basic", {}), ("lbk", {"window": 2}), ("L2", {})])
def test_nearest_neighbours_by_minima_of_blocks(series, monkeypatch, method, args):
    monkeypatch.setattr(D, "BLOCK_SERIES", 7)
    want = {r["i"]: (r["j"], pytest.approx(r["d"])) for r in D.nearest(D.symmetric_relation(series, method, **args).where("i != j")).collect()}
    assert {r["i"]: (r["j"], r["d"]) for r in D.nearest_neighbours(series, method=method, **args).collect()} == want


# Envelopes
@pytest.mark.parametrize("window", [0, 1, 3, 8, 20])
def test_envelopes_of_any_width(spark, window):
    from pyspark.sql import functions as F

    from chronoloom.functions import series as S

    x = RNG.normal(size=(3, 9))
    want = [[[f(r[max(0, i - window) : i + window + 1]) for i in range(9)] for r in x] for f in (min, max)]
    low, up = K.envelope(x, window)
    assert low == pytest.approx(np.array(want[0])) and up == pytest.approx(np.array(want[1]))
    rows = src.as_series(spark, x).orderBy("series_id").select(*S.envelope(F.col("values"), window)).collect()
    assert [[list(r[k]) for r in rows] for k in (0, 1)] == want


# Several clusterings at once
@pytest.mark.parametrize("distance,centroid,more", [("L2", "mean", {}), ("dtw_basic", "pam", {}), ("dtw_basic", "pam", {"control": CL.Partitional(precompute=False, repetitions=2, iterations=4)}), ("dtw_lb", "dba", {"args": {"window": 2}}), ("sbd", "shape", {})])
def test_runs_together_are_the_runs_alone(series, distance, centroid, more):
    control = more.get("control", CL.Partitional(repetitions=2, iterations=4))
    more = {a: b for a, b in more.items() if a != "control"}
    both = CL.cluster(series, "partitional", [2, 4], distance=distance, centroid=centroid, control=control, seed=5, **more)
    assert [c.config["k"] for c in both] == [2, 2, 4, 4] and [c.config["seed"] for c in both] == [5, 6] * 2
    for c in (both[1], both[2]):
        alone = CL.cluster(series, "partitional", c.config["k"], distance=distance, centroid=centroid, control=CL.Partitional(precompute=control.precompute, iterations=4), seed=c.config["seed"], **more)
        assert {r["series_id"]: (r["cluster"], round(r["d"], 9)) for r in c.labels.collect()} == {r["series_id"]: (r["cluster"], round(r["d"], 9)) for r in alone.labels.collect()}
        assert (c.iterations, c.converged) == (alone.iterations, alone.converged)


def test_medoids_beyond_the_matrix_are_those_of_the_matrix(series, monkeypatch):
    few = CL.cluster(series, "partitional", [2, 4], distance="L2", init_ids=[1, 2, 3, 4])
    monkeypatch.setattr(CL, "MATRIX_SERIES", 10)
    for a, b in zip(few, CL.cluster(series, "partitional", [2, 4], distance="L2", init_ids=[1, 2, 3, 4]), strict=True):
        assert {tuple(r)[:2] for r in a.labels.select("series_id", "cluster").collect()} == {tuple(r)[:2] for r in b.labels.select("series_id", "cluster").collect()}


def slow_fuzzy(x, ids, m, iterations, delta):
    z, before = x[np.array(ids) - 1], None
    for it in range(1, iterations + 1):
        u = K.memberships(np.linalg.norm(x[:, None] - z[None], axis=2), m)
        value = (u**m * ((x[:, None] - z[None]) ** 2).sum(2)).sum()
        if before is not None and abs(value - before) < delta:
            return it, True, u
        before, z = value, ((u**m).T @ x / (u**m).sum(0)[:, None]) if it < iterations else z
    return it, False, u


@pytest.mark.parametrize("m", [2.0, 1.6])
def test_fuzzy_runs_together_by_brute_force(series, m):
    found = CL.cluster(series, "fuzzy", [2, 3], distance="L2", control=CL.Fuzzy(m, 30), init_ids=[4, 5, 6])
    for k, c in zip((2, 3), found, strict=True):
        it, done, u = slow_fuzzy(MATRIX, [4, 5, 6][:k], m, 30, 1e-3)
        got = np.zeros((30, k))
        for r in c.membership.collect():
            got[r["series_id"] - 1, r["cluster"] - 1] = r["u"]
        assert (c.iterations, c.converged) == (it, done) and got == pytest.approx(u, abs=1e-7)


def test_profile_of_arrays():
    assert rules.profile_of([[1.0, 2.0], [3.0]]) == {"n": 2, "shortest": 1, "longest": 2, "least_vars": 1, "most_vars": 1}
    assert rules.profile_of([[[1.0, 2.0]], [[3.0, 4.0]]])["most_vars"] == 2


# Constraints
def test_closure_of_links_by_brute_force(spark):
    from chronoloom.operators import constraints as Co

    rng = np.random.default_rng(15)
    links = [(int(a), int(b), int(rng.choice([0, 1, 1, -1]))) for a, b in rng.integers(0, 60, (70, 2)) if a != b] + [(100, 101, 1), (101, 102, 1), (102, 100, 0), (200, 201, 0), (200, 201, 0)]
    root = {x: x for i, j, t in links if t >= 0 for x in (i, j)}
    for i, j, t in links:
        if t == 1:
            a, b = root[i], root[j]
            root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    cannot = {(min(root[i], root[j]), max(root[i], root[j])) for i, j, t in links if t == 0 and root[i] != root[j]}
    wrong = {(min(i, j), max(i, j)) for i, j, t in links if t == 0 and root[i] == root[j]}
    c = Co.closure(spark.createDataFrame(links, "i long, j long, type int"))
    assert {tuple(r) for r in c.members.collect()} == set(root.items())
    assert {tuple(r) for r in c.cannot.collect()} == cannot and {tuple(r) for r in c.contradictions.collect()} == wrong and (100, 102) in wrong
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 64, (200, 2))] + [(100, 102), (200, 201), (500, 501)]
    bad = {root[i] for i, _ in wrong}

    def kind(i, j):
        a, b = root.get(i), root.get(j)
        return -1 if a is None or b is None else 1 if a == b else 0 if (min(a, b), max(a, b)) in cannot else -1

    got = sorted(map(tuple, Co.implied(spark.createDataFrame(pairs, "i long, j long"), c).collect()))
    assert got == sorted((i, j, kind(i, j), root.get(i) in bad or root.get(j) in bad) for i, j in pairs)


def test_closure_of_no_links(spark):
    from chronoloom.operators import constraints as Co

    c = Co.closure(spark.createDataFrame([], "i long, j long, type int"))
    assert not c.members.count() and Co.implied(spark.createDataFrame([(1, 2)], "i long, j long"), c).collect() == [(1, 2, -1, False)]


# Files and streams
def test_lines_keep_their_numbers_in_many_splits(spark, tmp_path):
    rng = np.random.default_rng(16)
    rows = [",".join(f"{v:.4f}" for v in rng.normal(size=rng.integers(1, 30))) for _ in range(3000)]
    (tmp_path / "one").mkdir()
    for n, part in enumerate((rows[:1000], rows[1000:1001], rows[1001:])):
        (tmp_path / "one" / f"part-{n}.csv").write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        lines = src.numbered_lines(spark, f"file://{tmp_path}/one")
        assert spark.read.text(f"file://{tmp_path}/one").rdd.getNumPartitions() > 10
        assert [r["text"] for r in lines.orderBy("line").collect()] == rows and [r["line"] for r in lines.orderBy("line").select("line").collect()] == list(range(1, 3001))
        series = src.read_csv_directory(spark, [f"file://{tmp_path}/one"])
        assert {r["series_id"]: len(r["values"]) for r in series.collect()} == {i: x.count(",") + 1 for i, x in enumerate(rows, 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("method,args", [("dtw_basic", {"norm": "L2"}), ("sbd", {})])
def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path, method, args):
    import datetime as dt

    from chronoloom.streaming.windows import nearest, predict_windows

    rng, zero = np.random.default_rng(17), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    points = [(int(u), zero + dt.timedelta(minutes=int(m)), float(rng.normal())) for u in (1, 2, 3) for m in sorted(rng.choice(4 * 1440, 60, replace=False))]
    late = (1, zero + dt.timedelta(minutes=5, seconds=30), 99.0)  # its window has closed when it comes
    last = [(9, zero + dt.timedelta(days=d), 0.0) for d in (6, 7)]  # moves the watermark past every window
    files = [[p for p in points if p[1] < zero + dt.timedelta(days=2)], [p for p in points if p[1] >= zero + dt.timedelta(days=2)] + [last[0]], [late, last[1]], []]
    schema = "user_id long, ts timestamp, value double"
    for n, rows in enumerate(files[:3]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    cents = [(1, [0.0, 1.0, 2.0]), (2, [1.0, -1.0, 1.0, -1.0]), (3, [0.5, 0.5])]
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    query = predict_windows(events, cents, method, 86_400, "1 hour", **args).writeStream.format("memory").queryName(f"closed_{method}").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r["user_id"], r["start"].date().day): (r["points"], r["cluster"], round(r["d"], 9)) for r in spark.table(f"closed_{method}").collect() if r["user_id"] != 9}
    want = {}
    for u in (1, 2, 3):
        for day in range(4):
            own = [v for w, t, v in points if w == u and (t - zero).days == day]
            c, d = nearest([np.array(own)], [c for c, _ in cents], [np.array(v) for _, v in cents], method, args)
            want[u, day + 1] = (len(own), int(c[0]), round(float(d[0]), 9))
    assert got == want
