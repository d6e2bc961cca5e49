"""Clusterings of many series: iterations of one pass, trees beyond the driver's limit, density peaks without stored pairs."""

import numpy as np
import pytest

from chronoloom.operators import clustering as CL
from chronoloom.sources import series as src

RNG = np.random.default_rng(23)


def means_by_hand(x, start, iterations=100):
    """Labels (from 0) and distances by turns with means; an empty cluster starts again at the series farthest from its mean that is none yet."""
    points, ids, old = x[start].copy(), list(start), None
    for _ in range(iterations):
        d = np.linalg.norm(x[:, None] - points[None], axis=2)
        label = d.argmin(1)
        if old is not None and (label == old).all():
            break
        changed = set(range(len(start))) if old is None else set(label[label != old]) | set(old[label != old])
        old = label
        for c in sorted(changed & set(label)):
            points[c], ids[c] = x[label == c].mean(0), None
        for c in sorted(set(range(len(start))) - set(label)):
            ids[c] = next(i for i in np.argsort(-d[np.arange(len(x)), label], kind="stable") if i not in ids)
            points[c] = x[ids[c]]
    return label, d[np.arange(len(x)), label]


@pytest.mark.parametrize("twins", [False, True])
def test_means_and_shapes_store_labels_once(spark, monkeypatch, twins):
    x = RNG.normal(size=(60, 8)).round(3)
    if twins:
        x[1] = x[0]  # the second cluster is empty at first
    series = src.as_series(spark, x).repartition(3)
    stored, kept = [], CL.kept
    monkeypatch.setattr(CL, "kept", lambda df: stored.append(1) or kept(df))
    found = CL.cluster(series, k=[3, 5], distance="L2", centroid="mean", init_ids=[1, 2, 3, 4, 5])
    assert len(stored) == 1 and max(c.iterations for c in found) > 2
    for c in found:
        label, d = means_by_hand(x, list(range(c.config["k"])))
        rows = c.labels.orderBy("series_id").collect()
        assert [r["cluster"] - 1 for r in rows] == label.tolist() and [r["d"] for r in rows] == pytest.approx(d.tolist())
    stored.clear()
    assert CL.k_shape(series, 3).iterations > 1 and len(stored) == 1


def test_density_peaks_store_nothing_of_a_pair(spark, monkeypatch):
    """Twice as many series: tables between the passes have a row for each series, with tiles and blocks of several sizes the same labels."""
    from chronoloom.operators import distances as D, peaks

    x = np.concatenate([RNG.normal(c, 0.6, size=(30, 10)).cumsum(1) for c in (-1, 0, 1)]).round(2)
    series = src.as_series(spark, x).repartition(3).persist()
    found, kept, tables = [], D.kept, []
    monkeypatch.setattr(peaks.D, "kept", lambda df: tables.append(kept(df)) or tables[-1])
    for tile, block in ((512, 8), (16, 2), (7, 1)):
        monkeypatch.setattr(D, "BLOCK_SERIES", tile)
        monkeypatch.setattr(D, "BLOCK_TILES", block)
        for lb in ("lbk", "lbi"):
            tables.clear()
            c = CL.cluster(series, "tadpole", 3, control=CL.Tadpole(4.0, 2, lb))
            assert max(t.count() for t in tables) <= 90 and not any("binary" in t.dtypes for t in tables)
            found.append([tuple(r) for r in c.labels.select("series_id", "cluster").orderBy("series_id").collect()])
            found[-1].append(peaks_by_hand(x, 4.0, 2, lb, 3))
    labels, by_hand = [f[:-1] for f in found], [f[-1] for f in found]
    assert all(v == labels[0] for v in labels)
    assert all([c for _, c in v] == h for v, h in zip(labels, by_hand, strict=True))


def peaks_by_hand(x, dc, window, lb, k):
    from chronoloom.functions import kernels as K

    n = len(x)
    i, j = (v.ravel() for v in np.indices((n, n)))
    low = {"lbk": K.lb_keogh, "lbi": K.lb_improved}[lb](x[i], x[j], window, "L2", True).reshape(n, n)
    up, dtw = K.euclidean(x[i], x[j]).reshape(n, n), K.dtw(x[i], x[j], window, "L2", "symmetric1").reshape(n, n)
    dtw = np.tril(dtw, -1) + np.tril(dtw, -1).T
    unsure = (low <= dc) & (up > dc)
    within = np.where(unsure, dtw <= dc, (low <= dc) & (up < dc))
    np.fill_diagonal(within, False)
    rho = within.sum(1)
    rho = (rho - rho.min()) / (rho.max() - rho.min())
    d = np.where(unsure, dtw, up)
    before = lambda v: (v[None] > v[:, None]) | ((v[None] == v[:, None]) & (np.arange(n)[None] < np.arange(n)[:, None]))
    delta = np.where(before(rho), d, np.inf).min(1)
    delta[np.isinf(delta)] = delta[np.isfinite(delta)].max()
    standing = rho * delta
    ahead = before(standing)
    d = np.where(ahead, np.where(~unsure & (low <= delta[:, None]), dtw, d), np.inf)
    order = np.lexsort((np.arange(n), -standing))
    nn, near = order[d[:, order].argmin(1)], d.min(1)
    near[np.isinf(near)] = near[np.isfinite(near)].max()
    score = rho * (near - near.min()) / (near.max() - near.min())
    top = sorted(np.lexsort((np.arange(n), -standing, -score))[:k])
    label = {}
    for v in order:
        label[v] = top.index(v) + 1 if v in top else label.get(nn[v]) or 1 + int(np.argmin(dtw[v, top]))
    return [label[v] for v in range(n)]


@pytest.mark.parametrize("method", ["average", "complete"])
def test_trees_beyond_the_driver_s_limit_are_those_on_it(spark, monkeypatch, method):
    x = np.r_[RNG.normal(size=(40, 7)).cumsum(1), np.tile(RNG.normal(size=7), (9, 1))]  # nine equal series
    series = src.as_series(spark, x).repartition(3).persist()
    how = {"distance": "L2", "control": CL.Hierarchical(method, large=True)}
    want = CL.cluster(series, "hierarchical", 6, **how)
    monkeypatch.setattr(CL, "TREE_SERIES", 16)
    got = CL.cluster(series, "hierarchical", 6, **how)
    assert [r["d"] for r in got.extra["tree"].orderBy("d").collect()] == pytest.approx([h for _, _, h in want.merges])
    rows = lambda c: [tuple(r) for r in c.labels.select("series_id", "cluster", "d").orderBy("series_id").collect()]
    assert [r[:2] for r in rows(got)] == [r[:2] for r in rows(want)] and [r[2] for r in rows(got)] == pytest.approx([r[2] for r in rows(want)])


def test_compare_stores_labels_once_for_a_distance(spark, monkeypatch):
    from chronoloom.operators import compare

    series = src.as_series(spark, RNG.normal(size=(40, 6))).repartition(3)
    truth = series.selectExpr("series_id", "cast(series_id % 3 as int) cluster")
    stored, kept = [], CL.kept
    monkeypatch.setattr(CL, "kept", lambda df: stored.append(1) or kept(df))
    configs = {"partitional": [{"k": [2, 4], "distance": m, "centroid": "mean", "iterations": 20, "init_ids": [1, 2, 3, 4]} for m in ("L1", "L2")]}
    out = compare.compare(series, configs, compare.evaluators(["RI"], truth)[0], keep=False)
    assert len(out["results"]) == 4 and all(0 < r["RI"] <= 1 for r in out["results"]) and len(stored) == 2


@pytest.mark.parametrize("lengths", [(8,), (8, 6)])
def test_a_pass_stacks_a_batch_and_computes_its_distances_once(monkeypatch, lengths):
    """Whatever the number of runs, and of points that moved."""
    import pandas as pd

    from chronoloom.functions import kernels as K

    class Batches:  # stands for the series' frame: what a task would do with its batches
        select = groupBy = applyInPandas = lambda self, *_: self

        def mapInPandas(self, task, schema):
            self.task = task
            return self

    x = [RNG.normal(size=lengths[i % len(lengths)]) for i in range(300)]
    runs = [CL.Run(2, ()), CL.Run(3, ())]
    points, before = ({r: [RNG.normal(size=8) for _ in range(c.k)] for r, c in enumerate(runs)} for _ in "ab")
    stacked, met, dense, of_blocks = [], [], K.dense, K.of_blocks
    monkeypatch.setattr(K, "dense", lambda v: (len(v) > 50 and not isinstance(v, np.ndarray) and stacked.append(len(v))) or dense(v))
    monkeypatch.setattr(K, "of_blocks", lambda *a, **b: met.append(1) or of_blocks(*a, **b))
    pdf, number = pd.DataFrame({"series_id": range(300), "values": x}), CL._Numbering(runs)
    method, centroid = ("L2", "mean") if len(lengths) == 1 else ("sbd", "shape")
    task = lambda f: pd.concat(f.task([pdf]), ignore_index=True)
    sums = task(CL._hard_sums(Batches(), points, before, number, method, {}, centroid, {}))
    assert len(met) == 1 and (len(lengths) > 1 or stacked == [300])
    labels = task(CL._nearest_labels(Batches(), points, number, method, {}))
    assert len(met) == 2 and (len(lengths) > 1 or stacked == [300, 300])
    for r, c in enumerate(runs):
        near = [np.array([[(np.linalg.norm(v - p) if method == "L2" else K.sbd(v[None], p[None])[0]) for p in ps[r]] for v in x]) for ps in (points, before)]
        now, was = (d.argmin(1) for d in near)
        own, rows = labels[labels["run"] == r], sums[sums["cluster"].isin(number.of(r))].sort_values("cluster")
        assert (own["cluster"] - number.base[r] - 1).tolist() == now.tolist() and own["d"].tolist() == pytest.approx(near[0].min(1).tolist())
        assert rows["n"].tolist() == np.bincount(now, minlength=c.k).tolist()
        assert rows["moved"].tolist() == (np.bincount(now[now != was], minlength=c.k) + np.bincount(was[now != was], minlength=c.k)).tolist()
        if centroid == "mean":
            assert np.array(rows["s"].tolist()) == pytest.approx(np.array([np.sum([v for v, w in zip(x, now, strict=True) if w == k], axis=0) for k in range(c.k)]))
