"""Prototypes of clusters. `members` has (series_id, cluster, values); results have (cluster, [series_id,] values). All but
shape extraction take multivariate series as well, the means and medians by variable."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions import kernels as K
from chronoloom.sources.series import SeriesError, is_multivariate


def _points(members: DataFrame, *more: Column | str) -> DataFrame:
    """(cluster, t, v, value) rows, v of series of one variable 0, with further columns."""
    rows = members.select("cluster", *more, F.posexplode("values").alias("t", "value"))
    if not is_multivariate(members):
        return rows.withColumn("v", F.lit(0))
    names = [c for c in rows.columns if c != "value"]
    return rows.select(*names, F.posexplode("value").alias("v", "value"))


def _series(points: DataFrame, multivariate: bool, whole: bool = False) -> DataFrame:
    """(cluster, values) of (cluster, t, v, value) rows; whole: all points of a cluster must come from as many series (n)."""
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    if multivariate:
        points = points.groupBy("cluster", "t").agg(ordered("v", "value").alias("value"), *([F.min("n").alias("n"), F.max("n").alias("most")] if whole else []))
    values = ordered("t", "value")
    if whole:
        uneven = F.min("n") != F.max("most" if multivariate else "n")
        values = F.when(uneven, F.raise_error(F.lit("Series of several lengths have no mean or median by point.")).cast(points.schema["value"].dataType.simpleString().join(("array<", ">")))).otherwise(values)
    return points.groupBy("cluster").agg(values.alias("values"))


def _by_point(members: DataFrame, agg: Column) -> DataFrame:
    """One value for each point of a cluster; a cluster of series of several lengths has no such prototype and ends the job."""
    points = _points(members).groupBy("cluster", "t", "v").agg(agg.alias("value"), F.count(F.lit(1)).alias("n"))
    return _series(points, is_multivariate(members), whole=True)


def mean(members: DataFrame) -> DataFrame:
    return _by_point(members, F.avg("value"))


def median(members: DataFrame) -> DataFrame:
    return _by_point(members, F.median("value"))


def medoids(d: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, series_id): the member with the least sum of distances within its cluster, smallest id on ties. d has both halves; self-distances count if there. A series may be in clusters of several partitions."""
    c = members.select("series_id", "cluster")
    within = d.join(c.withColumnRenamed("series_id", "i"), "i").join(c.select(F.col("series_id").alias("j"), F.col("cluster").alias("cj")), "j").where("cluster = cj")
    own = within.groupBy("cluster", F.col("i").alias("series_id")).agg(F.sum("d").alias("s"))
    sums = c.join(own, ["cluster", "series_id"], "left").select("cluster", "series_id", F.coalesce("s", F.lit(0.0)).alias("s"))
    best = sums.groupBy("cluster").agg(F.min(F.struct("s", "series_id")).alias("b"))
    return best.select("cluster", F.col("b.series_id").alias("series_id"))


def medoids_of(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, medoid) from BlockMatrix.by_cluster(): the member with the least sum of distances to its own cluster, smallest id on ties; a single member is its own."""
    own = labels.select("series_id", "cluster").join(sums.where("cluster = other").select(F.col("i").alias("series_id"), "s"), "series_id", "left")
    best = own.groupBy("cluster").agg(F.min(F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), "series_id")).alias("b"))
    return best.select("cluster", F.col("b.series_id").alias("medoid"))


def pam(members: DataFrame, d: DataFrame) -> DataFrame:
    return medoids(d, members).join(members.select("series_id", "values"), "series_id")


def fcm(u: DataFrame, series: DataFrame, fuzziness: float = 2.0) -> DataFrame:
    """Means weighted by membership to the power of fuzziness; u has (series_id, cluster, u)."""
    rows = _points(u.join(series, "series_id"), F.pow("u", F.lit(fuzziness)).alias("w"))
    return _series(rows.groupBy("cluster", "t", "v").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value")), is_multivariate(series))


def fcmdd(u: DataFrame, d: DataFrame, fuzziness: float = 2.0) -> DataFrame:
    """(cluster, series_id): the least sum of distances weighted by membership; d has both halves."""
    w = u.select(F.col("series_id").alias("j"), "cluster", F.pow("u", F.lit(fuzziness)).alias("w"))
    return least_sums(d.join(w, "j").groupBy("cluster", "i").agg(F.sum(F.col("d") * F.col("w")).alias("s")))


def least_sums(sums: DataFrame) -> DataFrame:
    """(cluster, series_id): the series of the least sum, smallest id on ties; sums: (cluster, i, s)."""
    return sums.groupBy("cluster").agg(F.min(F.struct("s", "i")).alias("b")).select("cluster", F.col("b.i").alias("series_id"))


def dba_step(members: DataFrame, centroids: DataFrame, mv: str = "by-variable", **args) -> DataFrame:
    """One step of barycenter averaging: every series is aligned with its cluster's centroid, and each point becomes the mean of what is aligned with it.

    mv: multivariate series are aligned "by-variable", each variable by a path of its own, or "by-series", by one path. Alignment runs
    in the tasks that hold the series, for all those of a length at once; sums per (cluster, point) are added up before the shuffle.
    """
    if mv not in ("by-variable", "by-series"):
        raise SeriesError("Series are aligned by-variable or by-series.")
    points = {r["cluster"]: np.asarray(r["values"], float) for r in centroids.collect()}  # k centroids

    def align(batches):
        for pdf in batches:
            sums: dict = {}
            series = pdf["values"].tolist()
            for c, own in pdf.groupby("cluster").indices.items():
                z = points[c].reshape(len(points[c]), -1)
                s, n = sums.setdefault(c, (np.zeros(z.shape), np.zeros(z.shape)))
                for rows in K.by_length([series[k] for k in own]).values():
                    x = K.dense([series[own[k]] for k in rows])
                    x = x.reshape(*x.shape[:2], -1)
                    for part in [slice(v, v + 1) for v in range(z.shape[1])] if mv == "by-variable" else [slice(None)]:
                        for a, path in zip(x, K.dtw_paths(x[:, :, part], np.broadcast_to(z[:, part], (len(x), *z[:, part].shape)), **args)[1], strict=True):
                            np.add.at(s[:, part], path[:, 1], a[path[:, 0], part])
                            np.add.at(n[:, part], path[:, 1], 1)
            for c, (s, n) in sums.items():
                t, v = np.indices(s.shape)
                yield pd.DataFrame({"cluster": c, "t": t.ravel(), "v": v.ravel(), "s": s.ravel(), "n": n.ravel()})

    parts = members.select("cluster", "values").mapInPandas(align, "cluster int, t int, v int, s double, n double")
    sums = parts.groupBy("cluster", "t", "v").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return _series(sums.where("n > 0").select("cluster", "t", "v", (F.col("s") / F.col("n")).alias("value")), is_multivariate(members))


def dba(members: DataFrame, centroids: DataFrame, iterations: int = 20, delta: float = 1e-3, **args) -> DataFrame:
    """Steps until no point of a centroid moves by delta or more. Centroids (k short arrays) go through the driver between steps."""
    spark = members.sparkSession
    now = {r["cluster"]: r["values"] for r in centroids.collect()}
    for _ in range(iterations):
        frame = spark.createDataFrame(list(now.items()), centroids.select("cluster", "values").schema)
        new = {r["cluster"]: r["values"] for r in dba_step(members, frame, **args).collect()}
        moved = max((float(np.abs(np.asarray(new[c]) - np.asarray(now[c])).max()) for c in new), default=0.0)
        now |= new
        if moved < delta:
            break
    return spark.createDataFrame(list(now.items()), centroids.select("cluster", "values").schema)


def shape_sums(z: np.ndarray, ids: np.ndarray, series: list, znorm: bool = False, known: tuple | None = None) -> tuple[np.ndarray, int, np.ndarray]:
    """Of series shifted to z: their Gram matrix, the least id and that series; added to what is known."""
    g, low, head = known or (0, np.inf, None)
    for rows in K.by_length(series).values():
        x = K.dense([series[i] for i in rows])
        moved = K.sbd_shifts(z, x, znorm)[1] if z.any() else x
        y = K.zscores(moved)
        first = ids[rows].argmin()
        g, low, head = g + y.T @ y, *((ids[rows][first], moved[first]) if ids[rows][first] < low else (low, head))
    return g, low, head


def shape_of(head: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The shape of a Gram matrix, z-scored, on the side of head."""
    n = len(head)
    p = np.eye(n) - 1 / n
    top = np.linalg.eigh(p @ gram.reshape(n, n) @ p)[1][:, -1]
    top = -top if np.linalg.norm(head - top) >= np.linalg.norm(head + top) else top
    s = top.std(ddof=1) if n > 1 else 0
    return (top - top.mean()) / s if s > 0 else top * 0


def shape(members: DataFrame, centroids: DataFrame | None = None, znorm: bool = False) -> DataFrame:
    """Shape extraction per cluster; with a centroid, series are first shifted to it. The Gram matrix (length x length) of a cluster is summed from partial ones, so no task holds a cluster. znorm: z-scored series are shifted."""
    c = centroids.select("cluster", F.col("values").alias("z")) if centroids is not None else members.groupBy("cluster").agg(F.min(F.struct("series_id", "values")).alias("f")).select("cluster", F.col("f.values").alias("z"))
    joined = members.join(F.broadcast(c), "cluster")

    def gram(batches):
        sums: dict = {}
        for pdf in batches:
            ids, series = pdf["series_id"].to_numpy(), pdf["values"].tolist()
            for k, own in pdf.groupby("cluster").indices.items():
                sums[k] = shape_sums(np.asarray(pdf["z"].iloc[own[0]], float), ids[own], [series[i] for i in own], znorm, sums.get(k))
        if sums:
            yield pd.DataFrame({"cluster": list(sums), "first": [int(v[1]) for v in sums.values()], "head": [v[2].tolist() for v in sums.values()], "gram": [v[0].ravel().tolist() for v in sums.values()]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        head = np.asarray(pdf.sort_values("first")["head"].iloc[0], float)
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "values": [shape_of(head, np.sum([np.asarray(g, float) for g in pdf["gram"]], axis=0)).tolist()]})

    parts = joined.select("cluster", "series_id", "values", "z").mapInPandas(gram, "cluster int, first long, head array<double>, gram array<double>")
    return parts.groupBy("cluster").applyInPandas(solve, "cluster int, values array<double>")  # one partial a task and cluster


def lbfgs_steps(x: np.ndarray, iterations: int = 20, memory: int = 8, tolerance: float = 1e-8):
    """Limited-memory BFGS with backtracking as a generator: it yields points, is sent their (value, gradient) and returns the least point."""
    value, g = yield x
    steps, changes = [], []
    for _ in range(iterations):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(steps), reversed(changes), strict=True):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if steps:
            q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, y, a in zip(steps, changes, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        slope, rate = -(q @ g), 1.0 if steps else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while rate > 1e-10:
            new = x - rate * q
            v, ng = yield new
            if v <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = new - x, ng - g
        if s @ y > 1e-12:
            steps, changes = [*steps, s][-memory:], [*changes, y][-memory:]
        done = abs(value - v) < tolerance * max(1, abs(value))
        x, value, g = new, v, ng
        if done:
            break
    return x


def sdtw_gradients(members: DataFrame, points: dict[int, np.ndarray], gamma: float) -> dict[int, tuple[float, np.ndarray]]:
    """For each cluster's point the sum of soft-DTW to its members, weighted by w, and its gradient: one job. members: cluster, values, w."""

    def part(batches):
        sums = {c: [0.0, np.zeros(z.shape)] for c, z in points.items()}
        for pdf in batches:
            for c, own in pdf.groupby("cluster"):
                series, w = own["values"].tolist(), own["w"].to_numpy()
                for at in K.by_length(series).values():
                    v, g = K.sdtw_gradients(points[c], K.dense([series[k] for k in at]), gamma)
                    sums[c][0] += float(w[at] @ v)
                    sums[c][1] += np.tensordot(w[at], g, 1)
        yield pd.DataFrame({"cluster": list(sums), "v": [v for v, _ in sums.values()], "g": [g.ravel().tolist() for _, g in sums.values()]})

    parts = members.where(F.col("cluster").isin(list(points))).mapInPandas(part, "cluster int, v double, g array<double>").collect()  # k rows a task
    own = {c: [p for p in parts if p["cluster"] == c] for c in points}
    return {c: (sum(p["v"] for p in own[c]), np.sum([p["g"] for p in own[c]], axis=0).reshape(z.shape)) for c, z in points.items()}


def sdtw_centroid(members: DataFrame, centroids: DataFrame, gamma: float = 0.01, weights: DataFrame | None = None, iterations: int = 20) -> DataFrame:
    """Minimises the weighted sum of soft-DTW to the members by L-BFGS. An evaluation is a job that sums values and gradients over the series of all clusters that go on; their
    centroids (k short arrays) stay on the driver, where each minimizer waits for its next value."""
    rows = members.join(weights, "series_id") if weights is not None else members.withColumn("w", F.lit(1.0))
    rows = rows.select("cluster", "values", "w").persist()
    start = {r["cluster"]: np.asarray(r["values"], float) for r in centroids.select("cluster", "values").collect()}
    solvers = {c: lbfgs_steps(z.ravel(), iterations) for c, z in start.items()}
    asked, done = {c: next(s).reshape(start[c].shape) for c, s in solvers.items()}, {}
    while asked:
        for c, (value, gradient) in sdtw_gradients(rows, asked, gamma).items():
            try:
                asked[c] = solvers[c].send((value, gradient.ravel())).reshape(start[c].shape)
            except StopIteration as end:
                done[c] = end.value.reshape(start[c].shape).tolist()
                del asked[c]
    rows.unpersist()
    return members.sparkSession.createDataFrame(list(done.items()), centroids.select("cluster", "values").schema)


def prototypes(centroid, members: DataFrame, before: DataFrame, relation=None, **args) -> DataFrame:
    """(cluster, series_id or null, values) by the name of a function, or by a function of members and the centroids before; relation() gives distances to medoids."""
    if centroid in ("pam", "fcmdd"):
        return medoids(relation(), members).join(members.select("cluster", "series_id", "values"), ["cluster", "series_id"]).select("cluster", "series_id", "values")
    if callable(centroid):
        new = centroid(members, before, **args)
    elif centroid in ("mean", "fcm", "median"):
        new = (median if centroid == "median" else mean)(members)
    elif centroid in ("dba", "shape", "sdtw_cent"):
        new = {"dba": dba, "shape": shape, "sdtw_cent": sdtw_centroid}[centroid](members, before.select("cluster", "values"), **args)
    else:
        raise SeriesError(f"No prototype is known as '{centroid}'.")
    return new.select("cluster", F.lit(None).cast("long").alias("series_id"), "values")
