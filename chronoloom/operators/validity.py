"""Cluster validity indices as aggregates over labels, memberships and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EPS = 2.2e-16
EXTERNAL, INTERNAL = ("RI", "ARI", "J", "FM", "VI"), ("Sil", "D", "COP", "DB", "DBstar", "CH", "SF")
FUZZY_EXTERNAL, FUZZY_INTERNAL = ("ARI", "RI", "VI", "NMIM"), ("MPC", "K", "T", "SC", "PBMF")
MINIMISED = {"VI", "COP", "DB", "DBstar", "K", "T"}


def external(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of RI, ARI, J, FM and VI (logarithms to base 10) of two partitions (series_id, cluster)."""
    pairs = lambda c: c * (c - 1) / 2
    cells = a.select("series_id", F.col("cluster").alias("a")).join(b.select("series_id", F.col("cluster").alias("b")), "series_id").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    entropy = lambda key: cells.groupBy(key).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"p{key}"), F.sum(F.col("n") * F.log10("n")).alias(f"h{key}"))
    one = cells.agg(F.sum("n").alias("N"), F.sum(pairs(F.col("n"))).alias("both"), F.sum(F.col("n") * F.log10("n")).alias("hab")).crossJoin(entropy("a")).crossJoin(entropy("b"))
    total, both = pairs(F.col("N")), F.col("both")
    pa, pb = F.col("pa"), F.col("pb")
    expected = pa * pb / total
    # H(a) + H(b) - 2 MI with H = log N - h / N
    vi = (F.col("ha") + F.col("hb") - 2 * F.col("hab")) / F.col("N")
    return one.select(
        ((total + 2 * both - pa - pb) / total).alias("RI"), ((both - expected) / ((pa + pb) / 2 - expected)).alias("ARI"), (both / (pa + pb - both)).alias("J"), (both / F.sqrt(pa * pb)).alias("FM"), F.abs(vi).alias("VI")
    )


def soft_external(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of ARI, RI, VI and NMIM of two soft partitions (series_id, cluster, u)."""
    n = a.select("series_id").distinct().count()
    t = a.select("series_id", F.col("cluster").alias("a"), F.col("u").alias("ua")).join(b.select("series_id", F.col("cluster").alias("b"), F.col("u").alias("ub")), "series_id").groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("t"))
    side = lambda key: t.groupBy(key).agg(F.sum("t").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias(f"q{key}"), (-F.sum(F.col("s") / n * F.log(F.col("s") / n + EPS))).alias(f"H{key}"))
    one = t.agg(F.sum(F.col("t") * F.col("t")).alias("q"), F.sum("t").alias("sum"), (-F.sum(F.col("t") / n * F.log(F.col("t") / n + EPS))).alias("Hab")).crossJoin(side("a")).crossJoin(side("b"))
    both, neither = (F.col("q") - F.col("sum")) / 2, (F.lit(float(n * n)) + F.col("q") - F.col("qa") - F.col("qb")) / 2
    x, y = (F.col("qb") - F.col("q")) / 2, (F.col("qa") - F.col("q")) / 2
    total = both + neither + x + y
    expected = (both + x) * (both + y) / total
    mi = F.col("Ha") + F.col("Hb") - F.col("Hab")
    return one.select(((both - expected) / (((both + x) + (both + y)) / 2 - expected)).alias("ARI"), ((both + neither) / total).alias("RI"), (F.col("Ha") + F.col("Hb") - 2 * mi).alias("VI"), (mi / F.greatest("Ha", "Hb")).alias("NMIM"))


def by_cluster(d: DataFrame, labels: DataFrame) -> DataFrame:
    """The sums of BlockMatrix.by_cluster() from a relation (i, j, d) with both halves."""
    lab = labels.select("series_id", "cluster")
    both = d.where("i != j").join(lab.select(F.col("series_id").alias("i"), "cluster"), "i").join(lab.select(F.col("series_id").alias("j"), F.col("cluster").alias("other")), "j")
    return both.groupBy("i", "cluster", "other").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))


def silhouette(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean silhouette; sums from by_cluster(); 0 for clusters of one."""
    per = sums.groupBy("i", "cluster").agg(F.max(F.when(F.col("other") == F.col("cluster"), F.col("s") / F.col("n"))).alias("a"), F.min(F.when(F.col("other") != F.col("cluster"), F.col("s") / F.col("n"))).alias("b"))
    each = labels.select(F.col("series_id").alias("i")).join(per, "i", "left")
    return each.agg(F.avg(F.when(F.greatest("a", "b") > 0, F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).otherwise(0.0)).alias("Sil"))


def dunn(sums: DataFrame) -> DataFrame:
    """One row: the least distance between clusters over the greatest within one; sums from by_cluster()."""
    return sums.agg((F.min(F.when(F.col("cluster") != F.col("other"), F.col("least"))) / F.max(F.when(F.col("cluster") == F.col("other"), F.col("most")))).alias("D"))


def cop(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: over the clusters, sum of distances to the centroid over the least greatest distance of a member to outsiders; by N. sums from by_cluster(); labels has d, the distance to the own centroid."""
    far = sums.where("cluster != other").groupBy("i", "cluster").agg(F.max("most").alias("m")).groupBy("cluster").agg(F.min("m").alias("m"))
    near = labels.groupBy("cluster").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    return near.join(far, "cluster").agg((F.sum(F.col("s") / F.col("m"))).alias("s"), F.sum("n").alias("n")).select((F.col("s") / F.col("n")).alias("COP"))


def _scatter(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.avg("d").alias("av"), F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"))


def davies_bouldin(labels: DataFrame, between: DataFrame) -> DataFrame:
    """One row of DB and DBstar; between has (i, j, d) of centroids, both halves."""
    s = _scatter(labels).select("cluster", "av")
    p = between.where("i != j").join(s.select(F.col("cluster").alias("i"), F.col("av").alias("si")), "i").join(s.select(F.col("cluster").alias("j"), F.col("av").alias("sj")), "j")
    return p.groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("d")).alias("r"), (F.max(F.col("si") + F.col("sj")) / F.min("d")).alias("q")).agg(F.avg("r").alias("DB"), F.avg("q").alias("DBstar"))


def calinski_harabasz(labels: DataFrame, to_global: DataFrame) -> DataFrame:
    """One row of CH and SF; to_global has (cluster, d), the distance of each centroid to the global one."""
    one = _scatter(labels).join(to_global.select("cluster", F.col("d").alias("g")), "cluster").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("g")).alias("b"), F.sum("s").alias("w"), F.sum("av").alias("v"))
    return one.select(((F.col("N") - F.col("k")) / (F.col("k") - 1) * F.col("b") / F.col("w")).alias("CH"), (1 - 1 / F.exp(F.exp(F.col("b") / (F.col("N") * F.col("k")) - F.col("v")))).alias("SF"))


def fuzzy_internal(u: DataFrame, between: DataFrame, to_global: DataFrame, series_to_global: DataFrame, fuzziness: float = 2.0) -> DataFrame:
    """One row of MPC, K, T, SC and PBMF. u: (series_id, cluster, u, d); between: centroids (i, j, d), both halves; to_global: (cluster, d); series_to_global: (series_id, d)."""
    m = F.pow("u", F.lit(fuzziness))
    sums = u.agg(F.count_distinct("series_id").alias("N"), F.count_distinct("cluster").alias("k"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(F.col("u") * F.col("u") * F.col("d") * F.col("d")).alias("uudd"), F.sum(m * F.col("d")).alias("umd"))
    c = between.where("i != j").agg(F.min(F.col("d") * F.col("d")).alias("least"), F.max("d").alias("most"), F.sum(F.col("d") * F.col("d")).alias("bb"))
    g = to_global.agg(F.sum(F.col("d") * F.col("d")).alias("gg"))
    e = series_to_global.agg(F.sum("d").alias("e"))
    spread = u.groupBy("cluster").agg((F.sum(m * F.col("d") * F.col("d")) / F.sum("u")).alias("v")).agg(F.sum("v").alias("comp"))
    pairs = u.alias("a").join(u.alias("b"), F.col("a.series_id") == F.col("b.series_id")).where("a.cluster < b.cluster").select(F.col("a.cluster").alias("l"), F.col("b.cluster").alias("r"), F.least("a.u", "b.u").alias("w"))
    overlap = pairs.groupBy("l", "r").agg((F.sum(F.col("w") * F.col("w")) / F.sum("w")).alias("o")).agg(F.sum("o").alias("over"))
    top = u.groupBy("series_id").agg(F.max("u").alias("w")).agg((F.sum(F.col("w") * F.col("w")) / F.sum("w")).alias("top"))
    one = sums
    for other in (c, g, e, spread, overlap, top):
        one = one.crossJoin(other)
    k = F.col("k")
    return one.select(
        (1 - k / (k - 1) * (1 - F.col("uu") / F.col("N"))).alias("MPC"), ((F.col("uudd") + F.col("gg") / k) / F.col("least")).alias("K"), ((F.col("uudd") + F.col("bb") / (k * (k - 1))) / (F.col("least") + 1 / k)).alias("T"),
        (F.col("gg") / k / F.col("comp") - F.col("over") / F.col("top")).alias("SC"), F.pow(F.col("e") / k / F.col("umd") * F.col("most"), F.lit(2)).alias("PBMF"),
    )


def one_hot(labels: DataFrame) -> DataFrame:
    classes = labels.select(F.col("cluster").alias("c")).distinct()
    return labels.select("series_id", "cluster").crossJoin(F.broadcast(classes)).select("series_id", F.col("c").alias("cluster"), (F.col("cluster") == F.col("c")).cast("double").alias("u"))


def indices(clustering, series: DataFrame, which: str | list[str] = "valid", truth: DataFrame | None = None, distance_relation: DataFrame | None = None) -> dict[str, float]:
    """Indices of a clustering by name or group: valid, internal, external. What the given data don't allow is left out."""
    from chronoloom.operators import centroids as C
    from chronoloom.operators.blocks import block_matrix
    from chronoloom.operators.distances import kept, mirrored, to_centroids

    cfg, soft = clustering.config, clustering.membership is not None
    names = {"valid": (FUZZY_INTERNAL if soft else INTERNAL) + ((FUZZY_EXTERNAL if soft else EXTERNAL) if truth is not None else ()), "internal": FUZZY_INTERNAL if soft else INTERNAL, "external": FUZZY_EXTERNAL if soft else EXTERNAL}
    wanted = [n for w in ([which] if isinstance(which, str) else which) for n in names.get(w, (w,))]
    out: dict[str, float] = {}
    add = lambda df: out.update(df.first().asDict())
    if truth is not None and {"RI", "ARI", "J", "FM", "VI", "NMIM"} & set(wanted):
        add(soft_external(clustering.membership, one_hot(truth)) if soft else external(clustering.labels, truth))
    inside = set(wanted) & set(FUZZY_INTERNAL if soft else INTERNAL)
    if inside:
        args, method, cents = cfg.get("dist_args", {}), cfg["distance"], clustering.centroids.select("cluster", "values")
        method = "dtw_basic" if method == "dtw_lb" else method
        as_series = cents.select(F.col("cluster").cast("long").alias("series_id"), "values")
        matrix = []  # all distances, computed where an index or a medoid needs them, and not stored

        def blocks():
            if not matrix:
                matrix.append(block_matrix(series, method, **args))
            return matrix[0]

        def d() -> DataFrame:
            return distance_relation if distance_relation is not None else mirrored(blocks().relation()) if blocks().lower else blocks().relation()

        def to(rows: DataFrame, points: DataFrame) -> DataFrame:
            return to_centroids(rows, points, method, **args)

        between = to(as_series, cents).select(F.col("series_id").alias("i"), F.col("cluster").alias("j"), "d")
        if soft or inside & {"CH", "SF"}:
            # The prototype of all series, by the function that made those of the clusters.
            whole = series.select("series_id", "values", F.lit(1).alias("cluster"))
            first = whole.groupBy("cluster").agg(F.min_by("values", "series_id").alias("values"))
            center = kept(C.prototypes(cfg.get("centroid") or "pam", whole, first, d, **cfg.get("cent_args", {}))).select("cluster", "values")
            to_global = to(as_series, center).select(F.col("series_id").cast("int").alias("cluster"), "d")
        if soft:
            u = clustering.membership.join(to(series, cents), ["series_id", "cluster"])
            add(fuzzy_internal(u, between, to_global, to(series, center).select("series_id", "d"), cfg["control"].fuzziness))
        else:
            if inside & {"Sil", "D", "COP"}:
                sums = kept(by_cluster(distance_relation, clustering.labels) if distance_relation is not None else blocks().by_cluster(clustering.labels))
                for name, one in (("Sil", lambda: silhouette(sums, clustering.labels)), ("D", lambda: dunn(sums)), ("COP", lambda: cop(sums, clustering.labels))):
                    if name in inside:
                        add(one())
            if inside & {"DB", "DBstar"}:
                add(davies_bouldin(clustering.labels, between))
            if inside & {"CH", "SF"}:
                add(calinski_harabasz(clustering.labels, to_global))
    return {n: out[n] for n in wanted if n in out and out[n] is not None and not math.isnan(out[n])}


def scored(name: str, value: Column | float):
    """Minimised indices as reciprocals, so that more is better."""
    return 1 / value if name in MINIMISED else value
