"""Registered queries over whole tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from chronoloom.functions import series as S
from chronoloom.operators import blocks, centroids as C, clustering as K, compare, constraints, distances as D, trees, validity as V
from chronoloom.sources import series as src
from chronoloom.streaming import predict as streaming

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r(column, digits: int = 6):
    return F.round(column, digits)


def _d(df: DataFrame) -> DataFrame:
    return df.select("i", "j", r("d").alias("d"))


def _long(df: DataFrame) -> DataFrame:
    return src.to_long(df).select("series_id", "t", r("value").alias("value"))


def daily_z(spark: SparkSession, d: str) -> DataFrame:
    return src.daily(spark, d).withColumn("values", S.zscore(F.col("values")))


def nation_z(spark: SparkSession, d: str) -> DataFrame:
    return src.nation_monthly(spark, d).withColumn("values", S.zscore(F.col("values")))


def by_label(spark: SparkSession, d: str) -> DataFrame:
    return src.embeddings(spark, d).withColumn("cluster", F.col("label"))


def label_means(spark: SparkSession, d: str) -> DataFrame:
    return C.mean(by_label(spark, d))


def to_means(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, cluster, d): L2 distance of each embedding to the mean of each label."""
    return D.to_centroids(src.embeddings(spark, d).select("series_id", "values"), label_means(spark, d), "L2")


def l2_blocks(spark: SparkSession, d: str) -> blocks.BlockMatrix:
    return blocks.block_matrix(src.embeddings(spark, d).select("series_id", "values"), "L2")


# Series and their functions
@query
def series_daily(spark, d):
    return _long(src.daily(spark, d))


@query
def series_ragged(spark, d):
    return src.ragged(spark, d).select("series_id", F.size("values").cast("long").alias("n"), r(S.total(F.col("values")), 4).alias("total"), r(S.l2norm(F.col("values")), 4).alias("norm"))


@query
def series_multivariate(spark, d):
    return src.to_long(src.daily_by_type(spark, d)).groupBy("series_id", "var").agg(F.sum("value").alias("total"), F.max("value").alias("most"))


@query
def zscore(spark, d):
    return _long(daily_z(spark, d))


@query
def reinterpolate(spark, d):
    return _long(src.daily(spark, d).withColumn("values", S.reinterpolate(F.col("values"), 45)))


@query
def envelope(spark, d):
    low, up = S.envelope(F.col("values"), 3)
    rows = src.daily(spark, d).select("series_id", F.posexplode(F.arrays_zip(low.alias("low"), up.alias("up"))).alias("t", "e"))
    return rows.select("series_id", "t", r("e.low").alias("low"), r("e.up").alias("up"))


@query
def autocorrelation(spark, d):
    return _long(src.daily(spark, d).withColumn("values", S.acf(F.col("values"), 5)))


@query
def zscore_multivariate(spark, d):
    x = K.preprocess(src.daily_by_type(spark, d), "zscore")
    return src.to_long(x).select("series_id", "t", "var", r("value").alias("value"))


@query
def reshape_multivariate(spark, d):
    """A series for each variable of each user."""
    return src.variables(src.daily_by_type(spark, d)).select("series_id", "var", F.posexplode("values").alias("t", "value"))


@query
def cross_correlation(spark, d):
    """Of each nation and the next one, by lag."""
    x = nation_z(spark, d).select("series_id", "values")
    both = x.join(x.select((F.col("series_id") - 1).alias("series_id"), F.col("values").alias("y_values")), "series_id")
    rows = both.select("series_id", F.posexplode(S.nccc(F.col("values"), F.col("y_values"))).alias("lag", "value"), F.size("y_values").alias("n"))
    return rows.select("series_id", (F.col("lag") - F.col("n") + 1).alias("lag"), r("value").alias("value"))


@query
def characteristics(spark, d):
    return src.characteristics(daily_z(spark, d))


# Distances
@query
def l1_matrix(spark, d):
    return _d(D.distances(src.daily(spark, d), method="L1"))


@query
def l2_matrix(spark, d):
    return _d(D.distances(src.daily(spark, d), method="L2"))


@query
def lb_keogh(spark, d):
    return _d(D.distances(daily_z(spark, d), method="lbk", window=3, norm="L2"))


@query
def lb_improved(spark, d):
    return _d(D.distances(daily_z(spark, d), method="lbi", window=3, norm="L1"))


@query
def sbd_matrix(spark, d):
    return _d(D.distances(daily_z(spark, d), method="sbd"))


@query
def sbd_znorm(spark, d):
    """Of raw series with z-scores on the way: as sbd_matrix."""
    return _d(D.distances(src.daily(spark, d), method="sbd", znorm=True))


@query
def distance_table(spark, d):
    """A relation as a cross table: a column for each nation."""
    return D.as_matrix(_d(D.mirrored(D.distances(nation_z(spark, d), method="L2"))))


@query
def dtw_l1_matrix(spark, d):
    return _d(D.distances(nation_z(spark, d)))


@query
def dtw_l2_sym1(spark, d):
    return _d(D.distances(nation_z(spark, d), method="dtw_basic", norm="L2", step="symmetric1"))


@query
def dtw_ragged(spark, d):
    """Nations' first 40 months and as many more as their number."""
    x = nation_z(spark, d).withColumn("values", F.slice("values", F.lit(1), (40 + F.col("series_id")).cast("int")))
    return _d(D.distances(x, method="dtw_basic", norm="L2"))


@query
def dtw_window(spark, d):
    return _d(D.distances(nation_z(spark, d), method="dtw_basic", window=5, norm="L2"))


@query
def dtw_normalized(spark, d):
    return _d(D.distances(nation_z(spark, d), method="dtw_basic", normalize=True))


@query
def dtw_asymmetric(spark, d):
    return _d(D.distances(nation_z(spark, d), method="dtw_basic", step="asymmetric", normalize=True))


@query
def dtw_sloped(spark, d):
    return _d(D.distances(nation_z(spark, d), method="dtw_basic", step="symmetricP1", norm="L2", normalize=True))


@query
def dtw_typed(spark, d):
    """Between all nations either way: the pattern of the third type isn't symmetric."""
    return _d(D.distances(nation_z(spark, d), method="dtw_basic", step="typeIIIc", normalize=True))


@query
def dtw_open_ends(spark, d):
    """Each nation's last 24 months within all months of every nation."""
    x = nation_z(spark, d)
    return _d(D.distances(x.withColumn("values", F.slice("values", -24, 24)), x, "dtw_basic", step="asymmetric", norm="L2", open_begin=True, open_end=True))


@query
def dtw_pairwise(spark, d):
    x = nation_z(spark, d)
    return _d(D.distances(x, x.withColumn("values", F.reverse("values")), "dtw2", pairwise=True))


@query
def dtw_multivariate(spark, d):
    return _d(D.distances(src.daily_by_type(spark, d), method="dtw_basic", norm="L1", window=5))


@query
def dtw_path(spark, d):
    """Of each nation and the next one, in whole thousands, so that equal ways are exactly equal."""
    x = src.nation_monthly(spark, d).select("series_id", F.transform("values", lambda v: F.round(v / 1000)).alias("x_values"))
    y = x.select((F.col("series_id") - 1).alias("series_id"), F.col("x_values").alias("y_values"))
    paths = D.warping_paths(x.join(y, "series_id"), norm="L1")
    return paths.select("series_id", F.posexplode("path").alias("step", "p")).select("series_id", "step", "p.index1", "p.index2")


@query
def dtw_nn(spark, d):
    """Nearest neighbour of each user's daily series."""
    return _d(D.nearest_neighbours(daily_z(spark, d), digits=6))


@query
def dtw_lb_nn(spark, d):
    x = daily_z(spark, d)
    groups = C.mean(x.withColumn("cluster", F.pmod("series_id", F.lit(10)).cast("int"))).select(F.col("cluster").cast("long").alias("series_id"), "values")
    return _d(D.dtw_lb(x, groups, 3, "L1"))


@query
def sdtw_matrix(spark, d):
    return _d(D.distances(nation_z(spark, d), method="sdtw", gamma=1.0))


@query
def ugak_matrix(spark, d):
    return _d(D.distances(nation_z(spark, d), method="ugak", sigma=2.0))


@query
def gak_matrix(spark, d):
    return _d(D.distances(nation_z(spark, d), method="gak", sigma=2.0))


@query
def distance_memo(spark, d):
    """A relation computed in two parts, the second without the pairs of the first."""
    x = nation_z(spark, d)
    ids = x.select("series_id")
    pairs = ids.select(F.col("series_id").alias("i")).join(ids.select(F.col("series_id").alias("j")), F.col("i") > F.col("j"))
    first = D.memoised(None, pairs.where("(i + j) % 2 = 0"), x, "L2")
    return _d(D.memoised(first, pairs, x, "L2"))


@query
def gak_memo(spark, d):
    """The alignment kernel in two parts, as gak_matrix."""
    x = nation_z(spark, d)
    ids = x.select("series_id")
    pairs = ids.select(F.col("series_id").alias("i")).join(ids.select(F.col("series_id").alias("j")), F.col("i") > F.col("j"))
    first = D.memoised(None, pairs.where("(i + j) % 3 = 0"), x, "gak", sigma=2.0)
    return _d(D.memoised(first, pairs, x, "gak", sigma=2.0))


# Centroids and assignment
@query
def cent_mean(spark, d):
    return label_means(spark, d).select("cluster", F.posexplode("values").alias("t", "value")).select("cluster", "t", r("value").alias("value"))


@query
def cent_median(spark, d):
    return C.median(by_label(spark, d)).select("cluster", F.posexplode("values").alias("t", "value")).select("cluster", "t", r("value").alias("value"))


@query
def cent_multivariate(spark, d):
    """Means and medians by variable of the users of one remainder by 4."""
    x = src.daily_by_type(spark, d).withColumn("cluster", F.pmod("series_id", F.lit(4)).cast("int"))
    tall = lambda c, name: c.select("cluster", F.posexplode("values").alias("t", "row")).select("cluster", "t", F.posexplode("row").alias("var", name))
    return tall(C.mean(x), "mean").join(tall(C.median(x), "median"), ["cluster", "t", "var"]).select("cluster", "t", "var", r("mean").alias("mean"), r("median").alias("median"))


@query
def medoid(spark, d):
    x = by_label(spark, d)
    return C.medoids_of(l2_blocks(spark, d).by_cluster(x, within=True), x).select("cluster", F.col("medoid").alias("series_id"))


@query
def assign(spark, d):
    return K.assign(to_means(spark, d)).select("series_id", "cluster", r("d").alias("d"))


@query
def kmeans_step(spark, d):
    x = src.embeddings(spark, d).select("series_id", "values")
    new = C.mean(x.join(K.assign(to_means(spark, d)).select("series_id", "cluster"), "series_id"))
    return new.select("cluster", F.posexplode("values").alias("t", "value")).select("cluster", "t", r("value").alias("value"))


@query
def fuzzy_u(spark, d):
    return K.memberships(to_means(spark, d)).select("series_id", "cluster", r("u").alias("u"))


@query
def fcm_step(spark, d):
    new = C.fcm(K.memberships(to_means(spark, d)), src.embeddings(spark, d).select("series_id", "values"))
    return new.select("cluster", F.posexplode("values").alias("t", "value")).select("cluster", "t", r("value").alias("value"))


@query
def fcmdd_step(spark, d):
    return C.least_sums(blocks.weighted_sums(src.embeddings(spark, d), "L2", K.memberships(to_means(spark, d))))


@query
def dba_step(spark, d):
    x = daily_z(spark, d).withColumn("cluster", F.pmod("series_id", F.lit(4)).cast("int"))
    return C.dba_step(x, C.mean(x), window=5).select("cluster", F.posexplode("values").alias("t", "value")).select("cluster", "t", r("value").alias("value"))


@query
def shape_centroid(spark, d):
    x = daily_z(spark, d).withColumn("cluster", F.pmod("series_id", F.lit(4)).cast("int"))
    return C.shape(x).select("cluster", F.posexplode("values").alias("t", "value")).select("cluster", "t", r("value").alias("value"))


@query
def sdtw_centroid(spark, d):
    x = daily_z(spark, d).withColumn("cluster", F.lit(1))
    return C.sdtw_centroid(x, C.mean(x), 1.0).select("cluster", F.posexplode("values").alias("t", "value"))


@query
def sdtw_step(spark, d):
    """Of the users of one remainder by 4 the sum of soft-DTW to their mean, and the mean a gradient step further."""
    x = daily_z(spark, d).withColumn("cluster", F.pmod("series_id", F.lit(4)).cast("int"))
    start = {c["cluster"]: np.array(c["values"]) for c in C.mean(x).collect()}  # 4 prototypes
    found = C.sdtw_gradients(x.select("cluster", "values", F.lit(1.0).alias("w")), start, 1.0)
    rows = [(c, t, round(float(v), 6), round(float(z), 6)) for c, (v, g) in found.items() for t, z in enumerate(start[c] - 0.001 * g)]
    return spark.createDataFrame(rows, "cluster int, t int, objective double, value double")


# Clusterings from the series of the least ids, to the default limits of iterations
def least_ids(x: DataFrame, k: int) -> list[int]:
    return [i[0] for i in x.select("series_id").orderBy("series_id").limit(k).collect()]


def _labels_of(c: K.Clustering) -> DataFrame:
    return c.labels.select("series_id", "cluster", r("d").alias("d"))


@query
def pam_clustering(spark, d):
    x = nation_z(spark, d)
    return _labels_of(K.cluster(x, k=4, args={"window": 5}, init_ids=least_ids(x, 4)))


@query
def kmeans_clustering(spark, d):
    x = src.embeddings(spark, d).select("series_id", "values")
    return _labels_of(K.cluster(x, k=10, distance="L2", centroid="mean", init_ids=least_ids(x, 10)))


@query
def kshape_clustering(spark, d):
    return K.k_shape(src.daily(spark, d), 4).labels


@query
def fuzzy_clustering(spark, d):
    """Of autocorrelations."""
    x = src.daily(spark, d)
    c = K.cluster(x, "fuzzy", 4, "acf", "L2", preproc_args={"lags": 10}, init_ids=least_ids(x, 4))
    return c.membership.select("series_id", "cluster", r("u").alias("u"))


@query
def hierarchical_clustering(spark, d):
    return _labels_of(K.cluster(daily_z(spark, d), "hierarchical", 5, distance="sbd", control=K.Hierarchical(large=True)))


@query
def hierarchical_segments(spark, d):
    """125 series under the shape-based distance, 20 clusters by average linkage."""
    x = src.segment_monthly(spark, d).withColumn("values", S.zscore(F.col("values")))
    return _labels_of(K.cluster(x, "hierarchical", 20, distance="sbd"))


@query
def fuzzy_nations(spark, d):
    """25 series by their autocorrelations up to lag 50, 5 clusters."""
    x = src.nation_monthly(spark, d)
    c = K.cluster(x, "fuzzy", 5, "acf", "L2", preproc_args={"lags": 50}, init_ids=least_ids(x, 5))
    return c.membership.select("series_id", "cluster", r("u").alias("u"))


@query
def spanning_tree(spark, d):
    """The minimum spanning tree of the users' series under the shape-based distance."""
    x = daily_z(spark, d)
    return _d(trees.spanning_tree(blocks.block_matrix(x, "sbd"), x.select("series_id")))


@query
def single_linkage(spark, d):
    """Single linkage by its spanning tree, without a matrix on the driver."""
    return _labels_of(K.single_linkage(daily_z(spark, d), 5, "sbd"))


@query
def dendrogram(spark, d):
    """Merges of the nations' series in order (observations by their place among the ids, negative), with their boxes as drawn."""
    x = nation_z(spark, d)
    ids = [i[0] for i in x.select("series_id").orderBy("series_id").collect()]  # of nations
    merges = K.cluster(x, "hierarchical", 2, distance="L2").merges
    place, boxes = trees.layout(merges, len(ids))
    rows = [(n, a, b, *(round(float(v), 6) for v in box)) for n, ((a, b, _), box) in enumerate(zip(merges, boxes, strict=True), 1)]
    return spark.createDataFrame(rows, "merge int, a int, b int, left double, right double, left_height double, right_height double, height double")


@query
def kshape_step(spark, d):
    """One step of k-Shape from the series of the least ids: each series' nearest by shape, then the shapes extracted from those."""
    x = daily_z(spark, d)
    ids = least_ids(x, 4)
    first = x.where(F.col("series_id").isin(ids)).select((F.dense_rank().over(W.orderBy("series_id"))).alias("cluster"), "values")
    labels = K.assign(D.to_centroids(x, first, "sbd"))
    return C.shape(x.join(labels.select("series_id", "cluster"), "series_id"), first).select("cluster", F.posexplode("values").alias("t", "value")).select("cluster", "t", r("value").alias("value"))


@query
def tadpole_clustering(spark, d):
    return K.cluster(daily_z(spark, d), "tadpole", 4, control=K.Tadpole(6.0, 3)).labels.select("series_id", "cluster")


@query
def predict(spark, d):
    cents = [(x["cluster"], x["values"]) for x in label_means(spark, d).orderBy("cluster").collect()]  # one a label
    return streaming.predict(src.embeddings(spark, d), cents).select("series_id", "cluster", r("d").alias("d"))


# Validity indices of the assignment to label means
def _labels(spark, d):
    return K.assign(to_means(spark, d))


def _between(spark, d):
    c = label_means(spark, d)
    x = D.to_centroids(c.select(F.col("cluster").cast("long").alias("series_id"), "values"), c, "L2")
    return x.select(F.col("series_id").alias("i"), F.col("cluster").alias("j"), "d")


def _global(spark, d):
    return C.mean(src.embeddings(spark, d).withColumn("cluster", F.lit(1)))


def _to_global(spark, d):
    x = D.to_centroids(label_means(spark, d).select(F.col("cluster").cast("long").alias("series_id"), "values"), _global(spark, d), "L2")
    return x.select(F.col("series_id").cast("int").alias("cluster"), "d")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r(c).alias(c) for c in df.columns])


@query
def cvi_external(spark, d):
    return _rounded(V.external(_labels(spark, d), src.embeddings(spark, d).select("series_id", F.col("label").alias("cluster"))))


@query
def cvi_soft_external(spark, d):
    truth = V.one_hot(src.embeddings(spark, d).select("series_id", F.col("label").alias("cluster")))
    return _rounded(V.soft_external(K.memberships(to_means(spark, d)), truth))


@query
def cvi_silhouette(spark, d):
    labels = _labels(spark, d)
    return _rounded(V.silhouette(l2_blocks(spark, d).by_cluster(labels), labels))


@query
def cvi_dunn(spark, d):
    return _rounded(V.dunn(l2_blocks(spark, d).by_cluster(_labels(spark, d))))


@query
def cvi_cop(spark, d):
    labels = _labels(spark, d)
    return _rounded(V.cop(l2_blocks(spark, d).by_cluster(labels), labels))


@query
def cvi_davies_bouldin(spark, d):
    return _rounded(V.davies_bouldin(_labels(spark, d), _between(spark, d)))


@query
def cvi_calinski_score(spark, d):
    return _rounded(V.calinski_harabasz(_labels(spark, d), _to_global(spark, d)))


@query
def cvi_fuzzy(spark, d):
    own = D.to_centroids(src.embeddings(spark, d).select("series_id", "values"), _global(spark, d), "L2").select("series_id", "d")
    return _rounded(V.fuzzy_internal(K.memberships(to_means(spark, d)), _between(spark, d), _to_global(spark, d), own))


@query
def cvi_indices(spark, d):
    """All internal indices by the front door, with the prototype of all series made as those of the clusters."""
    c = K.from_parts(_labels(spark, d), label_means(spark, d), "L2", centroid="mean")
    found = V.indices(c, src.embeddings(spark, d).select("series_id", "values"), "internal")
    return spark.createDataFrame([tuple(round(found[n], 6) for n in V.INTERNAL)], ", ".join(f"{n} double" for n in V.INTERNAL))


@query
def cluster_sizes(spark, d):
    return _labels(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), r(F.avg("d")).alias("av_dist"))


# Comparison of configurations
def _windows(spark, d):
    """(share, window): windows as shares of the length of the nations' series."""
    length = src.nation_monthly(spark, d).agg(F.max(F.size("values")).alias("n"))
    return length.select(F.explode(F.array(F.lit(5), F.lit(10))).alias("share"), "n").select("share", F.ceil(F.col("n") * F.col("share") / 100).cast("double").alias("window_distance"))


@query
def config_grid(spark, d):
    k = spark.range(2, 5).select(F.col("id").cast("int").alias("k"))
    prep = spark.createDataFrame([("none",), ("zscore",)], "preproc string")
    dist = _windows(spark, d).select(F.lit("dtw_basic").alias("distance"), "window_distance").unionByName(spark.createDataFrame([("sbd", None)], "distance string, window_distance double"))
    return compare.grid_frame(spark, [k, prep, dist])


@query
def config_grid_shared(spark, d):
    """A grid whose parts share a column that isn't expanded: a full outer join."""
    a = _windows(spark, d).select(F.when(F.col("share") == 5, "L1").otherwise("L2").alias("norm"), "window_distance")
    b = spark.createDataFrame([("L1", "dba"), ("L3", "pam")], "norm string, centroid string")
    return compare.grid_frame(spark, [a, b], ["norm"])


@query
def compare_configs(spark, d):
    """Two numbers of clusters under two distances on the embeddings, each scored against the labels; best: the pick by majority."""
    x = src.embeddings(spark, d)
    series, truth = x.select("series_id", "values"), x.select("series_id", F.col("label").alias("cluster"))
    first = least_ids(series, 10)
    configs = {"partitional": [{"k": [5, 10], "distance": m, "centroid": "mean", "iterations": 20, "init_ids": first} for m in ("L1", "L2")]}
    names = ["RI", "ARI", "J", "FM", "VI"]
    score, pick = compare.evaluators(names, truth)
    out = compare.compare(series, configs, score, pick, keep=False)
    rows = [(r["config_id"], r["distance"], r["k"], *(round(float(r[n]), 6) for n in names), r["config_id"] == out.get("pick")) for r in out["results"]]
    return spark.createDataFrame(rows, "config_id string, distance string, k int, " + ", ".join(f"{n} double" for n in names) + ", best boolean")


def _partitions(spark, d):
    """Three partitions of the embeddings: by label, by nearest mean of a label and by the sign of the first value."""
    x = src.embeddings(spark, d)
    parts = [x.select("series_id", F.col("label").alias("cluster")), _labels(spark, d).select("series_id", "cluster"), x.select("series_id", (F.col("values")[0] > 0).cast("int").alias("cluster"))]
    out = parts[0].withColumn("part", F.lit(1))
    for n, p in enumerate(parts[1:], 2):
        out = out.unionByName(p.withColumn("part", F.lit(n)))
    return out


@query
def consensus_partition(spark, d):
    return compare.consensus(_partitions(spark, d))


@query
def majority_pick(spark, d):
    parts, truth = _partitions(spark, d), src.embeddings(spark, d).select("series_id", F.col("label").alias("cluster"))
    rows = None
    for n in (2, 3):
        one = V.external(parts.where(F.col("part") == n), truth)
        tall = one.select(F.lit(f"config{n}").alias("config_id"), F.stack(F.lit(4), *[x for c in ("RI", "ARI", "J", "FM") for x in (F.lit(c), F.col(c))]).alias("cvi", "score"))
        rows = tall if rows is None else rows.unionByName(tall)
    return compare.majority(rows)


# Constraints: users of one remainder by 10 must be together, neighbours by id must not
def _flags(spark, d):
    x = src.daily(spark, d)
    total = lambda w: S.total(F.slice("values", F.lit(1), F.lit(w)))
    labels = None
    for w in (3, 5, 8, 12):
        one = x.select(F.lit(w).alias("window"), "series_id", F.pmod(F.floor(F.round(total(w), 2) / 50).cast("long"), F.lit(3)).cast("int").alias("cluster"))
        labels = one if labels is None else labels.unionByName(one)
    ids = x.select(F.col("series_id").alias("i"))
    links = ids.select("i", (F.col("i") + 10).alias("j"), F.lit(1).alias("type")).unionByName(ids.select("i", (F.col("i") + 1).alias("j"), F.lit(0).alias("type")))
    return constraints.satisfied(labels, links)


@query
def constraint_complexity(spark, d):
    c = constraints.complexity(_flags(spark, d))
    return c.select("i", "j", "type", r("complexity").alias("complexity"), F.col("first_ok").cast("double").alias("first_ok"))


@query
def window_vote(spark, d):
    return constraints.choose_window(constraints.complexity(_flags(spark, d)), 0.5)


@query
def constraint_closure(spark, d):
    """What links between users one and two ids apart say of pairs five apart: the former must be together if their sums are of one level of three, and must not otherwise; the latter by their sums of the first week."""
    x = src.daily(spark, d)
    level = lambda v: F.pmod(F.floor(F.round(S.total(v), 2) / 50).cast("long"), F.lit(3))
    x = x.select("series_id", level(F.col("values")).alias("l1"), level(F.slice("values", 1, 7)).alias("l2"))
    links = None
    for n in (1, 2):
        other = x.select((F.col("series_id") - n).alias("series_id"), F.col(f"l{n}").alias("other"))
        one = x.join(other, "series_id").select(F.col("series_id").alias("i"), (F.col("series_id") + n).alias("j"), (F.col(f"l{n}") == F.col("other")).cast("int").alias("type"))
        links = one if links is None else links.unionByName(one)
    return constraints.implied(x.select(F.col("series_id").alias("i"), (F.col("series_id") + 5).alias("j")), constraints.closure(links))
