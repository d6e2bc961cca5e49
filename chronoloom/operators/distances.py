"""Distance relations (i, j, d) between series: the joins of this engine.

L1 and L2 of few series (BROADCAST_VALUES) stay in Catalyst. Otherwise series of both sides meet in blocks of BLOCK_TILES x BLOCK_SERIES at most. A task holds two blocks and goes through them by tiles of BLOCK_SERIES series a side, whose
distances it sends on before it begins the next tile; what a kernel needs of each series (envelopes, transforms, own terms) is computed once a tile. A
symmetric self-distance is computed for i > j only; `mirrored` gives both halves of it.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronoloom.functions import kernels as K, series as S
from chronoloom.operators import rules
from chronoloom.operators.rules import REGISTRY, Distance, lookup, register  # noqa: F401 - the registry's public names
from chronoloom.sources.series import SeriesError, check_series, check_window, profile

BROADCAST_VALUES, BLOCK_SERIES, BLOCK_TILES, LEAST_BLOCK, SIGMA_POINTS, MANY = 50_000, 512, 8, 16, 10_000, 1 << 14


def _dtw2(x, y, **a):
    return K.dtw(x, y, norm="L2", **a)


def lbk_expression(x: Column, y: Column, window: int = 1, norm: str = "L1") -> Column:
    """lb_keogh within Catalyst; an envelope is computed for each pair, so the kernel serves the matrices."""
    return S.norm_sum(S.excess(x, *S.envelope(y, window)), norm)


def lbi_expression(x: Column, y: Column, window: int = 1, norm: str = "L1") -> Column:
    low, up = S.envelope(y, window)
    h = S.clamp(x, low, up)
    return S.norm_sum(F.concat(S.excess(x, low, up), S.excess(y, *S.envelope(h, window))), norm)


def _dtw2_outer(x, y, **a):
    return K.dtw_outer(x, y, norm="L2", **a)


def _plain(kernel: Callable) -> Callable:
    return lambda x, y, **_: kernel(x, y)


def _warped(kernel: Callable) -> Callable:
    """kernel where the step is one of two and the ends are closed."""
    return lambda a: kernel if a.get("step", "symmetric2") in ("symmetric1", "symmetric2") and not {"open_begin", "open_end", "limit"} & set(a) else None


_elastic = lambda a: a.get("step", "symmetric2").startswith("symmetric") and (a.get("window") is None or a.get("equal_lengths", False))
register(Distance("dtw_basic", K.dtw, ragged=True, multivariate=True, symmetric=_elastic, outer=_warped(K.dtw_outer)), "dtw")
register(Distance("dtw2", _dtw2, ragged=True, multivariate=True, symmetric=_elastic, outer=_warped(_dtw2_outer)))
register(Distance("sdtw", K.sdtw, ragged=True, multivariate=True, diagonal=True))
register(Distance("sbd", K.sbd, K.spectrum, ragged=True, outer=lambda a: K.sbd_outer))
register(Distance("ugak", K.log_gak, ragged=True, multivariate=True, diagonal=True))
register(Distance("lbk", K.lb_keogh, K.envelopes, symmetric=lambda a: a.get("force_symmetry", False), bound=True, outer=lambda a: K.lb_keogh_outer), "lb_keogh")
register(Distance("lbi", K.lb_improved, K.envelopes, symmetric=lambda a: a.get("force_symmetry", False), bound=True, outer=lambda a: K.lb_improved_outer), "lb_improved")
register(Distance("L1", K.manhattan, expression=lambda x, y, **_: S.minkowski(x, y, 1), outer=lambda a: _plain(K.manhattan_outer)), "manhattan")
register(Distance("L2", K.euclidean, expression=lambda x, y, **_: S.minkowski(x, y, 2), outer=lambda a: _plain(K.euclidean_outer)), "euclidean")
register(Distance("gak", K.gak, K.gak_self, ragged=True, multivariate=True))


def batch_udf(kernel: Callable, **args):
    """A kernel of stacked pairs as an Arrow-batched function of two array columns."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(K.in_batches(lambda a, b: kernel(a, b, **args), x.tolist(), y.tolist()))

    return run


def given(args: dict) -> dict:
    return {k: v for k, v in args.items() if v is not None}


def pair_distance(method: str, **args) -> Column:
    """The distance of x_values and y_values of a row."""
    dist = lookup(method)
    if dist.expression:
        return dist.expression(F.col("x_values"), F.col("y_values"), **given(args))
    return batch_udf(dist.kernel, **given(args))("x_values", "y_values")


def with_sigma(method: str, args: dict, x: DataFrame) -> dict:
    """args with the bandwidth of an alignment kernel, estimated from x if it isn't given."""
    return args if lookup(method).name not in ("gak", "ugak") or args.get("sigma") else args | {"sigma": estimate_sigma(x)}


def few_pairs(x: DataFrame, y: DataFrame | None, lower: bool, diagonal: bool) -> DataFrame:
    """(i, x_values, j, y_values): all pairs, or i > j (i >= j with the diagonal) of one side; the other side goes to all tasks."""
    left = x.select(F.col("series_id").alias("i"), F.col("values").alias("x_values"))
    right = (x if y is None else y).select(F.col("series_id").alias("j"), F.col("values").alias("y_values"))
    cond = (F.col("i") >= F.col("j") if diagonal else F.col("i") > F.col("j")) if lower else F.lit(True)
    return left.repartition(2 * x.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(right), cond)


@dataclass(frozen=True)
class Plan:
    """A distance between two sides, looked at and ready: which pairs are wanted (lower: i > j of one side, with the diagonal where that isn't 0) and with what arguments."""

    x: DataFrame
    y: DataFrame | None
    dist: Distance
    args: dict
    lower: bool
    known: dict
    other: dict

    def blocks(self, square: bool = False, wide: int = 1, most: int | None = None) -> tuple[int, int]:
        """Number of blocks of either side, for two tasks a core and blocks of wide x BLOCK_TILES tiles (or of `most` series) at most: a series is sent once for each block of the other side, so the larger, the less is sent."""
        tasks, most = 2 * self.x.sparkSession.sparkContext.defaultParallelism, most or wide * BLOCK_TILES * BLOCK_SERIES
        cut = lambda n, few: max(1, -(-n // most), min(few, -(-n // LEAST_BLOCK)))
        if square or self.lower:
            n = cut(self.known["n"], int((2 * tasks) ** 0.5) + 1)
            return n, n
        columns = cut(self.other["n"], 4)
        return cut(self.known["n"], -(-tasks // columns)), columns

    def meet(self, body: Callable, schema: str, rows: int, columns: int, whole: bool = False, by: str = "series_id") -> DataFrame:
        """body(key, a, b, wanted) of tiles of each pair of blocks, at most BLOCK_SERIES series a side (whole: of the pair of blocks): frames a (i, x) and b (j, y) with further columns of their sides;
        of a lower triangle each pair of blocks, and of tiles, once. What a tile gives is sent on before the next one begins. by: the column that deals series to blocks."""
        lower, diagonal = self.lower, self.dist.diagonal
        block = lambda n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
        every = lambda a, b: F.explode(F.sequence(a, b))
        left = self.x.withColumn("p", block(rows)).withColumn("q", every(F.col("p") if lower else F.lit(0), F.lit(columns - 1)))
        right = (self.x if self.y is None else self.y).withColumn("q", block(columns)).withColumn("p", every(F.lit(0), F.col("q") if lower else F.lit(rows - 1)))
        if lower:  # a block meets itself: its series are sent once
            right = right.where("p < q")
        names, nested = [c for c in self.x.columns if c not in ("series_id", "values")], isinstance(self.x.schema["values"].dataType.elementType, T.ArrayType)
        more = [*names, "_length"] if nested else names
        if nested:  # points of several variables are sent as one array and get their shape back
            left, right = (v.withColumn("_length", F.size("values")).withColumn("values", F.flatten("values")) for v in (left, right))

        def sides(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
            a, b = (v.sort_values("series_id", ignore_index=True) for v in (a, a if lower and key[0] == key[1] else b))
            if nested:
                a, b = (v.assign(values=pd.Series([x.reshape(n, -1) for x, n in zip(v["values"], v["_length"], strict=True)], dtype=object)) for v in (a, b))
            a, b = (v[["series_id", "values", *names]] for v in (a, b))
            return a.rename(columns={"series_id": "i", "values": "x"}), b.rename(columns={"series_id": "j", "values": "y"})

        def pairs(key: tuple, a: pd.DataFrame, b: pd.DataFrame, own: bool) -> np.ndarray:
            if not own:
                return np.ones((len(a), len(b)), bool)
            i, j = a["i"].to_numpy()[:, None], b["j"].to_numpy()[None, :]
            return i >= j if diagonal else i > j

        def once(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            a, b = sides(key, a, b)
            if not len(a) or not len(b):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            return body(key, a, b, pairs(key, a, b, lower and key[0] == key[1]))

        def pack(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"p": [key[0]], "q": [key[1]], "both": [pickle.dumps(sides(key, a, b))]})

        def by_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for p, q, both in zip(pdf["p"], pdf["q"], pdf["both"], strict=True):
                    key, (a, b), own = (p, q), pickle.loads(both), lower and p == q
                    steps = [[slice(s, s + BLOCK_SERIES) for s in range(0, len(v), BLOCK_SERIES)] for v in (a, b)]
                    for n, s in enumerate(steps[0]):
                        for t in steps[1][: n + 1] if own else steps[1]:
                            one, other = a.iloc[s].reset_index(drop=True), b.iloc[t].reset_index(drop=True)
                            yield body(key, one, other, pairs(key, one, other, own and s == t))

        n = min(10_000, rows * (rows + 1) // 2 if lower else rows * columns)
        # aliases: both sides may be one frame, whose columns would be ambiguous
        one, other = (v.select(*[F.col(c).alias(c) for c in ("p", "q", "series_id", "values", *more)]).repartition(n, "p", "q").groupBy("p", "q") for v in (left, right))
        met = one.cogroup(other)
        # a cogroup gives one frame: where all distances are sent on it gives the two blocks, which the next step goes through by tiles
        return met.applyInPandas(once, schema) if whole else met.applyInPandas(pack, "p int, q int, both binary").mapInPandas(by_tiles, schema)

    def kernel(self) -> Callable:
        """Distances of the wanted pairs of two lists of series: f(x, y, wanted)."""
        dist, args = self.dist, self.args
        kernel, prepare, outer = dist.kernel, dist.prepare, dist.outer(args)
        return lambda x, y, wanted: K.of_blocks(lambda u, v, **known: kernel(u, v, **args, **known), x, y, wanted, prepare and (lambda v, other: prepare(v, other, **args)), outer=outer and (lambda u, v: outer(u, v, **args)))

    def sums_kernel(self) -> Callable:
        """Distances of all pairs of two lists (or stacks) of series, of which only sums, least and greatest ones are wanted: f(x, y)."""
        if self.dist.name == "L2":
            return lambda x, y: K.euclidean_products(K.dense(x), K.dense(y))
        f = self.kernel()
        return lambda x, y: f(x, y, np.ones((len(x), len(y)), bool))

    def all_distances(self, emit: Callable) -> Callable:
        """A body for meet() that computes every wanted distance: emit(i, j, d, wanted, key)."""
        f = self.kernel()

        def body(key, a: pd.DataFrame, b: pd.DataFrame, wanted: np.ndarray) -> pd.DataFrame:
            return emit(a["i"].to_numpy(), b["j"].to_numpy(), f(a["x"].tolist(), b["y"].tolist(), wanted), wanted, key)

        return body


def plan(x: DataFrame, y: DataFrame | None = None, method: str = "dtw_basic", check: bool = True, known: dict | None = None, **args) -> Plan:
    """One job looks at x, and one at y, before distances are planned; known, a profile() of x, saves the first. check: whether the distance takes them."""
    dist = lookup(method)
    args["window"] = check_window(args.get("window"), required=dist.bound)
    if known is None:
        known = check_series(x) if check else profile(x)
    other = (check_series(y) if check else profile(y)) if y is not None else known
    if check:
        rules.fits(method, known, other)
        for p in (known, other):
            rules.check_distance(method, p, args["window"])
    equal = known["shortest"] == known["longest"] == other["longest"] == other["shortest"]
    lower = y is None and dist.symmetric({**args, "equal_lengths": equal})
    return Plan(x, y, dist, given(with_sigma(method, args, x)), lower, known, other)


def distances(x: DataFrame, y: DataFrame | None = None, method: str = "dtw_basic", pairwise: bool = False, check: bool = True, known: dict | None = None, **args) -> DataFrame:
    """(i, j, d). Without y: of x with itself, i > j if the distance is symmetric (i >= j for soft-DTW), else all pairs. pairwise: rows of equal series_id."""
    own = plan(x, y, method, check, known, **args)
    if pairwise:
        rows = x.select(F.col("series_id").alias("i"), F.col("values").alias("x_values")).join((y if y is not None else x).select(F.col("series_id").alias("j"), F.col("values").alias("y_values")), F.col("i") == F.col("j"))
        return rows.select("i", "j", pair_distance(method, **own.args).alias("d"))
    if own.dist.expression and own.other["values"] <= BROADCAST_VALUES:
        return few_pairs(x, y, own.lower, own.dist.diagonal).select("i", "j", pair_distance(method, **own.args).alias("d"))
    lower = own.lower

    def rows(i: np.ndarray, j: np.ndarray, d: np.ndarray, wanted: np.ndarray, key: tuple) -> pd.DataFrame:
        if wanted.all():
            i, j, d = np.repeat(i, len(j)), np.tile(j, len(i)), d.ravel()
        else:
            p, q = np.nonzero(wanted)
            i, j, d = i[p], j[q], d[p, q]
        return pd.DataFrame({"i": np.maximum(i, j) if lower else i, "j": np.minimum(i, j) if lower else j, "d": d})

    return own.meet(own.all_distances(rows), "i long, j long, d double", *own.blocks())


def nearest_neighbours(x: DataFrame, y: DataFrame | None = None, method: str = "dtw_basic", digits: int | None = None, **args) -> DataFrame:
    """(i, j, d): the nearest of y (without y, of the other series of x) for each of x, smallest id on ties; digits: distances are rounded to so many before they are compared.

    A block sends one row for each of its series (for those of both sides where the distance is symmetric), not one for each pair."""
    own = plan(x, y, method, **args)
    lower, alone = own.lower, y is None

    def best(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        order = np.argsort(j, kind="stable")
        at = order[np.argmin(d[:, order], axis=1)]
        found = d[np.arange(len(i)), at]
        return pd.DataFrame({"i": i, "j": j[at], "d": found})[np.isfinite(found)]

    def minima(i: np.ndarray, j: np.ndarray, d: np.ndarray, wanted: np.ndarray, key: tuple) -> pd.DataFrame:
        d = np.where(wanted & ~(alone & (i[:, None] == j[None, :])), d if digits is None else np.round(d, digits), np.inf)
        return pd.concat([best(i, j, d), best(j, i, d.T)]) if lower else best(i, j, d)

    schema = "i long, j long, d double"
    if not _by_single(own):
        return nearest(own.meet(own.all_distances(minima), schema, *own.blocks()))
    given_args, slack = {k: own.args[k] for k in ("window", "step") if k in own.args}, 0.0 if digits is None else 2 * 10.0**-digits

    def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame, _: np.ndarray) -> pd.DataFrame:
        """Of a pair of blocks: distances in single precision, then those in double of the pairs that could be a series' nearest by them."""
        twin, xs, ys = lower and key[0] == key[1], K.dense(a["x"].tolist()), K.dense(b["y"].tolist())
        i, j = a["i"].to_numpy(), b["j"].to_numpy()
        most = [np.full(len(v), np.inf) for v in (i, j)]  # a series' nearest is no farther
        most = most[:1] * 2 if twin else most
        kept_pairs = []
        for s in range(0, len(i), BLOCK_SERIES):
            for t in range(0, s + 1 if twin else len(j), BLOCK_SERIES):
                p, q = slice(s, s + BLOCK_SERIES), slice(t, t + BLOCK_SERIES)
                d, off = K.dtw_single(xs[p], ys[q], **given_args)
                if alone:
                    d[i[p][:, None] == j[q][None, :]] = np.inf
                high, low = d + off, d - off - slack
                most[0][p] = np.minimum(most[0][p], high.min(1))
                near = low <= most[0][p][:, None]
                if lower:
                    most[1][q] = np.minimum(most[1][q], high.min(0))
                    near |= low <= most[1][q][None, :]
                m, n = np.nonzero(near & np.isfinite(d))
                kept_pairs.append((m + s, n + t, low[m, n]))
        m, n, low = (np.concatenate(c) for c in zip(*kept_pairs, strict=True))
        some = (low <= most[0][m]) | (lower & (low <= most[1][n]))
        m, n = m[some], n[some]
        d = np.concatenate([K.dtw_banded(xs[m[at : at + MANY]], ys[n[at : at + MANY]], **given_args) for at in range(0, len(m), MANY)] or [np.zeros(0)])
        rows = pd.DataFrame({"i": i[m], "j": j[n], "d": d if digits is None else np.round(d, digits)})
        rows = pd.concat([rows, rows.rename(columns={"i": "j", "j": "i"})[["i", "j", "d"]]]) if lower else rows
        return rows.sort_values(["i", "d", "j"]).drop_duplicates("i")

    return nearest(own.meet(search, schema, *own.blocks(), whole=True))



def _by_single(own: Plan) -> bool:
    """Whether a search may look at DTW in single precision first: of one variable and length, by L1 and the steps that are for all pairs of two stacks."""
    lengths = {p[k] for p in (own.known, own.other) for k in ("shortest", "longest")}
    nested = isinstance(own.x.schema["values"].dataType.elementType, T.ArrayType)
    return own.dist.name == "dtw_basic" and not nested and len(lengths) == 1 and set(own.args) <= {"window", "step", "norm"} and own.args.get("norm", "L1") == "L1" and own.args.get("step", "symmetric2") in ("symmetric1", "symmetric2")


def to_centroids(series: DataFrame, centroids: DataFrame, method: str, check: bool = True, **args) -> DataFrame:
    """(series_id, cluster, d): each series with each of a few centroids (cluster, values), which go to the tasks that hold the series. check: both are looked at first, whether the distance takes them."""
    dist, args = lookup(method), given(args)
    if check:
        known, points = profile(series), profile(centroids)
        rules.fits(method, known, points)
        if dist.bound:
            rules.check_distance(method, points, args.get("window"))
    if dist.expression:
        both = series.select("series_id", F.col("values").alias("x_values")).join(F.broadcast(centroids.select("cluster", F.col("values").alias("y_values"))), F.lit(True))
        return both.select("series_id", "cluster", pair_distance(method, **args).alias("d"))
    args = with_sigma(method, args, series)
    rows = centroids.select("cluster", "values").collect()  # k centroids
    names, points = np.array([r["cluster"] for r in rows], np.int32), [np.asarray(r["values"], float) for r in rows]
    kernel, prepare = dist.kernel, dist.prepare

    def compare(batches):
        for pdf in batches:
            d = K.of_blocks(lambda u, v, **known: kernel(u, v, **args, **known), pdf["values"].tolist(), points, np.ones((len(pdf), len(points)), bool), prepare and (lambda v, other: prepare(v, other, **args)))
            yield pd.DataFrame({"series_id": np.repeat(pdf["series_id"].to_numpy(), len(names)), "cluster": np.tile(names, len(pdf)), "d": d.ravel()})

    return series.select("series_id", "values").mapInPandas(compare, "series_id long, cluster int, d double")


def estimate_sigma(series: DataFrame, seed: int = 1, points: int = SIGMA_POINTS) -> float:
    """A bandwidth for the alignment kernel: root of the median length times the median distance of random samples of points.

    Lengths are of all series; the samples are drawn from `points` points, the first by a hash of their place.
    """
    rng = np.random.default_rng(seed)
    least, median = series.agg(F.min(F.size("values")), F.percentile(F.size("values"), F.lit(0.5))).first()
    at = series.select("series_id", F.posexplode("values").alias("t", "value"))
    pool = np.array([np.atleast_1d(r[0]) for r in at.orderBy(F.xxhash64("series_id", "t", F.lit(seed)), "series_id", "t").limit(points).select("value").collect()], float)
    n, k = max(1, round(least / 2)), max(1, int(median))
    d = [np.linalg.norm(pool[rng.integers(len(pool), size=n)] - pool[rng.integers(len(pool), size=n)]) for _ in range(k)]
    return float(np.sqrt(median) * np.median(d))


def mirrored(d: DataFrame) -> DataFrame:
    """Both halves of a lower triangle, with a zero diagonal left implied: each row is turned after its distance is known, so that is computed once."""
    ends = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return d.select(F.explode(ends).alias("p"), "d").select("p.i", "p.j", "d")


def symmetric_relation(series: DataFrame, method: str, known: dict | None = None, **args) -> DataFrame:
    """All (i, j, d) with i != j (and i = j where that isn't 0)."""
    known = known or check_series(series)
    d = distances(series, method=method, known=known, **args)
    return mirrored(d) if lookup(method).symmetric({**args, "equal_lengths": known["shortest"] == known["longest"]}) else d


def as_matrix(d: DataFrame, order: list[int] | None = None) -> DataFrame:
    """A relation as a cross table: a row for each i, a column named after each j; ids are listed by the driver."""
    ids = order or [r[0] for r in d.select("j").distinct().orderBy("j").collect()]
    return d.groupBy("i").pivot("j", ids).agg(F.first("d")).orderBy("i")


def memoised(known: DataFrame | None, wanted: DataFrame, series: DataFrame, method: str, **args) -> DataFrame:
    """known with the (i, j) of wanted that it lacks computed: an anti-join, then one pass over the new pairs."""
    new = wanted if known is None else wanted.join(known.select("i", "j"), ["i", "j"], "left_anti")
    rows = new.join(series.select(F.col("series_id").alias("i"), F.col("values").alias("x_values")), "i").join(series.select(F.col("series_id").alias("j"), F.col("values").alias("y_values")), "j")
    out = rows.select("i", "j", pair_distance(method, **with_sigma(method, args, series)).alias("d"))
    return out if known is None else known.unionByName(out)


def nearest(d: DataFrame, by: str = "i") -> DataFrame:
    """The nearest partner of each i (or j), smallest id on ties: (i, j, d)."""
    other = "j" if by == "i" else "i"
    best = d.groupBy(by).agg(F.min(F.struct("d", other)).alias("b"))
    return best.select(by, F.col(f"b.{other}").alias(other), F.col("b.d").alias("d"))


def warping_paths(pairs: DataFrame, **args) -> DataFrame:
    """Adds path, an array of 1-based (index1, index2), to rows with x_values and y_values."""

    @F.pandas_udf("array<struct<index1: int, index2: int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y, out = x.tolist(), y.tolist(), [None] * len(x)
        shapes: dict = {}
        for k, (a, b) in enumerate(zip(x, y, strict=True)):
            shapes.setdefault((len(a), len(b)), []).append(k)
        for own in shapes.values():
            for k, path in zip(own, K.dtw_paths(K.dense([x[k] for k in own]), K.dense([y[k] for k in own]), **args)[1], strict=True):
                out[k] = [{"index1": i, "index2": j} for i, j in (path + 1).tolist()]
        return pd.Series(out)

    return pairs.withColumn("path", run("x_values", "y_values"))


def dtw_lb(x: DataFrame, y: DataFrame | None, window: int, norm: str = "L1", margin: int = 1, step: str = "symmetric2", pairwise: bool = False, method: str = "dtw_basic", counts: bool = False, check: bool = True) -> DataFrame:
    """Nearest neighbours under DTW, bounds first: (i, j, d) for each of x (margin 1) or of y; without y, of other series of x. One job; bounds are never written.

    Within two blocks that meet, every series takes its candidates in the order of their lower bounds (lb_improved) and computes DTW until the next bound lies above the
    best distance so far; all series of a block go on in step, so a step is one stack of pairs, and a pair whose cells all exceed its series' best is abandoned.
    counts: with the number of distances computed and of pairs. pairwise: DTW of rows of equal series_id, no search. Ties go to the smallest id.
    """
    if method not in ("dtw_basic", "dtw", "dtw2") or step not in ("symmetric1", "symmetric2"):
        raise SeriesError("A search by lower bounds is for dtw_basic, dtw or dtw2 with symmetric1 or symmetric2.")
    norm = "L2" if method == "dtw2" else norm
    if pairwise:
        return distances(x, y, "dtw_basic", pairwise=True, check=check, window=window, norm=norm, step=step)
    left, right = (x, x if y is None else y) if margin == 1 else (x if y is None else y, x)
    alone, swap = y is None, margin != 1
    own = plan(left, right, "lbi", check, window=window, norm=norm)
    args = {"window": window, "norm": norm, "step": step}

    def search(key, a: pd.DataFrame, b: pd.DataFrame, wanted: np.ndarray) -> pd.DataFrame:
        i, j = a["i"].to_numpy(), b["j"].to_numpy()
        order = np.argsort(j, kind="stable")
        j, xs, ys = j[order], K.dense(a["x"].tolist()), K.dense(b["y"].tolist())[order]
        # The bound is of x to y's envelope, whichever side searches.
        bound = (lambda u, v, **k: K.lb_improved(v, u, window, norm, **{("x_" if s[0] == "y" else "y_") + s[2:]: w for s, w in k.items()})) if swap else (lambda u, v, **k: K.lb_improved(u, v, window, norm, **k))
        bounds = K.of_blocks(bound, list(xs), list(ys), wanted, lambda v, other: K.envelopes(v, other, window))
        if alone:
            bounds[i[:, None] == j[None, :]] = np.inf
        turn = np.argsort(bounds, axis=1, kind="stable")
        best, found, at, n = np.full(len(i), np.inf), np.full(len(i), -1), np.zeros(len(i), int), np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        while len(live):
            live = live[at[live] < len(j)]
            pick = turn[live, at[live]]
            low = bounds[live, pick]
            going = np.isfinite(low) & (low <= best[live] + 1e-9 * np.maximum(1, low))
            live, pick = live[going], pick[going]
            if not len(live):
                break
            d = K.dtw(xs[live], ys[pick], limit=best[live], **args)
            n[live] += 1
            better = (d < best[live]) | ((d == best[live]) & (pick < found[live]))
            best[live[better]], found[live[better]] = d[better], pick[better]
            at[live] += 1
        out = pd.DataFrame({"i": i, "j": j[found], "d": best, "computed": n, "pairs": np.isfinite(bounds).sum(1)})
        return out[found >= 0]

    rows, columns = own.blocks()
    one = own.meet(search, "i long, j long, d double, computed long, pairs long", rows, max(1, -(-own.other["n"] // (BLOCK_TILES * BLOCK_SERIES))))
    best = one.groupBy("i").agg(F.min(F.struct("d", "j")).alias("b"), F.sum("computed").alias("computed"), F.sum("pairs").alias("pairs"))
    ends = (F.col("i"), F.col("b.j").alias("j")) if margin == 1 else (F.col("b.j").alias("i"), F.col("i").alias("j"))
    return best.select(*ends, F.col("b.d").alias("d"), *(["computed", "pairs"] if counts else []))


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: a table written to the folder of spark.checkpoint.dir and read back, which outlives executors and leaves nothing of the plan (a checkpoint keeps its constraints, which
    grow with every round); where it is unset, on a machine of its own in a temporary folder, and on a cluster, whose machines share no such folder, a cached frame, which saves the work again but lets the plan grow."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            return df.persist()
        folder = f"file://{tempfile.mkdtemp(prefix='chronoloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
