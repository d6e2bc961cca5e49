"""Exact top-k search by inner product: vectors in descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components are scaled and floored to integers, so scores are exact integers and their order is total: (score down, vec_id up).

1. Equal candidate vectors become one, with their k + 1 smallest ids: more of them can't be among a query's k others. Equal query rows become one with a count.
2. Candidates are dealt by descending length (ties by a hash) into blocks of up to BLOCK vectors, in the order of length within, and written to the
   shared folder. The Gram matrix of all of them, summed by the tasks, gives the rotation onto its eigenvectors (the right singular vectors of the candidates); the
   first axes hold most of the lengths, so few of them bound a product well.
3. Every query meets the longest block alone first, which is one block whatever the table: the k-th best score there is the query's threshold.
4. A query goes to the blocks whose longest vector could reach its threshold at all (|q| |c| by Cauchy-Schwarz); by descending length these are
   the first ones. Queries travel in groups of GROUP, so a block is copied once a group. Within a (block, group) the vectors are taken by tiles in
   descending length: queries whose bound by length is below their threshold leave, for the others the partial sums of the first axes
   and the product of the lengths of what remains bound the score, axis group by axis group; what could still reach the threshold (ties
   included) is computed exactly, and thresholds rise from tile to tile.
5. The best of all blocks of a query are put together, and its own row is taken out.

Bounds are widened by their rounding error. The driver holds a length for each block (8 bytes for up to BLOCK vectors) and a matrix for each number of components; no vectors
but the longest block go with a job.

Edge cases: vectors that are null, hold null or non-finite components, or a component too large for exact 64-bit scores take no part.
Vectors of different numbers of components have no inner product; they aren't each other's candidates. Empty vectors score 0 with each other. Rows of one
vec_id are rows of their own; a query leaves out its own row alone. A null vec_id is no query and comes last among ties.
Only vec_id and embedding are read, whatever other columns there are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize, repeated, small_batches

SCALE, EVERY, TOP = 256, 50, 5
BLOCK, LEAST_BLOCK, GROUP, TILE, AXES = 65_536, 2_048, 8_192, 256, (8, 24)
BATCH_BYTES = 8 << 20
NO_ID = (1 << 63) - 1  # stands for a missing vec_id, last among ties


def scaled(vector: Column) -> Column:
    """floor(SCALE x) of each component; null if the vector takes no part. So many components as large as the limit have a product that a long holds."""
    limit = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(vector), F.lit(1)))
    limit = F.least(limit, F.lit(float((1 << 31) - 1)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) >= limit))
    return F.when(~bad, whole)


def decode(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.asarray(v) for v in vectors]).astype(np.int64) if dim else np.zeros((len(vectors), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: by floating point where no sum can leave its whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


def tails(rotated: np.ndarray) -> np.ndarray:
    """Length of what each axis group leaves over, a column for each of AXES (and 0 axes first)."""
    rest = np.cumsum((rotated**2)[:, ::-1], axis=1)[:, ::-1]
    rest = np.c_[rest, np.zeros(len(rest))]
    return np.sqrt(np.stack([rest[:, min(a, rotated.shape[1])] for a in (0, *AXES)], axis=1))


class Best:
    """The best entries of some queries so far: score and id, and whether the vector is the query's own; the worst of them is the threshold."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.rows = [np.zeros(0, np.int64)] * 4  # query, score, id, own

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        q, s, i, o = (np.concatenate(x) for x in zip(self.rows, (query, score, ids, own.astype(np.int64)), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i, o = q[order], s[order], i[order], o[order]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begin, len(q)])
        rank = np.arange(len(q)) - np.repeat(begin, size)
        full = size >= self.k
        at = begin[full] + self.k - 1
        self.floor[q[at]] = np.maximum(self.floor[q[at]], s[at])
        self.rows = [x[rank < self.k] for x in (q, s, i, o)]


LEAST = -(1 << 62)


def search(queries: np.ndarray, turned: np.ndarray, floor: np.ndarray, block: np.ndarray, turned_block: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[Best, int]:
    """The k best entries at or above each query's floor among the rows of block (in descending length, each with its ids), and how many products were computed."""
    best, computed = Best(len(queries), k, floor), 0
    q_tails, c_tails = tails(turned), tails(turned_block)
    slack = 1e-6 + 1e-9 * q_tails[:, 0]
    steps = [0, *(min(a, block.shape[1]) for a in AXES)]
    for at in range(0, len(block), TILE):
        tile = slice(at, min(at + TILE, len(block)))
        length = c_tails[at, 0]
        live = np.flatnonzero(q_tails[:, 0] * length + slack * (1 + length) >= best.floor)
        if not len(live):
            if (best.floor > 0).all():
                break  # shorter vectors reach no positive threshold either
            continue
        alive = np.ones((len(live), tile.stop - at), bool)
        partial_sum = np.zeros(alive.shape)
        for n, (a, b) in enumerate(zip(steps, steps[1:]), 1):
            partial_sum += turned[live, a:b] @ turned_block[tile, a:b].T
            bound = partial_sum + q_tails[live, n, None] * c_tails[None, tile, n]
            alive &= bound + slack[live, None] * (1 + length) >= best.floor[live, None]
        rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            continue
        score = products(queries[live[rows]], block[at + columns])
        computed += score.size
        r, c = np.nonzero(alive[np.ix_(rows, columns)] & (score >= best.floor[live[rows], None]))
        if not len(r):
            continue
        query, row = live[rows[r]], at + columns[c]
        own = (queries[query] == block[row]).all(1)
        sizes = np.array([len(ids[x]) for x in row])
        best.add(np.repeat(query, sizes), np.repeat(score[r, c], sizes), np.concatenate([ids[x] for x in row]), np.repeat(own, sizes))
    return best, computed


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """v, dim, length and the k + 1 smallest ids of each distinct vector."""
    order = W.partitionBy("v").orderBy(F.col("id").asc())
    first = vectors.select("v", F.coalesce("id", F.lit(NO_ID)).alias("id")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", F.size("v").alias("dim"), length.alias("length"), "ids")


def blocks_of(rows: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """dim, block, most (its greatest length), v, length, ids: written; blocks are numbered within each dim by descending length."""
    spark = rows.sparkSession
    if block is None:
        block = max(LEAST_BLOCK, min(BLOCK, n // (4 * spark.sparkContext.defaultParallelism)))
    parts = max(1, -(-n // block))
    dealt = rows.repartitionByRange(parts, "dim", F.desc("length"), F.xxhash64("v")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt.select("dim", "part", "v", "length", "ids"), "vector-blocks")
    known = dealt.groupBy("dim", "part").agg(F.max("length").alias("most"))
    known = known.withColumn("block", F.row_number().over(W.partitionBy("dim").orderBy(F.desc("most"), "part")) - 1)  # a row for each block
    return dealt.join(F.broadcast(known), ["dim", "part"]).drop("part")


def rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """For each number of components the eigenvectors of the candidates' Gram matrix, greatest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                x = decode(own["v"], dim).astype(float)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        yield pd.DataFrame({"dim": list(sums), "gram": [g.ravel().tolist() for g in sums.values()]})

    parts = blocks.select("dim", "v").mapInPandas(run, "dim int, gram array<double>")
    at = parts.select("dim", F.posexplode("gram").alias("at", "x")).groupBy("dim", "at").agg(F.sum("x").alias("x"))
    out = {}
    for dim, gram in at.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("g")).select("dim", "g.x").collect():  # components**2 numbers
        out[dim] = np.linalg.eigh(np.array(gram).reshape(dim, dim))[1][:, ::-1]
    return out


def _entries(pdf: pd.DataFrame, best: Best) -> pd.DataFrame:
    q, score, ids, own = best.rows
    return pd.DataFrame({"query": pdf["query"].to_numpy()[q], "score": score, "id": ids, "own": own.astype(bool)})


def _turn(dim: int, turns: dict[int, np.ndarray], x: np.ndarray) -> np.ndarray:
    return x.astype(float) @ turns[dim] if dim else x.astype(float)


def top_k(docs: DataFrame, every: int = EVERY, k: int = TOP, block: int | None = None, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of docs (vec_id, embedding): for rows whose vec_id is divisible by `every` the k best other rows."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    vectors = materialize(docs.select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding")).alias("v")).where("v IS NOT NULL"), "vectors")
    blocks = blocks_of(candidates(vectors, k), vectors.count(), block)
    turns = rotations(blocks.where("dim > 0"))
    asked = vectors.where(F.col("id") % every == 0).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    asked = asked.select(F.col("id"), "v", "copies", F.size("v").alias("dim"), F.xxhash64("id", "v").alias("query"))
    heads = {}
    for dim, own in blocks.where("block = 0").select("dim", "v", "length", "ids").toPandas().groupby("dim"):  # one block for each number of components
        own = own.sort_values("length", ascending=False, kind="stable")
        heads[dim] = decode(own["v"], dim).astype(np.int32), [np.asarray(i) for i in own["ids"]]

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                q = decode(own["v"], dim)
                x, own_ids = heads[dim]
                best, _ = search(q, _turn(dim, turns, q), np.full(len(q), LEAST), x, _turn(dim, turns, x), own_ids, k + 1)
                out = own.copy()
                out["floor"] = best.floor
                order = np.argsort(best.rows[0], kind="stable")
                cuts = np.searchsorted(best.rows[0][order], np.arange(len(q) + 1))
                pick = lambda x: [x[order[a:b]].tolist() for a, b in zip(cuts, cuts[1:])]  # noqa: B023, E731
                out["scores"], out["ids"], out["owns"] = (pick(x) for x in best.rows[1:])
                yield out[["query", "id", "v", "copies", "dim", "floor", "scores", "ids", "owns"]]

    begun = asked.repartition(F.col("query")).mapInPandas(start, "query long, id long, v array<long>, copies long, dim int, floor long, scores array<long>, ids array<long>, owns array<long>")
    begun = materialize(begun, "queries")
    most: dict[int, np.ndarray] = {}
    for dim, own in blocks.select("dim", "block", "most").distinct().toPandas().groupby("dim"):  # a row for each block
        most[dim] = own.sort_values("block")["most"].to_numpy()
    groups = max(1, -(-begun.count() // group))

    @F.pandas_udf("int")
    def last(dim: pd.Series, v: pd.Series, floor: pd.Series) -> pd.Series:
        """The last block that could reach a query's threshold."""
        out = np.zeros(len(dim), np.int32)
        for d in dim.unique():
            own = np.flatnonzero(dim == d)
            length = np.sqrt((decode(v.iloc[own], d).astype(float) ** 2).sum(1))
            need = (floor.iloc[own].to_numpy() - 1e-6) / np.maximum(length * (1 + 1e-9), 1e-9)
            out[own] = np.where(floor.iloc[own] <= 0, len(most[d]), np.searchsorted(-most[d], -need, side="right")) - 1
        return pd.Series(out)

    far = begun.select("query", "v", "floor", F.col("dim").alias("qdim"), F.pmod("query", F.lit(groups)).cast("int").alias("part"), last("dim", "v", "floor").alias("last")).where("last > 0")
    far = far.withColumn("at", F.explode(F.sequence(F.lit(1), "last"))).drop("last")
    near = blocks.where("block > 0").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    meet = partial(_meet, turns=turns, k=k + 1)
    found = far.groupBy("qdim", "at", "part").cogroup(near.groupBy("dim", "block", "group")).applyInPandas(meet, "query long, score long, id long, own boolean")
    first = begun.select("query", F.explode(F.arrays_zip("scores", "ids", "owns")).alias("e")).select("query", F.col("e.scores").alias("score"), F.col("e.ids").alias("id"), (F.col("e.owns") == 1).alias("own"))
    ranked = first.unionByName(found).withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id", F.desc("own")))).where(F.col("place") <= k + 1)
    answers = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "score", F.col("id").alias("other"), "own"))).alias("all"))
    return _without_own(begun.select("query", "id", "copies"), answers, k)


def _meet(left: pd.DataFrame, right: pd.DataFrame, turns: dict[int, np.ndarray], k: int) -> pd.DataFrame:
    """Queries with a block: their entries at or above their thresholds."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "own": np.zeros(0, bool)})
    dim = int(right["dim"].iloc[0])
    right = right.sort_values("length", ascending=False, kind="stable")
    q, x = decode(left["v"], dim), decode(right["v"], dim)
    best, _ = search(q, _turn(dim, turns, q), left["floor"].to_numpy(), x, _turn(dim, turns, x), [np.asarray(i) for i in right["ids"]], k)
    return _entries(left, best)


def _without_own(queries: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """One entry of the query's own vector and id goes, the k best of the others are ranked; a query row that occurs several times is answered as often."""
    rows = queries.join(answers, "query")
    mine = F.array_min(F.transform(F.filter("all", lambda e: e["own"] & (e["other"] == F.col("id"))), lambda e: e["place"]))
    rows = rows.select("id", "copies", F.slice(F.filter("all", lambda e: F.coalesce(e["place"] != mine, F.lit(True))), 1, k).alias("others"))
    rows = repeated(rows, "copies", "copy")
    rows = rows.select(F.col("id").alias("query_id"), F.posexplode("others").alias("rank", "e"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.when(F.col("e.other") != NO_ID, F.col("e.other")).alias("vec_id"), F.col("e.score").alias("score"))


#: top_k() over embeddings: all products. A vector with a missing or non-finite component takes no part.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""
