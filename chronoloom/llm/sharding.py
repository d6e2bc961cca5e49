"""Sharding by balanced label propagation.

Documents of equal texts are linked, as a star around their group. Equal texts have equal sizes, so the members
of a group in one shard are interchangeable: the state is the table of cells (group, shard, count), which has at
most `shards` rows for a group however hot it is.

Every round joins each cell with its group's homes, its most frequent shard or, if it is larger than a shard's share, as
many as it needs; members elsewhere want to move there. The
demand between shards (shards x shards numbers) goes to the driver, which grants quotas that keep the linked documents of
every shard within its share (single documents give way later); cells move their granted part. A last step moves single documents first, then
whole or split cells, until the counts of all shards are at most one apart (law `rows`). Documents are then dealt to the
cells of their group by rank, with ranks in two levels so that no task holds a group or a shard.

The graph's edges are the pairs of equal texts: each row tells how many of its own end in its shard before and after. Texts are hashed whole; only
doc_id and text are read, whatever other columns there are. Ties between a group's fullest shards are broken by a hash.

shard_graph() does the same on a given table of links, where a document follows its neighbours' weight.

Edge cases: null texts form a group of their own (8 bytes, CRC 0), empty texts another; repeated rows are rows of
their own; null ids come first in a shard's slots; fewer rows than shards leave some shards empty; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

SHARDS, ROUNDS = 24, 3
MOST_HOT = 10_000  # hubs that are joined by broadcast at most: each has more than 1/MOST_HOT of all links


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def granted(demand: np.ndarray, counts: np.ndarray, cap: float) -> np.ndarray:
    """The part of each wish (from, to) that may move so that no shard ends above cap, unless it began there and nobody leaves."""
    part = np.ones_like(demand, dtype=float)
    for _ in range(50):
        moves = demand * part
        room = cap - (counts - moves.sum(1))
        scale = np.clip(np.where(moves.sum(0) > 0, room / np.maximum(moves.sum(0), 1), 1), 0, 1)
        if (scale > 0.999).all():
            break
        part *= scale
    return part


def transport(counts: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(from, first, end, to): of the surplus of `from`, its units first..end-1 go to `to`."""
    spare, out, giver, used = (counts - wanted).astype(np.int64), [], 0, 0
    for to in np.flatnonzero(spare < 0):
        need = -int(spare[to])
        while need:
            while spare[giver] - used <= 0:
                giver, used = giver + 1, 0
            n = min(need, int(spare[giver]) - used)
            out.append((giver, used, used + n, int(to)))
            used, need = used + n, need - n
    return out


def level(cells: DataFrame, counts: np.ndarray, n: int, shards: int, buckets: int, seed: int) -> DataFrame:
    """Cells (_g, _s, group_size, _n, _rank 0 or 1) after the moves that bring the counts of all shards at most one apart: those of rank 0 move first, then whole or split cells of rank 1."""
    wanted = np.full(shards, n // shards)
    wanted[np.argsort(-counts, kind="stable")[: n % shards]] += 1
    moves = transport(counts, wanted)
    if not moves:
        return cells.drop("_rank")
    # Cells of a shard in a fixed order; the first `surplus` units leave.
    cells = cells.withColumn("_b", (F.col("_rank") * buckets + F.pmod(F.xxhash64("_g", F.lit(seed)), F.lit(buckets))).cast("int"))
    sums = cells.groupBy("_s", "_b").agg(F.sum("_n").alias("_k"))
    offsets = sums.select("_s", "_b", F.coalesce(F.sum("_k").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = W.partitionBy("_s", "_b").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_i", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(offsets, ["_s", "_b"]).withColumn("_first", F.col("_o") + F.col("_i"))
    plans: dict[int, list] = {}
    for s, a, b, t in moves:
        plans.setdefault(s, []).append((a, b, t))
    rows = [(s, [*p, (p[-1][1], 1 << 62, s)]) for s, p in plans.items()]
    plan = cells.sparkSession.createDataFrame(rows, "_s int, _plan array<struct<a: long, b: long, t: int>>")  # shards rows, 2 x shards intervals in all
    cells = cells.join(F.broadcast(plan), "_s", "left")
    pieces = F.when(F.col("_plan").isNull(), F.array(F.struct(F.col("_s").alias("t"), F.col("_n").alias("n")))).otherwise(
        F.filter(F.transform("_plan", lambda p: F.struct(p["t"].alias("t"), (F.least(p["b"], F.col("_first") + F.col("_n")) - F.greatest(p["a"], F.col("_first"))).alias("n"))), lambda x: x["n"] > 0)
    )
    cells = cells.select("_g", "group_size", F.explode(pieces).alias("_p")).select("_g", "group_size", F.col("_p.t").alias("_s"), F.col("_p.n").alias("_n"))
    return cells.groupBy("_g", "_s", "group_size").agg(F.sum("_n").alias("_n"))


def _joined(links: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """links (a, b, w) with the shard of b as _t. Rows of b in hot (at most MOST_HOT ids) meet their labels by broadcast, so no task reads a hub's links."""
    known = F.broadcast(hot.join(labels, "b"))
    cold = links.join(F.broadcast(hot), "b", "left_anti").join(labels, "b")
    return cold.select("a", "w", "_t").unionByName(links.join(known, "b").select("a", "w", "_t"))


def shard_graph(docs: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Balanced label propagation on given links: docs (doc_id), edges (a, b, weight) between ids. Gives (doc_id, shard, copies) and the weight of edges cut (before: by hash; after).

    In each round a document wants to go to the shard that most of its neighbours' weight is in (its own on ties); the demand between shards meets quotas so that none
    grows above its share, and a part of those who want to go, by hash, goes. At last the counts of all shards are brought at most one apart, documents without links first. Rows
    of one doc_id are one vertex of so many copies, which that last step alone may split; a null id has no links. Links to ids that aren't there, to itself and
    without positive weight count nothing; equal links add up. Only doc_id, a, b and weight are read.
    """
    vertices = materialize(docs.groupBy(F.col("doc_id").cast("long").alias("a")).agg(F.count(F.lit(1)).alias("_n")), "shard-vertices")
    n = vertices.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    there = vertices.select("a").where("a IS NOT NULL")
    one = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double").alias("w")).where("a != b AND w > 0")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    links = materialize(both.join(there.hint("merge"), "a", "left_semi").join(there.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi"), "shard-links")
    degrees = materialize(links.groupBy("b").agg(F.count(F.lit(1)).alias("k")), "shard-degrees")
    total = degrees.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    hot = materialize(degrees.where(F.col("k") > max(1000, total // MOST_HOT)).select("b"), "shard-hubs")
    labels = materialize(vertices.select("a", "_n", F.pmod(F.xxhash64("a", F.lit(seed)), F.lit(shards)).cast("int").alias("_s")), "shard-labels")

    def counts() -> np.ndarray:
        out = np.zeros(shards, np.int64)
        for s, k in labels.groupBy("_s").agg(F.sum("_n")).collect():  # a row for each shard
            out[s] = k
        return out

    def cut(final: DataFrame, name: str) -> DataFrame:
        met = _joined(links.withColumnRenamed("a", "c").select(F.col("c").alias("a"), "b", "w"), final.select(F.col("a").alias("b"), F.col("_s").alias("_t")), hot)
        sums = met.groupBy("a", "_t").agg(F.sum("w").alias("w"))
        return sums.join(final.select("a", "_s"), "a").agg((F.coalesce(F.sum(F.when(F.col("_s") != F.col("_t"), F.col("w"))), F.lit(0.0)) / 2).alias(name))

    before = cut(labels, "before")
    for r in range(rounds):
        near = _joined(links, labels.select(F.col("a").alias("b"), F.col("_s").alias("_t")), hot).groupBy("a", "_t").agg(F.sum("w").alias("w"))
        best = near.join(labels, "a").groupBy("a", "_s", "_n").agg(F.max(F.struct("w", (F.col("_t") == F.col("_s")).alias("own"), F.xxhash64("a", "_t").alias("h"), "_t")).alias("m"))
        wishes = materialize(best.select("a", "_s", "_n", F.col("m._t").alias("_to")).where("_s != _to"), f"shard-wishes{r}")
        demand = np.zeros((shards, shards))
        for s, t, k in wishes.groupBy("_s", "_to").agg(F.sum("_n")).collect():  # shards x shards rows at most
            demand[s, t] = k
        if not demand.any():
            break
        # Two neighbours that change places gain nothing: half of those who may go wait for the next round.
        part = granted(demand, counts(), n / shards) * (0.5 if r < rounds - 1 else 1)
        quota = F.element_at(F.array(*[F.lit(float(x)) for x in part.ravel()]), F.col("_s") * shards + F.col("_to") + 1)
        going = wishes.where(_uniform("a", F.lit(f"{seed}-{r}")) < quota).select("a", F.col("_to").alias("_go"))
        labels = materialize(labels.join(going, "a", "left").select("a", "_n", F.coalesce("_go", "_s").alias("_s")), f"shard-labels{r}")
    linked = labels.join(links.select("a").distinct(), "a", "left_semi").select("a", F.lit(1).alias("_rank"))
    cells = labels.join(linked, "a", "left").select(F.col("a").alias("_g"), "_s", F.col("_n").alias("group_size"), "_n", F.coalesce("_rank", F.lit(0)).alias("_rank"))
    placed = level(cells, counts(), n, shards, max(64, min(65536, n // 20000)), seed)
    placed = materialize(placed.select(F.col("_g").alias("a"), "_s", "_n"), "shard-graph")
    first = placed.groupBy("a").agg(F.min("_s").alias("_s"))  # copies of one id in several shards count where the first is
    return placed.select(F.col("a").alias("doc_id"), F.col("_s").alias("shard"), F.col("_n").alias("copies")), before.crossJoin(cut(first, "after"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """doc_id and text of docs -> doc_id, size, text_crc32, shard, slot, group_size, mates_before and mates_after (the other documents of the group that share
    the document's shard by hash, and its shard in the end: group_size - 1 - mates are its cut edges)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = materialize(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), text), 256)).alias("_g")), "shard-base")
    n = base.count()
    buckets = max(64, min(65536, n // 20000))
    start = F.pmod(F.xxhash64("doc_id", "_g", F.lit(seed)), F.lit(shards)).cast("int")
    cells = base.groupBy("_g", start.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cells.groupBy("_g").agg(F.sum("_n").alias("group_size"))
    cells = materialize(cells.join(sizes, "_g"), "shard-cells")
    started = cells
    single, linked = cells.where("group_size = 1"), cells.where("group_size > 1")

    def counts_of(df: DataFrame) -> np.ndarray:
        out = np.zeros(shards, np.int64)
        for s, k in df.groupBy("_s").agg(F.sum("_n")).collect():  # a row for each shard
            out[s] = k
        return out

    alone = counts_of(single)
    for r in range(rounds):
        # A group's homes: its fullest shards, as many as it needs; members elsewhere want to move to one of them.
        full = F.sort_array(F.collect_list(F.struct("_n", F.xxhash64("_g", "_s").alias("_h"), "_s")), False)["_s"]
        need = F.greatest(F.lit(1), F.ceil(F.first("group_size") * shards / F.lit(n))).cast("int")
        homes = linked.groupBy("_g").agg(F.slice(full, F.lit(1), need).alias("_homes"))
        other = F.element_at("_homes", (F.pmod(F.xxhash64("_g", "_s", F.lit(seed + r)), F.size("_homes")) + 1).cast("int"))
        wishes = linked.join(homes, "_g").withColumn("_to", F.when(F.array_contains("_homes", F.col("_s")), F.col("_s")).otherwise(other)).drop("_homes")
        demand = np.zeros((shards, shards))
        for s, t, k in wishes.where("_s != _to").groupBy("_s", "_to").agg(F.sum("_n")).collect():  # shards x shards rows at most
            demand[s, t] = k
        if not demand.any():
            break
        part = granted(demand, counts_of(linked), n / shards)
        quota = F.element_at(F.array(*[F.lit(float(x)) for x in part.ravel()]), F.col("_s") * shards + F.col("_to") + 1)
        moved = F.when(F.col("_s") == F.col("_to"), F.lit(0)).otherwise(F.least(F.col("_n"), F.floor(F.col("_n") * quota + _uniform("_g", "_s", F.lit(seed + r))))).cast("long")
        wishes = wishes.withColumn("_moved", moved)
        pieces = F.array(F.struct(F.col("_s"), (F.col("_n") - F.col("_moved")).alias("_n")), F.struct(F.col("_to").alias("_s"), F.col("_moved").alias("_n")))
        linked = wishes.select("_g", "group_size", F.explode(pieces).alias("_p")).select("_g", "group_size", "_p._s", "_p._n").where("_n > 0")
        linked = materialize(linked.groupBy("_g", "_s", "group_size").agg(F.sum("_n").alias("_n")), f"shard-round{r}")

    cells = single.select("_g", "_s", "group_size", "_n").unionByName(linked.select("_g", "_s", "group_size", "_n"))
    counts = alone + counts_of(linked)
    cells = level(cells.withColumn("_rank", (F.col("group_size") > 1).cast("int")), counts, n, shards, buckets, seed)

    # Each group's cells in one short array; documents go to them by rank in their group.
    homes = cells.groupBy("_g", "group_size").agg(F.array_sort(F.collect_list(F.struct("_s", "_n"))).alias("_cells"))
    keyed = base.withColumns({"_b": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).cast("int"), "_start": start})
    ranks = keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_k"))
    starts = started.groupBy("_g").agg(F.collect_list(F.struct("_s", "_n")).alias("_starts"))
    homes = homes.join(starts, "_g")
    ranks = ranks.select("_g", "_b", F.coalesce(F.sum("_k").over(W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o")).join(homes, "_g")
    placed = keyed.withColumn("_r", F.row_number().over(W.partitionBy("_g", "_b").orderBy("doc_id"))).join(ranks, ["_g", "_b"]).withColumn("_r", F.col("_o") + F.col("_r") - 1)
    ends = F.aggregate("_cells", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, c: F.when((a["s"] < 0) & (F.col("_r") < a["sum"] + c["_n"]), F.struct(a["sum"].alias("sum"), c["_s"].alias("s"), c["_n"].alias("n"))).otherwise(F.struct((a["sum"] + c["_n"]).alias("sum"), a["s"].alias("s"), a["n"].alias("n"))))
    before = F.filter("_starts", lambda c: c["_s"] == F.col("_start"))[0]["_n"] - 1
    placed = placed.select("doc_id", "size", "text_crc32", "group_size", ends.alias("_e"), before.alias("mates_before"))
    placed = placed.select("doc_id", "size", "text_crc32", "group_size", F.col("_e.s").alias("shard"), "mates_before", (F.col("_e.n") - 1).alias("mates_after"))
    placed = materialize(placed, "shard-placed")
    return with_slots(placed, "shard", buckets)


def with_slots(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    """A gapless slot from 0 within each shard: offsets of hash buckets (shards x buckets rows), then ranks within a bucket."""
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    offsets = sums.select(by, "_b", F.coalesce(F.sum("_k").over(W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    ranked = keyed.withColumn("_r", F.row_number().over(W.partitionBy(by, "_b").orderBy("doc_id", "text_crc32")))
    return ranked.join(offsets, [by, "_b"]).withColumn("slot", (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_o", "_r")
