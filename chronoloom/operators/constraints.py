"""Semi-supervised choice of a window from must-link and cannot-link constraints, and the bookkeeping of asked pairs."""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoloom.operators.clustering import cluster
from chronoloom.operators.compare import consensus
from chronoloom.operators.distances import kept
from chronoloom.operators.graphs import components

DONT_KNOW, CANNOT, MUST = -1, 0, 1


class PairTracker:
    """Graphs of answers over 1..n. link() tells whether the graph of that answer is now complete (must-link: connected)."""

    def __init__(self, n: int, seed: int = 1):
        self.n, self.rng = n, random.Random(seed)
        self.edges: dict[int, set] = {DONT_KNOW: set(), CANNOT: set(), MUST: set()}
        self.seen: set[tuple[int, int]] = set()
        self.root = list(range(n + 1))
        self.own = {k: [k] for k in range(1, n + 1)}

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int, answer: int) -> bool:
        if answer not in self.edges or not (1 <= i <= self.n and 1 <= j <= self.n) or i == j:
            raise ValueError("Invalid pair or link type.")
        pair = (min(i, j), max(i, j))
        self.edges[answer].add(pair)
        self.seen.add(pair)
        if answer == MUST:
            a, b = sorted((self._find(i), self._find(j)), key=lambda r: len(self.own[r]))
            if a != b:
                self.seen |= {(min(x, y), max(x, y)) for x in self.own[a] for y in self.own[b]}
                self.root[a] = b
                self.own[b] += self.own.pop(a)
            return len(self.own[b]) == self.n
        return len(self.edges[answer]) == self.n * (self.n - 1) // 2

    def unseen_pair(self) -> tuple[int, int] | None:
        if len(self.seen) >= self.n * (self.n - 1) // 2:
            return None
        while True:
            pair = tuple(sorted(self.rng.sample(range(1, self.n + 1), 2)))
            if pair not in self.seen:
                return pair


@dataclass(frozen=True)
class Closure:
    """What links imply: members (series_id, component) of must-links, cannot (a, b, a < b) between components, contradictions (i, j): cannot-links within a component."""

    members: DataFrame
    cannot: DataFrame
    contradictions: DataFrame


def closure(links: DataFrame) -> Closure:
    """Links (i, j, type) as components: must-links are transitive, and a cannot-link holds between all of two components. No pair is written that wasn't given."""
    given = links.where(f"type != {DONT_KNOW}").select("i", "j", "type")
    own = kept(components(given.where(F.col("type") == MUST)))
    members = given.select(F.explode(F.array("i", "j")).alias("series_id")).distinct().join(own.withColumnRenamed("id", "series_id"), "series_id", "left").select("series_id", F.coalesce("component", "series_id").alias("component"))
    members = kept(members)
    apart = given.where(F.col("type") == CANNOT)
    for end, name in (("i", "a"), ("j", "b")):
        apart = apart.join(members.select(F.col("series_id").alias(end), F.col("component").alias(name)), end)
    apart = kept(apart)
    cannot = apart.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return Closure(members, cannot, apart.where("a = b").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct())


def implied(pairs: DataFrame, links: Closure) -> DataFrame:
    """pairs (i, j) with type: must or cannot where the closure says so, else don't know; contradicted: the component of either end holds a cannot-link."""
    own = links.members
    bad = links.contradictions.join(own.select(F.col("series_id").alias("i"), "component"), "i").select("component").distinct().withColumn("bad", F.lit(True))
    marked = own.join(bad, "component", "left").select("series_id", "component", F.coalesce("bad", F.lit(False)).alias("bad"))
    out = pairs.select("i", "j")
    for end, name in (("i", "a"), ("j", "b")):
        out = out.join(marked.select(F.col("series_id").alias(end), F.col("component").alias(name), F.col("bad").alias(f"bad_{name}")), end, "left")
    out = out.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    out = out.join(links.cannot.select(F.col("a").alias("low"), F.col("b").alias("high"), F.lit(True).alias("apart")), ["low", "high"], "left")
    kind = F.when(F.col("a") == F.col("b"), MUST).when(F.col("apart"), CANNOT).otherwise(DONT_KNOW)
    return out.select("i", "j", kind.alias("type"), (F.coalesce("bad_a", F.lit(False)) | F.coalesce("bad_b", F.lit(False))).alias("contradicted"))


def satisfied(labels: DataFrame, constraints: DataFrame) -> DataFrame:
    """(i, j, type, window, ok): whether a partition (window, series_id, cluster) keeps each constraint (i, j, type)."""
    a = labels.select("window", F.col("series_id").alias("i"), F.col("cluster").alias("ci"))
    b = labels.select("window", F.col("series_id").alias("j"), F.col("cluster").alias("cj"))
    return constraints.where(f"type != {DONT_KNOW}").join(a, "i").join(b, ["window", "j"]).select("i", "j", "type", "window", ((F.col("ci") == F.col("cj")) == (F.col("type") == MUST)).alias("ok"))


def complexity(flags: DataFrame) -> DataFrame:
    """(i, j, type, complexity, first_ok): changes of the flag over windows in order, by the number of windows less one and by the longest run of satisfied windows; infinite without one, 0 for a single window."""
    key = ["i", "j", "type"]
    w = W.partitionBy(*key).orderBy("window")
    steps = flags.withColumn("change", F.coalesce((F.col("ok") != F.lag("ok").over(w)).cast("int"), F.lit(0))).withColumn("island", F.sum("change").over(w))
    runs = steps.groupBy(*key, "island").agg(F.sum("change").alias("c"), F.count_if("ok").alias("run"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("ok"), F.col("window"))).alias("first"))
    out = runs.groupBy(*key).agg(F.sum("c").alias("c"), F.max("run").alias("run"), F.sum("n").alias("n"), F.min("first").alias("first_ok"))
    return out.select(*key, F.when(F.col("n") <= 1, F.lit(0.0)).when(F.col("run") == 0, F.lit(float("inf"))).otherwise(F.col("c") / (F.col("n") - 1) / F.col("run")).alias("complexity"), "first_ok")


def choose_window(complexities: DataFrame, threshold: float = float("inf")) -> DataFrame:
    """One row (window, votes): the vote of constraints with 0 < complexity < threshold for their first satisfied window; if all are trivial, the least window of any."""
    some = complexities.where((F.col("complexity") > 0) & (F.col("complexity") < threshold) & F.col("first_ok").isNotNull())
    votes = some.groupBy(F.col("first_ok").alias("window")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.agg(F.min(F.struct((-F.col("votes")).alias("v"), "window")).alias("b"))
    least = complexities.agg(F.min("first_ok").alias("least"))
    return best.crossJoin(least).select(F.coalesce("b.window", "least").alias("window"), F.coalesce(-F.col("b.v"), F.lit(0)).alias("votes"))


def window_partitions(series: DataFrame, windows: list[int], type: str = "partitional", k: int = 2, args: dict | None = None, control=None, **more) -> DataFrame:
    """(window, series_id, cluster): one clustering for each window; of several (repetitions, linkages) the consensus partition."""
    parts = []
    for w in windows:
        # Density peaks take the window from their control, the others from the distance's arguments.
        own = replace(control, window=w) if type == "tadpole" else control
        found = cluster(series, type, k, args={**(args or {}), "window": w}, control=own, **more)
        found = found if isinstance(found, list) else [found]
        labels = found[0].class_ids()
        if len(found) > 1:
            named = [c.class_ids().withColumn("part", F.lit(i)) for i, c in enumerate(found)]
            every = named[0]
            for n in named[1:]:
                every = every.unionByName(n)
            labels = every.join(F.broadcast(consensus(every)), "part").drop("part")  # consensus() has one row
        parts.append(labels.withColumn("window", F.lit(w)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("window", "series_id", "cluster")


def search_window(series: DataFrame, windows: list[int], links: DataFrame, threshold: float = float("inf"), **clustering) -> DataFrame:
    """One row (window, votes): the window whose clusterings agree best with links (i, j, type)."""
    return choose_window(complexity(satisfied(window_partitions(series, windows, **clustering), links)), threshold)
