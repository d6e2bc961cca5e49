"""Grids of clustering configurations, their evaluation and choice."""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoloom.operators import validity
from chronoloom.operators.clustering import KINDS, Clustering, cluster, preprocess

TYPES = ("partitional", "hierarchical", "fuzzy", "tadpole")


def pdc_configs(kind: str, functions: dict[str, dict], by_type: dict[str, dict] | None = None) -> dict[str, list[dict]]:
    """For preprocessing, distance or centroid functions: every combination of each one's arguments, shared by all types, then those of a type alone."""
    if kind not in ("preproc", "distance", "centroid"):
        raise ValueError("Unknown kind of function.")

    def rows(specs: dict[str, dict]) -> list[dict]:
        out = []
        for name, args in specs.items():
            lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in (args or {}).items()}
            out += [{kind: name} | {f"{k}_{kind}": v for k, v in zip(lists, combo, strict=True)} for combo in itertools.product(*lists.values())]
        return out

    shared = rows(functions)
    return {t: shared + rows((by_type or {}).get(t, {})) for t in TYPES}


def config_grid(types: tuple[str, ...], k: list[int], controls: dict[str, dict], preprocs: dict, distances: dict, centroids: dict) -> dict[str, list[dict]]:
    """For each type the product of its control grid with preprocessing, distance and centroid configurations."""
    out = {}
    for t in types:
        control = {a: v if isinstance(v, (list, tuple)) else [v] for a, v in controls.get(t, {}).items()}
        parts = [[dict(zip(control, c, strict=True)) for c in itertools.product(*control.values())], preprocs.get(t) or [{"preproc": None}], [] if t == "tadpole" else distances.get(t) or [{}], [] if t == "hierarchical" and not centroids.get(t) else centroids.get(t) or [{}]]
        out[t] = [{"k": list(k)} | {a: b for part in combo for a, b in part.items()} for combo in itertools.product(*[p for p in parts if p])]
    return out


def grid_frame(spark: SparkSession, parts: list[DataFrame], shared: list[str] | None = None) -> DataFrame:
    """The same as a relation: cross join of parts, or a full outer join on the columns that no part should expand."""
    out = parts[0]
    for p in parts[1:]:
        keys = [c for c in shared or [] if c in out.columns and c in p.columns]
        out = out.join(p, keys, "outer") if keys else out.crossJoin(p)
    return out


def seed_of(seed: int, config_id: str) -> int:
    return crc32(f"{seed}:{config_id}".encode())


def run_config(series: DataFrame, type: str, config: dict, seed: int, ready: bool = False) -> list[Clustering]:
    """One row of a grid. Columns named <argument>_preproc, _distance or _centroid go to that function, init_ids are the first series (of fewer clusters the first of them), all others but k go to the type's control; ready: series are preprocessed."""
    own: dict = {"preproc": {}, "distance": {}, "centroid": {}, "": {}}
    for a, b in config.items():
        if a in ("k", "preproc", "distance", "centroid", "init_ids"):
            continue
        kind = next((s for s in own if s and a.endswith(f"_{s}")), "")
        own[kind][a.removesuffix(f"_{kind}") if kind else a] = b
    control = KINDS[type](**own[""]) if own[""] else None
    found = cluster(series, type, config["k"], None if ready else config.get("preproc"), config.get("distance"), config.get("centroid"), control, None, seed, config.get("init_ids"), None if ready else own["preproc"], own["distance"], own["centroid"])
    return found if isinstance(found, list) else [found]


def preproc_of(config: dict) -> tuple:
    """What tells the preprocessing of two configurations apart."""
    return config.get("preproc"), tuple(sorted((a.removesuffix("_preproc"), b) for a, b in config.items() if a.endswith("_preproc")))


def compare(series: DataFrame, configs: dict[str, list[dict]], score=None, pick=None, seed: int = 1, shuffle: bool = False, errors: str = "stop", keep: bool = True, parallel: int = 2) -> dict:
    """Every configuration is run (jobs of several at once), scored and listed with ids config<i>_<j>; errors: stop, remove or pass. Preprocessing is done once for each distinct one."""
    if errors not in ("stop", "remove", "pass"):
        raise ValueError("Unknown way with errors.")
    jobs = [(f"config{i}", t, c) for i, (t, c) in enumerate(((t, c) for t in configs for c in configs[t]), 1)]
    if shuffle:
        random.Random(seed).shuffle(jobs)
    ready: dict = {}
    for _, _, c in jobs:
        name, args = key = preproc_of(c)
        if key not in ready:
            ready[key] = preprocess(series, name, **dict(args)).persist()

    def run(job):
        name, t, c = job
        try:
            own = ready[preproc_of(c)]
            found = run_config(own, t, c, seed_of(seed, name), ready=True)
            return [(f"{name}_{j}", t, c, r, score(r, own) if score else {}) for j, r in enumerate(found, 1)]
        except Exception as e:
            if errors == "stop":
                raise
            return [(f"{name}_1", t, c, e, {})] if errors == "pass" else []

    with ThreadPoolExecutor(parallel) as pool:
        rows = [r for rs in pool.map(run, jobs) for r in rs]
    table = [{"config_id": n, "type": t} | {a: b for a, b in c.items() if a not in ("k", "init_ids")} | ({"k": r.config["k"]} if isinstance(r, Clustering) else {"error": str(r)}) | s for n, t, c, r, s in rows]
    out = {"results": table, "scores": {n: s for n, _, _, _, s in rows}}
    if keep:
        out["objects"] = {n: r for n, _, _, r, _ in rows}
    if pick:
        try:
            out["pick"] = pick(out["scores"])
        except ValueError as e:
            out["pick_error"] = str(e)
    return out


def evaluators(which: list[str], truth: DataFrame | None = None):
    """A score function of those indices and a pick by majority of the indices' votes."""

    def score(c: Clustering, series: DataFrame) -> dict:
        return {n: validity.scored(n, v) for n, v in validity.indices(c, series, which, truth).items()}

    def pick(scores: dict[str, dict]) -> str:
        names = sorted({n for s in scores.values() for n in s})
        votes = [max(scores, key=lambda c: scores[c].get(n, float("-inf"))) for n in names]
        if len(votes) > 1 and len(set(votes)) == len(votes):
            raise ValueError("All votes are distinct.")
        return max(dict.fromkeys(votes), key=votes.count)

    return score, pick


def majority(votes: DataFrame) -> DataFrame:
    """The most frequent config of (cvi, config_id, score) rows' best ones: one row (config_id, votes), smallest id on ties."""
    best = votes.groupBy("cvi").agg(F.min(F.struct((-F.col("score")).alias("s"), "config_id")).alias("b")).select("cvi", "b.config_id")
    return best.groupBy("config_id").agg(F.count(F.lit(1)).alias("votes")).agg(F.min(F.struct((-F.col("votes")).alias("v"), "config_id")).alias("b")).select("b.config_id", (-F.col("b.v")).alias("votes"))


def repeat(series: DataFrame, configs: dict[str, list[dict]], config_id: str, seed: int = 1) -> Clustering:
    """Run one configuration again as compare() ran it."""
    name, _, j = config_id.partition("_")
    jobs = [(t, c) for t in configs for c in configs[t]]
    t, c = jobs[int(name.removeprefix("config")) - 1]
    return run_config(series, t, c, seed_of(seed, name))[int(j or 1) - 1]


def consensus(partitions: DataFrame) -> DataFrame:
    """Of partitions (part, series_id, cluster) the one with the least sum of disagreeing pairs with all: one row (part)."""
    a, b = partitions.select(F.col("part").alias("pa"), "series_id", F.col("cluster").alias("ca")), partitions.select(F.col("part").alias("pb"), "series_id", F.col("cluster").alias("cb"))
    cells = a.join(b, "series_id").groupBy("pa", "pb", "ca", "cb").agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy("pa", "pb").agg(F.sum(F.col("n") * F.col("n")).alias("s"))
    sizes = partitions.groupBy("part", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    apart = both.join(sizes.select(F.col("part").alias("pa"), F.col("q").alias("qa")), "pa").join(sizes.select(F.col("part").alias("pb"), F.col("q").alias("qb")), "pb")
    return apart.groupBy("pa").agg(F.sum(F.col("qa") + F.col("qb") - 2 * F.col("s")).alias("d")).agg(F.min(F.struct("d", "pa")).alias("b")).select(F.col("b.pa").alias("part"))
