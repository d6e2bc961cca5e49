"""Clusters of the windows of a stream: state keeps the open windows of every user, and a window is compared with the centroids when it closes.

The points of a window are a series in order of time, of any number of points, under any registered distance (DTW, shape-based, ..) with a kernel. A window closes
when the watermark passes its end; events that come later than that are left out, as in Spark's own windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.functions import kernels as K
from chronoloom.operators.distances import given, lookup
from chronoloom.sources.series import SeriesError

CLOSED = "user_id long, start timestamp, points int, cluster int, d double"
OPEN = "starts array<long>, times array<long>, counts array<double>"


def nearest(series: list[np.ndarray], names: list[int], points: list[np.ndarray], method: str, args: dict) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and distance of the nearest centroid of each series, the first on ties."""
    dist = lookup(method)
    kernel, prepare = dist.kernel, dist.prepare
    d = K.of_blocks(lambda u, v, **known: kernel(u, v, **args, **known), series, points, np.ones((len(series), len(points)), bool), prepare and (lambda v, other: prepare(v, other, **args)))
    return np.array(names)[d.argmin(1)], d.min(1)


def predict_windows(events: DataFrame, centroids: list[tuple[int, list[float]]], method: str = "dtw_basic", seconds: int = 86_400, late: str = "1 hour", **args) -> DataFrame:
    """CLOSED rows of a stream of events (user_id, ts, value): the nearest centroid of each user's points in each window of so many seconds, once it has closed."""
    if not lookup(method).ragged:
        raise SeriesError(f"Windows hold any number of points, and {method} takes series of one length.")
    args, length = given(args), seconds * 1000
    names, points = [c for c, _ in centroids], [np.asarray(v, float) for _, v in centroids]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, times, values = (list(x) for x in state.get) if state.exists else ([], [], [])
        now = state.getCurrentWatermarkMs()
        for pdf in batches:
            for at, value in zip(pdf["at"], pdf["value"], strict=True):
                start = at - at % length
                if start + length > now:
                    starts.append(int(start))
                    times.append(int(at))
                    values.append(float(value))
        done = sorted({s for s in starts if s + length <= now})
        if done:
            own = [[v for _, v in sorted((t, v) for s, t, v in zip(starts, times, values, strict=True) if s == one)] for one in done]
            cluster, d = nearest([np.array(x) for x in own], names, points, method, args)
            yield pd.DataFrame({"user_id": key[0], "start": pd.to_datetime(done, unit="ms"), "points": [len(x) for x in own], "cluster": cluster, "d": d})
        rest = [i for i, s in enumerate(starts) if s + length > now]
        if rest:
            state.update(([starts[i] for i in rest], [times[i] for i in rest], [values[i] for i in rest]))
            state.setTimeoutTimestamp(min(starts[i] for i in rest) + length)
        elif state.exists:
            state.remove()

    rows = events.where("value IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_millis("ts").alias("at"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("user_id").applyInPandasWithState(step, CLOSED, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
