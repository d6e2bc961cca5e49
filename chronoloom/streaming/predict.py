"""Assignment of streamed series to given centroids, and series from a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions import series as S


def nearest_centroid(values: Column, centroids: list[tuple[int, list[float]]], power: int = 2) -> Column:
    """A struct (d, cluster): centroids are literals of the projection, so it needs no state and is the same for batch and stream."""
    options = [F.struct(S.minkowski(values, F.array(*[F.lit(float(x)) for x in v]), power).alias("d"), F.lit(c).alias("cluster")) for c, v in centroids]
    return F.array_min(F.array(*options))


def predict(series: DataFrame, centroids: list[tuple[int, list[float]]], power: int = 2) -> DataFrame:
    return series.withColumn("_n", nearest_centroid(F.col("values"), centroids, power)).select("series_id", F.col("_n.cluster").alias("cluster"), F.col("_n.d").alias("d"))


def daily_sums(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, day, value) sums of a stream of events with (ts, user_id, value); days close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(F.sum("value").alias("value")).select("user_id", F.col("day.start").alias("day"), "value")
