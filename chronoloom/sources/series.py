"""Series collections: DataFrames of (series_id, values), values an array of doubles (or, multivariate, an array of arrays, time first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T


class SeriesError(ValueError):
    pass


def as_series(spark: SparkSession, data) -> DataFrame:
    """A collection from a DataFrame, a pandas or numpy table (row = series), a list of series or a single series."""
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_numpy"):
        data = data.to_numpy()
    if hasattr(data, "tolist"):
        data = data.tolist()
    if not isinstance(data, (list, tuple)) or not data:
        raise SeriesError("Series come as a frame, a table or a list of numbers or of lists.")
    rows = [data] if isinstance(data[0], (int, float)) and not isinstance(data[0], bool) else list(data)
    rows = [r.tolist() if hasattr(r, "tolist") else list(r) for r in rows]
    nested = rows[0] and isinstance(rows[0][0], (list, tuple))
    flat = [x for r in rows for p in r for x in (p if nested else [p])]
    if any(not r for r in rows) or any(isinstance(x, (bool, str)) or x is None or x != x for x in flat):
        raise SeriesError("A series needs numbers: it may not be empty, nor hold text or gaps.")
    kind = "array<array<double>>" if nested else "array<double>"
    return spark.createDataFrame([(i + 1, [[float(x) for x in p] for p in r] if nested else [float(x) for x in r]) for i, r in enumerate(rows)], f"series_id long, values {kind}")


def is_multivariate(series: DataFrame) -> bool:
    return isinstance(series.schema["values"].dataType.elementType, T.ArrayType)


def profile(series: DataFrame) -> dict:
    """Number of series and of their values, least and greatest length and number of variables, missing values: one aggregate."""
    inner = F.size(F.col("values")[0]) if is_multivariate(series) else F.lit(1)
    flat = F.flatten("values") if is_multivariate(series) else F.col("values")
    missing = F.col("values").isNull() | (F.size("values") == 0) | F.exists(flat, lambda x: x.isNull() | F.isnan(x))
    return series.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("values")).alias("shortest"), F.max(F.size("values")).alias("longest"), F.min(inner).alias("least_vars"), F.max(inner).alias("most_vars"), F.count_if(missing).alias("missing"), F.coalesce(F.sum(F.size("values") * inner), F.lit(0)).alias("values")).first().asDict()


def check_series(series: DataFrame, ragged: bool = True) -> dict:
    return check_profile(profile(series), ragged)


def check_profile(p: dict, ragged: bool = True) -> dict:
    if p.get("missing"):
        raise SeriesError("A series needs numbers: it may not be empty, nor hold text or gaps.")
    if p["least_vars"] != p["most_vars"]:
        raise SeriesError("The series differ in how many variables they have.")
    if not ragged and p["shortest"] != p["longest"]:
        raise SeriesError("Series of one length are needed here.")
    return p


def check_window(window: int | None, required: bool = False) -> int | None:
    if window is None:
        if required:
            raise SeriesError("A lower bound needs a window.")
        return None
    if window < 0:
        raise SeriesError("A window has 0 or more points to either side.")
    return int(window)


def to_long(series: DataFrame) -> DataFrame:
    """(series_id, t, [var,] value), t and var from 0."""
    if is_multivariate(series):
        return series.select("series_id", F.posexplode("values").alias("t", "row")).select("series_id", "t", F.posexplode("row").alias("var", "value"))
    return series.select("series_id", F.posexplode("values").alias("t", "value"))


def from_long(rows: DataFrame, key: str = "series_id") -> DataFrame:
    """The series of (key, t, value) rows, in order of t."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"].cast("double")).alias("values"))


def variables(series: DataFrame) -> DataFrame:
    """A univariate series for each variable: (series_id, var, values)."""
    count = F.size(F.col("values")[0])
    return series.select("series_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("var"), "values").withColumn("values", F.transform("values", lambda r: F.get(r, F.col("var"))))


def characteristics(series: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n_series, multivariate, same_length, centered, scaled."""
    from chronoloom.functions.series import mean, sample_sd

    v = F.flatten("values") if is_multivariate(series) else F.col("values")
    return series.agg(
        F.count(F.lit(1)).alias("n_series"), F.lit(is_multivariate(series)).alias("multivariate"), (F.min(F.size("values")) == F.max(F.size("values"))).alias("same_length"),
        F.bool_and(F.abs(mean(v)) < tolerance).alias("centered"), F.bool_and(F.abs(sample_sd(v) - 1) < tolerance).alias("scaled"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of the files of a path, numbered from 1 in order of file names. A file is read in as many splits as Spark makes of it: lines are counted by split, and a line's
    number is its place within its split (rows of a split are numbered in a row by the task) after the lines of the splits before."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each split
    before = W.orderBy("file", "at").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("file", "at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["file", "at"]).select((F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), F.col("value").alias("text"))


def read_csv_directory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one ragged series a line, one path a variable; lines with equal numbers are the variables of one multivariate series."""
    parts = []
    for i, p in enumerate(paths):
        lines = numbered_lines(spark, p)
        parts.append(lines.select(F.col("line").alias("series_id"), F.transform(F.split("text", ","), lambda x: F.trim(x).cast("double")).alias(f"v{i}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "series_id")
    if len(parts) == 1:
        return out.withColumnRenamed("v0", "values")
    return out.select("series_id", F.transform(F.arrays_zip(*[f"v{i}" for i in range(len(parts))]), lambda z: F.array(*[z[f"v{i}"] for i in range(len(parts))])).alias("values"))


def write_csv(series: DataFrame, path: str, digits: int = 5) -> None:
    """A line a series, in order of series_id, values with so many significant digits."""
    line = F.array_join(F.transform("values", lambda x: F.format_string(f"%.{digits}g", x)), ",")
    series.orderBy("series_id").select(line.alias("value")).write.mode("overwrite").text(path)


# Series of the driver's tables.
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("series_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("values"))


def _filled(sums: DataFrame, keys: DataFrame, steps: DataFrame) -> DataFrame:
    """Arrays over all steps (one row: first, n), 0 where a key has none: a map side array from the key's own steps."""
    lists = sums.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("m"))
    return lists.crossJoin(F.broadcast(steps)).select("series_id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.element_at("m", k + F.col("first")), F.lit(0.0))).alias("values"))


def _day(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01")))


def daily(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    """Per user the sum of value by day (or by so many days) over the days of the table, 0 where there are none."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("series_id"), F.floor(_day(F.col("ts")) / days).cast("int").alias("t"), "value")
    sums = ev.groupBy("series_id", "t").agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("double").alias("value"))
    return _filled(sums, None, sums.agg(F.min("t").alias("first"), (F.max("t") - F.min("t") + 1).alias("n")))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the values in order of (ts, event_id)."""
    ev = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return ev.groupBy(F.col("user_id").cast("long").alias("series_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"].cast("double")).alias("values"))


def daily_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multivariate: per user and day the number of events of each type, types in order."""
    ev = table(spark, sf_dir, "events")
    types = [r[0] for r in ev.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of types
    d = ev.select(F.col("user_id").cast("long").alias("series_id"), _day(F.col("ts")).alias("t"), "event_type")
    sums = d.groupBy("series_id", "t").agg(F.array(*[F.count_if(F.col("event_type") == x).cast("double") for x in types]).alias("value"))
    steps = sums.agg(F.min("t").alias("first"), (F.max("t") - F.min("t") + 1).alias("n"))
    lists = sums.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("m"))
    zero = F.array(*[F.lit(0.0) for _ in types])
    return lists.crossJoin(F.broadcast(steps)).select("series_id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.element_at("m", k + F.col("first")), zero)).alias("values"))


def nation_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation the sum of order prices by month over the months of the table, 0 where there are none."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    sums = o.groupBy(F.col("c_nationkey").cast("long").alias("series_id"), month.alias("t")).agg(F.sum("o_totalprice").cast("double").alias("value"))
    return _filled(sums, None, sums.agg(F.min("t").alias("first"), (F.max("t") - F.min("t") + 1).alias("n")))


def segment_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation and market segment the sum of order prices by month over the months of the table, 0 where there are none; series_id is nation x segments + place of the segment by name."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    names = customers.select("c_mktsegment").distinct()  # a handful of segments
    places = names.withColumn("place", F.row_number().over(W.orderBy("c_mktsegment")) - 1).withColumn("of", F.count(F.lit(1)).over(W.partitionBy()))
    own = customers.join(F.broadcast(places), "c_mktsegment")
    o = table(spark, sf_dir, "orders").join(own, F.col("o_custkey") == F.col("c_custkey"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    sums = o.groupBy((F.col("c_nationkey") * F.col("of") + F.col("place")).cast("long").alias("series_id"), month.alias("t")).agg(F.sum("o_totalprice").cast("double").alias("value"))
    return _filled(sums, None, sums.agg(F.min("t").alias("first"), (F.max("t") - F.min("t") + 1).alias("n")))
