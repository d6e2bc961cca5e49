"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

A document's key is -ln(u)/w: u from a hash of seed, doc_id and text, w its quality weight; within a source documents are
taken in the order of their keys until the budget is spent. Budgets of one source size or more take complete
epochs first and sample the rest.

Prefix sums run in two levels (buckets of the key within a source, then rows of a bucket), so no task holds a
whole source; there are as many buckets as the rows need for BUCKET_ROWS each, were they of one source. The window over the source table has a row per source, not per document.

Edge cases: a null source is a source of its own, last in order; a null text has size 0; documents of size 0 add
nothing and take 0; a null or non-positive quality weight counts as 1. A null doc_id hashes as 'null', a null text as an empty one. Rows of one
doc_id are rows of their own; equal rows have one key and are ordered by size. Words of the whole text are counted. Further columns are returned as they
came, but for those that the result adds, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WEIGHTS, SHARE, MOST_EPOCHS, BUCKET_ROWS = (5, 2, 1), 1.5, 2, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of MD5."""
    named = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *named)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sized(docs: DataFrame, labels: DataFrame, *more: Column) -> DataFrame:
    """Of docs (doc_id, source, text): doc_id, source, size (words), salt (a hash of the text) and weight, with further columns."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("salt"), *more)
    return rows.join(quality_weights(labels), "doc_id", "left")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> and target. Sources in order of code points, null last, weigh `weights` repeating and share `share` of all sizes;
    a target stops at `most` times its source, and the excess goes to the others by weight until none is above: with sources
    ordered by cap over weight, the capped ones come first, and the first level that caps none of the rest holds."""
    n = len(weights)
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % n + 1)).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    levels = weighed.withColumns({"_level": (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)})
    levels = levels.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    levels = levels.withColumn("_hold", F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(W.partitionBy())["_level"])
    return levels.select("source", "source_size", F.when(F.col("_hold").isNull() | (F.col("_hold") * F.col("_w") > F.col("_cap")), F.col("_cap")).otherwise(F.col("_hold") * F.col("_w")).alias("target"))


def mix_documents(docs: DataFrame, seed: str = "mix-1", weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, buckets: int | None = None) -> DataFrame:
    """Rows of (doc_id, source, size, salt, weight), with whatever other columns, with source_size, target, epochs (complete passes), picked (in the fractional pass) and taken.

    A document is in the fractional pass if the middle of its words lies within the budget, so that a source misses its target by half a document at most.
    """
    buckets = buckets or max(1024, min(1 << 20, docs.count() // BUCKET_ROWS))
    kept = docs.drop("weight", "salt", "source_size", "target", "epochs", "picked", "taken").columns
    d = docs.select(*kept, F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(F.lit(1.0)).alias("_weight"), "salt").withColumn("size", F.col("size").cast("long"))
    d = d.withColumn("_key", -F.log(uniform(seed, F.col("doc_id"), F.col("salt"))) / F.col("_weight"))
    d = d.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("_key"))) * buckets)).cast("int"))
    d = d.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))  # a key that is never null
    sums = d.groupBy("source", "_s", "_bucket").agg(F.sum("size").alias("_n"))
    sizes = sums.groupBy("source", "_s").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    offsets = sums.select("_s", "_bucket", F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets, "_s")
    inner = W.partitionBy("_s", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["_s", "_bucket"])
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    d = d.withColumn("picked", (F.col("size") > 0) & (F.col("_offset") + F.col("_inner") + F.col("size") / 2 <= rest))
    return d.select(*kept, "source_size", "target", "epochs", "picked", (F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))).alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 where a label calls the document good, 0.5 where one calls it bad; one row an id."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


#: mix_documents() with its default parameters over documents, with weights from labels.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS salt, coalesce(q.weight, 1.0) AS weight
  FROM documents LEFT JOIN (SELECT doc_id AS q_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1) q ON q_id = doc_id
), keyed AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || salt), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / CAST(weight AS DOUBLE) AS k FROM d
), sizes AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY 1
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, 2.0 * source_size AS cap FROM sizes
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), held AS (
  SELECT *, (SELECT arg_min(level, cap / w) FROM levels WHERE level * w <= cap) AS hold FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN hold IS NULL OR hold * w > cap THEN cap ELSE hold * w END AS target FROM held
), run AS (
  SELECT keyed.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed JOIN targets ON keyed.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
