"""A training-data pipeline over `documents`: five stages, each of which calls one operator on all that the one before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of docs, whatever they are. Null and empty texts can't be
toxic or contaminated: they pass those filters. Rows without doc_id, or of one doc_id with other texts, are documents of their own; of
repeated rows one stays. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from chronoloom.llm import decontamination, mixing, neardup, sharding, toxicity
from chronoloom.llm.common import materialize, small_batches, table, unused
from chronoloom.llm.queries import toxicity_held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores 0.5 or more go; a text without words has no window and stays."""
    small_batches(spark)
    network = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity_held_out())
    wordless = F.coalesce(~F.rlike("text", F.lit(mixing.WORD)), F.lit(True))
    return docs.where(wordless | (toxicity.score_column(network, F.col("text")) < 0.5))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, that of the smallest id."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    index = decontamination.Index(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontamination.phrase_matches(docs.select("doc_id", "text"), index).where(F.size("hits") > 0)
    (key,) = unused(docs, "_key")
    return decontamination.keyed(docs, key).join(hit.select(F.col("_key").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words pass once. The mix sees ids and sizes; the texts meet their numbers of copies in one join."""
    key, made, rank = unused(docs, "_key", "_made", "_rank")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat(decontamination.row_key(), F.encode(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")), "utf-8")))))
    sized = mixing.sized(keyed, table(spark, sf_dir, "labels"), F.col(key).alias("_row"))
    mixed = mixing.mix_documents(sized)
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("picked").cast("long")).otherwise(1)
    # Repeated rows have one key: what they are taken in all is dealt out among them.
    taken = mixed.select("_row", copies.alias("n")).groupBy(F.col("_row").alias(key)).agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).alias(made))
    both = keyed.join(taken, key).withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(key)))
    own = F.floor(F.col(f"{made}.n") / F.col(f"{made}.rows")) + (F.col(rank) <= F.col(f"{made}.n") % F.col(f"{made}.rows")).cast("long")
    return both.withColumn(made, F.explode(F.array_repeat(F.lit(1), own.cast("int")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained network decides the first stage; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
