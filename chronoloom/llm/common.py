"""Helpers shared by the operators: tables, the shared folder, token buffers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
POLY = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
POLY_INV = pow(POLY, -1, 1 << 64)


#: Rows of an Arrow batch where whole texts go to Python: a batch of 10,000 would hold tens of megabytes on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, and its bytes to most_bytes if given (the settings are read when a plan runs)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if most_bytes and not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most_bytes:
        spark.conf.set(name, f"{most_bytes}b")


def release_memory() -> None:
    """Give what a process has freed back to the system, which its other half needs; where the C library can't, it stays with Python."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset on a machine of its own (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("A cluster needs spark.checkpoint.dir, a folder that the driver and all executors share.")
        folder = f"file://{tempfile.mkdtemp(prefix='chronoloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back: it cuts the lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names as close to those given as df's columns allow."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Copies of a row that one task makes of it at once.
COPIES = 1000


def repeated(df: DataFrame, count: str, place: str) -> DataFrame:
    """Every row as often as the column count says; the column place numbers the copies from 0. More than COPIES of a row are dealt to the tasks first, so none makes them all."""
    few, many = df.where(F.col(count) <= COPIES), df.where(F.col(count) > COPIES)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(COPIES).cast("long")))
    begun = few.withColumn(place, F.lit(0).cast("long")).unionByName(many.withColumn(place, starts).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    last = F.least(F.col(count), F.col(place) + COPIES) - 1
    return begun.withColumn(place, F.explode(F.sequence(F.col(place), last)))


#: Equal rows are many if their texts and ROW_BYTES for each come to so many bytes; so many kinds of them at most have their hashes broadcast (8 bytes each).
MANY_BYTES, ROW_BYTES, MOST_KINDS = 1 << 20, 1 << 10, 1_000_000


def split_repeats(docs: DataFrame, count: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of docs (with a column text) that aren't one of many equal ones, and those that are, each once, or None if there are none; the column count says how many a row stands for.

    Which rows these are is told by sums for each hash, without moving a text. Their texts are then added up where they are read, so a row that makes up much of
    a table moves once from each task; the other rows don't move."""
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    hashed = docs.withColumn("_row", F.xxhash64(*docs.columns))
    sums = hashed.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    many = materialize(sums.where((F.col("n") > 1) & (F.col("w") >= MANY_BYTES)).select("_row"), "many-equal")
    kinds = many.count()
    if not kinds:
        return docs.withColumn(count, F.lit(1).cast("long")), None
    many = F.broadcast(many) if kinds <= MOST_KINDS else many
    once = hashed.join(many, "_row", "left_anti").select(*docs.columns, F.lit(1).cast("long").alias(count))
    # Grouped by the row itself: two rows of one hash stay apart.
    added = hashed.join(many, "_row", "left_semi").groupBy(*docs.columns).agg(F.count(F.lit(1)).alias(count))
    return once, materialize(added, "equal-rows")


def exact_ids(texts) -> pd.api.extensions.ExtensionArray:
    """Ids that came as text: with nulls among them pandas would have held numbers as doubles."""
    return pd.array([None if x is None or x != x else int(x) for x in texts], "Int64")


def text_totals(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """POLY**i and its inverse for i below the largest length asked for, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, POLY, np.uint64), np.full(size, POLY_INV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()

#: Bytes that separate words: all but [^\x20\x09-\x0D], and all but [0-9A-Za-z] and non-ASCII.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of some texts, A-Z in lower case: hash, document (position in the list) and byte range of each, in order.

    The buffer is the texts' UTF-8 with a separator before, between and after. A word's hash is a polynomial
    over its bytes, from prefix sums, then mixed; two different words share one with a probability near 2**-64.
    """

    def __init__(self, texts: list[str], separators: np.ndarray = SPACES):
        parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.buffer = LOWER[np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)]
        self.ends_of = 1 + np.cumsum(sizes + 1)  # where the next document begins
        gap = separators[self.buffer]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _POWERS.get(len(self.buffer) + 1)
        total = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum((self.buffer.astype(np.uint64) + np.uint64(1)) * up[: len(self.buffer)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.doc = np.searchsorted(self.ends_of, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(parts))


def chunks(texts: list[str], most: int = 1 << 20):
    """Ranges of texts of about `most` characters in all; a longer text is a range of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n + 1
    if at < len(texts):
        yield at, len(texts)
