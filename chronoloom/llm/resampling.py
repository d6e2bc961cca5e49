"""Importance resampling towards a target distribution of hashed n-grams, by external sort-count.

1. Each task turns its documents into blocks: one stream of packed uint16 bucket numbers with the documents' offsets, written to the shared
   folder (two bytes a feature, a row a block of up to BLOCK_FEATURES).
2. Counts: a task sorts the stream of one block after the other, encodes each as runs (bucket, length) and merges runs as soon as MERGE_RUNS have come
   up; Spark adds up what the tasks send, a row for each bucket and task.
3. The gains of the buckets, a table whose size is the number of buckets, go with the job to the blocks' second reading: every stream gathers its gains, and
   np.add.reduceat sums them from offset to offset.
4. Scores are integers: log-likelihood weight plus Gumbel noise hashed from doc_id. Rows with equal ids, weights and scores become one with a count. How many rows lie above a
   score comes from counts by score, so the rank of a drawn document needs the order within its own score alone: no task orders the table. The
   noise of different ids spreads: a score holds 1/2700 of documents of one weight.

A bucket number must fit 16 bits. Repeated documents are features as often as they occur, and draw as often.

Edge cases: a null text has no words. A document without features weighs 0. Rows of one doc_id are documents of their own, with one noise; a null doc_id
hashes as the empty text and comes last among ties. Texts are taken whole: a longer text than a batch is a block of its own. Only
doc_id and text are read, whatever other columns there are. Empty tables give an empty result, an empty target counts 0 everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import LOWER, NOT_ALNUM, materialize, repeated, small_batches

GRAMS, BUCKETS, LEAST_WORDS, PERCENT = 1, 10_000, 20, 10
BATCH_BYTES = 4 << 20
BLOCK_FEATURES, MERGE_RUNS = 1 << 20, 1 << 18
TO_WORDS = bytes(np.where(NOT_ALNUM, 0x20, LOWER).astype(np.uint8))
BLOCK = "ids array<string>, words binary, sizes binary, stream binary"


def features(text: str | None, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to `grams` of them."""
    words = (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()
    runs = (words if n == 1 else map(b" ".join, zip(*(words[i:] for i in range(n)))) for n in range(1, grams + 1))
    drawn = [np.fromiter(map(crc32, r), np.uint32) % np.uint32(buckets) for r in runs]
    return len(words), (drawn[0] if grams == 1 else np.concatenate(drawn)).astype("<u2")


def bucket_streams(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """BLOCK rows of docs (doc_id, text): ids as text, the documents' numbers of words and of features, and their features one after the other."""
    small_batches(docs.sparkSession, BATCH_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, streams, held = [], [], [], 0

        def block() -> pd.DataFrame:
            sizes = np.fromiter(map(len, streams), "<i8", len(streams))
            return pd.DataFrame({"ids": [list(ids)], "words": [np.array(words, "<i8").tobytes()], "sizes": [sizes.tobytes()], "stream": [np.concatenate(streams).tobytes()]})

        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                n, drawn = features(text, grams, buckets)
                if ids and held + len(drawn) > BLOCK_FEATURES:
                    yield block()
                    ids, words, streams, held = [], [], [], 0
                ids.append(i)
                words.append(n)
                streams.append(drawn)
                held += len(drawn)
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, BLOCK)


def encode_runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted stream as runs: buckets and lengths."""
    ordered = np.sort(stream)
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[begin].astype(np.int64), np.diff(np.r_[begin, len(ordered)])


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several streams as those of one."""
    keys, lengths = np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs])
    order = np.argsort(keys, kind="stable")
    keys, lengths = keys[order], lengths[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(lengths, begin) if len(begin) else lengths


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n) of all streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: list = []
        for pdf in batches:
            for data in pdf["stream"]:
                runs.append(encode_runs(np.frombuffer(data, "<u2")))
                if sum(len(k) for k, _ in runs) > MERGE_RUNS:
                    runs = [merge_runs(runs)]
        if runs:
            keys, lengths = merge_runs(runs)
            yield pd.DataFrame({"bucket": keys, "n": lengths})

    return streams.select("stream").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():  # as many rows as buckets
        out[bucket] = n
    return out


def gains_of(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each bucket the floor of a thousand times the logarithm of its smoothed share of the target over that of the source."""
    n = len(target)
    s, t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(a) + 1) * s / ((float(b) + 1) * t))) for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weigh(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, words, n_features and weight (floored mean of the gains of its features) of every document of the streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, words, sizes, data in zip(pdf["ids"], pdf["words"], pdf["sizes"], pdf["stream"], strict=True):
                sizes = np.frombuffer(sizes, "<i8")
                some = sizes > 0
                total = np.zeros(len(sizes), np.int64)
                if some.any():
                    total[some] = np.add.reduceat(gains[np.frombuffer(data, "<u2")], (np.cumsum(sizes) - sizes)[some])
                yield pd.DataFrame({"doc_id": list(ids), "words": np.frombuffer(words, "<i8"), "n_features": sizes, "weight": total // np.maximum(sizes, 1)})

    rows = streams.mapInPandas(run, "doc_id string, words long, n_features long, weight long")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = "2024") -> DataFrame:
    """weighed with score and rank: of the documents with least_words or more `percent` of a hundred with the highest scores are drawn, in order of (score down, doc_id up)."""
    rows = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fits", F.col("words") >= least_words)
    rows = materialize(rows.groupBy("doc_id", "n_features", "weight", "score", "fits").agg(F.count(F.lit(1)).alias("copies")), "resampled")
    by_score = W.orderBy(F.desc("score"))  # a row for each score, a whole number between -4,000 and 23,000 above a weight
    levels = rows.where("fits").groupBy("score").agg(F.sum("copies").alias("n")).withColumn("above", F.sum("n").over(by_score) - F.col("n"))
    levels = levels.withColumn("drawn", F.floor(F.sum("n").over(W.partitionBy()) * percent / 100)).where("above < drawn").select("score", "above", "drawn")
    own = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    high = rows.where("fits").join(levels, "score").withColumn("before", F.col("above") + F.sum("copies").over(own) - F.col("copies"))
    rest = rows.join(levels.select("score", F.lit(True).alias("fits")), ["score", "fits"], "left_anti")
    both = high.unionByName(rest, allowMissingColumns=True)
    place = F.col("before") + F.col("place") + 1
    return repeated(both, "copies", "place").select("doc_id", "n_features", "weight", "score", F.when(place <= F.col("drawn"), place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every document of docs (doc_id, text); target has text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("A bucket's number has 16 bits.")
    streams = materialize(bucket_streams(docs, grams, buckets), "bucket-streams")
    wanted = bucket_streams(target.select(F.lit(None).alias("doc_id"), "text"), grams, buckets)
    gains = gains_of(_dense(bucket_counts(wanted), buckets), _dense(bucket_counts(streams), buckets))
    return draw(weigh(streams, gains), percent, least_words, seed)


#: resample() over documents and benchmark. CRC-32 byte by byte of the distinct words' UTF-8.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
dt AS (SELECT r, term, count(*) AS n FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2), bt AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM b) GROUP BY 1),
terms AS (SELECT term, hex(encode(term)) AS x FROM (SELECT term FROM dt UNION SELECT term FROM bt)),
crc AS (SELECT term, CAST(xor(4294967295::UBIGINT, list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT),
  lambda a, c: list_reduce(range(0, 8)::UBIGINT[], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, xor(a, c)), 4294967295::UBIGINT)) % 10000 AS BIGINT) AS k FROM terms),
s AS (SELECT k, sum(n)::DOUBLE AS n FROM dt JOIN crc USING (term) GROUP BY 1), t AS (SELECT k, sum(n)::DOUBLE AS n FROM bt JOIN crc USING (term) GROUP BY 1),
total AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s, coalesce((SELECT sum(n) FROM t), 0) AS t),
gain AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (total.s + 10000) / ((s.n + 1) * (total.t + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), total),
w AS (SELECT r, sum(dt.n * g) AS g FROM dt JOIN crc USING (term) JOIN gain USING (k) GROUP BY 1),
h AS (SELECT r, doc_id, len(w) AS n, (('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5) / 4294967296 AS h FROM d),
c AS (SELECT r, doc_id, CAST(h.n AS BIGINT) AS n_features, CASE WHEN h.n > 0 THEN CAST((g - ((g % h.n) + h.n) % h.n) // h.n AS BIGINT) ELSE 0 END AS weight, CAST(floor(-1000 * ln(-ln(h))) AS BIGINT) AS noise FROM h LEFT JOIN w USING (r)),
o AS (SELECT *, weight + noise AS score FROM c),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM o LEFT JOIN p USING (r)
"""
