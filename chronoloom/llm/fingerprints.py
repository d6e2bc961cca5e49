"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its s-mers stands at its first or last s-mer.
The choice looks at the k-mer alone, so an edit moves or removes only the anchors that touch it.
`closed_syncmers` gives the anchors with their positions; `fingerprint` sketches their set by one-permutation
MinHash (128 bins of 16 bits), `likeness` estimates the Jaccard similarity of two sets from two fingerprints, and
`matches` aligns two texts by the positions of their common anchors.

Edge cases: a null text counts as empty; an empty text has no anchor (all bins zero) and is like another empty
one (1.0) and unlike any other (0.0); a text of fewer than k code points has one anchor, the whole text. Rows of
equal doc_id are taken in the order of a hash of their texts, null ids first; repeated rows follow each other (many equal ones are read once, with their number). Texts are fingerprinted whole, however
long. Only doc_id and text are read, whatever other columns there are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import POLY, exact_ids, materialize, mix, repeated, small_batches, split_repeats, text_totals

K, S, BINS = 11, 4, 128
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000  # of text in a range, and ranges at most, as their bounds are literals of the plan
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long"
COUNTED = f"{SCHEMA}, n long"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _polynomial(codes: np.ndarray, n: int) -> np.ndarray:
    out = codes[: len(codes) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(POLY)
        out += codes[j : len(codes) - n + 1 + j]
    return out


def closed_syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 64-bit hashes of the closed syncmers of a text, in order."""
    codes, w = _codes(text), k - s + 1
    if len(codes) < k:
        return np.zeros(min(len(codes), 1), np.int64), mix(_polynomial(codes, len(codes))) if len(codes) else np.zeros(0, np.uint64)
    raw = _polynomial(codes, s)
    order = mix(raw)
    least, span = order, 1
    while span < w:  # the least of w neighbours, by doubling
        step = min(span, w - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    at = np.flatnonzero((order[: len(least)] == least) | (order[w - 1 :] == least))
    value, last = raw[at], k - s
    for j in [*range(s, last, s), last]:
        value = value * np.uint64(POLY) ** np.uint64(s) + raw[at + j]
    return at, mix(value)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least hash of each bin, 16 bits of it (1 to 65535); 0: no hash fell into the bin."""
    out, bits = np.zeros(bins, np.uint16), bins.bit_length() - 1
    x = np.sort(hashes)
    b = (x >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(x) else np.zeros(0, np.int64)
    out[b[first]] = (mix(x[first]) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def fingerprint(text: str) -> tuple[np.ndarray, int]:
    _, hashes = closed_syncmers(text)
    return sketch(hashes), len(hashes)


def to_hex(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal bins over bins that either fills; 1 for two empty sets."""
    either = int(np.count_nonzero(a | b))
    return float(np.count_nonzero((a == b) & (a > 0)) / either) if either else 1.0


def matches(a: str, b: str, least: int = 2) -> list[tuple[int, int, int]]:
    """Shared passages of two texts as (start in a, start in b, length): runs of at least `least` anchors that stand at one offset of each other and cover their
    passage without a gap, grown to either side while the texts agree; longest first."""
    (p, x), (q, y) = closed_syncmers(a), closed_syncmers(b)
    order = np.argsort(y, kind="stable")
    low, high = (np.searchsorted(y[order], x, side=s) for s in ("left", "right"))
    i = np.repeat(np.arange(len(x)), high - low)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    shift, start = q[j] - p[i], p[i]
    by = np.lexsort((start, shift))
    shift, start = shift[by], start[by]
    if not len(by):
        return []
    new = np.flatnonzero(np.r_[True, (shift[1:] != shift[:-1]) | (start[1:] > start[:-1] + K)])
    found = set()
    for u, v in zip(new, np.r_[new[1:], len(by)], strict=True):
        if v - u < least:
            continue
        s, e, d = int(start[u]), min(int(start[v - 1]) + K, len(a)), int(shift[u])
        while s > 0 and s + d > 0 and a[s - 1] == b[s + d - 1]:
            s -= 1
        while e < len(a) and e + d < len(b) and a[e] == b[e + d]:
            e += 1
        found.add((s, s + d, e - s))
    return sorted(found, key=lambda m: (-m[2], m))


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n] if n else text


def _pairs(batches):
    """Rows arrive by bucket and then by id; the row that closes a bucket is a copy of the next bucket's first. Of a row that stands for several, all but the last are followed by itself."""
    pending = None  # bucket, doc_id, text, bins, anchors, rows

    def pair(row: tuple, text: str, bins: np.ndarray, times: int) -> tuple:
        _, own_id, own, own_bins, anchors, _ = row
        new = edited(own, text)
        new_bins = fingerprint(new)[0] if new != own else own_bins
        return own_id, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(own_bins), to_hex(new_bins), likeness(own_bins, new_bins), likeness(own_bins, bins), anchors, times

    for pdf in batches:
        out = []
        for bucket, copy, doc_id, text, rows in zip(pdf.bucket, pdf.copy_of, pdf.doc_id, pdf.text, pdf.n, strict=True):
            if copy and (pending is None or pending[0] != bucket):
                continue  # a second copy of the same first id
            text = text or ""
            bins, n = fingerprint(text)
            if pending is not None:
                if pending[5] > 1:
                    out.append(pair(pending, pending[2], pending[3], pending[5] - 1))
                out.append(pair(pending, text, bins, 1))
            pending = None if copy else (bucket, doc_id, text, bins, n, rows)
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in COUNTED.split(", ")])
        frame["doc_id"] = exact_ids(frame["doc_id"])
        yield frame


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last quarter replaced by the next document's start) and their likeness.

    One shuffle of the texts, by ranges of (doc_id, hash of the text). Their bounds are percentiles of doc_id; an id, or a missing one, that
    takes several of them has its rows spread over as many ranges by the hash. The first document of each range is sent to the range
    before as well; only bounds and first keys, a few numbers a range, go to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = text_totals(docs)[1]
    once, equal = split_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "n")
    docs = (once if equal is None else once.unionByName(equal)).select("doc_id", "text", "n", F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min)).alias("_key"), F.xxhash64("text").alias("_hash"))
    parts = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = np.sort(np.array(docs.agg(F.percentile_approx("_key", steps, 50 * parts)).first()[0] or [], np.int64))

    def range_of(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(bounds, key, side="left"), np.searchsorted(bounds, key, side="right")
        several = high - low
        part = np.minimum((mark / 2.0**64 + 0.5) * several, several - 1).astype(np.int64)
        return np.where(several > 1, low + 1 + part, high)

    @F.pandas_udf("int")
    def own(key: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series(range_of(key.to_numpy(), mark.to_numpy()).astype(np.int32))

    rows = docs.groupBy(own("_key", "_hash").alias("own")).agg(F.min(F.struct("_key", "_hash")).alias("f")).orderBy("own").collect()
    first = {r["own"]: (r["f"]["_key"], r["f"]["_hash"]) for r in rows}
    before = dict(zip(first, [*list(first)[-1:], *list(first)[:-1]], strict=True))

    @F.pandas_udf("struct<own: int, also: int>")
    def place(key: pd.Series, mark: pd.Series) -> pd.DataFrame:
        at = range_of(key.to_numpy(), mark.to_numpy())
        also = [before[p] if first[p] == (k, m) else -1 for p, k, m in zip(at.tolist(), key, mark, strict=True)]
        return pd.DataFrame({"own": at.astype(np.int32), "also": np.array(also, np.int32)})

    at = docs.withColumn("_at", place("_key", "_hash"))
    rows = at.select("doc_id", "text", "n", "_key", "_hash", F.explode(F.expr("filter(array(struct(_at.own AS bucket, 0 AS copy_of), struct(_at.also AS bucket, 1 AS copy_of)), x -> x.bucket >= 0)")).alias("_to"))
    rows = rows.select(F.col("_to.bucket").alias("bucket"), F.col("_to.copy_of").alias("copy_of"), "_key", "_hash", "doc_id", "text", "n")
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy_of", "_key", "_hash", "text")
    paired = dealt.select("bucket", "copy_of", F.col("doc_id").cast("string").alias("doc_id"), "text", "n").mapInPandas(_pairs, COUNTED)
    return (paired if equal is None else repeated(materialize(paired, "fingerprints"), "n", "place")).select(*(x.split()[0] for x in SCHEMA.split(", ")))
