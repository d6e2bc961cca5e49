"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

A text's shingles are its runs of SHINGLE words (alphanumeric, A-Z in lower case); a shorter text has one, the whole. A
shingle weighs its count times the mean inverse document frequency of its words, as an integer. The frequency is of
words, not of whole shingles: a shingle of a much copied text occurs in every copy, so a frequency of shingles would take the weight
from just the part that copies share and put it on their edits, and large groups of near copies would come apart.

1. Exact copies (equal texts, by half of their SHA-256) are one node from the start; the row of their smallest doc_id stands for them.
2. Blocks of documents get the document frequencies of their words from the whole corpus (exchange.py), draw
   BANDS x ROWS samples for each document and write bands and packed weight vectors to the shared folder.
3. A text's standing is the number of texts in its buckets, over all bands: the source of a family of near copies
   shares more bands with its copies than they do with each other and stands highest. In each bucket the HUBS highest are compared with
   all members: every pair of a bucket of up to HUBS + 1, and a number of pairs in proportion to the members of a
   larger one. The highest are found in two levels, within parts of a bucket and then among those of its parts, so that no task
   holds a bucket, and meet its members in parts of PART_ROWS. A pair counts if
   the weighted Jaccard similarity of the two whole vectors is at least THRESHOLD; pairs whose total weights rule that out aren't compared.
4. Classes are connected components by minimum labels with pointer jumping.
5. In a bucket of more than HUBS + 1, members outside its largest class are compared, in blocks of bounded size, with all
   members of other classes; the links found join classes. So every pair that shares a bucket is compared or already in one
   class. The work is the product of the members outside and all members of a bucket; no pair is written unless it is a link.

A pair at the threshold shares some band with a probability of 1 - (1 - 0.8**ROWS)**BANDS = 0.9998.

Edge cases: a text without words (also an empty one) has no shingle and is in a class with equal texts only; null texts are equal if
their ids are. Rows of one doc_id with different texts are texts of their own, rows without doc_id too: a class_id is the smallest id of
the class's rows and null if none has one. Repeated rows are in one class. Texts are taken whole, however long. Ties of standing
go to the greater id, then text hash. Only doc_id and text are read, whatever other columns there are. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import GOLDEN, NOT_ALNUM, Words, chunks, materialize, mix, release_memory, small_batches, text_totals, unused
from .exchange import MOST_TASKS, answer_of, blocked, count_exchange, pack, send, unpack

SHINGLE, THRESHOLD, BANDS, ROWS, HUBS = 5, 0.8, 12, 3, 12
REST_ROWS, REST_WEIGHT = 512, 2e8  # the most texts of a block of step 5, and their total weight (a shingle weighs 55 at least)
HUB_PARTS, PART_ROWS, MOST_HOT = 16, 512, 10_000  # parts of a bucket in which its highest members are found first; members of a part that meets them; buckets that are dealt to parts at most
NO_ID = -(1 << 63)  # stands for a missing doc_id in keys of joins
CHUNK = 1 << 18  # characters of a block that are split into words and sampled at a time
BATCH_BYTES = 8 << 20  # of an Arrow batch: a thousand pairs of long texts hold hundreds of megabytes
IDF_STEPS = 16  # inverse document frequencies are rounded to sixteenths


class _Tables:
    """Gamma(2, 1) and uniform variates by table: a sample's r, ln c and beta come from 12, 20 and 12 bits of a hash."""

    def __init__(self):
        x = np.linspace(1e-4, 30, 1 << 18)
        mass = 1 - (1 + x) * np.exp(-x)
        quantile = lambda bits: np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), mass, x)
        self.r = quantile(12).astype(np.float32)
        self.over_r = (1 / self.r).astype(np.float32)
        self.ln_c = np.log(quantile(20)).astype(np.float32)
        self.beta = ((np.arange(1 << 12) + 0.5) / (1 << 12)).astype(np.float32)


_TABLES: list[_Tables] = []


def _tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


def samples(keys: np.ndarray, ln_weight: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """ICWS: n samples (as hashes) for each document, whose elements begin at `first`. Documents with equal weights of an element agree on it;
    the probability of an equal sample is the weighted Jaccard similarity."""
    t = _tables()
    out = np.empty((len(first), n), np.uint64)
    number = np.arange(len(keys), dtype=np.uint64)
    low = np.uint64((1 << 32) - 1)
    for i in range(n):
        h = mix(keys + np.uint64((i + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        a = (h & np.uint64(0xFFF)).astype(np.int64)
        b = (h >> np.uint64(12) & np.uint64(0xFFF)).astype(np.int64)
        c = (h >> np.uint64(24) & np.uint64(0xFFFFF)).astype(np.int64)
        beta = t.beta[b]
        step = np.floor(ln_weight * t.over_r[a] + beta)
        ln_a = t.ln_c[c] - t.r[a] * (step - beta + np.float32(1))
        bits = ln_a.view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        least = np.minimum.reduceat(order << np.uint64(32) | number, first) & low
        at = least.astype(np.int64)
        out[:, i] = mix(keys[at] ^ mix(step[at].astype(np.int64).astype(np.uint64) + np.uint64(i)))
    return out


def _shingles(words: np.ndarray, n: np.ndarray, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of n words each (hashes, in order): distinct shingles of each text in order of (text, key): text, key, integer weight (count x summed idf of words), and where a text begins."""
    weight = idf[np.searchsorted(known, words)] if len(known) else np.zeros(0, np.int64)
    begin = np.cumsum(n) - n
    sizes = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    span = np.minimum(n[doc], SHINGLE)
    key, total = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.int64)
    for j in range(SHINGLE):
        inside = j < span
        i = np.minimum(at + j, max(len(words) - 1, 0))
        key = np.where(inside, mix(key * GOLDEN + words[i]), key)
        total += np.where(inside, weight[i], 0)
    order = np.lexsort((key, doc))
    doc, key, total = doc[order], key[order], total[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])] if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    doc, key = doc[at], key[at]
    mass = np.add.reduceat(total, at) if len(at) else total
    return doc, key, mass, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)


def band_keys(drawn: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(drawn), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(drawn), b, np.uint64)
        for r in range(rows):
            key = mix(key * GOLDEN + drawn[:, b * rows + r])
        out[:, b] = key
    return out


def pack_vector(keys: np.ndarray, weights: np.ndarray) -> bytes:
    """A sorted vector; keys by their upper 40 bits, which tell a pair's shingles apart."""
    a, b = pack(np.diff(keys >> np.uint64(24), prepend=np.uint64(0))), pack(weights)
    return len(a).to_bytes(4, "little") + a + b


def unpack_vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    return np.cumsum(unpack(data[4 : 4 + n]), dtype=np.uint64), unpack(data[4 + n :]).astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater."""
    both = int(a[1].sum() + b[1].sum())
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    less = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return less / (both - less) if both > less else 1.0


SKETCH = "key long, node binary, total long, bands array<long>, vector binary"


def _lean(f: Callable) -> Callable:
    """f of a cogroup, after which the worker keeps no memory that it doesn't use: it lives on, idle too, beside others that need it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = f(left, right)
        release_memory()
        return out

    return run


def _word_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order, each with its number of texts."""
    keys = []
    for a, b in chunks(texts, CHUNK):
        w = Words(texts[a:b], NOT_ALNUM)
        known, at = np.unique(w.hash, return_inverse=True)
        pair = np.unique(at * len(w.count) + w.doc)  # a word once a text; of numbers, as hashes of the two may meet
        keys.append(known[pair // len(w.count)])
    return np.unique(np.concatenate(keys), return_counts=True)


def _sender(blocks: int):
    def sender(pdf: pd.DataFrame) -> list[tuple]:
        known, counts = _word_texts(pdf["text"].tolist())
        release_memory()
        return send(int(pdf["block"].iloc[0]), known, counts, blocks, 0)

    return sender


def _sketcher(n_docs: int):
    def sketch(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts, parts = pdf["text"].tolist(), []
        for a, b in chunks(texts, CHUNK):
            w = Words(texts[a:b], NOT_ALNUM)
            parts.append((a, w.hash, w.count))
        known = np.unique(np.concatenate([h for _, h, _ in parts])) if parts else np.zeros(0, np.uint64)
        idf = np.rint(IDF_STEPS * np.log1p(n_docs / np.maximum(answer_of(answers, 0).astype(np.float64), 1))).astype(np.int64)
        ids, nodes, totals, bands, vectors = [], [], [], [], []
        for a, h, count in parts:
            doc, key, mass, first = _shingles(h, count, known, idf)
            if not len(doc):
                continue
            keys = band_keys(samples(key, np.log(mass).astype(np.float32), first, BANDS * ROWS))
            ends = np.r_[first[1:], len(doc)]
            for i, (x, y) in enumerate(zip(first, ends, strict=True)):
                ids.append(pdf["key"].iloc[a + doc[x]])
                nodes.append(pdf["node"].iloc[a + doc[x]])
                totals.append(int(mass[x:y].sum()))
                bands.append(keys[i].view(np.int64))
                vectors.append(pack_vector(key[x:y], mass[x:y].astype(np.uint64)))
        return pd.DataFrame({"key": np.array(ids, np.int64), "node": nodes, "total": np.array(totals, np.int64), "bands": bands, "vector": vectors})

    return _lean(sketch)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    last, vector, out = None, None, []
    for x, y in zip(a, b, strict=True):
        if x != last:
            last, vector = x, unpack_vector(x)
        out.append(weighted_jaccard(vector, unpack_vector(y)))
    return pd.Series(out, dtype="float64")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> id, class_id: the smallest id that is reached. Labels go to neighbours, then to the label's own label, until nothing changes."""
    both = materialize(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("class_id")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), F.col("class_id").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(near, "id").select("id", F.least("class_id", "c").alias("l"), F.col("class_id").alias("old"))
        jump = low.join(labels.select(F.col("id").alias("l"), F.col("class_id").alias("j")), "l").select("id", F.least("l", "j").alias("class_id"), "old")
        new = materialize(jump, "labels")
        if not new.where("class_id != old").limit(1).count():
            return new.select("id", "class_id")
        labels = new.select("id", "class_id")


def shared_buckets(sketches: DataFrame) -> DataFrame:
    """band, part, parts, node, key, total and members n of each bucket of two or more: sketches has a row (node, key, total, bands) for each node.

    Sizes are counted first, from sums of the tasks. Members meet them by (band, part): a bucket of more than PART_ROWS and more than 1/MOST_HOT of all
    members is dealt to parts of PART_ROWS, so neither here nor later does a task read a large bucket whole. There can't be more than MOST_HOT such buckets: their list is broadcast."""
    buckets = sketches.select("node", "key", "total", F.explode("bands").alias("band"))
    sizes = materialize(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
    members = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col("n") > max(PART_ROWS, members // MOST_HOT)).select("band", F.ceil(F.col("n") / PART_ROWS).alias("parts")))
    dealt = lambda df: df.join(hot, "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = dealt(buckets).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    each = dealt(sizes).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return materialize(own.join(each, ["band", "part"]), "near-shared")


def near_links(shared: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, hubs: int = HUBS) -> DataFrame:
    """Verified links (a, b, similarity) between nodes: shared from shared_buckets, vectors has the vector of each (node, key)."""
    standing = shared.groupBy("node").agg(F.sum("n").alias("standing"))
    members = materialize(shared.join(standing, "node").select("band", "n", F.struct("standing", "key", "node").alias("m"), "total"), "near-members")
    top = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("m")))).where(F.col("rank") <= hubs).drop("rank")
    heads = top(top(members.withColumn("part", F.pmod(F.xxhash64("m.node"), F.lit(HUB_PARTS))), "band", "part"), "band")
    parts = F.ceil(F.col("n") / PART_ROWS)
    heads = materialize(heads.select("band", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("m").alias("h"), F.col("total").alias("t")), "near-heads")
    members = members.select("band", F.pmod(F.xxhash64("m.node"), parts).alias("part"), "m", "total")
    alike = F.least("t", "total") >= threshold * F.greatest("t", "total")
    pairs = materialize(members.join(heads, ["band", "part"]).where((F.col("m") < F.col("h")) & alike).select("h", "m").distinct(), "near-pairs")
    pairs = pairs.select(F.col("h.node").alias("a"), F.col("h.key").alias("ia"), F.col("m.node").alias("b"), F.col("m.key").alias("ib"))
    first, second = (vectors.select(F.col("node").alias(x), F.col("key").alias(f"i{x}"), F.col("vector").alias(f"v{x}")) for x in "ab")
    checked = pairs.join(second, ["b", "ib"]).join(first, ["a", "ia"]).select("a", "b", similarity("va", "vb").alias("similarity"))
    return checked.where(F.col("similarity") >= threshold).dropDuplicates(["a", "b"])


def common_weight(left: list[tuple], right: list[tuple], same: np.ndarray, tile: int = 2048) -> np.ndarray:
    """Sum of the lesser weights for each of left with each of right (vectors), exact: min(x, y) is a sum over the levels of a key's
    weights that both reach, so it is a matrix product over (key, level). Keys that occur in one text alone are left out."""
    out = np.zeros((len(left), len(right)))
    rows = np.concatenate([np.repeat(np.arange(len(v), dtype=np.int32), [len(x[0]) for x in v]) for v in (left, right)])
    side = np.repeat(np.array([0, 1], np.int8), [sum(len(x[0]) for x in v) for v in (left, right)])
    key, weight = np.concatenate([x[0] for x in left + right]), np.concatenate([x[1] for x in left + right])
    order = np.lexsort((weight, key))
    rows, side, key, weight = rows[order], side[order], key[order], weight[order]
    column = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    n = [np.bincount(column[side == i], minlength=column[-1] + 1) for i in (0, 1)]
    least = [np.zeros(column[-1] + 1, np.int64) for _ in n]
    for i in (0, 1):
        least[i][column[side == i]] = rows[side == i]
    alone = (n[0] == 0) | (n[1] == 0) | ((n[0] == 1) & (n[1] == 1) & same[least[0], least[1]])
    use = ~alone[column]
    rows, side, key, weight = rows[use], side[use], key[use], weight[use]
    if not len(key):
        return out
    new = np.r_[True, (key[1:] != key[:-1]) | (weight[1:] != weight[:-1])]  # a level of a key
    level = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    begin = np.r_[True, key[at][1:] != key[at][:-1]]
    gain = np.where(begin, weight[at], np.diff(weight[at], prepend=0)).astype(np.float64)
    lowest = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))[level]  # an entry reaches levels lowest..level
    reach = level - lowest + 1
    entry = np.repeat(np.arange(len(level)), reach)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(reach) - reach, reach) + lowest[entry]
    order = np.argsort(level, kind="stable")
    level, rows, side = level[order], rows[entry][order], side[entry][order]
    for a in range(0, len(at), tile):
        x, y = np.searchsorted(level, (a, a + tile))
        dense = [np.zeros((len(v), min(tile, len(at) - a))) for v in (left, right)]
        for i in (0, 1):
            own = side[x:y] == i
            dense[i][rows[x:y][own], level[x:y][own] - a] = 1
        out += (dense[0] * gain[a : a + tile]) @ dense[1].T
    return out


def _rest_comparer(threshold: float):
    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": np.zeros(0)})
        code = pd.factorize(pd.concat([left["class_node"], right["class_node"]]))[0]
        node = pd.factorize(pd.concat([left["node"], right["node"]]))[0]
        n = len(left)
        less = common_weight([unpack_vector(x) for x in left["vector"]], [unpack_vector(x) for x in right["vector"]], node[:n, None] == node[None, n:])
        union = left["total"].to_numpy(float)[:, None] + right["total"].to_numpy(float)[None, :] - less
        found = less / union
        i, j = np.nonzero((found >= threshold) & (code[:n, None] != code[None, n:]))
        ends = [(min(x, y), max(x, y)) for x, y in zip(left["node"].to_numpy()[i], right["node"].to_numpy()[j], strict=True)]
        return pd.DataFrame({"a": [x for x, _ in ends], "b": [y for _, y in ends], "similarity": found[i, j]})

    return _lean(compare)


def rest_links(shared: DataFrame, vectors: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, hubs: int = HUBS, rows: int = REST_ROWS, weight: float = REST_WEIGHT) -> DataFrame | None:
    """Links (a, b, similarity, class_a, class_b) across classes (id, class_id of linked nodes) in the buckets that near_links doesn't compare whole; None if there are none to compare."""
    over = shared.where(F.col("n") > hubs + 1).join(classes.withColumnRenamed("id", "node"), "node", "left").withColumn("class_node", F.coalesce("class_id", "node"))
    over = materialize(over.select("band", "part", "parts", "node", "key", "total", "n", "class_node"), "near-over")
    by_class = over.groupBy("band", "class_node").agg(F.count(F.lit(1)).alias("k"), F.max("total").alias("t"), F.max("parts").alias("parts"))
    largest = by_class.groupBy("band").agg(F.max(F.struct("k", "class_node")).alias("most"), F.sum("k").alias("all"), F.max("t").alias("t"), F.max("parts").alias("parts")).where("most.k < all")
    of = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(weight) / F.greatest("t", F.lit(1))))).cast("int")
    parts = lambda size: F.ceil(F.col(size) / F.col("of")).cast("int")
    largest = largest.withColumn("of", of).withColumn("outside", F.col("all") - F.col("most.k"))
    plan = largest.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("most.class_node").alias("inner"), parts("outside").alias("n_left"), parts("all").alias("n_right"))
    members = over.join(plan, ["band", "part"]).withColumn("outer", F.col("class_node") != F.col("inner"))
    members = materialize(members.drop("inner", "n", "part", "parts"), "near-rest")
    if not members.limit(1).count():
        return None
    full = members.hint("merge").join(vectors, ["node", "key"])
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [F.col(c).alias(c) for c in ("band", "x", "y", "node", "class_node", "total", "vector")]  # of their own on either side
    left = full.where("outer").withColumn("x", part("n_left")).withColumn("y", every("n_right")).select(columns)
    right = full.withColumn("y", part("n_right")).withColumn("x", every("n_left")).select(columns)
    found = left.groupBy("band", "x", "y").cogroup(right.groupBy("band", "x", "y")).applyInPandas(_rest_comparer(threshold), "a binary, b binary, similarity double")
    names = over.select("node", "class_node").distinct()
    found = found.dropDuplicates(["a", "b"])
    for x in "ab":
        found = found.join(names.select(F.col("node").alias(x), F.col("class_node").alias(f"class_{x}")), x)
    return materialize(found, "near-rest-links")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _node() -> Column:
    """Half of the SHA-256 of a row's text; of a missing text that of its id."""
    own_text = F.coalesce("text", F.concat(F.lit("\0"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))))
    return F.unhex(F.substring(F.sha2(own_text, 256), 1, 32))


def _dealt(df: DataFrame, tasks: int, *by: str) -> DataFrame:
    """df by keys for the join that follows, in so many partitions or the session's number: whole texts or vectors would fill a fixed number more and more."""
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, hubs: int = HUBS) -> tuple[DataFrame, DataFrame, int]:
    """Of docs (doc_id, text): the rows as (doc_id, key, node); for each node its smallest key and doc_id, class_node (one node of the class) and class_id (its smallest doc_id); the number of tasks for whole texts."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    docs = docs.select(F.col("doc_id").cast("long"), _key().alias("key"), "text", _node().alias("node"))
    n_docs, size = text_totals(docs)
    rows, blocks = blocked(docs.where("text IS NOT NULL"), size)
    answers = count_exchange(rows, blocks, _sender(blocks))
    sketches = materialize(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_sketcher(n_docs), SKETCH), "near-sketches")
    own = materialize(docs.select("doc_id", "key", "node"), "near-nodes")
    firsts = own.groupBy("node").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"))
    one = sketches.select("node", "key", "total", "bands").join(firsts, ["node", "key"]).dropDuplicates(["node"])
    shared = shared_buckets(one)
    # Vectors of texts in shared buckets alone go into the joins below; a merge join, as the list of texts grows with the corpus.
    wanted = shared.select("node", "key").distinct().hint("merge")
    tasks = min(blocks, MOST_TASKS)
    vectors = _dealt(sketches.select("node", "key", "vector"), tasks, "node", "key").join(wanted, ["node", "key"], "left_semi").dropDuplicates(["node", "key"])
    vectors = materialize(vectors, "near-vectors")
    links = materialize(near_links(shared, vectors, threshold, hubs), "near-links")
    classes = components(links.select("a", "b"))
    rest = rest_links(shared, vectors, classes, threshold, hubs)
    if rest is not None and rest.limit(1).count():
        joined = components(rest.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).select(F.col("id").alias("class_id"), F.col("class_id").alias("joined"))
        ids = classes.select("id", "class_id").union(rest.select(F.explode(F.array("class_a", "class_b")).alias("id")).select("id", "id")).dropDuplicates(["id"])
        classes = ids.join(joined, "class_id", "left").select("id", F.coalesce("joined", "class_id").alias("class_id"))
    nodes = firsts.join(classes.withColumnRenamed("id", "node"), "node", "left").select("node", "key", "doc_id", F.coalesce("class_id", "node").alias("class_node"))
    least = nodes.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
    return own, nodes.join(least, "class_node"), tasks


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, hubs: int = HUBS) -> DataFrame:
    """doc_id and text of docs -> doc_id, class_id (smallest doc_id of the class) for each row."""
    own, nodes, _ = text_classes(docs, threshold, hubs)
    return own.join(nodes.select("node", "class_id"), "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, hubs: int = HUBS) -> DataFrame:
    """Of each class of docs the row of the smallest doc_id, of several texts with that id the first by hash, of repeated rows one; a class without ids keeps one row too. Columns as in docs."""
    _, nodes, tasks = text_classes(docs, threshold, hubs)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")
    first = nodes.groupBy("class_node").agg(F.min(order).alias("f")).select(F.col("f.node").alias("node"), F.coalesce("f.doc_id", F.lit(NO_ID)).alias("key"))
    node, key = unused(docs, "_node", "_key")
    keyed = docs.withColumns({node: _node(), key: _key()})
    kept = _dealt(keyed, tasks, node, key).join(first.select(F.col("node").alias(node), F.col("key").alias(key)), [node, key], "left_semi")
    atomic = [c for c, t in docs.dtypes if "map" not in t and "variant" not in t]
    one = kept.groupBy(node, key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*atomic)).alias(node + "_row"))
    return one.select(*[F.col(f"{node}_row")[c].alias(c) for c in docs.columns])


#: near_classes() over documents: all pairs that share a shingle, their similarity from whole vectors, connected texts.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT dense_rank() OVER (ORDER BY text) AS g, text, w FROM (SELECT text, any_value(w) AS w FROM d WHERE text IS NOT NULL GROUP BY 1)
), idf AS (SELECT term, CAST(round_even({IDF_STEPS} * ln(1 + n / df), 0) AS BIGINT) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT r, unnest(w) AS term FROM d) GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM d)
), tok AS (SELECT g, n, i, term, idf FROM (SELECT g, len(w) AS n, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t) JOIN idf USING (term)
), sh AS (
  SELECT g, n, i, sum(idf) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN CURRENT ROW AND {SHINGLE - 1} FOLLOWING) AS m, concat_ws(' ', term, {", ".join(f"lead(term, {k}) OVER (PARTITION BY g ORDER BY i)" for k in range(1, SHINGLE))}) AS k FROM tok
), v AS (SELECT g, k, sum(m) AS m FROM sh WHERE i <= greatest(n - {SHINGLE - 1}, 1) GROUP BY 1, 2
), total AS (SELECT g, sum(m) AS m FROM v GROUP BY 1
), pairs AS (SELECT a.g AS x, b.g AS y, sum(least(a.m, b.m))::DOUBLE AS s FROM v a JOIN v b ON a.k = b.k AND a.g < b.g GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs JOIN total p ON p.g = x JOIN total q ON q.g = y WHERE s / (p.m + q.m - s) >= {THRESHOLD}
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT g AS a, g AS b FROM t UNION SELECT a, y FROM reach JOIN edges ON b = x
), class AS (SELECT a AS g, min(b) AS c FROM reach GROUP BY 1
), named AS (SELECT d.*, c FROM d LEFT JOIN t USING (text) LEFT JOIN class USING (g))
SELECT doc_id, CASE WHEN c IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY c) END AS class_id FROM named
"""
