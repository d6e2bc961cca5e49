"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

1. Corpus frequencies of the benchmark's terms: one pass over all tokens, summed before the shuffle.
2. For each window of WINDOW consecutive item words, its RAREST rarest places. Postings (document, position) are stored for these
   places' terms alone, in the shared folder.
3. Offset-adjusted postings (position in the document less position in the item) are intersected: an alignment needs
   postings at two places of the item at least (one for items of one word), as a window that occurs has them.
4. Each distinct alignment is intersected with the document's other positions: words at equal offsets must be
   equal over a whole window.

`proximity_matches` uses the same index: documents in which an item's two rarest terms of the corpus stand at most SLOP words
further apart than where they are closest in the item. Their postings are stored too, whether a window is anchored at them or not.

Each table derived from the benchmark is measured and broadcast up to BROADCAST_BYTES; beyond it its join shuffles. Corpus
frequencies are summed before that join, and a very common term among the postings is left to Spark's skew join: the joins
by term are followed by a write or another exchange, so their partitions can be split.

A row is known by 128 bits of its id and text, which are the same for repeated rows: they share their result.

Edge cases: a null text has no words; an item without words matches nothing; an item of fewer words than a window is one
window; an item with fewer than two terms of the corpus has no proximity match; items that share an id count once; a null item_id is left out; repeated rows are rows of their own. Rows without id, or of one id
with other texts, are told apart by their texts. Texts are matched whole, however long. Of ties between terms of equal frequency the first by code point is the rarer.
Only the columns doc_id and text are read, whatever others there are. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

WINDOW, RAREST, BROADCAST_BYTES, SLOP = 10, 2, 32 << 20, 5
#: Lower-case words, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, as the list of what they exclude: Java looks single characters up in a table, where
#: ranges are tried one after another for each character and take seven times as long.
WORD = f"[^{''.join(f'\\x{c:02X}' for c in range(0x80) if not chr(c).isdigit() and not chr(c).islower())}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text. lower() does for ASCII texts; others must keep their upper-case letters beyond Z."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, an index row for each distinct (item_id, words), with its words and window length."""
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    return rows.withColumn("item", F.xxhash64("item_id", "item_words")).withColumn("span", F.least(F.size("item_words"), F.lit(WINDOW)))


def row_key() -> Column:
    """128 bits of a row's id and text: rows of one id but other texts, and rows without id, stay apart."""
    known = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(known("doc_id"), F.lit("\0"), known("text"))))


def keyed(docs: DataFrame, name: str = "_key") -> DataFrame:
    return docs.withColumn(name, row_key())


def fits(df: DataFrame, size: Column) -> bool:
    """Whether the bytes of all rows (size, of each) allow a broadcast."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def least_gap(places: Column) -> Column:
    """Least distance between positions of unlike terms in an array of (p, k): in order, it is that of two neighbours."""
    ordered = F.array_sort(places)
    n = F.size(ordered) - 1
    return F.array_min(F.zip_with(F.slice(ordered, 1, n), F.slice(ordered, 2, n), lambda a, b: F.when(a["k"] != b["k"], b["p"] - a["p"])))


class Index:
    """Rarest terms of the items' windows and of whole items, and their postings in the documents."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        term_bytes = F.octet_length("term") + 32
        self.small = {}
        self.items = self._table("items", items_of(benchmark), F.octet_length(F.array_join("item_words", "")) + 16 * F.size("item_words") + 64)
        places = self.items.select("item", "span", F.size("item_words").alias("m"), F.posexplode("item_words").alias("q", "term"))
        terms = self._table("terms", places.select("term").distinct(), term_bytes)
        tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
        summed = lambda df: df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        known = lambda df: df.join(self._side("terms", terms), "term", "left_semi")
        # Without a broadcast tokens are summed first, so that a term meets the join as one row.
        counts = summed(known(tokens)) if self.small["terms"] else known(summed(tokens))
        self.places = materialize(places.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), "item-terms")
        starts = self.places.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("span") + 1), F.least(F.col("q"), F.col("m") - F.col("span")))))
        rarest = starts.groupBy("item", "start").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term", "q"))), F.lit(1), F.lit(RAREST)).alias("r")).where("r[0].df > 0")  # WINDOW places at most
        places = rarest.select("item", F.explode("r").alias("r")).select("item", "r.term", "r.q").distinct()
        self.anchors = self._table("anchors", places.join(self.items.select("item", F.least(F.col("span"), F.lit(RAREST)).alias("need")), "item"), term_bytes + 32)
        terms = self.places.where("df > 0").groupBy("item", "df", "term").agg(F.collect_list("q").alias("q"))
        pairs = terms.groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term", "q"))), 1, 2).alias("r")).where("size(r) = 2")
        at = [F.transform(F.col("r")[k]["q"], lambda q: F.struct(q.alias("p"), F.lit(k).alias("k"))) for k in (0, 1)]  # noqa: B023
        pairs = pairs.select("item", F.col("r.term").alias("terms"), least_gap(F.concat(*at)).alias("apart")).join(self.items.select("item", "item_id"), "item")
        self.pairs = self._table("pairs", pairs, F.octet_length(F.array_join("terms", "")) + F.octet_length("item_id") + 64)
        # The empty term closes each document: its posting is a row a document and its position the number of words.
        wanted = self.anchors.select("term").union(self.pairs.select(F.explode("terms"))).union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        wanted = self._table("wanted", wanted, term_bytes)
        closed = F.array_append(words(F.col("text")), F.lit(""))
        postings = keyed(docs).select("_key", "doc_id", F.posexplode(closed).alias("p", "term")).join(self._side("wanted", wanted), "term", "left_semi")
        self.postings = materialize(postings.select("term", "_key", "doc_id", "p"), "postings")

    def _table(self, name: str, df: DataFrame, size: Column) -> DataFrame:
        """df written to the shared folder and measured."""
        out = materialize(df, f"decontamination-{name}")
        self.small[name] = fits(out, size)
        return out

    def _side(self, name: str, df: DataFrame) -> DataFrame:
        """Columns of a measured table as one side of a join."""
        return F.broadcast(df) if self.small[name] else df

    def alignments(self) -> DataFrame:
        """Distinct (_key, item, shift)."""
        places = self.postings.join(self._side("anchors", self.anchors), "term").groupBy("_key", "item", (F.col("p") - F.col("q")).alias("shift"))
        return places.agg(F.min("q").alias("first"), F.max("q").alias("last"), F.first("need").alias("need")).where("first < last OR need = 1").select("_key", "item", "shift")


def phrase_matches(docs: DataFrame, index: Index) -> DataFrame:
    """_key, doc_id, n_words, hit positions and item_ids, for each row of docs. Only texts with an alignment are split into words again."""
    per_doc = index.alignments().join(index._side("items", index.items.select("item", F.size("item_words").alias("m"))), "item").groupBy("_key").agg(F.collect_list(F.struct("item", "shift", "m")).alias("near"))
    texts = keyed(docs).select("_key", "text").join(per_doc, "_key").select("_key", "near", words(F.col("text")).alias("w"))
    cut = F.transform("near", lambda c: F.struct(c["item"].alias("item"), c["shift"].alias("shift"), F.slice("w", F.greatest(c["shift"], F.lit(0)) + 1, F.greatest(F.lit(0), c["m"] + F.least(c["shift"], F.lit(0)))).alias("seen")))
    each = texts.select("_key", F.explode(cut).alias("c")).select("_key", "c.*").join(index._side("items", index.items), "item")
    lost = -F.least("shift", F.lit(0))  # item words before the document's first
    whole = lambda i: F.slice("item_words", i + 1, F.col("span")) == F.slice("seen", i - lost + 1, F.col("span"))
    last = F.least(F.size("item_words"), lost + F.size("seen")) - F.col("span")
    found = F.when(last >= lost, F.filter(F.sequence(lost, F.greatest(last, lost)), whole)).otherwise(F.array().cast("array<int>"))
    each = each.withColumn("found", found)
    hit = F.flatten(F.transform("found", lambda i: F.sequence(F.col("shift") + i, F.col("shift") + i + F.col("span") - 1)))
    each = each.where(F.size("found") > 0).select("_key", F.array_distinct(hit).alias("hit"), "item_id")
    hits = each.groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = index.postings.where("term = ''").select("_key", "doc_id", F.col("p").cast("long").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return rows.join(hits, "_key", "left").select("_key", "doc_id", "n_words", none("hits", "array<int>"), none("item_ids", "array<string>"))


def proximity_matches(index: Index, slop: int = SLOP) -> DataFrame:
    """_key, doc_id, item_id, distance: an item's two rarest terms within `slop` words more than they stand apart in the item."""
    terms = index.pairs.select("item", F.posexplode("terms").alias("k", "term"))
    both = index.postings.join(index._side("pairs", terms), "term").groupBy("_key", "doc_id", "item").agg(least_gap(F.collect_list(F.struct("p", "k"))).alias("gap"))
    near = both.where("gap IS NOT NULL").join(index._side("pairs", index.pairs.select("item", "item_id", "apart")), "item").where(F.col("gap") <= F.col("apart") + slop)
    return near.groupBy("_key", "doc_id", "item_id").agg(F.min("gap").alias("distance"))


def report(matches: DataFrame, *more: Column) -> DataFrame:
    n_hit = F.size("hits").cast("long")
    return matches.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *more)


def whole_report(matches: DataFrame, near: DataFrame) -> DataFrame:
    """report() and, for each row, the number and digest of the items that proximity_matches finds in it."""
    items = near.groupBy("_key").agg(F.array_sort(F.collect_set("item_id")).alias("near"))
    rows = matches.join(items, "_key", "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
    n_near = F.size("near").cast("long")
    return report(rows, n_near.alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"))


#: whole_report() over documents and benchmark: every 10-word sequence of documents joined with the windows of the items, and the
#: places of each item's two rarest terms.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, len(x) AS span, array_to_string(x, ' ') AS g FROM (SELECT item_id, unnest([w[i:i + least(len(w), 10) - 1] FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS x FROM b WHERE len(w) > 0)
), spans AS (SELECT DISTINCT span FROM windows
), grams AS (
  SELECT r, i, span, array_to_string(w[i:i + span - 1], ' ') AS g FROM (SELECT r, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)
), found AS (SELECT r, i, span, item_id FROM grams JOIN windows USING (span, g)
), hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + span)) AS p FROM found) GROUP BY 1
), names AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY 1
), it AS (SELECT i, item_id, unnest(w) AS term, generate_subscripts(w, 1) AS q FROM (SELECT row_number() OVER () AS i, * FROM b)
), dt AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d
), freq AS (SELECT term, count(*) AS df FROM dt SEMI JOIN it USING (term) GROUP BY 1
), rare AS (SELECT i, item_id, term, row_number() OVER (PARTITION BY i ORDER BY df, term) AS k FROM (SELECT DISTINCT i, item_id, term FROM it) JOIN freq USING (term)
), pair AS (SELECT i, item_id, min(term) FILTER (k = 1) AS a, min(term) FILTER (k = 2) AS b FROM rare WHERE k <= 2 GROUP BY 1, 2 HAVING count(*) = 2
), apart AS (SELECT pair.i, min(abs(x.q - y.q)) AS apart FROM pair JOIN it x ON x.i = pair.i AND x.term = pair.a JOIN it y ON y.i = pair.i AND y.term = pair.b GROUP BY 1
), gaps AS (SELECT x.r, pair.i, item_id, min(abs(x.p - y.p)) AS gap FROM pair JOIN dt x ON x.term = pair.a JOIN dt y ON y.r = x.r AND y.term = pair.b GROUP BY 1, 2, 3
), near AS (SELECT r, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near FROM (SELECT DISTINCT r, item_id FROM gaps JOIN apart USING (i) WHERE gap <= apart + 5) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r) LEFT JOIN near USING (r)
"""
