"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Candidates are found by regular expressions in each whole text; positions come from the lengths of the pieces
between matches. Hashes of the candidates' secrets are then counted over the corpus by distinct repository and distinct owner,
in two levels (owner and repository first), so a secret that a third of the rows share is summed before it meets
in one task. A secret that more than MAX_OWNERS owners or more than MAX_REPOS repositories have is a widely copied example; one
that fewer have, that is varied enough and names no example is live-looking.

Base kinds are `assign`, `access` and `hex`; `token`, `key` and `url` are added. The base patterns of `access` and
`hex` match maximal runs, so the least length may stand in the pattern; that of `assign` is matched as it is and
short matches are dropped afterwards.

Texts are scanned whole; the work is in proportion to a text's length and to its matches (beyond PART times as many, to their square over PART
squared). Only doc_id, text and the owner's and repository's columns are read, whatever others there are. Where kinds match at one place, the kinds' order decides.

Edge cases: a null or empty text has no span (the digest is that of the empty string); a null owner counts as one owner;
repeated rows are rows of their own but one repository, if they share the id. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

# Pattern, group of the secret, least characters of that group.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "url": (r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]+:([^\s:/@]+)@", 1, 1),
}
#: Substrings without which a kind can't match; the regular expression then isn't run.
HINTS = {"access": ("AKIA",), "token": ("gh", "xox", "eyJ"), "key": ("PRIVATE KEY",), "url": ("://",)}
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start: int, rank: int, end: int, secret: string>>"
MAX_OWNERS, LEAST_VARIETY = 1, 5
PART = 256  # pieces of a text that are walked in one go
#: A live credential may recur in a few repositories of its owner.
MAX_REPOS = 10
PLACEHOLDER = r"(?i)example|dummy|changeme|placeholder|your[_-]?|x{6,}|12345"


def spans_of(text: Column, kind: str) -> Column:
    """Spans of a kind in a text, in order."""
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    found = F.rlike(text, F.lit(pattern))
    for i, hint in enumerate(HINTS.get(kind, ())):
        gate = text.contains(hint) if i == 0 else gate | text.contains(hint)  # noqa: F821
    if kind in HINTS:
        found = gate & found
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("own"))

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["all"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), z["own"].alias("secret"))
        return F.struct(end.alias("at"), F.when(F.length(z["own"]) >= least, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    def walk(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)

    def join(a: Column, part: Column) -> Column:
        return F.struct((a["at"] + part["at"]).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("base"), part["out"].alias("spans"))).alias("out"))

    def whole(z: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / PART).cast("int")), lambda k: walk(F.slice(z, k * PART + 1, F.lit(PART))))
        placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<base: int, spans: {SPAN}>>").alias("out")), join)["out"]
        move = lambda x, by: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), (x["end"] + by).alias("end"), x["secret"].alias("secret"))
        return F.flatten(F.transform(placed, lambda p: F.transform(p["spans"], lambda x: move(x, p["base"]))))

    # Appending copies an array, so a text with many matches is walked in parts, whose places are then moved.
    walked = F.get(F.transform(F.array(pieces), whole), F.lit(0))
    return F.when(found, walked).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame) -> DataFrame:
    """Adds spans, an array of (start, rank of the kind, end, secret) ordered by start and kind, to rows with a text."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("spans", F.array_sort(F.concat(*[spans_of(text, k) for k in KINDS])))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def ownership(candidates: DataFrame, max_repos: int = MAX_REPOS) -> DataFrame:
    """(hash, secret, repo, owner) rows -> hash, n_repos, n_owners, live."""
    pairs = candidates.groupBy("hash", "owner", "repo").agg(F.first("secret").alias("secret"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.first("secret").alias("secret"))
    counts = owners.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.first("secret").alias("secret"))
    few = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repos") <= max_repos)
    varied = F.size(F.array_distinct(F.split(F.lower("secret"), ""))) >= LEAST_VARIETY
    return counts.select("hash", "n_repos", "n_owners", (few & varied & ~F.rlike("secret", F.lit(PLACEHOLDER))).alias("live"))


def scan_corpus(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, spans, and for each row with spans: n_live, n_copied (spans by verdict), most_owners and most_repos (of one of its secrets).

    The texts are scanned once; the spans are written to the shared folder and serve both the counts and the rows.
    """
    rows = scan(docs.select("doc_id", "text", F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo")))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "owner", "repo", "spans"), "secret-spans")
    each = rows.where(F.size("spans") > 0).select("_row", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.explode("spans.secret").alias("secret"))
    each = each.withColumn("hash", F.sha2("secret", 256))
    verdicts = each.select("_row", "hash").join(ownership(each, max_repos), "hash")
    by_row = verdicts.groupBy("_row").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    return rows.join(by_row, "_row", "left").select("doc_id", "spans", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "most_owners", "most_repos")])


def report(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == list(KINDS).index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return scanned.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_copied", "most_owners", "most_repos")


def _either_case(pattern: str) -> str:
    """A pattern whose a-z stand for either case: (?i) would fold letters beyond ASCII in DuckDB."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


def _oracle() -> str:
    """report(scan_corpus()) in SQL: the spans of each kind by the pieces between matches, then counts by hash."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = []
    for rank, (pattern, group, least) in enumerate(KINDS.values()):
        if pattern.startswith("(?i)"):
            names, rest = pattern.removeprefix("(?i)").split(")", 1)
            pattern = _either_case(names) + ")" + rest
        p = quoted(pattern.replace(r"\s", r"\x09-\x0D\x20"))
        found.append(f"SELECT r, {rank} AS rank, {least} AS least, string_split_regex(t, {p}) AS gap, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {group}) AS own FROM d WHERE regexp_matches(t, {p})")
    placeholder = quoted(_either_case(PLACEHOLDER.removeprefix("(?i)")))
    names = ", ".join(map(quoted, KINDS))
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in (*BASE, "live", "copied"))
    by_kind = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(source AS VARCHAR), '?none') AS owner, coalesce(CAST(doc_id AS VARCHAR), '?none') AS repo, coalesce(text, '') AS t FROM documents
), m AS ({" UNION ALL ".join(found)}
), e AS (SELECT r, rank, least, gap, whole, own, unnest(range(1, len(whole) + 1)) AS i FROM m
), s AS (
  SELECT r, rank, own[i] AS secret, list_sum([length(x) for x in gap[1:i]]) + coalesce(list_sum([length(x) for x in whole[1:i - 1]]), 0) AS start, length(whole[i]) AS n FROM e WHERE length(own[i]) >= least
), named AS (SELECT *, concat([{names}][rank + 1], ':', CAST(start AS BIGINT), ':', CAST(start + n AS BIGINT)) AS span FROM s
), owned AS (
  SELECT secret, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos,
         count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT (owner, repo)) <= {MAX_REPOS} AND len(list_distinct(string_split(lower(secret), ''))) >= {LEAST_VARIETY} AND NOT regexp_matches(secret, {placeholder}) AS live
  FROM s JOIN d USING (r) GROUP BY secret
), by_row AS (
  SELECT r, {by_kind}, string_agg(span, ',' ORDER BY start, rank) AS spans, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(n_owners) AS most, max(n_repos) AS most_repos
  FROM named JOIN owned USING (secret) GROUP BY r
)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(most, 0) AS BIGINT) AS most_owners, CAST(coalesce(most_repos, 0) AS BIGINT) AS most_repos
FROM d LEFT JOIN by_row USING (r)
"""


ORACLE = _oracle()
