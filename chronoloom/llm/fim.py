"""Fill-in-the-middle: documents with their middle moved to the end, and back, on ropes.

A text is a rope of units (rope.py). Two hashed ranks split it into prefix, middle and suffix; the subtrees are joined in another order with
sentinels between. The form is drawn by further parts of the same hash: plain (the text as it is), psm (prefix, suffix, middle) or spm
(suffix, prefix, middle). To invert, the output's rope is split where the sentinels' units stand; no sentinel's text occurs in a part, as a text
that holds one stays plain, and no occurrence can begin in one part and end in a sentinel, whose first character occurs in it once.

Rows never meet: there is no shuffle, whatever the keys. A task holds one Arrow batch (BATCH_BYTES) or one longer text, its rope and its output.

Edge cases: a null text is empty and so plain; empty texts are plain. A null doc_id hashes as the empty text. Repeated rows give equal
rows. Texts are taken whole, however long; a run of letters of any length is one unit. Only doc_id and text are read, whatever other columns
there are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import rope
from .common import small_batches

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BATCH_BYTES = 8 << 20
FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rates:
    """Of a hundred documents so many are rearranged, and of a hundred of those so many by suffix first."""

    rearranged: int = 90
    suffix_first: int = 20


def rearrange(text: str, h: tuple[int, int, int, int], rates: Rates = Rates()) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of a text by four hashes: two ranks, whether and how."""
    whole = rope.build(text)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rates.rearranged:
        return whole.units, "plain", None, None, text
    first, second = sorted((h[0] % (whole.units + 1), h[1] % (whole.units + 1)))
    head, suffix = rope.split(whole, second)
    prefix, middle = rope.split(head, first)
    p, s, m = map(rope.build, (PREFIX, SUFFIX, MIDDLE))
    form, order = ("spm", (s, suffix, p, prefix, m, middle)) if h[3] % 100 < rates.suffix_first else ("psm", (p, prefix, s, suffix, m, middle))
    out = rope.EMPTY
    for part in order:
        out = rope.concat(out, part)
    return whole.units, form, prefix.chars, middle.chars, rope.text_of(out)


def restore(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    rest, parts = rope.build(output), {}
    for name, sentinel in (zip("psm", (PREFIX, SUFFIX, MIDDLE)) if form == "psm" else zip("spm", (SUFFIX, PREFIX, MIDDLE))):
        before, after = rope.split(rest, rope.unit_rank(rest, rope.find(rest, sentinel)))
        if parts:
            parts[last] = before  # noqa: F821
        last, rest = name, rope.split(after, rope.count_units(sentinel))[1]
        parts[last] = rest
    return rope.text_of(rope.concat(rope.concat(parts["p"], parts["m"]), parts["s"]))


def hashes(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def form_documents(docs: DataFrame, seed: str = "1", rates: Rates = Rates()) -> DataFrame:
    """FORMED: of every document (doc_id, text) its number of units, form, code points of prefix and middle (null if plain) and output."""
    small_batches(docs.sparkSession, BATCH_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [rearrange(t or "", h, rates) for t, *h in zip(pdf["text"], pdf["h1"], pdf["h2"], pdf["h3"], pdf["h4"], strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            for c in ("prefix_chars", "middle_chars"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pd.array([None if i is None else int(i) for i in pdf["doc_id"]], "Int64"))
            yield out

    # The id goes as text: with nulls among them pandas would hold numbers as doubles.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", *hashes(F.col("doc_id").cast("long"), seed))
    return rows.mapInPandas(run, FORMED)


@F.pandas_udf(T.StringType())
def restored(output: pd.Series, form: pd.Series) -> pd.Series:
    """The text of each output."""
    return pd.Series([restore(o, f) for o, f in zip(output, form, strict=True)], dtype=object)


def report(formed: DataFrame) -> DataFrame:
    """Digests instead of texts."""
    rows = formed.withColumn("restored", restored("output", "form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: report(form_documents()) over documents.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || s[1:8])::BIGINT AS a, ('0x' || s[9:16])::BIGINT AS b, ('0x' || s[17:24])::BIGINT AS c, ('0x' || s[25:32])::BIGINT AS e FROM d),
f AS (SELECT *, least(a % (n + 1), b % (n + 1)) AS x, greatest(a % (n + 1), b % (n + 1)) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c % 100 >= 90 THEN 'plain' WHEN e % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:x], '') AS prefix, array_to_string(u[x + 1:y], '') AS middle, array_to_string(u[y + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
