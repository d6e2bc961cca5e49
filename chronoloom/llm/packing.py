"""Token ids in packed rows: best-fit-decreasing with a segment tree over the remaining capacities.

Texts are tokenized with a public byte-level BPE vocabulary (a path parameter), an end-of-text id closes each. Documents longer than a row
are split without loss into whole rows and a remainder; remainders are put, longest first, into the fullest row
that still holds them. The tree has a leaf for every remaining capacity and finds the least sufficient one in
log2(length) steps.

Documents are dealt to groups of about GROUP_BYTES of text by a hash of doc_id and text and each group is packed by itself, so the result
doesn't depend on the cluster. Many equal rows go in shares of about MANY_BYTES, each to a group of its own hash. A task holds one group, as there are as many tasks as groups up to MOST_TASKS; at most a fraction of a row a group is lost to that.

Each output row has the ids as little-endian unsigned 32-bit (`ids`, padded to the row length with the end id), the
cumulative segment lengths from 0 (`cu_seqlens`), the positions at which position ids start again (`resets`), and
for each segment its document, its offset in the document's tokens and its length.

write_packed() puts packed rows into files, as matrices of ids with their segments; read_packed() reads them.

Edge cases: a null or empty text is its end id alone; repeated rows are packed as rows of their own; a null doc_id stays null; texts are
tokenized whole, however long; ties of length go to the smaller id, then text. Only doc_id and text are read, whatever other columns there are. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import MANY_BYTES, ROW_BYTES, repeated, split_repeats, text_totals

ROW_LENGTH, GROUP_BYTES, MOST_TASKS = 2048, 8 << 20, 50_000
VOCABULARY, END_ID = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 50256
# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, offsets array<long>, lengths array<int>"


class Capacities:
    """A segment tree over 0..length: for each node the number of open rows in its range of remaining capacities."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int | None:
        """The least capacity of an open row that is at least need."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], row: int = ROW_LENGTH) -> list[list[int]]:
    """Indices of the pieces in each row."""
    tree, open_rows, rows = Capacities(row), [[] for _ in range(row + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = tree.least(n)
        if at is None:
            r, at = len(rows), row
            rows.append([])
        else:
            r = open_rows[at].pop()
            tree.add(at, -1)
        rows[r].append(i)
        open_rows[at - n].append(r)
        tree.add(at - n, 1)
    return rows


_ENCODINGS: dict = {}


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(content: bytes):
    """The tokenizer of a vocabulary file's content; made once a process."""
    import tiktoken

    key = hash(content)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def decode(ids: np.ndarray, path: str = VOCABULARY) -> str:
    return encoder(vocabulary(path)).decode_bytes([int(x) for x in ids if x != END_ID]).decode()


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids that start again with each segment."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def _packer(content, row: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["known", "key", "text"], kind="stable")
        encode = encoder(content.value).encode_ordinary
        ids_of = {t: np.array([*encode(t), END_ID], "<u4") for t in pdf["text"].unique()}
        tokens = [ids_of[t] for t in pdf["text"]]
        pieces = [(d, a, min(row, len(t) - a)) for d, t in enumerate(tokens) for a in range(0, len(t), row)]
        ids = [int(x) if known else None for x, known in zip(pdf["key"], pdf["known"], strict=True)]
        out = []
        for n, bins in enumerate(best_fit_decreasing([p[2] for p in pieces], row)):
            own = [pieces[i] for i in bins]
            cu = np.cumsum([0, *(p[2] for p in own)])
            matrix = np.full(row, END_ID, "<u4")
            matrix[: cu[-1]] = np.concatenate([tokens[d][a : a + k] for d, a, k in own])
            out.append(((int(pdf["bucket"].iloc[0]) << 32) + n, int(cu[-1]), matrix.tobytes(), cu, cu[:-1], [ids[d] for d, _, _ in own], [a for _, a, _ in own], [k for _, _, k in own]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return packed


def pack_documents(docs: DataFrame, path: str = VOCABULARY, row: int = ROW_LENGTH) -> DataFrame:
    """Packed rows (SCHEMA) of every text of docs. One shuffle of the texts, by group."""
    groups = max(1, -(-text_totals(docs)[1] // GROUP_BYTES))
    # A missing id goes as a flag beside a number: with nulls among them pandas would hold ids as doubles.
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("key")
    rows, equal = split_repeats(docs.select(key, F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text")), "n")
    rows = rows.withColumn("place", F.lit(0).cast("long"))
    if equal is not None:
        rows = rows.unionByName(repeated(equal, "n", "place"))
    share = F.floor(F.col("place") / F.greatest(F.lit(1), F.floor(F.lit(MANY_BYTES) / (F.octet_length("text") + ROW_BYTES))))
    dealt = rows.select(F.pmod(F.xxhash64("known", "key", "text", share), F.lit(groups)).cast("int").alias("bucket"), "key", "known", "text")
    dealt = dealt.repartition(min(groups, MOST_TASKS), "bucket")
    # The driver reads the vocabulary (about 1 MB) and sends it to the executors, which need no such file.
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    return dealt.groupBy("bucket").applyInPandas(_packer(content, row), SCHEMA)


FILE_ROWS = 2048
FILES = "file long, n_rows int, row_length int, ids binary, cu_seqlens binary, resets binary, row_splits binary, doc_ids array<long>, offsets array<long>, lengths array<int>"


def write_packed(packed: DataFrame, path: str, row: int = ROW_LENGTH) -> None:
    """Packed rows as files for training: each of their rows is one matrix of up to FILE_ROWS packed rows, little-endian unsigned 32-bit ids row by row, that a reader maps without parsing, with
    the cumulative segment lengths and resets of all its rows one after the other (32-bit) and where each row's begin in either (row_splits: two rows of 32-bit numbers).

    Rows come in order of pack_id within a file. The files are Parquet, so a lost task leaves no half of one behind."""

    def matrices(batches):
        for pdf in batches:
            for at in range(0, len(pdf), FILE_ROWS):
                own = pdf.iloc[at : at + FILE_ROWS].sort_values("pack_id", kind="stable")
                flat = lambda c: np.concatenate([np.asarray(x) for x in own[c]])  # noqa: B023, E731
                splits = [np.cumsum([0, *map(len, own[c])]) for c in ("cu_seqlens", "resets")]
                binary = {c: [flat(c).astype("<i4").tobytes()] for c in ("cu_seqlens", "resets")}
                ids = pd.array([None if pd.isna(x) else int(x) for c in own["doc_ids"] for x in c], "Int64")
                yield pd.DataFrame({"file": [int(own["pack_id"].iloc[0])], "n_rows": [len(own)], "row_length": [row], "ids": [b"".join(own["ids"])], **binary, "row_splits": [np.stack(splits).astype("<i4").tobytes()], "doc_ids": [ids.tolist()], "offsets": [flat("offsets").tolist()], "lengths": [flat("lengths").tolist()]})

    files = packed.select("pack_id", "ids", "cu_seqlens", "resets", F.transform("doc_ids", lambda x: x.cast("string")).alias("doc_ids"), "offsets", "lengths")
    files.mapInPandas(matrices, FILES).write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_packed()'s files: file, row, ids (binary), cu_seqlens, resets, doc_ids, offsets, lengths."""

    def rows(batches):
        for pdf in batches:
            for f in pdf.itertuples():
                cu, resets = np.frombuffer(f.cu_seqlens, "<i4"), np.frombuffer(f.resets, "<i4")
                a, b = np.frombuffer(f.row_splits, "<i4").reshape(2, -1)
                width = 4 * f.row_length
                part = lambda x: [x[b[r] : b[r + 1]] for r in range(f.n_rows)]  # noqa: B023, E731
                ids = [[None if x is None else int(x) for x in own] for own in part(list(f.doc_ids))]
                yield pd.DataFrame({"file": f.file, "row": np.arange(f.n_rows), "ids": [f.ids[r * width : (r + 1) * width] for r in range(f.n_rows)], "cu_seqlens": [cu[a[r] : a[r + 1]] for r in range(f.n_rows)], "resets": part(resets), "doc_ids": ids, "offsets": part(np.asarray(f.offsets)), "lengths": part(np.asarray(f.lengths))})

    stored = spark.read.parquet(path).withColumn("doc_ids", F.transform("doc_ids", lambda x: x.cast("string")))
    return stored.mapInPandas(rows, "file long, row int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, offsets array<long>, lengths array<int>")
