"""Corpus-wide counts of 64-bit keys, and each block's own view of them.

Documents are dealt to blocks of some megabytes of text by a hash of doc_id and text, so that neither a repeated nor a missing id
makes a block large. A block sends every distinct key that it holds, with its count, to the part that owns the key's range; a part
adds up the counts of all blocks and sends each block the totals of its own keys, in the order in which the block sent them. Keys are
sums of a block before they are shuffled, so a frequent key costs a block one entry. Sorted keys travel as byte planes of their
differences under zstd, a packet for each (block, part) that share keys.

There are as many parts as blocks, as both hold a bounded share of the text. A packet so holds about (block size)**2 / (4 x text)
keys; blocks grow with the root of the text once that would fall below PACKET_KEYS (from 130 GB of text on; blocks of 80 MB at 100 TB),
so what moves stays in proportion to the text, and packets' headers a small part of it.

No table of all keys is collected or broadcast anywhere.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialize

BLOCK_BYTES, PACKET_KEYS, MOST_TASKS = 4 << 20, 32, 50_000


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes: equal high bytes cost next to nothing."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return struct.pack("<IB", len(values), used) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<IB", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:]), np.uint8).reshape(used, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").reshape(n).astype(np.uint64)


def blocked(docs: DataFrame, total_bytes: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Deals rows with doc_id and text to blocks (column block), a task for each up to MOST_TASKS."""
    size = max(block_bytes, int((4 * PACKET_KEYS * total_bytes) ** 0.5))
    blocks = max(1, -(-total_bytes // size))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(min(blocks, MOST_TASKS), "block"), blocks


def _slices(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where the keys of each part begin: parts own equal ranges of the numbers of so many bits."""
    bounds = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)
    return np.r_[0, np.searchsorted(keys, bounds, side="left"), len(keys)]


def send(block: int, keys: np.ndarray, counts: np.ndarray, parts: int, kind: int, bits: int = 64) -> list[tuple]:
    """Packets of a block's sorted distinct keys, numbers of so many bits."""
    at = _slices(keys, parts, bits)
    out = []
    for p in np.flatnonzero(at[1:] > at[:-1]):
        own = keys[at[p] : at[p + 1]]
        out.append((kind, int(p), block, pack(np.diff(own, prepend=np.uint64(0))), pack(counts[at[p] : at[p + 1]])))
    return out


PACKET = "kind int, part int, block int, keys binary, counts binary"
ANSWER = "kind int, part int, block int, total long, distinct long, counts binary"


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in pdf["keys"]]
    counts = [unpack(x) for x in pdf["counts"]]
    known, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(where, weights=np.concatenate(counts).astype(np.float64), minlength=len(known)).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    out = pdf[["kind", "part", "block"]].copy()
    out["total"], out["distinct"] = 0, 0
    out["counts"] = [pack(sums[w]) for w in np.split(where, ends)]
    # The part's own sums go with one of its packets.
    out.iloc[0, out.columns.get_loc("total")] = int(sums.sum())
    out.iloc[0, out.columns.get_loc("distinct")] = int(np.count_nonzero(sums))
    return out


def count_exchange(rows: DataFrame, blocks: int, sender: Callable[[pd.DataFrame], list[tuple]], name: str | None = None) -> DataFrame:
    """Answers (ANSWER) for the blocks of rows; sender gives the packets of a block's rows. With a name they are written to the shared folder;
    without one they are part of the caller's plan, which then deals the texts to blocks once for both."""

    def packets(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sender(pdf), columns=["kind", "part", "block", "keys", "counts"])

    sent = rows.groupBy("block").applyInPandas(packets, PACKET).repartition(min(blocks, MOST_TASKS), "kind", "part")
    answers = sent.groupBy("kind", "part").applyInPandas(_add_up, ANSWER)
    return materialize(answers, name) if name else answers


def answer_of(answers: pd.DataFrame, kind: int) -> np.ndarray:
    """The corpus counts of a block's sorted distinct keys of a kind."""
    own = answers[answers["kind"] == kind].sort_values("part")
    return np.concatenate([unpack(x) for x in own["counts"]]) if len(own) else np.zeros(0, np.uint64)
