"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

`write_archives` deals pages to archives and writes each as a file through Spark's own writer, so any file system
of Spark will do and lost tasks are written anew. `read_archives` loads the dictionary of an archive from its
first frame, finds each frame's end from the block headers, decodes one frame per record and validates version,
required headers, lengths and digests; a fault raises ArchiveError.

Edge cases: a null html counts as an empty payload, a null url leaves out the target header, a null page_id is
kept as null and never chosen as the response of a group that has ids. Rows that repeat the smallest page_id are all
responses. An empty table writes no archive and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: An empty skippable frame. The text writer puts it after each row, that is at the end of each archive.
FILLER = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 8 << 20  # of records before compression
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 128, 1 << 20
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class ArchiveError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, block: bytes, *headers: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if url is not None:
        own.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").strip() or "about:blank"))
    name = f"urn:page:{'none' if page_id is None else page_id}"
    if refers_to is None:
        return _record("response", name, http + payload, *own)
    return _record("revisit", name, http, *own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"))


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from whole records spread over the archive (SAMPLES records, SAMPLE_BYTES bytes at most); empty if they don't yield one."""
    picked, size = [], 0
    for r in records[:: max(1, len(records) // SAMPLES)]:
        if size + len(r) <= SAMPLE_BYTES:
            picked.append(r)
            size += len(r)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, picked, k=200, d=8).as_bytes() if len(picked) > 7 else b""
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes]) -> bytes:
    trained = train_dictionary(records)
    packer = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained if trained else b""
    return head + b"".join(map(packer.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at this place ends; for a Zstandard frame from its header and block headers."""
    if len(data) - at < 8:
        raise ArchiveError("a frame is cut off")
    magic, size = struct.unpack_from("<II", data, at)
    if magic in SKIPPABLE:
        end = at + 8 + size
    elif bytes(data[at : at + 4]) == FRAME_MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise ArchiveError("a frame is cut off")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            if kind == 3:
                raise ArchiveError("a block of a reserved type")
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ArchiveError("no frame begins here")
    if end > len(data):
        raise ArchiveError("a frame is cut off")
    return end


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("not a WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError("a header line without colon")
        headers[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ArchiveError(f"headers are missing: {sorted(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block's length differs from Content-Length")
    block = rest[:-4]
    if headers.get("warc-block-digest", x := f"sha1:{digest(block)}") != x:
        raise ArchiveError("the block's digest differs")
    return headers, block


def read_archive(data: bytes):
    """Headers and block of each record, one frame at a time."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        at = frame_end(view, 0)
        trained = bytes(view[8:at])
        if trained[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
            trained = unpack.decompressobj().decompress(trained)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    while at < len(data):
        end = frame_end(view, at)
        if bytes(view[at : at + 4]) == FRAME_MAGIC:
            try:
                yield parse_record(unpack.decompressobj().decompress(view[at:end]))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame can't be decoded: {e}") from e
        at = end


def _page_of(uri: str) -> int | None:
    name = uri.strip("<>").removeprefix("urn:page:")
    return None if name == "none" else int(name)


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    """The fields of RECORD; a response's length and digest are checked against its payload."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not gap or len(sizes) != 1 or not stated:
        raise ArchiveError("no HTTP header with a length, or no payload digest")
    if (kind := headers["warc-type"]) == "response" and (len(payload) != sizes[0] or digest(payload) != stated):
        raise ArchiveError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ArchiveError("a revisit with a payload or without what it refers to")
    url = headers.get("warc-target-uri")
    url = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    refers = headers.get("warc-refers-to")
    return _page_of(headers["warc-record-id"]), url, sizes[0], stated, kind, None if refers is None else _page_of(refers), payload if kind == "response" else None


def _write(batches):
    def archive(records):
        info = _record("warcinfo", f"urn:archive:{hashlib.sha1(b''.join(records)).hexdigest()}", b"format: WARC File Format 1.1\r\n", ("Content-Type", "application/warc-fields"))
        return pd.DataFrame({"archive": [write_archive([info, *records])]})

    records, size = [], 0
    for pdf in batches:
        for page_id, url, html, first in zip(pdf.page_id, pdf.url, pdf.html, pdf["first"], strict=True):
            page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
            records.append(page_record(page_id, url, (html or "").encode("utf-8", "replace"), None if first is None or first == page_id else first))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield archive(records)
                records, size = [], 0
    if records:
        yield archive(records)


def write_archives(pages: DataFrame, path: str) -> None:
    """Of equal payloads the one of the smallest page_id is the response, the others revisit it. One shuffle of the pages, by digest; a hot digest is split by the skew join."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("_digest"))
    firsts = pages.groupBy("_digest").agg(F.min("page_id").alias("first"))
    rows = pages.join(firsts, "_digest").select("page_id", "url", "html", "first")
    blobs = rows.mapInPandas(_write, "archive binary")
    blobs.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", FILLER).option("maxRecordsPerFile", 1).text(path)


def _read(batches):
    for pdf in batches:
        for content in pdf.content:
            rows = [page_of(h, b) for h, b in read_archive(content) if h["warc-type"] in ("response", "revisit")]
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
            for c in ("page_id", "refers_to"):
                frame[c] = frame[c].astype("Int64")
            for at in range(0, len(frame), 512):
                yield frame.iloc[at : at + 512]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page record in the archives of a folder, validated."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInPandas(_read, RECORD)


#: write_archives() and read_archives() over pages: digests as base32 from hexadecimal, 20 bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INT), 5))::BIGINT >> CAST(5 * (3 - k % 4) AS BIGINT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM p
"""
