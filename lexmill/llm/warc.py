"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each of many whole WARC records, and ends with a seek table (a
skippable frame, as in the seekable format). A record's place is its frame and its offset in the decompressed frame, so one
record is read by decompressing one frame.

Bundles are rows of a Parquet table (bundle, data, records): Spark's commit protocol makes them whole or absent when executors
are lost, and any store that Spark writes to can hold them. ``data`` alone is a valid ``.warc.zst`` file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import bound_batches, join_hot
from lexmill.session import Scratch

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
ARCHIVE = "bundle string, data binary, records array<struct<page_id: bigint, frame: int, offset: int, length: int>>"


def base32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{original}>")
    lines += [f"WARC-Payload-Digest: sha1:{base32(digest)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: compressed and decompressed size of each."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of each frame, from the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, start = [], 0
    for packed, size in struct.iter_unpack("<II", data[-9 - 8 * count : -9]):
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=size) if size else b""


def parse_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bytes]]:
    """Offset, WARC header, HTTP header and payload of each record of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in frame[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        size = int(head["Content-Length"])
        http, _, payload = frame[end + 4 : end + 4 + size].partition(b"\r\n\r\n")
        yield at, head, http, payload
        at = end + 4 + size + 4


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, original, is_revisit). Of equal payloads of at least ``min_bytes`` the largest id is the
    response; rows that repeat that id are responses too. Without any id, all are responses. Digests that very many pages have are
    broadcast, all others joined by a shuffle."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    least = F.octet_length("payload") >= min_bytes
    originals = rows.where(least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    originals = Scratch(pages.sparkSession).write(originals, "originals")
    total = originals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_hot(rows.where(least), originals, "digest", total)  # copies of a page that is found very often stay where they are
    if min_bytes > 0:
        joined = joined.unionByName(rows.where(~least).withColumn("original", F.lit(None).cast("long")))
    return joined.withColumn("is_revisit", F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, **columns) -> DataFrame:
    """Write a record per row of ``pages`` into bundles at ``path``, and return the archive as read from there.

    Null html is an empty payload, a null url leaves out its header, a null id gives an empty record id. A record longer than
    a frame or a bundle has one of its own. Other columns are not written. An empty table gives an archive without bundles.
    """

    def bundles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, task = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        done, made, places, open_frame, held, size = 0, [], [], [], 0, 0

        def flush() -> None:
            nonlocal held, size
            raw = b"".join(open_frame)
            made.append((packer.compress(raw), len(raw)))
            size += len(made[-1][0])
            open_frame.clear()
            held = 0

        def close() -> pd.DataFrame:
            nonlocal size, done
            data = b"".join(x for x, _ in made) + seek_table([(len(x), n) for x, n in made])
            out = pd.DataFrame({"bundle": [f"{task:06d}-{done:06d}"], "data": [data], "records": [list(places)]})
            made.clear()
            places.clear()
            size, done = 0, done + 1
            return out

        for pdf in frames:
            for page, url, payload, digest, original, revisit in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["original"], pdf["is_revisit"]):
                page = None if pd.isna(page) else int(page)
                one = record(page, None if pd.isna(url) else url, bytes(payload), digest, int(original) if revisit else None, bool(revisit), date)
                places.append({"page_id": page, "frame": len(made), "offset": held, "length": len(one)})
                open_frame.append(one)
                held += len(one)
                if held >= frame_bytes:
                    flush()
                    if size >= bundle_bytes:
                        yield close()
        if open_frame:
            flush()
        if made:
            yield close()

    bound_batches(pages.sparkSession)
    mark_revisits(pages, **columns).mapInPandas(bundles, ARCHIVE).write.option("compression", "uncompressed").parquet(path)
    return pages.sparkSession.read.schema(ARCHIVE).parquet(path)


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def _row(head: dict[str, str], http: bytes, payload: bytes) -> tuple:
    number = lambda uri: int(uri[len("<urn:page:") : -1]) if uri and uri != "<urn:page:>" else None
    kind, size = head["WARC-Type"], int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its header")
    return number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, number(head.get("WARC-Refers-To")), digest, size, payload


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read(archive: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of an archive, frame by frame; payloads are checked against their digests. A revisit's payload is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["data"]:
                for frame in read_seek_table(data):
                    rows = [_row(h, http, p) for _, h, http, p in parse_records(read_frame(data, frame))]
                    yield _frame(rows if payloads else [(*r[:-1], None) for r in rows])

    return archive.select("data").mapInPandas(run, RECORD)


def index(archive: DataFrame) -> DataFrame:
    """(bundle, page_id, frame, offset, length): where each record is. Reads no data."""
    return archive.select("bundle", F.inline("records"))


def fetch(archive: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of some ids. Only the frames that hold them are decompressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data, places in zip(pdf["data"], pdf["places"]):
                table, rows, last, raw = read_seek_table(data), [], None, b""
                for p in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                    if p["frame"] != last:
                        last, raw = p["frame"], read_frame(data, table[p["frame"]])
                    rows += [_row(h, http, x) for _, h, http, x in parse_records(raw[p["offset"] : p["offset"] + p["length"]])]
                yield _frame(rows)

    wanted = index(archive).join(ids.select(F.col(id_col).cast("long").alias("page_id")).distinct(), "page_id", "left_semi")
    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))
    return archive.select("bundle", "data").join(places, "bundle").mapInPandas(run, RECORD)
