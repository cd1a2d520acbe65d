"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames of some hundred KB, each of whole WARC records, and a footer in a
skippable frame: the seek table with each frame's sizes.  The index maps a record's id to (bundle, frame, offset within
the frame's content, length), so that a reader fetches the footer and then one frame.  Bundles are written by tasks under
unique names; the index, which Spark commits, names only those of tasks that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import shared_dir, written

#: Fixed values of the formats: a skippable frame's magic number with which seek tables begin, and the one that ends them.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, content) sizes."""
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


class BundleWriter:
    def __init__(self, files: fs.FileSystem, path: str, frame_bytes: int, level: int):
        self.path, self.frame_bytes = path, frame_bytes
        self.out = files.open_output_stream(path, compression=None)  # else the name would set it
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames, self.buffer, self.buffered, self.size = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame's content, length) of the record.  A record is never split over frames."""
        if self.buffered and self.buffered + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), self.buffered, len(record))
        self.buffer.append(record)
        self.buffered += len(record)
        return place

    def flush(self) -> None:
        if self.buffer:
            packed = self.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.buffered))
            self.size += len(packed)
            self.buffer, self.buffered = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


class BundleReader:
    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entries = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.places, at = [], 0
        for packed, content in struct.iter_unpack("<II", entries):
            self.places.append((at, packed, content))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, content = self.places[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=content)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit keeps the response's headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict, bytes, bytes]]:
    """(offset, length, headers in lower case, HTTP head, payload) of each record of a frame's content."""
    at = 0
    while at < len(content):
        start, end = at, content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["content-length"])
        http, _, payload = content[end + 4 : end + 4 + size].partition(b"\r\n\r\n")
        at = end + 4 + size + 4
        yield start, at - start, headers, http, payload


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, revisit): of equal payloads the largest page_id's is the response.

    Only digests that occur twice are joined back, and they are written first, so a digest that a third of the pages
    share is split over tasks.  Equal rows of the largest page_id are all responses; a page without an id revisits where
    its group has one, else it is a response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and first_id is not null").select("sha1", "first_id"), "warc-groups")
    joined = rows.join(groups, "sha1", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; Spark's names for object stores are understood."""
    scheme, sep, rest = uri.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
    return fs.FileSystem.from_uri(f"{known.get(scheme, scheme)}{sep}{rest}")


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write every page to bundles in ``folder`` (a path or URI that all executors share); the index, as a written table."""
    files, root = store(folder)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        bundle, places = None, []

        def done() -> pa.RecordBatch:
            bundle.close()
            ids, spots = [p[0] for p in places], [p[1] for p in places]
            cells = [pa.array(ids, pa.int64()), pa.array([f"{folder}/{bundle.path.rpartition('/')[2]}"] * len(ids), pa.string())]
            cells += [pa.array([s[k] for s in spots], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            places.clear()
            return pa.RecordBatch.from_arrays(cells, ["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if bundle is None:
                        bundle = BundleWriter(files, f"{root}/{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    places.append((row["page_id"], bundle.add(record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"], row["revisit"], date))))
                    if bundle.size >= bundle_bytes:
                        yield done()
                        bundle = None
        if bundle is not None:
            yield done()

    return written(deduplicated(pages, least_bytes).mapInArrow(run, INDEX), "warc-index")


RECORDS = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary"


def read_archive(index: DataFrame, payloads: bool = True, task_bytes: int = 1 << 24) -> DataFrame:
    """The records that ``index`` (a written table) names, read from their frames; payload is null for revisits, or for all if not wanted.

    Runs of frames are dealt over as many tasks as make some ``task_bytes`` of records each; the index alone is small, and
    wouldn't tell.  Each frame is fetched alone, by its bundle's seek table.  A response whose payload doesn't match its
    digest raises an error; an empty index gives no rows, and rows that name one record twice give it once.
    """
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(100_000, -(-size // task_bytes)))
    runs = index.withColumn("run", F.floor(F.col("frame") / 16)).repartition(tasks, "bundle", "run")
    frames = runs.groupBy("bundle", "run", "frame").agg(F.array_sort(F.collect_set(F.struct("offset", "length"))).alias("places"))
    frames = frames.drop("run").sortWithinPartitions("bundle", "frame")

    def page(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, BundleReader] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] not in readers:
                    readers.clear()
                    readers[row["bundle"]] = BundleReader(*store(row["bundle"]))
                content, found = memoryview(readers[row["bundle"]].frame(row["frame"])), []
                for place in row["places"]:  # of a frame only what the index names is parsed
                    _, _, headers, http, payload = next(parse_records(bytes(content[place["offset"] : place["offset"] + place["length"]])))
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    found.append((page(headers["warc-record-id"]), kind, page(headers.get("warc-refers-to")), digest, size, headers.get("warc-target-uri"), payload if payloads and kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "url", "payload"])

    return frames.mapInArrow(run, RECORDS)


def lookup(index: DataFrame, ids: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the pages in ``ids`` (page_id): their frames alone are fetched, and of these their records parsed."""
    return read_archive(written(index.join(ids.select("page_id").distinct(), "page_id", "left_semi"), "warc-lookup"), payloads)


def op2_warc(pages: DataFrame) -> DataFrame:
    """Every page written to an archive in the shared folder and read back: a row per row; null html is an empty payload."""
    folder = f"{shared_dir(pages.sparkSession)}/windrow/warc-{uuid.uuid4().hex}"
    found = read_archive(write_archive(pages, folder), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
