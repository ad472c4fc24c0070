"""WARC archives as seekable Zstandard bundles.

A bundle holds independent frames, each of a group of whole records, and ends with a seek table in a skippable frame:
compressed and decompressed size of every frame, so any Zstandard reader still reads the bundle
from end to end. The index maps a record identifier to (bundle, frame, offset in the frame): one range read and one frame
decompressed give the record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.llm.scratch import discard, filesystem, materialize, small_batches
from eventweave.llm.textbuf import release_freed_memory

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Record bytes after which a frame ends, and a bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
_URN = "urn:x-page:"


class BundleWriter:
    """Appends records to frames; ``close`` writes the seek table."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        fs, path = filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.uri, self.frame_bytes = fs.open_output_stream(path, compression=None), uri, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in its content, and length of the record."""
        place = len(self.frames), self.held, len(record)
        self.pending.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.codec.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw)))
            self.written += len(raw)
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE))
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.codec = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        raw = self.codec.decompressobj().decompress(self.file.read_at(self.sizes[k][0], self.starts[k]))
        if len(raw) != self.sizes[k][1]:
            raise ValueError(f"frame {k} is broken")
        return raw

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def __enter__(self) -> BundleReader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: object) -> str:
    """One header line's worth of text: line ends become spaces."""
    return " ".join(str(value).splitlines())


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, copy: str = "") -> bytes:
    """A response record, or a revisit record without payload when it refers to another page. ``copy`` tells records of one page_id apart."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}{copy and ':' + copy}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {header_value(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[dict]:
    """The records of a frame: headers in lower case, HTTP headers, and payload."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:stop].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a WARC/1.1 record")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        begin = stop + 4
        end = begin + int(headers["content-length"])
        http, _, payload = raw[begin:end].partition(b"\r\n\r\n")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])}
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield {"headers": headers, "http": fields, "payload": payload}
        at = end + 4


def _page(urn: str | None) -> int | None:
    name = urn[1:-1].removeprefix(_URN).partition(":")[0] if urn else ""
    return int(name) if name else None


def first_copies(pages: DataFrame, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """pages as (page_id, url, html, refers_to, repeated): a page whose payload a smaller page_id has refers to the smallest; ``repeated`` ones share their id.

    Payloads are equal when their SHA-256 is. Only rows of id and digest are grouped and joined by digest; what is found, a row for each page that is a copy,
    is stored and joined with the pages by id, which shuffles no page where that is small enough to be broadcast. Payloads under ``min_bytes`` refer to nothing.
    """
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    named = pages.select(pages[id_col].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages[text_col].cast("string").alias("html"))
    keys = materialize(named.select("page_id", F.unhex(digest).alias("digest"), (F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes).alias("counts")), "warc-keys")
    shared = keys.where("counts").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    copies = keys.where("counts").join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first", F.lit(False).alias("repeated"))
    ids = keys.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id")
    again = keys.join(ids, keys["page_id"].eqNullSafe(ids["page_id"]), "left_semi").select("page_id", "digest", F.lit(None).cast("long").alias("first"), F.lit(True).alias("repeated"))
    found = materialize(copies.unionByName(again).groupBy("page_id", "digest").agg(F.max("first").alias("refers_to"), F.max("repeated").alias("repeated")), "warc-copies")
    discard(keys)
    p, c = named.withColumn("digest", F.unhex(digest)).alias("p"), found.alias("c")
    joined = p.join(c, F.col("p.page_id").eqNullSafe(F.col("c.page_id")) & (F.col("p.digest") == F.col("c.digest")), "left")
    return joined.select("p.page_id", "url", "html", "refers_to", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", text_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page into bundles below out_dir; returns the stored index (page_id, path, frame, offset, length).

    A null text has an empty payload; a null url gives no target header. Of equal payloads the smallest page_id is the response; rows that repeat that id are
    responses too. A null page_id refers to the first copy, if that has one. Records have identifiers of their own: those of pages that share an id, or have none, end
    in a random part. A very long page is a frame of its own. No pages: an empty index. Other
    columns are ignored, whatever their names. Each task writes bundles under names of its own, and the index says which count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bundle = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            release_freed_memory()
            for page_id, url, html, refers_to, repeated in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "repeated")), strict=True):
                if bundle is None:
                    bundle = BundleWriter(f"{out_dir}/pages-{part:06d}-{uuid.uuid4().hex}.warc.zst")
                place = bundle.add(format_record(page_id, url, (html or "").encode(), refers_to, date, uuid.uuid4().hex if repeated or page_id is None else ""))
                rows.append((page_id, bundle.uri, *place))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["page_id", "path", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    small_batches(pages.sparkSession)
    linked = first_copies(pages, id_col, text_col, min_bytes)
    return materialize(linked.mapInArrow(write, "page_id long, path string, frame long, offset long, length long"), "warc-index")


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _row(path: str, page_id: int | None, raw: bytes) -> tuple:
    """The record of an index entry; an error if it isn't a whole record of that page."""
    try:
        (record,) = parse_records(raw)
    except ValueError as e:
        raise ValueError(f"{path}: the entry of page {page_id} names no single record") from e
    h, kind = record["headers"], record["headers"]["warc-type"]
    size, digest = int(record["http"]["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(record["payload"]) != size or base32_sha1(record["payload"]) != digest):
        raise ValueError(f"{path}: a payload doesn't match its header")
    if _page(h["warc-record-id"]) != page_id:
        raise ValueError(f"{path}: the entry of page {page_id} names another page's record")
    return page_id, size, digest, kind, _page(h.get("warc-refers-to")), h.get("warc-target-uri"), record["payload"] if kind == "response" else None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset", "length", "page_id")), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def read_warc(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record that an index names: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload).

    Records are cut out of frames at the places in the index. ``payload`` is null for revisits. It is an error when a response's payload doesn't
    have its digest and length, when a record isn't that of its entry, and when a bundle holds bytes that no entry names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, own in groupby(_entries(batches), itemgetter(0)):
            release_freed_memory()
            with BundleReader(path) as bundle:
                seen = 0
                for k, places in groupby(own, itemgetter(1)):
                    if k != seen or k >= len(bundle.sizes):
                        raise ValueError(f"{path}: the index has frame {k} where {seen} of {len(bundle.sizes)} follows")
                    raw, at, rows = bundle.frame(k), 0, []
                    for _, _, offset, length, page_id in places:
                        if offset != at:
                            raise ValueError(f"{path}: the index doesn't fit the records of frame {k}")
                        rows.append(_row(path, page_id, raw[offset : offset + length]))
                        at = offset + length
                    if at != len(raw):
                        raise ValueError(f"{path}: the index doesn't fit the records of frame {k}")
                    seen += 1
                    yield _batch(rows)
                if seen != len(bundle.sizes):
                    raise ValueError(f"{path}: the index has {seen} of {len(bundle.sizes)} frames")

    bundles = max(1, index.select("path").distinct().count())
    places = index.select("path", "frame", "offset", "length", "page_id").repartitionByRange(bundles, "path").sortWithinPartitions("path", "frame", "offset")
    return places.mapInArrow(read, _READ)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records, as read_warc() gives them, of the page_ids in ids: only their frames are read. Unknown and null ids give nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, own in groupby(_entries(batches), itemgetter(0)):
            with BundleReader(path) as bundle:
                for k, places in groupby(own, itemgetter(1)):
                    raw = bundle.frame(k)
                    yield _batch([_row(path, page_id, raw[offset : offset + length]) for _, _, offset, length, page_id in places])

    asked = index.join(ids.select(ids["page_id"].cast("long").alias("page_id")), "page_id", "left_semi")
    places = asked.select("path", "frame", "offset", "length", "page_id").repartition("path", "frame").sortWithinPartitions("path", "frame", "offset")
    return places.mapInArrow(read, _READ)
