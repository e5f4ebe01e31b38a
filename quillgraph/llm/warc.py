"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records, and a seek table in a
skippable frame at the end (the seekable Zstandard format).  A reader needs only the footer to find a frame, and only that
frame to get at a record.  Writing also returns an index: record id -> bundle, frame and offset inside the frame.

Records with equal payloads of at least ``LEAST_SHARED`` bytes are stored once: the one with the smallest page id is the
response, the others are revisit records that refer to it.

A task writes its rows into bundles of bounded size under names no other attempt uses, and returns their index; the
index table, once written, is what counts as the archive.  Files of lost or repeated attempts are in no index and are
never read.  Reading is dealt out by frame, so a bundle can be read by many tasks.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.common import STEP, write_table
from quillgraph.operators.ordering import scratch_path

LEAST_SHARED = 100
#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed text of the record format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("page_id {kind}, record_id string, bundle string, frame int, frame_start long, frame_size long, offset long, length long")


def record_name(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}"


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One record.  A revisit has the HTTP head of the payload but not the payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_name(page_id)}>"),
              ("WARC-Date", date), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_name(refers_to)}>"), ("X-Refers-To-Page", str(refers_to))]
    fields += [("X-Page", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    text = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]) + "\r\n\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record fields, HTTP fields and payload of one record; the lengths must fit."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record ends in the wrong place")
    head, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at the end: compressed and plain size per frame, then the footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) per frame of an open seekable file."""
    file.seek(0, io.SEEK_END)
    end = file.tell()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 128 else 8
    file.seek(end - 9 - n * each)
    table, out, start = file.read(n * each), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * each)
        out.append((start, packed, plain))
        start += packed
    return out


class _Bundle:
    """One bundle being written; rows of its index are returned when a frame is closed."""

    def __init__(self, folder: str):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.out = store.open_output_stream(f"{base}/{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.start, self.held, self.size, self.rows = 0, [], 0, []

    def add(self, page_id, raw: bytes) -> None:
        self.rows.append((page_id, record_name(page_id), self.size, len(raw)))
        self.held.append(raw)
        self.size += len(raw)

    def close_frame(self) -> list[tuple]:
        import zstandard
        if not self.rows:
            return []
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(b"".join(self.held))
        self.out.write(packed)
        done = [(page, name, self.name, len(self.frames), self.start, len(packed), offset, length)
                for page, name, offset, length in self.rows]
        self.frames.append((len(packed), self.size))
        self.start += len(packed)
        self.held, self.size, self.rows = [], 0, []
        return done

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload (binary), payload_digest and refers_to for every row of ``pages`` (page_id, url, html)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = pages.select("page_id", payload.alias("_payload")).filter(F.octet_length("_payload") >= least).groupBy(
        F.sha2("_payload", 256).alias("payload_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter(
        "_n > 1").select("payload_digest", "_first")
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the rows of ``pages`` as records under ``folder`` (a URI all executors share); returns the written index."""
    rows = with_revisits(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = INDEX.format(kind=kind)
    arrow = pa.schema([("page_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()),
                       ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()),
                       ("frame_size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, done = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                for row in batch.slice(start, STEP).to_pylist():
                    bundle = bundle or _Bundle(folder)
                    bundle.add(row["page_id"], warc_record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"]))
                    if bundle.size >= frame_bytes:
                        done += bundle.close_frame()
                        if bundle.start >= bundle_bytes:
                            bundle.close()
                            bundle = None
                if done:
                    yield _as_batch(done, arrow)
                    done = []
        if bundle:
            done = bundle.close_frame()
            bundle.close()
            if done:
                yield _as_batch(done, arrow)

    return write_table(rows.mapInArrow(run, schema), "warc-index")[0]


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, html of the records in an index, frame by frame.

    Every frame is opened by its place in the seek table of its bundle, which must agree with the index.  Length and digest of a
    response are taken from the payload that was read, which must agree with its record; those of a revisit are its fields.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    number = (lambda x: int(x) if x else None) if kind in ("bigint", "int") else (lambda x: x or None)
    frames = index.groupBy("bundle", "frame").agg(
        F.max("frame_start").alias("start"), F.max("frame_size").alias("size"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    schema = (f"page_id {kind}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {kind}, html string")
    arrow = pa.schema([("page_id", _kind(kind)), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("refers_to", _kind(kind)), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        tables: dict[str, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['bundle']}") as file:
                    if row["bundle"] not in tables:
                        tables = {row["bundle"]: read_seek_table(file)}
                    start, packed, plain = tables[row["bundle"]][row["frame"]]
                    if (start, packed) != (row["start"], row["size"]):
                        raise ValueError("seek table and index disagree")
                    file.seek(start)
                    raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                out = []
                for place in row["records"]:
                    fields, http, payload = parse_record(raw[place["offset"]:place["offset"] + place["length"]])
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                        raise ValueError("a payload differs from its record")
                    out.append((number(fields["X-Page"]), fields["WARC-Target-URI"], fields["WARC-Type"], n, digest,
                                number(fields.get("X-Refers-To-Page")), None if revisit else payload.decode("utf-8")))
                yield _as_batch(out, arrow)

    return frames.mapInArrow(run, schema)


def _kind(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(name, pa.string())


def fetch(index: DataFrame, folder: str, page_ids: DataFrame) -> DataFrame:
    """The records of some pages, read through their frames only."""
    return read_records(index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi"), folder)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) and read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Null html counts as empty, a null url as no target.  A null page id is written without a number and never referred to, unless
    all copies of a payload have none; then they are all responses.  Of repeated rows with the smallest id every one is a response.
    Payloads below 100 bytes are all responses.  A record is never cut, however long: it makes a long frame.
    An empty table writes no bundle and gives no rows.  Other columns are ignored.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    index = write_bundles(pages, folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
