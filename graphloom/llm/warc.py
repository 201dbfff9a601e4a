"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, one frame per record.

Archives are files of bounded size in a folder that all executors share. Each attempt of a task writes to a
folder of its own, and only the folders that successful attempts have reported are read, so tasks can be lost,
run again or run twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, row_id, slices, values
from .files import filesystem

DICTIONARY_FRAME = 0x184D2A5D
#: Compressed bytes after which a file is closed.
FILE_BYTES = 16 << 20
#: A file's dictionary is trained on its first payloads: at most so many bytes and records.
TRAIN_BYTES, TRAIN_RECORDS, DICTIONARY_BYTES = 1 << 20, 200, 32 << 10
_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*?)[ \t]*\r\n")


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int, uri: str, payload: bytes, payload_digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record whose block is an HTTP response, for a revisit only its headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, what: str) -> dict[bytes, bytes]:
    out, at = {}, 0
    while at < len(raw):
        m = _HEADER.match(raw, at)
        if not m:
            raise WarcError(f"bad {what} header at {at}: {raw[at:at + 40]!r}")
        name = m[1].lower()
        if name in out:
            raise WarcError(f"{what} header {m[1]!r} stands twice")
        out[name], at = m[2], m.end()
    return out


def _page(urn: bytes) -> int:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", urn)
    if not m:
        raise WarcError(f"bad record id {urn!r}")
    return int(m[1])


def parse(raw: bytes) -> tuple[int, int, str, str, int | None, bytes | None]:
    """page, payload bytes, payload digest, type, page referred to, payload (None for a revisit) of one record.

    The version line, header syntax, mandatory headers, both lengths, both digests and the closing line ends
    are checked; a fault raises WarcError.
    """
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not re.match(rb"WARC/1\.[01]\r\n", head):
        raise WarcError(f"not a WARC record: {raw[:20]!r}")
    h = _headers(head.partition(b"\r\n")[2] + b"\r\n", "WARC")
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest"):
        if name not in h:
            raise WarcError(f"no {name!r}")
    if not h[b"content-length"].isdigit() or len(rest) != int(h[b"content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"the block has {len(rest) - 4} bytes, not {h[b'content-length']!r}")
    block = rest[:-4]
    if b"warc-block-digest" in h and h[b"warc-block-digest"] != b"sha1:" + digest(block).encode():
        raise WarcError("the block's digest is wrong")
    http, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/1."):
        raise WarcError("the block is no HTTP response")
    size = _headers(http.partition(b"\r\n")[2] + b"\r\n", "HTTP").get(b"content-length", b"")
    kind, want = h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if not size.isdigit() or kind == "response" and len(body) != int(size):
        raise WarcError(f"the payload has {len(body)} bytes, not {size!r}")
    if kind == "response" and digest(body) != want:
        raise WarcError("the payload's digest is wrong")
    if kind == "revisit" and (b"warc-refers-to" not in h or body):
        raise WarcError("a revisit has no payload and refers to a record")
    return _page(h[b"warc-record-id"]), int(size), want, kind, _page(h[b"warc-refers-to"]) if b"warc-refers-to" in h else None, body if kind == "response" else None


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing if the samples are too few or too small for one."""
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES // 4:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(data: bytes):
    """The records of an archive, one for each frame after the dictionary's."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        n = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + n:
            raise WarcError("the dictionary is cut off")
        raw = bytes(view[8 : 8 + n])
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + n
    z = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        size = zstandard.frame_content_size(view[at : at + 18])
        d, parts, step = z.decompressobj(), [], 4096  # unused_data copies what is left of a slice, so slices start small
        while not d.eof:
            if at >= len(data):
                raise WarcError("the last frame is cut off")
            parts.append(d.decompress(view[at : at + step]))
            at, step = min(at + step, len(data)), step * 2
        raw, at = b"".join(parts), at - len(d.unused_data)
        if size >= 0 and size != len(raw):
            raise WarcError(f"the frame before {at} has {len(raw)} bytes, not {size}")
        yield raw


class _Writer:
    """Writes records to files of about FILE_BYTES each; the first records of each wait for its dictionary."""

    def __init__(self, fs, folder: str):
        self.fs, self.folder, self.files, self.records, self.held, self.held_bytes, self.out = fs, folder, 0, 0, [], 0, None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.held.append(raw)
            self.held_bytes += len(raw)
            if self.held_bytes >= TRAIN_BYTES or len(self.held) >= TRAIN_RECORDS:
                self._begin()
        else:
            self._put(raw)
        if self.out is not None and self.size >= FILE_BYTES:
            self.finish()

    def _begin(self) -> None:
        dictionary = train(self.held)
        if not self.files:
            self.fs.create_dir(self.folder, recursive=True)
        self.out, self.size = self.fs.open_output_stream(f"{self.folder}/{self.files:05d}.warc.zst", compression=None), 0
        self.files += 1
        self.z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=3, write_content_size=True)
        if dictionary:
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        for raw in self.held:
            self._put(raw)
        self.held, self.held_bytes = [], 0

    def _put(self, raw: bytes) -> None:
        frame = self.z.compress(raw)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def finish(self) -> None:
        if self.out is None and self.held:
            self._begin()
        if self.out is not None:
            self.out.close()
            self.out = None


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes records(page, url, html, sha1, refers_to) to archives: a row (folder, files, records) for each task.

    sha1 is the payload's, in hexadecimal. refers_to null makes a response, else a revisit. Null html is an
    empty payload. The frame must be run once, as each run writes anew.
    """

    def run(batches):
        fs, path = filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        w = _Writer(fs, f"{path}/{name}")
        for part in slices(batches, "html"):
            cols = [values(part, c).to_pylist() for c in ("page", "url", "html", "sha1", "refers_to")]
            for page, url, html, sha1, refers in zip(*cols):
                payload, uri = (html or "").encode(), re.sub(r"[\x00-\x20\x7f]", "", url or "")
                w.add(record("response" if refers is None else "revisit", page, uri, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), len(payload), refers))
        w.finish()
        if w.files:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([w.files], pa.int64()), pa.array([w.records], pa.int64())], names=["folder", "files", "records"])

    return records.mapInArrow(run, "folder string, files long, records long")


def read(spark: SparkSession, folders: list[str], with_payload: bool = False) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record.

    A file of about FILE_BYTES is one row of the reader; a fault in any record fails the job with WarcError.
    """
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches):
        for b in batches:
            for data in values(b, "content"):
                rows, size = [], 0
                for raw in frames(data.as_buffer().to_pybytes()):
                    rows.append(parse(raw)[: len(names)])
                    size += len(raw) if with_payload else 0
                    if len(rows) == 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folders).select("content")
    return found.mapInArrow(run, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else ""))


def archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a record for every page, then reads the archives back: page, payload_bytes, payload_digest,
    record_type and refers_to of every record.

    Of payloads that are equal (by SHA-1) and have min_bytes or more, the one with the largest page is stored;
    the others are revisits of it. Null html is an empty payload. Rows with the same id and payload are each
    stored as that response or revisit. Null ids are the smallest and come back null. An empty table gives an
    empty table. Without folder, one in the shared checkpoint folder is used.
    """
    spark = pages.sparkSession
    folder = folder or Scratch(spark, "warc").path("archives")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(row_id(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).alias("n"))
    heads = rows.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page").alias("head"), F.count("*").alias("k")).where("k > 1").select("sha", "head")
    linked = rows.join(heads, "sha", "left").select("page", "url", "html", F.col("sha").alias("sha1"), F.when(F.col("head") != F.col("page"), F.col("head")).alias("refers_to"))
    written = write(linked, folder).collect()  # a row for each task
    if not written:
        return spark.createDataFrame([], "page long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, [r.folder for r in written])
