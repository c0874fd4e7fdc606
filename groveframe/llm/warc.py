"""WARC archives compressed record by record with a Zstandard dictionary that the file carries in front.

A file begins with a skippable frame that holds the dictionary, built from the first records of that file; then each record is a
frame of its own. Pages with equal payloads are archived once: the one with the smallest page_id as ``response``, the others as
``revisit`` records that name it, if the payload has at least ``least_bytes`` bytes.

Each task writes one file into the shared folder, every attempt under a new name; only files named by the written manifest are
read. The reader streams a file, so neither side holds a whole archive.

Defined cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; rows that repeat the page_id of a response
are responses too; rows with a null page_id revisit an equal payload that has an id, or else are responses; an empty table
gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, one_task_each, scratch, table

#: Fixed values of the compressed WARC format and of the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A dictionary is built from so many bytes of a file's first records, and has so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
DATE = "2000-01-01T00:00:00Z"
SALTS = 16
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *((k, v) for k, v in fields if v is not None), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    target = " ".join((url or "").split()).replace(" ", "%20") or f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Record-ID", record_id(page_id, target)), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("WARC-Profile", PROFILE if revisit else None), ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", refers_to if revisit else None), ("X-Payload-Length", len(payload)),
    ]
    return record("revisit" if revisit else "response", fields, block)


def build_dictionary(samples: list[bytes]):
    """A trained dictionary, or for too few samples their own bytes as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class WarcWriter:
    def __init__(self, uri: str, level: int = 3):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.level, self.compressor = fs.open_output_stream(path, compression=None), level, None
        self.held = [record("warcinfo", [("WARC-Record-ID", record_id(None, uri)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        self.size = self.n = 0

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.compressor is not None:
            self.file.write(self.compressor.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        import zstandard

        built = build_dictionary(self.held)
        raw = built.as_bytes()
        self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=built, write_checksum=True)
        for data in self.held:
            self.file.write(self.compressor.compress(data))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self.start()
        self.file.close()


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in order: header fields and block."""
    import zstandard

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri} has no dictionary frame")
        dictionary = zstandard.ZstdCompressionDict(file.read(size))
        stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(file, read_across_frames=True), 1 << 20)
        while (line := stream.readline()) not in (b"",):
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"{uri}: not a record: {line[:40]!r}")
            fields = {}
            while line := stream.readline().strip():
                k, _, v = line.decode().partition(": ")
                fields[k] = v
            block = stream.read(int(fields["Content-Length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: record without an end")
            yield fields, block


def with_first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first): the smallest page_id of equal payloads, null where a payload occurs once or is too small."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    counted = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a payload that fills a third of the table is dealt over SALTS tasks
    firsts = counted.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "html", "first")


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0) -> DataFrame:
    """Writes all pages below ``out``; returns the manifest: path, n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri = None, f"{out}/{uuid.uuid4().hex}.warc.zst"
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                writer = writer or WarcWriter(uri)
                writer.add(page_record(page_id, url, html, first, first is not None and page_id != first))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([writer.n], pa.int64())], ["path", "n_records"])

    return materialize(with_first_pages(pages, least_bytes).mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per page record of all archives; the digest of a response is computed from its payload and held against its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for fields, block in read_records(path):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if base32_sha1(payload) != digest or len(payload) != size:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    rows.append((number("X-Page-Id"), size, digest, kind, number("X-Refers-To-Page-Id")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return one_task_each(manifest.select("path"), "path").mapInArrow(read, SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


#: DuckDB: base32 of a SHA-1 from its four groups of 40 bits.
OP8_SQL = """
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY p) AS first
      FROM (SELECT page_id, coalesce(html, '') AS p, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages))
"""
