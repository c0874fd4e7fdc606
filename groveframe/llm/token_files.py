"""Token ids of documents in binary files of independent Zstandard frames with a trailing seek table.

A file is a series of Zstandard frames, each a block of whole documents; then a skippable frame with the id range and number of
documents of each block; then the seek table (Zstandard's seekable format): compressed size, content size and the low 32 bits
of xxh64 of the content for each frame. A reader takes the last bytes of a file, then fetches and decompresses only the frames
of the documents it wants. Blocks close at ``FRAME_TOKENS`` ids, so a document of any length has its place.

A block holds: number of documents (u32), width of an id in bytes (u32), then per document null flag (u8), doc_id (i64) and
number of ids (u32), then all ids.

Files are written by one task each into the shared folder, in ascending doc_id order over all files. Every attempt of a task
writes a file of its own; only the files that the written manifest names are read, so lost executors and repeated tasks do no
harm.

Defined cases: null texts count as empty and yield the end id alone; null ids come first; rows with the same id stand next to
each other, ordered by a hash of their text; an empty table gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, one_task_each, scratch, table

#: Fixed values of the Zstandard seekable format and its skippable frames.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_FOOTER, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: A frame closes with the document that brings it to so many ids.
FRAME_TOKENS = 1 << 17


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def pack_block(docs: list[tuple[int | None, bytes]], width: int) -> bytes:
    """The content of a frame from (doc_id, ids as bytes)."""
    heads = b"".join(struct.pack("<BqI", k is None, k or 0, len(ids) // width) for k, ids in docs)
    return struct.pack("<II", len(docs), width) + heads + b"".join(ids for _, ids in docs)


def unpack_block(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    n, width = struct.unpack_from("<II", data)
    at = 8 + 13 * n
    for i in range(n):
        null, key, count = struct.unpack_from("<BqI", data, 8 + 13 * i)
        yield (None if null else key), np.frombuffer(data, f"<u{width}", count, at)
        at += count * width


class TokenFileWriter:
    def __init__(self, uri: str, width: int, level: int = 3):
        import zstandard

        fs, path = opened(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.width, self.compressor = fs.open_output_stream(path, compression=None), width, zstandard.ZstdCompressor(level=level)
        self.docs: list[tuple[int | None, bytes]] = []
        self.size = self.n_docs = self.n_tokens = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.docs.append((key, ids))
        self.size += len(ids) // self.width
        if self.size >= FRAME_TOKENS:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.docs:
            data = pack_block(self.docs, self.width)
            frame = self.compressor.compress(data)
            self.file.write(frame)
            self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            keys = [k for k, _ in self.docs if k is not None] or [0]
            self.index.append((min(keys), max(keys), len(self.docs)))
            self.n_docs += len(self.docs)
            self.n_tokens += self.size
            self.docs, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<qqI", *x) for x in self.index)
        self.file.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_FOOTER)
        self.file.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.file.close()


class TokenFileReader:
    """Reads a token file from its end: the seek table and index first, then the frames that are asked for."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_FOOTER or flags != CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table")
        start = size - 9 - 12 * n
        raw = self.file.read_at(12 * n, start)
        self.frames = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.offsets = np.cumsum([0] + [f[0] for f in self.frames]).tolist()
        raw = self.file.read_at(20 * n, self.offsets[-1] + 8)
        self.index = [struct.unpack_from("<qqI", raw, 20 * i) for i in range(n)]

    def frame(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        import xxhash
        import zstandard

        size, content, checksum = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, self.offsets[i]), max_output_size=content)
        if len(data) != content or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return unpack_block(data)

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted documents, from the frames whose id range may hold them."""
        keys = np.array(sorted(wanted))
        for i, (low, high, _) in enumerate(self.index):
            if np.searchsorted(keys, low) < np.searchsorted(keys, high, "right"):
                yield from ((k, ids) for k, ids in self.frame(i) if k in wanted)

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts and writes them below ``out``; returns the manifest: part, path, n_docs, n_tokens of each file in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .subwords import encoder_of

        part, writer, encoder, uri = TaskContext.get().partitionId(), None, None, ""
        for batch in batches:
            if encoder is None:
                encoder = encoder_of(tokenizer, end_id)
                width = encoder.dtype.itemsize
                end = np.array([end_id], encoder.dtype).tobytes()
                uri = f"{out}/part-{part:06d}-{uuid.uuid4().hex}.ztok"
                writer = TokenFileWriter(uri, width)
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 512):
                for key, ids in zip(keys[at : at + 512], encoder.encode(batch.column(1).slice(at, 512).to_pylist()), strict=True):
                    writer.add(key, ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]}, pa.schema({"part": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64()}))

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").drop("mark")
    return materialize(ordered.mapInArrow(write, "part int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All documents of the manifest's files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = TokenFileReader(path)
                for i in range(len(reader.frames)):
                    rows = []
                    for key, ids in reader.frame(i):
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    # one row a file: the running total over files is small; one task a file (a number given is not merged by adaptive execution)
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("start"))
    return one_task_each(files, "path").mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))


def token_rows(docs: DataFrame) -> DataFrame:
    """Writes and reads back the token files of ``docs`` with the public 50k byte-level BPE and end id 2."""
    import public_tokenizers

    manifest = write_token_files(docs, scratch(docs.sparkSession, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_files(manifest)
