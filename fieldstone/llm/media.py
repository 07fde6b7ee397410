"""Media columns (op3): payloads as images in archives of the shared folder, read back through a data source of our own."""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch, slices

WIDTH = 64
#: An archive is closed at this size; its directory, which a reader loads whole, is bounded so.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive that one partition of the source reads, and of payloads in one Arrow batch.
SPLIT_BYTES, BATCH_BYTES = 16 << 20, 2 << 20
#: Tries of one member before the task fails.
TRIES = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of the image's width."""
    return data + bytes(max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def write_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image of 64 columns with the payload as its samples, and the unpadded length in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows by 64) and the unpadded length. Raises ValueError on damage."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, shape, n_bytes = 8, b"", (0, 0), -1
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n_bytes = int(body[6:])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are written here")
    return lines[:, 1:], n_bytes


def image_feature(samples: np.ndarray) -> str:
    """Mean and spread of the samples, and a hash of 8 by 8 cells: a bit is set where the cell is lighter than the whole."""
    height = len(samples)
    edges = np.arange(8) * height // 8
    bands = [samples[a : max(a + 1, b)].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), height], strict=True)]
    mean, spread = float(samples.mean()), float(samples.std())
    bits = np.packbits(np.array(bands).ravel() > mean).tobytes().hex()
    return f"{bits}:{mean:.3f}:{spread:.3f}"


class _Sink:
    """The part of a file that zipfile needs to write a stream."""

    def __init__(self, stream):
        self.stream, self.size = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def write_archives(df: DataFrame, folder: str, id_col: str, bytes_of: str) -> int:
    """Stores each row's payload (column bytes_of: text, null as empty) as a member of an archive in `folder`; returns the members' number.
    A task writes under a name of its attempt and renames at the end, so a repeated task replaces equal files."""

    def run(batches):
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        done, archive, row = [], None, 0

        def close():
            nonlocal archive
            if archive:
                sink, stream, out, temporary, n = archive
                out.close()
                stream.close()
                system.move(temporary, f"{root}/part-{ctx.partitionId():07d}-{len(done):05d}.zip")
                done.append((n[0], sink.size))
                archive = None

        for part, texts in slices(batches, bytes_of):
            for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                data = text.encode()
                if archive is None:
                    temporary = f"{root}/_{ctx.taskAttemptId()}-{len(done)}"
                    stream = system.open_output_stream(temporary)
                    sink = _Sink(stream)
                    archive = sink, stream, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), temporary, [0]
                info = zipfile.ZipInfo(f"{row}/{'n' if key is None else 'v' + str(key)}")
                archive[2].writestr(info, write_png(padded(data), len(data)))
                archive[4][0] += 1
                row += 1
                if archive[0].size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.record_batch([pa.array([n for n, _ in done], pa.int64()), pa.array([s for _, s in done], pa.int64())], ["members", "bytes"])

    return df.select(id_col, bytes_of).mapInArrow(run, "members long, bytes long").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


@dataclass
class ArchiveRange(InputPartition):
    """Members of an archive whose headers begin in a range of bytes."""

    path: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, split: int):
        self.folder, self.split = folder, split

    def partitions(self) -> list[ArchiveRange]:
        """From the archives' sizes alone; their directories are read by the tasks."""
        system, root = pafs.FileSystem.from_uri(self.folder)
        files = [f for f in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".zip")]
        return [ArchiveRange(f.path, at, at + self.split) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)] or [ArchiveRange("", 0, 0)]

    def read(self, part: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = pafs.FileSystem.from_uri(self.folder)
        with system.open_input_file(part.path) as source, zipfile.ZipFile(source) as archive:
            members = sorted((m for m in archive.infolist() if part.start <= m.header_offset < part.stop), key=lambda m: m.header_offset)
        rows, size = [], 0
        for m in members:
            data = member(system, part.path, m)
            rows.append((part.path, m.filename, m.header_offset, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["archive", "member", "offset", "media"])


_OPEN: dict[str, object] = {}


def member(system, path: str, info: zipfile.ZipInfo, tries: int = TRIES) -> bytes:
    """One member by its offset, checked; it alone is read again, from a newly opened file, when that fails."""
    for left in reversed(range(tries)):
        try:
            if path not in _OPEN:
                _OPEN.clear()
                _OPEN[path] = system.open_input_file(path)
            source = _OPEN[path]
            source.seek(info.header_offset + 26)
            name, extra = struct.unpack("<HH", source.read(4))
            source.seek(info.header_offset + 30 + name + extra)
            data = source.read(info.compress_size)
            if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                raise OSError(f"damaged member {info.filename} of {path}")
            return data
        except (OSError, ValueError, struct.error) as e:
            _OPEN.pop(path, None)
            if not left:
                raise OSError(f"member {info.filename} of {path} can't be read: {e}") from e
            time.sleep(0.1 * (tries - left))
    raise AssertionError


class ArchiveSource(DataSource):
    """spark.read.format("media_archives").load(folder): archive, member, offset, media. Option split_bytes sizes the partitions."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores each whole text as an image and gives the stored images: id_col, archive, member, offset, media.

    The payload is the text's UTF-8 bytes (null: none) with zeros up to a positive multiple of 64. Archives go to `folder`, else to a new
    place in the shared folder. Every row is a member, repeated rows and null ids too; an empty table gives no rows; equal texts give
    equal images."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    spark.dataSource.register(ArchiveSource)
    key = F.regexp_extract("member", r"(?s)^\d+/(.)(.*)$", 1), F.regexp_extract("member", r"(?s)^\d+/(.)(.*)$", 2)
    stored = spark.read.format("media_archives").load(folder)
    return stored.select(F.when(key[0] == "v", key[1]).cast(docs.schema[id_col].dataType).alias(id_col), "archive", "member", "offset", "media")


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads images back: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for m in part.column(1):
                    media = m.as_py()
                    samples, n = read_png(media)
                    payload = samples.tobytes()
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(samples)))
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select(id_col, "media").mapInArrow(run, f"`{id_col}` {stored.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
