"""Operator 5: media columns: texts as 8-bit images in archives, read back by a custom data source.

Writing. The payload (UTF-8 bytes, then zero bytes up to a positive multiple of 64) is stored as the samples of a
greyscale image of 64 columns (PNG, 8 bits a sample, so lossless). Each task appends its images to archives (ZIP, members
stored as they are) in the shared folder under names of its own; a manifest, written by Spark's committer, lists the
archives of the attempts that count, so retried or lost attempts leave only unread files.

Reading. The data source takes the manifest, cuts every archive into byte ranges and gives each range to a partition. A
partition reads the archive's own directory, takes the members whose headers begin inside its range, and yields Arrow
batches bounded in bytes. A member that can't be read or whose checksum is wrong is read again by its offset, alone; when
that fails too, the row carries the error or the read stops, as asked. An archive whose directory can't be read is one row
with the error and no id.

Cases: null text counts as empty (64 zero bytes); equal texts give equal media, so equal values; null ids and repeated
rows are members of their own; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_path, read

COLUMNS = 64
#: Bytes of an archive, of a partition's range in it, and of a batch.
ARCHIVE, RANGE, BATCH = 32 << 20, 16 << 20, 8 << 20
TRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % COLUMNS or (0 if data else COLUMNS)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """payload (a positive multiple of COLUMNS bytes) as the samples of a greyscale image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    lines = np.zeros((len(rows), COLUMNS + 1), np.uint8)  # a filter byte, none, before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", COLUMNS, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"payload-bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes) of to_png(); ValueError if anything is not as written."""
    if media[:8] != SIGNATURE:
        raise ValueError("no image")
    at, size, n_bytes, packed = 8, None, None, b""
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if media[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt":
            n_bytes = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed += data
        at += 12 + length
    if size is None or n_bytes is None or size[0] != COLUMNS or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError(f"header {size}")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], COLUMNS + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes(), n_bytes


def write_archives(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", archive_bytes: int = ARCHIVE) -> str:
    """Store every row's payload in archives under folder; returns the manifest's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out = archive = name = None
        members = size = 0

        def done() -> pa.RecordBatch:
            archive.close()
            out.close()
            info = fs.get_file_info(f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([info.size], pa.int64()), "members": pa.array([members], pa.int64())})

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                if archive is None:
                    name, members, size = f"{uuid.uuid4().hex}.zip", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                media = to_png(*payload_of(t.as_py()))
                entry = zipfile.ZipInfo(f"{members:08d}.png")
                entry.comment = json.dumps(i.as_py()).encode()
                archive.writestr(entry, media)
                members, size = members + 1, size + len(media)
                if size >= archive_bytes:
                    yield done()
                    archive = None
        if archive is not None:
            yield done()

    manifest = f"{folder}-manifest"
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text).mapInArrow(run, "archive string, bytes long, members long")
    rows.write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.manifest = options["path"], options["manifest"]
        self.range, self.tries = int(options.get("rangebytes", RANGE)), int(options.get("tries", TRIES))
        self.stop = options.get("onerror", "stop") == "stop"

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from the manifest: a row for each archive, none for members."""
        import pyarrow.dataset as ds

        fs, root = filesystem(self.manifest)
        listed = ds.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(["archive", "bytes"])
        cuts = [ByteRange(a, s, min(s + self.range, n)) for a, n in zip(listed["archive"].to_pylist(), listed["bytes"].to_pylist()) for s in range(0, n, self.range)]
        return cuts or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, root = filesystem(self.folder)
        path = f"{root}/{part.archive}"
        rows: list[tuple] = []
        size = 0
        try:
            entries = again(lambda: directory(fs, path), self.tries)
        except OSError as e:
            if self.stop:
                raise OSError(f"{path}, directory: {e}") from e
            # its members are unknown: one row for the archive, from its first range
            entries, rows = [], [(None, None, None, None, f"{part.archive}, directory: {e}")] if part.start == 0 else []
        for entry in entries:
            if not part.start <= entry.header_offset < part.end:
                continue
            try:
                row = again(lambda e=entry: member(fs, path, e), self.tries)
            except OSError as e:
                if self.stop:
                    raise OSError(f"{path}, offset {entry.header_offset}: {e}") from e
                row = (json.loads(entry.comment), None, None, None, str(e))
            rows.append(row)
            size += len(row[2] or b"") + len(row[3] or b"")
            if size >= BATCH:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


SCHEMA = "doc_id string, n_bytes long, payload binary, media binary, error string"


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "payload", "media", "error"])


def again(f, tries: int):
    """f(), and so again after a failure that may pass."""
    for k in range(tries):
        try:
            return f()
        except (OSError, ValueError, EOFError, struct.error, zlib.error, zipfile.BadZipFile) as e:
            if k + 1 == tries:
                raise OSError(str(e)) from e
            time.sleep(0.1 * 2**k)


def directory(fs, path: str) -> list[zipfile.ZipInfo]:
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
        return archive.infolist()


#: The file a worker reads just now, kept open between its members.
_open: dict[str, object] = {}


def member(fs, path: str, entry: zipfile.ZipInfo) -> tuple:
    """The row of one member, read by its offset alone. A failure closes the file, so the next try opens it anew."""
    try:
        if path not in _open:
            _open.clear()
            _open[path] = fs.open_input_file(path)
        f = _open[path]
        f.seek(entry.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member here")
        f.seek(entry.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        media = f.read(entry.compress_size)
        if len(media) != entry.file_size or zlib.crc32(media) != entry.CRC:
            raise ValueError("checksum of the member")
        payload, n_bytes = from_png(media)
        return json.loads(entry.comment), n_bytes, payload, media, None
    except (OSError, ValueError, EOFError, struct.error, zlib.error):
        _open.clear()
        raise


class ArchiveSource(DataSource):
    """Members of the archives under `path` that `manifest` lists; options rangeBytes, tries, onError (stop, row)."""

    @classmethod
    def name(cls) -> str:
        return "image_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, manifest: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("image_archives").options(manifest=manifest, **options).load(folder)


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and 64 bits: which of 64 equal stretches are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8).astype(float)
    parts = x.reshape(COLUMNS, -1).mean(1)
    bits = np.packbits(parts > x.mean()).tobytes().hex()
    return f"{x.mean():.4f} {x.std():.4f} {bits}"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of what was read back."""
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, m = b.column(2).to_pylist(), b.column(3).to_pylist()
            columns = [
                pa.array([len(x) for x in p], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in p], pa.string()),
                pa.array([zlib.crc32(x[-COLUMNS:]) for x in p], pa.int64()),
                pa.array([len(x) for x in m], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in m], pa.string()),
                pa.array([feature(x) for x in p], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    return media.mapInArrow(run, schema)


def op5_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as an image and read back."""
    docs = read(spark, sf_dir, "documents")
    folder = fresh_path(spark, "archives")
    out = media_features(read_archives(spark, folder, write_archives(docs, folder)))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
