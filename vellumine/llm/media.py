"""Media columns: payloads as images in archives, read through a custom Spark data source.

Writing: each task stores its payloads as 8-bit grey PNG images (lossless) in ZIP archives in the
shared folder, and one row an archive in a manifest beside them: its path, where its directory lies, and the
entries at which ranges of about ``RANGE`` bytes begin. An archive is written under a name of its own,
so retried or lost tasks leave files that the manifest doesn't name.

Reading (format ``vellumine_media``): a partition is some ranges of archives' directories. They are planned from the
manifest, without opening an archive; for folders without one, from each archive's end record and a binary search for
offsets among the fixed-width directory entries, archives beside each other. Partitions hold about equal bytes
and there are at most ``PARTITIONS`` of them. A reader fetches its slice of a directory, then each member's byte range, and yields Arrow
batches of bounded size. A member is retried alone, by its offset, and checked against its CRC.

Edge cases: a null text counts as empty; an empty payload is one block of blanks; texts of any
length are stored whole; repeated rows are members of their own; a null doc_id stays null; an
empty table makes no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vellumine.llm.columns import pieces, tidied
from vellumine.session import scratch

#: Bytes in an image's row and in a unit of payload; bytes of an archive; of members read by a partition; of an Arrow batch.
UNIT, ARCHIVE, RANGE, BATCH = 192, 64 << 20, 16 << 20, 4 << 20
TRIES = 4
#: Partitions that a read has at most, and archives that are looked at together where there is no manifest.
PARTITIONS, TOGETHER = 100_000, 32
MANIFEST = "manifest"
#: Member names: doc_id (or null), payload bytes without padding, serial; fixed width, so directory entries are too.
NAME = "{:>20}_{:0>12}_{:0>9}.png"
NAME_BYTES = len(NAME.format(0, 0, 0))
ENTRY = 46 + NAME_BYTES
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, archive string, offset long, attempts int, error string"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system of pyarrow's and the path in it: local paths and file:, hdfs:, s3:, gs: URIs."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload: UTF-8 and blanks up to a positive multiple of UNIT; its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0), len(raw)


def png(payload: bytes) -> bytes:
    """An 8-bit grey image with UNIT pixels a row, each byte a sample."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    filtered = np.zeros((len(rows), UNIT + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that ``png`` made, checked."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, width, height = 8, b"", 0, 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at:at + 8])
        body = image[at + 8:at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n:at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that png() doesn't write")
    return rows[:, 1:].tobytes()


def write_archives(docs: DataFrame, where: str, doc_id: str = "doc_id", text: str = "text", most: int = ARCHIVE, ranged: int = RANGE) -> None:
    """Store every payload under ``where``, archives and their manifest (about input bytes / ``most`` and one archive a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(where)
        done: list[tuple[str, int, int, list[int], list[int]]] = []
        out = archive = None
        name, serial = "", 0
        cuts: list[int] = []
        offsets: list[int] = []

        def close() -> None:
            nonlocal out, archive
            if archive is not None:
                archive.close()
                out.close()
                done.append((name, archive.start_dir, serial, cuts, offsets))
            out = archive = None

        for batch in batches:
            for piece in pieces(batch, "text"):
                for key, whole in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    if archive is None:
                        name, serial, cuts, offsets = f"{uuid.uuid4().hex}.zip", 0, [], []
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}")
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    if not cuts or archive.fp.tell() - offsets[-1] >= ranged:
                        cuts.append(serial)
                        offsets.append(archive.fp.tell())
                    payload, n = padded(whole)
                    member = zipfile.ZipInfo(NAME.format("null" if key is None else key, n, serial))
                    archive.writestr(member, png(payload))
                    serial += 1
                    if archive.fp.tell() >= most or serial >= 60_000:  # within the plain ZIP format's 65,535 members
                        close()
        close()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=["name", "directory", "entries", "cuts", "offsets"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows.mapInArrow(tidied(run), "name string, directory long, entries long, cuts array<long>, offsets array<long>").write.parquet(f"{where}/{MANIFEST}")


class DirectoryRanges(InputPartition):
    """Entries [first, last) of archives' directories: (path, where the directory lies, first, last)."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]) -> None:
        self.ranges = ranges


def looked_at(path: str, size: int, ranged: int) -> tuple[str, int, int, list[int], list[int]]:
    """An archive's directory, and ranges of about ``ranged`` bytes, from its end record and a few entries."""
    fs, inner = open_fs(path)
    with fs.open_input_file(inner) as f:
        f.seek(size - 22)
        sign, entries, length, directory = struct.unpack("<4s6xHII2x", f.read(22))
        if sign != b"PK\x05\x06" or length != entries * ENTRY:
            raise ValueError(f"{path} isn't an archive of this kind")

        def offset(k: int) -> int:
            f.seek(directory + k * ENTRY + 42)
            return struct.unpack("<I", f.read(4))[0]

        cuts = [0] if entries else []
        for wanted in range(ranged, directory, ranged):
            cuts.append(bisect_left(range(entries), wanted, key=offset))
        cuts = sorted({c for c in cuts if c < entries})
        return path, directory, entries, cuts, [offset(c) for c in cuts]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.range = int(options.get("rangebytes", RANGE))

    def listed(self) -> list[tuple[str, int, int, list[int], list[int]]]:
        """Of each archive its path, where its directory lies, its entries, and the entries and offsets at which ranges begin."""
        where = self.options["path"].rstrip("/")
        fs, base = open_fs(where)
        files = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        if any(i.base_name == MANIFEST for i in files):
            parts = [i.path for i in fs.get_file_info(pafs.FileSelector(f"{base}/{MANIFEST}")) if i.path.endswith(".parquet")]
            rows = [r for p in sorted(parts) for r in pq.read_table(p, filesystem=fs, partitioning=None).to_pylist()]
            return [(f"{where}/{r['name']}", r["directory"], r["entries"], r["cuts"], r["offsets"]) for r in rows]
        found = sorted((f"{where}/{i.base_name}", i.size) for i in files if i.base_name.endswith(".zip"))
        with ThreadPoolExecutor(TOGETHER) as pool:
            return list(pool.map(lambda x: looked_at(*x, self.range), found))

    def partitions(self) -> list[DirectoryRanges]:
        """Ranges of about ``rangebytes`` of members each, or more where that would make too many."""
        ranges = []
        for path, directory, entries, cuts, offsets in self.listed():
            ends = [*cuts[1:], entries]
            sizes = np.diff([*offsets, directory]).tolist()
            ranges += [((path, directory, first, last), n) for first, last, n in zip(cuts, ends, sizes, strict=True) if last > first]
        most = max(self.range, -(-sum(n for _, n in ranges) // PARTITIONS))
        out: list[list] = []
        held = most
        for own, n in ranges:
            if held + n > most:
                out.append([])
                held = 0
            out[-1].append(own)
            held += n
        return [DirectoryRanges(r) for r in out] or [DirectoryRanges([])]

    def read(self, partition: DirectoryRanges) -> Iterator[pa.RecordBatch]:
        for own in partition.ranges:
            yield from self.members(*own)

    def members(self, path: str, at: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
        fs, inner = open_fs(path)
        arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("attempts", pa.int32()), ("error", pa.string())])
        with fs.open_input_file(inner) as f:
            f.seek(at + first * ENTRY)
            directory = f.read((last - first) * ENTRY)
        rows, held = [], 0
        for k in range(0, len(directory), ENTRY):
            crc, size = struct.unpack("<I4xI", directory[k + 16:k + 28])
            offset = struct.unpack("<I", directory[k + 42:k + 46])[0]
            key, n, _ = directory[k + 46:k + ENTRY].decode().strip().split("_")
            image, payload, attempts, error = None, None, 0, None
            for attempts in range(1, TRIES + 1):
                try:
                    image = fetch(fs, inner, offset, size, crc)
                    payload, error = samples(image), None
                    break
                except (OSError, ValueError, struct.error, zlib.error) as e:
                    error = str(e)[:200]
                    time.sleep(0.05 * 2**attempts if attempts < TRIES else 0)
            rows.append((None if key == "null" else int(key), int(n), payload, image if error is None else None, path, offset, attempts, error))
            held += len(payload or b"") + size
            if held >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)


def fetch(fs: pafs.FileSystem, path: str, offset: int, size: int, crc: int) -> bytes:
    """One member's bytes, by its offset alone."""
    with fs.open_input_file(path) as f:
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member starts here")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(offset + 30 + name + extra)
        data = f.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("a member's bytes differ from its directory entry")
    return data


class MediaSource(DataSource):
    """``spark.read.format("vellumine_media")`` over a folder of archives (option ``path``)."""

    @classmethod
    def name(cls) -> str:
        return "vellumine_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def feature(payload: bytes) -> str:
    """What is computed of an image: height, mean and deviation of its samples, and how many grey values it has."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(x))
    spread = float(np.sqrt((counts * (values - mean) ** 2).sum() / len(x)))
    return f"{len(x) // UNIT}x{UNIT} mean={mean:.6f} sd={spread:.6f} levels={int((counts > 0).sum())}"


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of what was read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column("doc_id"), b.column("n_bytes")
            payloads, images = b.column("payload").to_pylist(), b.column("media").to_pylist()
            yield pa.RecordBatch.from_arrays([
                ids, sizes, pa.array(map(len, payloads), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array(map(len, images), pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in images]), pa.array(map(feature, payloads)),
            ], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "payload", "media").mapInArrow(tidied(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """Members of the archives in a folder; those that failed all tries have null payload and an error."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("vellumine_media").option("path", where).load()


def op5(spark, sf_dir: str) -> DataFrame:
    """Every whole text stored as an image, read back by the data source, and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = scratch(spark, "media")
    write_archives(docs, where)
    members = read_archives(spark, where)
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("unread member: "), "error"))).otherwise(F.col("payload"))
    return describe(members.withColumn("payload", whole))
