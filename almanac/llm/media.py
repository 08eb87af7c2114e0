"""Media columns: payloads stored as sound files in ZIP archives, read by a Spark data source.

Writing: each task stores its rows' payloads as 8-bit WAV members of archives in a shared folder.
Names depend on the task's partition only and an archive appears under its name when it is whole,
so a repeated task replaces what it wrote.  Reading: the data source lists the archives and plans
byte ranges of them; a task reads the archive's own directory, takes the members that start in its
range, and streams them in Arrow batches.  Each member is fetched by its offset and, when that
fails, tried again on a fresh handle without touching the others.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from almanac.llm.common import scratch_path

#: Bytes of payload in one archive, of an archive in one task's range, of payload in one Arrow batch.
ARCHIVE, RANGE, BATCH = 64 << 20, 8 << 20, 4 << 20
MEMBERS = 50_000
#: A payload's length is a multiple of this.
UNIT = 64
TRIES = 3
RATE = 8000

MEDIA = "archive string, member string, offset long, media binary, tries int, error string"
FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def wav(payload: bytes, n_bytes: int) -> bytes:
    """A mono 8-bit WAV file of the payload; a chunk of its own keeps the length before padding."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    own = struct.pack("<4sIQ", b"nlen", 8, n_bytes)
    data = struct.pack("<4sI", b"data", len(payload)) + payload
    body = b"WAVE" + form + own + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def samples(media: bytes) -> tuple[bytes, int]:
    """The payload and its length before padding, read from a WAV file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, payload, n_bytes = 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"nlen":
            n_bytes = struct.unpack_from("<Q", media, at + 8)[0]
        elif name == b"data":
            payload = media[at + 8 : at + 8 + size]
            if len(payload) != size:
                raise ValueError("a WAV file ends early")
        at += 8 + size + size % 2
    if payload is None:
        raise ValueError("a WAV file without samples")
    return payload, len(payload) if n_bytes is None else n_bytes


def feature(payload: bytes) -> str:
    """Level, loudness, sign changes and the shares of eight loudness bands, from whole-number sums."""
    wave = np.frombuffer(payload, dtype=np.uint8)
    n, total, power, turns = len(wave), 0, 0, 0
    bands = np.zeros(8, dtype=np.int64)
    last = None
    for at in range(0, n, 1 << 20):
        part = wave[at : at + (1 << 20)].astype(np.int32) - 128
        total += int(part.sum(dtype=np.int64))
        power += int((part * part).sum(dtype=np.int64))
        sign = part >= 0
        turns += int((sign[1:] != sign[:-1]).sum()) + (last is not None and bool(last != sign[0]))
        last = sign[-1]
        bands += np.bincount(wave[at : at + (1 << 20)] >> 5, minlength=8)
    shares = "/".join(f"{x / n:.4f}" for x in bands)
    return f"mean={total / n:.6f};rms={(power / n) ** 0.5:.6f};zcr={turns / n:.6f};bands={shares}"


def stored(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text") -> int:
    """Writes every row's text as a member of archives in ``folder``; returns the number of members.

    Null texts are empty ones; repeated keys are separate members; a null key is kept as null.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        archive = None
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    draft = posixpath.join(root, f"_draft-{uuid.uuid4().hex}")
                    sink = fs.open_output_stream(draft)
                    archive, first, size = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1), n, 0
                name = name.as_py()
                payload, length = padded(value.as_py())
                member = zipfile.ZipInfo(f"{n:09d}.wav" if name is None else f"{n:09d}-{quote(name, safe='')}.wav")
                member.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(member, wav(payload, length))
                n += 1
                size += len(payload)
                if size >= ARCHIVE or n - first >= MEMBERS:
                    archive = finish(fs, archive, sink, draft, root, part, first)
        if archive is not None:
            finish(fs, archive, sink, draft, root, part, first)
        yield pa.RecordBatch.from_pydict({"members": pa.array([n], pa.int64())})

    def finish(fs, archive, sink, draft, root, part, first):
        archive.close()
        sink.close()
        fs.move(draft, posixpath.join(root, f"part-{part:06d}-{first:09d}.zip"))

    rows = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(write, "members long").agg(F.sum("members")).first()[0] or 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range, self.tries = int(options.get("range", RANGE)), int(options.get("tries", TRIES))

    def partitions(self) -> list[Range]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        whole = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.path.endswith(".zip"))
        return [Range(path, at, at + self.range) for path, size in whole for at in range(0, size, self.range)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        rows, size = [], 0
        with closing(fs.open_input_file(partition.path)) as source, zipfile.ZipFile(source) as archive:
            own = [x for x in archive.infolist() if partition.start <= x.header_offset < partition.end]
            for member in own:
                media, tries, error = self.member(fs, partition.path, archive, member)
                rows.append((partition.path, member.filename, member.header_offset, media, tries, error))
                size += len(media or b"")
                if size >= BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def member(self, fs, path: str, archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> tuple[bytes | None, int, str | None]:
        """The member's bytes, checked by its CRC; after a failure from a handle opened anew."""
        error = None
        for n in range(1, self.tries + 1):
            try:
                if n == 1:
                    return archive.read(member), n, None
                with closing(fs.open_input_file(path)) as source, zipfile.ZipFile(source) as again:
                    return again.read(member), n, None
            except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as problem:
                error = f"{type(problem).__name__}: {problem}"
        return None, self.tries, error


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "member", "offset", "media", "tries", "error"])


class ArchiveSource(DataSource):
    """Members of the ZIP archives under ``path``; options ``range`` (bytes a task) and ``tries``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEDIA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Rows of archive, member, offset, media, tries, error; a member that never reads has an error and no media."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def examined(media: DataFrame) -> DataFrame:
    """Per member its key (as text), FACTS from the stored bytes, and its error; members in error have no facts."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                key = unquote(name[10:-4]) if name[9] == "-" else None
                if not value.is_valid:
                    rows.append((key, *[None] * 7, error))
                    continue
                stored_form = value.as_py()
                payload, n_bytes = samples(stored_form)
                rows.append((key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored_form), hashlib.sha256(stored_form).hexdigest(), feature(payload), None))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["key", *(x.split()[0] for x in FACTS.split(", ")), "error"])

    return media.select("member", "media", "error").mapInArrow(facts, f"key string, {FACTS}, error string")


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Every text as a media member, read back and examined; a member that cannot be read fails the query.

    A null or empty text is 64 bytes 0; rows that repeat are members of their own, a null doc_id
    stays null; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch_path(spark, "media")
    stored(docs, folder)
    found = examined(read(spark, folder))
    key = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("a member cannot be read: "), "error"))).otherwise(F.col("key"))
    return found.withColumn("doc_id", key.cast(docs.schema["doc_id"].dataType)).select("doc_id", *(x.split()[0] for x in FACTS.split(", ")))
