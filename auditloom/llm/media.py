"""Media columns: texts stored as 8-bit audio in archives, and a Spark data source that reads archives by byte ranges."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir, table
from .vectext import cuts

FRAME = 192
#: A RIFF/WAVE header of 44 bytes for 8-bit unsigned mono samples.
RATE, HEADER = 8000, 44
#: Sizes of a ZIP member's local header before its name, and of that header's two length fields.
LOCAL, LENGTHS = 30, slice(26, 30)


def padded(data: bytes) -> bytes:
    """data with bytes 32 up to a positive multiple of 192."""
    return data + b" " * (-len(data) % FRAME or (0 if data else FRAME))


def wav(samples: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a file by wav()."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack_from("<HHIIHH", media, 20)[-1] != 8 or media[36:40] != b"data":
        raise ValueError("not 8-bit WAVE")
    n = struct.unpack_from("<I", media, 40)[0]
    if len(media) != HEADER + n:
        raise ValueError("cut short")
    return media[HEADER:]


def feature(samples: bytes) -> str:
    """Mean, root mean square about it, crossings of it, and centroid of the frames' summed power spectrum."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.mean()
    above = x > mean
    power = np.zeros(FRAME // 2 + 1)
    for at in range(0, len(x), FRAME << 10):
        part = x[at : at + (FRAME << 10)].reshape(-1, FRAME).astype(np.float32) - np.float32(mean)
        power += (np.abs(np.fft.rfft(part, axis=1)) ** 2).sum(axis=0, dtype=np.float64)
    total = power.sum()
    centroid = float((power * np.arange(len(power))).sum() / total) if total > 0 else 0.0
    return f"mean={mean:.4f};rms={x.std():.4f};crossings={int((above[1:] != above[:-1]).sum())};centroid={centroid:.3f}"


def write_archives(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes docs as ZIP archives of WAVE members into folder (a URI that all executors reach); returns a lazy table
    (name, members, bytes), which has to be run for the files to appear.

    An archive's name has its attempt in it, and the table, once written as `_written` in the folder, lists those of the
    attempts that Spark committed. So what a task leaves that runs again, or twice at once, is read by nobody.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        part, turn, buf, zip_, n = TaskContext.get().partitionId(), 0, io.BytesIO(), None, 0

        def close() -> pa.RecordBatch:
            zip_.close()
            name = f"media-{part:06d}-{turn:05d}-{uuid.uuid4().hex[:12]}.zip"
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(buf.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([buf.getbuffer().nbytes])], ["name", "members", "bytes"])

        for batch in batches:
            done = 0
            for to in cuts(batch.column("text"), 1 << 20):
                ids, texts = (batch.column(c).slice(done, to - done).to_pylist() for c in ("id", "text"))
                done = to
                for i, text in zip(ids, texts, strict=True):
                    if zip_ is None:
                        zip_, n = zipfile.ZipFile(buf := io.BytesIO(), "w", zipfile.ZIP_DEFLATED, compresslevel=1), 0
                    data = (text or "").encode()
                    member = zipfile.ZipInfo(f"{n:07d}.wav")  # dated 1980: bytes depend on the rows alone
                    member.compress_type, member.comment = zipfile.ZIP_DEFLATED, json.dumps([i, len(data)]).encode()
                    zip_.writestr(member, wav(padded(data)), compresslevel=1)
                    n += 1
                    if buf.tell() >= archive_bytes:
                        yield close()
                        zip_, turn = None, turn + 1
        if zip_ is not None:
            yield close()

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "name string, members long, bytes long")


def retried(read: Callable, attempts: int = 3, pause: float = 0.2):
    """What read() returns; errors of storage, and of bytes that are short or damaged, are tried again after a growing pause."""
    for left in range(attempts - 1, -1, -1):
        try:
            return read()
        except (OSError, ValueError, EOFError, struct.error, zlib.error, zipfile.BadZipFile):
            if not left:
                raise
            time.sleep(pause)
            pause *= 2


def member_bytes(store: fs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
    """One member read by its offset alone and checked against its checksum; independent of every other member."""
    with store.open_input_file(path) as f:
        head = f.read_at(LOCAL, info.header_offset)
        if len(head) != LOCAL:
            raise ValueError(f"{path} is cut short")
        name, extra = struct.unpack("<HH", head[LENGTHS])
        raw = f.read_at(info.compress_size, info.header_offset + LOCAL + name + extra)
    data = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError(f"{info.filename} in {path} is damaged")
    return data


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, split: int, batch: int):
        self.folder, self.split, self.batch = folder, split, batch

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges of the folder's archives, planned from the names and sizes in its table `_written`, or of a folder
        without one, from its files; an archive's own directory is read by the tasks that get its ranges."""
        store, path = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{path}/_written").type == fs.FileType.Directory:
            written = dataset(f"{path}/_written", filesystem=store, format="parquet").to_table(columns=["name", "bytes"])
            files = [(f"{path}/{n}", size) for n, size in zip(written["name"].to_pylist(), written["bytes"].to_pylist(), strict=True)]
        else:
            files = [(i.path, i.size) for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(".zip")]
        ranges = [ArchiveRange(name, at, min(at + self.split, size)) for name, size in sorted(files) for at in range(0, size, self.split)]
        return ranges or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        """The members that begin in the range, in batches of bounded size."""
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)

        def listed() -> list[zipfile.ZipInfo]:
            with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                return [m for m in z.infolist() if partition.start <= m.header_offset < partition.end]

        members = retried(listed)
        rows, size = [], 0
        for m in members:
            i, n = json.loads(m.comment)
            rows.append((i, n, m.header_offset, retried(lambda m=m: member_bytes(store, partition.path, m))))
            size += m.file_size
            if size >= self.batch:
                yield self.packed(partition.path, rows)
                rows, size = [], 0
        if rows:
            yield self.packed(partition.path, rows)

    @staticmethod
    def packed(path: str, rows: list[tuple]) -> pa.RecordBatch:
        ids, n, at, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "archive", "at", "media"])


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder): one row for each member. Options: split_bytes, batch_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, n_bytes long, archive string, at long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split_bytes", 4 << 20)), int(self.options.get("batch_bytes", 2 << 20)))


def media_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of rows (id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column("media"):
                data = m.as_py()
                x = samples_of(data)
                rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(x)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("id", "n_bytes", "media").mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, archive_bytes: int = 16 << 20) -> DataFrame:
    """docs' texts as media rows (id, n_bytes, archive, at, media), written to archives in the shared folder and read back.

    Null texts count as empty, and an empty text is one frame of bytes 32; repeated rows and null ids are members of their
    own; empty docs make no archives and no rows; other columns are not read. Ids are whole numbers, any other type is a TypeError.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("ids are whole numbers")
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    write_archives(docs.withColumn(id_col, F.col(id_col).cast("long")), folder, id_col=id_col, text_col=text_col, archive_bytes=archive_bytes).write.parquet(f"{folder}/_written")
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(folder)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(stored_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_media": op7_media}
