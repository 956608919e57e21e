"""One file for each row, under its relative path: a data source whose writer commits, and a table of what was committed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "path string, content string"
MANIFEST = "path string, status string, bytes long, uri string"


def refused(path: str | None) -> bool:
    """Paths that are none, or would leave the folder."""
    return not path or path.startswith("/") or any(x in ("", ".", "..") for x in path.split("/"))


@dataclass
class Written(WriterCommitMessage):
    """A task's rows of the manifest, as a file beside the others: its size doesn't go through the driver."""

    part: str | None
    files: int


class TreeWriter(DataSourceWriter):
    """Each task writes its rows' files, then one list of them. commit() names the lists of the tasks that Spark took; what a lost
    task has left is in none of them, and abort() deletes what it can still see."""

    def __init__(self, options: dict):
        self.folder, self.job = options["path"].rstrip("/"), options["job"]

    def write(self, iterator: Iterator) -> Written:
        store, root = fs.FileSystem.from_uri(self.folder)
        rows, made = [], set()
        for row in iterator:
            if refused(row.path) or row.content is None:
                rows.append((row.path, "refused" if refused(row.path) else "empty", 0, None))
                continue
            head, _, name = row.path.rpartition("/")
            folder = f"{root}/{head}" if head else root
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            data, at = row.content.encode(), f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(at) as f:
                f.write(data)
            store.move(at, f"{folder}/{name}")  # readers never see half a file
            rows.append((row.path, "written", len(data), f"{self.folder}/{row.path}"))
        if not rows:
            return Written(None, 0)
        part = f"_lists/{self.job}-{uuid.uuid4().hex}.json"
        store.create_dir(f"{root}/_lists", recursive=True)
        with store.open_output_stream(f"{root}/{part}") as f:
            f.write("\n".join(json.dumps(dict(zip(("path", "status", "bytes", "uri"), r, strict=True))) for r in rows).encode())
        return Written(part, len(rows))

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_committed-{self.job}") as f:
            f.write("\n".join(m.part for m in messages if m and m.part).encode())

    def abort(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m and m.part:
                store.delete_file(f"{root}/{m.part}")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options)


def emit(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (path, content) under a folder (a URI that all executors reach), a file a row, directories as in the paths.
    Returns the manifest (path, status, bytes, uri): written, empty (null content: no file) or refused (no path, or one that
    leaves the folder). Rows of one path are repeats of one file: the last to be written stays, and each is listed."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(TreeSource)
    files.select("path", "content").write.format("file_tree").mode("append").option("path", folder).option("job", job).save()
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/_committed-{job}") as f:
        parts = f.read().decode().split()
    return spark.read.schema(MANIFEST).json([f"{folder}/{p}" for p in parts]) if parts else spark.createDataFrame([], MANIFEST)


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, content) of the files that a manifest says were written; others in the folder are not read."""
    spark: SparkSession = manifest.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(folder)
    prefix = fs.FileSystem.from_uri(folder)[1]
    found = files.select(F.substring_index("path", prefix + "/", -1).alias("path"), F.col("content").cast("string").alias("content"))
    wanted = manifest.where("status = 'written'").groupBy("path").agg(F.max("bytes").alias("bytes"))
    return wanted.join(found, "path", "left").select("path", F.when(F.col("bytes") == 0, "").otherwise(F.col("content")).alias("content"))  # empty files aren't read


def statuses(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
