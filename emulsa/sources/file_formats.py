"""Python data sources: ``named_files`` writes a file a row, ``pair_files`` and ``replay_files`` read training files.

``named_files`` (name, content): a task writes under ``_temporary``; the driver moves the files of the attempts that Spark
committed to their names, so that a repeated task leaves no second file and a failed job none at all.  Mode
``append`` keeps what is there and replaces files of the same name, ``overwrite`` clears the folder's files first.

``pair_files`` and ``replay_files`` plan partitions by file: as many files a partition as hold ``partition_mb`` together;
by default a 256th of all bytes, but 1 MB at least (a quarter of a million pixels) and 16 MB at most.
A file that can't be read raises, or with ``skip`` is left out.  Option ``path`` is a folder or a file on
any file system that Arrow knows (file, hdfs, s3); folders are searched for ``*.bin`` files, in all their folders.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from emulsa.sources import training_files as tf


def located(path: str) -> tuple[fs.FileSystem, str]:
    if not path:
        raise ValueError("option path is missing")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- sink ---------------------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _folder(self, at: str) -> str:
        return f"{at}/_temporary/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        store, at = located(self.path)
        context = TaskContext.get()
        folder = f"{self._folder(at)}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            name = row["name"]
            if not name or name != posixpath.basename(name) or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} is no file name")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(row["content"] or b""))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = located(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        store.create_dir(at, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(at)):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
        for m in done:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = located(self.path)
        if store.get_file_info(self._folder(at)).type != fs.FileType.NotFound:
            store.delete_dir(self._folder(at))
        rest = store.get_file_info(fs.FileSelector(f"{at}/_temporary", allow_not_found=True))
        if not rest and store.get_file_info(f"{at}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/_temporary")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options.get("path", ""), overwrite)


# --- scans --------------------------------------------------------------------------------------------
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}


#: Partitions by default, and what each holds at least and at most: bytes are compact here, a pixel takes four.
PARTITIONS, LEAST, MOST = 256, 1e6, 16e6


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class TrainingReader(DataSourceReader):
    def __init__(self, options: dict, rows, columns: str):
        self.path, self.rows = options.get("path", ""), rows
        self.schema = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in columns.split(", ")])
        self.skip = options.get("skip", "false").lower() == "true"
        self.most = float(options["partition_mb"]) * 1e6 if "partition_mb" in options else None

    def partitions(self) -> list[Files]:
        store, at = located(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".bin") and "/_temporary/" not in f.path]
        parts: list[list[str]] = []
        room = 0.0
        most = min(max(sum(f.size for f in found) / PARTITIONS, LEAST), MOST) if self.most is None else self.most
        for f in sorted(found, key=lambda f: f.path):
            if not parts or f.size > room:
                parts.append([])
                room = most
            parts[-1].append(f.path)
            room -= f.size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as f:
                    made = self.rows(path, f.read())
            except (ValueError, OSError):
                if not self.skip:
                    raise
                continue
            yield from pa.Table.from_pandas(made[self.schema.names], self.schema, preserve_index=False).to_batches(max_chunksize=65536)


class PairFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pair_files"

    def schema(self) -> str:
        return tf.PAIR_ROWS

    def reader(self, schema) -> DataSourceReader:
        return TrainingReader(dict(self.options), tf.pair_rows, tf.PAIR_ROWS)


class ReplayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay_files"

    def schema(self) -> str:
        return tf.REPLAY_ROWS

    def reader(self, schema) -> DataSourceReader:
        return TrainingReader(dict(self.options), tf.replay_rows, tf.REPLAY_ROWS)


def register(spark: SparkSession) -> None:
    for source in (NamedFiles, PairFiles, ReplayFiles):
        spark.dataSource.register(source)


def save_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (name, content) as files."""
    register(files.sparkSession)
    files.select("name", "content").write.format("named_files").mode(mode).option("path", path).save()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, length and SHA-256 of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))
