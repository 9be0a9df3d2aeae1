"""The active model and the library's history, as files under one folder of any file system that Spark can reach.

A model is committed by renaming a finished file to its version's name: readers see a whole version or none,
and whatever a writer left before its rename is never read.  Of two writers of one version the
second finds the name taken and goes on to the next.  A reset is a version too.
History is append-only: each line is a file of its own, named by its time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.operators.learning import Network

RESET = "reset"
DIGITS = 12


class ModelStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _put(self, name: str, text: str) -> str:
        """Writes a file beside its place and returns its temporary name."""
        made = f"_writing/{name}-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(made), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return made

    def _commit(self, made: str, name: str) -> bool:
        self._fs.mkdirs(self._path(name).getParent())
        return not self._fs.exists(self._path(name)) and self._fs.rename(self._path(made), self._path(name))

    def _files(self, kind: str) -> list[str]:
        at = self._path(kind)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _save(self, text: str) -> int:
        made = self._put("model", text)
        while True:
            version = max((int(f[:DIGITS]) for f in self._files("models")), default=0) + 1
            if self._commit(made, f"models/{version:0{DIGITS}d}.json"):
                return version

    def save(self, model: Network) -> int:
        """Makes the model the active one; returns its version."""
        return self._save(model.to_json())

    def reset(self) -> int:
        version = self._save(RESET)
        self.append("Reset to the built-in model.")
        return version

    def load(self) -> Network | None:
        """The active model; none (so the built-in one) after a reset, before the first save and where the newest version can't be read."""
        files = self._files("models")
        if not files:
            return None
        lines = self.spark.read.text(f"{self.folder}/models/{files[-1]}", wholetext=True).first()  # one model
        try:
            return Network.from_json(lines.value) if lines and lines.value != RESET else None
        except (ValueError, TypeError, KeyError):
            return None

    def versions(self) -> DataFrame:
        """version and text of every model, the newest first."""
        if not self._files("models"):
            return self.spark.createDataFrame([], "version long, text string")
        found = self.spark.read.text(f"{self.folder}/models", wholetext=True)
        return found.select(F.substring(F.col("_metadata.file_name"), 1, DIGITS).cast("long").alias("version"), F.col("value").alias("text")).orderBy(F.desc("version"))

    def append(self, line: str) -> None:
        """Adds a line to the history."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.txt"
        if not self._commit(self._put("line", line), f"history/{name}"):
            raise OSError(f"{name} could not be committed")

    def history(self) -> DataFrame:
        """seq (a time that orders them) and line, the newest first."""
        if not self._files("history"):
            return self.spark.createDataFrame([], "seq long, line string")
        found = self.spark.read.text(f"{self.folder}/history", wholetext=True)
        return found.select(F.substring(F.col("_metadata.file_name"), 1, 20).cast("long").alias("seq"), F.col("value").alias("line")).orderBy(F.desc("seq"), "line")
