"""Small shared values in numbered files: the last number counts, and a number is written once.

A writer names the number that it has read; the next one is taken by a rename that does not replace, which a file
system grants to one writer only. So of two writers that have read the same value one is refused, and none is lost.
Files are reached through Hadoop's file system, so any store with such renames will do.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Older numbers that stay for readers who are about to open them.
KEPT = 16


class Conflict(RuntimeError):
    """Another writer has been faster."""


class Numbered:
    """Reads and writes the values of folders."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._hadoop, self._gateway = jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(configuration)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), configuration)

    def path(self, name: str):
        return self._hadoop.Path(name)

    def numbers(self, folder: str) -> list[int]:
        """The numbers that a folder has, in order."""
        if not self._fs.exists(self.path(folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self.path(folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self, folder: str) -> tuple[int, dict | None]:
        """The last number and its value; 0 and None where nothing was written."""
        found = self.numbers(folder)
        if not found:
            return 0, None
        stream = self._fs.open(self.path(f"{folder}/{found[-1]:010}.json"))
        try:
            return found[-1], json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def add(self, folder: str, seen: int, value: dict) -> int:
        """Writes the value that follows number ``seen``; Conflict if that is no longer the last one."""
        if self.numbers(folder)[-1:] not in ([], [seen]):
            raise Conflict(folder)
        passing, final = self.path(f"{folder}/.{uuid.uuid4().hex}"), self.path(f"{folder}/{seen + 1:010}.json")
        out = self._fs.create(passing, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        try:
            self._context.rename(passing, final, self._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(passing, False)
            if self._fs.exists(final):
                raise Conflict(folder) from e
            raise
        for old in self.numbers(folder):
            if old <= seen + 1 - KEPT:
                self._fs.delete(self.path(f"{folder}/{old:010}.json"), False)
        return seen + 1

    def folders(self, root: str) -> list[str]:
        """The folders in a folder, by name."""
        if not self._fs.exists(self.path(root)):
            return []
        return sorted(s.getPath().toString() for s in self._fs.listStatus(self.path(root)) if s.isDirectory())

    def remove(self, folder: str) -> None:
        self._fs.delete(self.path(folder), True)
