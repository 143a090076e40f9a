"""Numbered states of a table in a shared folder, committed one after the other.

A state is a small JSON file named by its number.  It is written under a
temporary name and renamed, which fails if the number is taken: of two writers
that started from one state the second gets ``Conflict`` and starts again.
Readers see whole states only, and data files become visible with the state
that lists them.  The folder must be on a file system with an atomic rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the same number."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/_versions"
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Committed numbers in order."""
        system, folder = self._system(), self._fs.Path(self.folder)
        if not system.exists(folder):
            return []
        names = (s.getPath().getName() for s in system.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._system().open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The last number and its state; 0 and an empty state if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, state: dict) -> None:
        """Makes ``state`` the state of this number, or raises ``Conflict``."""
        system, held, wanted = self._system(), self._path(f"tmp-{uuid.uuid4().hex}"), self._path(f"{number:012d}.json")
        stream = system.create(held, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = self._fs.FileContext.getFileContext(held.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(held, wanted, self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0))
        except Exception as error:
            system.delete(held, False)
            if system.exists(wanted):
                raise Conflict(f"version {number} of {self.folder}") from error
            raise
