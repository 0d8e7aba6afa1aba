"""Tables that change together: a run's tables become visible at once, or not at all.

A run writes its tables into a folder of its own, then publishes them by one file,
``published/<version>``, that names the folder of every table.  That file is moved into place
with a rename that fails where one is there already, so of two writers that start from one
version the second fails, and a run that dies before leaves the version as it was.  Readers
take the last published version and keep it: its files are never written again.

This is a folder of Parquet tables and a pointer, not a table format: no log is replayed, rows
are not tracked, and files are dropped only by ``expire``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published a version since the one that a run started from."""


@dataclass(frozen=True)
class Version:
    """A published version: its number (0 before the first) and the folder of each table."""

    number: int
    folders: dict[str, str]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.folders[name])


class VersionedTables:
    """Versions of some tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        """Published versions in order."""
        folder = self._path("published")
        if not self.fs.exists(folder):
            return []
        return sorted(int(name) for name in (s.getPath().getName() for s in self.fs.listStatus(folder)) if name.isdigit())

    def version(self, number: int) -> Version:
        """A version by number; reading stays with it whatever is published later."""
        if number == 0:
            return Version(0, {})
        stream = self.fs.open(self._path(f"published/{number}"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, json.loads(text))

    def current(self) -> Version:
        return self.version(max(self.numbers(), default=0))

    def write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write tables where no reader looks; (table, folder) for ``publish``."""
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        folders = {}
        for name, df in tables.items():
            folders[name] = f"{run}/{name}"
            df.write.parquet(folders[name])
        return folders

    def publish(self, base: Version, folders: dict[str, str]) -> Version:
        """Make the next version of ``base``; tables that ``folders`` leaves out stay as they are."""
        new = Version(base.number + 1, {**base.folders, **folders})
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"published/{new.number}")
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(new.folders), "utf-8"))
        out.close()
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind_class(self.jvm), 1)
        never_over[0] = self.jvm.java.lang.Enum.valueOf(kind, "NONE")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, never_over)
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise Conflict(f"version {new.number} is there already") from error
            raise
        return new

    def commit(self, base: Version, tables: dict[str, DataFrame]) -> Version:
        """Write the tables and publish them on top of ``base``."""
        return self.publish(base, self.write(tables))

    def expire(self, keep: int = 10) -> list[int]:
        """Drop all but the last versions, and the folders that only they name.  Folders of runs
        that have not published are left alone."""
        numbers = self.numbers()
        gone, stay = numbers[:-keep], numbers[-keep:]
        used = {f for n in stay for f in self.version(n).folders.values()}
        for n in gone:
            for folder in set(self.version(n).folders.values()) - used:
                self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(folder), True)
            self.fs.delete(self._path(f"published/{n}"), False)
        return gone


def kind_class(jvm):
    """The class of rename options, for an array of them."""
    return getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
