"""A folder of versions, of which one is in use: named by a small file that is renamed into place."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Versions:
    """Which version under a folder is in use. Readers see the former or the next, nothing between."""

    def __init__(self, spark: SparkSession, path: str, pointer: str = "CURRENT"):
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), pointer
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._fs.Path(self.path).getFileSystem(self._conf)

    def at(self, *parts: str):
        return self._fs.Path("/".join((self.path, *parts)))

    def exists(self, *parts: str) -> bool:
        return self.files.exists(self.at(*parts))

    def current(self) -> str | None:
        if not self.exists(self.pointer):
            return None
        stream = self.files.open(self.at(self.pointer))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def use(self, version: str) -> None:
        """One rename over the file that names the version in use."""
        beside = self.at(f".{self.pointer}-{uuid.uuid4().hex}")
        out = self.files.create(beside, True)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()
        rename = getattr(self._fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._fs.FileContext.getFileContext(self._conf).rename(
            self.files.makeQualified(beside), self.files.makeQualified(self.at(self.pointer)), how)

    def by_age(self, *parts: str) -> list[str]:
        """Names in a folder, the oldest first."""
        if not self.exists(*parts):
            return []
        found = sorted(self.files.listStatus(self.at(*parts)), key=lambda s: (s.getModificationTime(), s.getPath().getName()))
        return [s.getPath().getName() for s in found]

    def remove(self, *parts: str) -> None:
        self.files.delete(self.at(*parts), True)
