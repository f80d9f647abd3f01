"""Versioned tables in a folder: written aside, put in force by one rename, never by two runs at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has put a version in force since this one began."""


class VersionedFolder:
    """``root`` holds data folders and one small file ``version-<n>`` per version, which names the version's data folder.

    The greatest n is in force. A version comes into force when its file is renamed into place, which fails if
    a file of that name is there: of two runs that began at one version only the first succeeds. What a crash
    left behind has no file and is never read. Folders older than the version before are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, root = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[len("version-") :]) for n in names if n.startswith("version-") and n[len("version-") :].isdigit())

    def version(self) -> int | None:
        """The version in force, None before the first."""
        return max(self._versions(), default=None)

    def _data(self, version: int) -> str:
        return json.loads(self.spark.read.text(f"{self.root}/version-{version}").first().value)["data"]

    def read(self, version: int | None) -> DataFrame | None:
        return None if version is None else self.spark.read.parquet(f"{self.root}/{self._data(version)}")

    def aside(self, what: str) -> str:
        """The name of a new folder that no version has yet."""
        return f"{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, what: str, by: list[str] | None = None) -> str:
        name = self.aside(what)
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.root}/{name}")
        return name

    def put_in_force(self, name: str, after: int | None) -> int:
        """Makes the data folder ``name`` the version that follows ``after``; ``Conflict`` if that is no longer in force."""
        if self.version() != after:
            raise Conflict(f"version {after} is no longer in force")
        new = 0 if after is None else after + 1
        self._rename(name, new)
        self._clean(new)
        return new

    def _rename(self, name: str, new: int) -> None:
        fs, note = self._fs(), self._path(f"_next-{uuid.uuid4().hex}")
        out = fs.create(note, False)
        out.write(bytearray(json.dumps({"data": name}), "utf-8"))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(note, self._path(f"version-{new}"), options)
        except Exception as e:
            fs.delete(note, False)
            if fs.exists(self._path(f"version-{new}")):
                raise Conflict(f"version {new} is there already") from e
            raise

    def _clean(self, new: int) -> None:
        kept = {self._data(v) for v in self._versions() if v >= new - 1}
        for v in [v for v in self._versions() if v < new - 1]:
            data = self._data(v)
            if data not in kept:
                self._fs().delete(self._path(data), True)
            self._fs().delete(self._path(f"version-{v}"), False)
