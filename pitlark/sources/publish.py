"""Outputs that are whole or absent, and checked in the pass that writes them.

Rows go to a staging folder beside the output; what is asked of them is observed while they are written. Only if the check finds
nothing is the folder renamed to its place, with a manifest of its files. A job that is killed, or whose rows are refused,
leaves what was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from .store import json_safe

MANIFEST = "_manifest.json"


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._jsc, self.path = spark._jvm, spark._jsc, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def files(self, name: str = "") -> dict[str, int]:
        """Names and lengths of the files in a folder; none where it does not exist."""
        if not self._fs.exists(self._at(name)):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._at(name)) if s.isFile()}

    def put(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def publish(self, staged: str, name: str) -> None:
        """Puts a staged folder in a place, instead of what may be there."""
        old = f"{staged}-before"
        self._fs.mkdirs(self._at(name).getParent())
        if self._fs.exists(self._at(name)) and not self._fs.rename(self._at(name), self._at(old)):
            raise OSError(f"cannot move {self.path}/{name} away")
        if not self._fs.rename(self._at(staged), self._at(name)):
            self._fs.rename(self._at(old), self._at(name))
            raise OSError(f"cannot put {self.path}/{name} in its place")
        self.delete(old)

    def copy_from(self, source: str, name: str) -> None:
        """A file of any file system, byte for byte."""
        conf = self._jsc.hadoopConfiguration()
        where = self._jvm.org.apache.hadoop.fs.Path(source)
        if not self._jvm.org.apache.hadoop.fs.FileUtil.copy(where.getFileSystem(conf), where, self._fs, self._at(name), False, conf):
            raise OSError(f"cannot copy {source}")


def data_files(files: dict[str, int]) -> dict[str, int]:
    return {n: size for n, size in files.items() if not n.startswith(("_", "."))}


class Refused(ValueError):
    """The rows break what they were checked for; `found` says how."""

    def __init__(self, path: str, found: list[str]):
        super().__init__(f"not written to {path}: {'; '.join(found)}")
        self.found = found


def publish(df: DataFrame, path: str, facts: dict[str, Column], check: Callable[[dict], list[str]] = lambda facts: [], then: Callable[[DataFrame], DataFrame] = lambda df: df, kind: str = "parquet", **options) -> dict:
    """Writes then(df) to path, in place of what is there, and returns the facts: aggregates over df's rows, taken as they are
    written. What check(facts) finds is raised as Refused, and nothing is changed."""
    spark, (parent, _, name) = df.sparkSession, path.rstrip("/").rpartition("/")
    folder, staged, seen = Folder(spark, parent), f"_staging-{uuid.uuid4().hex}", Observation()
    try:
        then(df.observe(seen, *(c.alias(n) for n, c in facts.items()))).write.format(kind).options(**options).save(f"{parent}/{staged}")
        found = dict(seen.get)
        if wrong := check(found):
            raise Refused(path, wrong)
        folder.put(f"{staged}/{MANIFEST}", json.dumps(json_safe({"files": data_files(folder.files(staged)), "facts": found}), sort_keys=True))
        folder.publish(staged, name)
        return found
    finally:
        folder.delete(staged)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder that was published has the files of its manifest."""
    folder = Folder(spark, path)
    files = folder.files()
    return MANIFEST in files and json.loads(folder.read(MANIFEST))["files"] == data_files(files)
