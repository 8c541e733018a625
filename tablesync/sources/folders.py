"""Small files next to the data (manifests, state) through the Hadoop file system of the session.

Works on every file system Spark writes to. Only small JSON documents pass through here, never rows.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession


class AlreadyPublished(RuntimeError):
    """Another writer has published this version."""


# Temporary folders of local sessions that name no shared one, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tablesync-")
        shared = _LOCAL_FOLDERS[app]
    return f"{shared.rstrip('/')}/tablesync"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder for intermediate tables of one pass, removed when the pass is over."""
    path = fresh_folder(spark, name)
    try:
        yield path
    finally:
        Folder(spark, path).delete()


class Folder:
    """A directory on the file system of the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self) -> list[str]:
        fs, path = self._at()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def has_data(self) -> bool:
        """Whether any visible file or folder is in here."""
        return any(not n.startswith(("_", ".")) for n in self.names())

    def read_json(self, name: str) -> dict[str, Any]:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create_json(self, name: str, document: dict[str, Any]) -> None:
        """Write a document under a name that must be free; readers see it whole or not at all."""
        if self.exists(name):
            raise AlreadyPublished(f"{self.path}/{name}")
        fs, draft = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        finally:
            stream.close()
        if not fs.rename(draft, self._at(name)[1]):
            raise AlreadyPublished(f"{self.path}/{name}")

    def delete(self, name: str = "") -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


class VersionedDocument:
    """A JSON document as numbered files; the highest number is the current one."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names() if n.endswith(".json") and n[:-5].isdigit()]

    def current(self) -> tuple[int, dict[str, Any]] | None:
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else None

    def read(self, number: int) -> dict[str, Any]:
        return self.folder.read_json(self._name(number))

    def publish(self, number: int, document: dict[str, Any]) -> None:
        self.folder.create_json(self._name(number), document)

    def drop_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.folder.delete(self._name(n))

    @staticmethod
    def _name(number: int) -> str:
        return f"{number:012d}.json"
