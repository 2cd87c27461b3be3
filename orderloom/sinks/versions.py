"""Versions of a table, decided by one marker file for each.

A writer puts its files into folders of their own, which nothing refers to yet. Then it claims the next number:
the marker of a version can be made only once, so of two writers that started from the same version one wins, and
the other learns that it was too late before any of its rows can be seen. The marker says all that the catalog needs to know, so
a swap that was cut off after it is completed by whoever comes next.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_MARKERS = "_versions"


class Conflict(Exception):
    """Another writer made the version first."""


@dataclass(frozen=True)
class Version:
    """The folder of a table's files, its columns, and the folders of partitions kept from earlier versions."""

    number: int
    folder: str
    columns: str
    partition_by: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)


class VersionLog:
    """The markers in a table's folder.

    Making a marker relies on the file system: a rename that fails where the name exists (HDFS), or a hard link
    (local). Object stores without such an operation need one writer at a time.
    """

    def __init__(self, spark: SparkSession, table_folder: str):
        self._jvm = spark._jvm
        self._root = self._path(f"{table_folder.rstrip('/')}/{_MARKERS}")
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def number(self) -> int:
        """The latest version's number; 0 if there is none."""
        if not self._files.exists(self._root):
            return 0
        names = [status.getPath().getName() for status in self._files.listStatus(self._root)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def latest(self) -> Version | None:
        number = self.number()
        if not number:
            return None
        stream = self._files.open(self._marker(number))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _marker(self, number: int):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, f"{number:010d}.json")

    def claim(self, version: Version) -> None:
        """Make the version the latest one, or raise ``Conflict``. Its marker is complete when it appears."""
        draft = self._jvm.org.apache.hadoop.fs.Path(self._root, f".{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        try:
            stream.write(json.dumps(asdict(version)).encode())
        finally:
            stream.close()
        try:
            if version.number <= self.number() or not self._named(draft, self._marker(version.number)):
                raise Conflict(f"version {version.number} exists")
        finally:
            self._files.delete(draft, False)

    def _named(self, draft, marker) -> bool:
        if self._files.getUri().getScheme() != "file":
            return self._files.rename(draft, marker)
        paths = [self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (marker, draft)]
        try:
            self._jvm.java.nio.file.Files.createLink(*paths)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True
