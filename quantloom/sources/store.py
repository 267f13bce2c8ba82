"""Small documents on a shared file system: read by name, written once or by compare-and-set.

All access goes through the session's Hadoop file systems, so that a store may be on a local disk (file://), HDFS or an object store, and everything that is
written outlives the driver's machine.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

TRIES = 40


class Conflict(FileExistsError):
    """Somebody else wrote first."""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Store:
    """Documents below a root folder. A name is a relative path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self._bytes = jvm.java.io.ByteArrayOutputStream

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.uri(name)))

    def names(self, folder: str = "") -> list[str]:
        """The names in a folder, sorted; none if it isn't there."""
        at = self._path(self.uri(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str | None:
        """A document, or None without one."""
        try:
            stream, out = self._fs.open(self._path(self.uri(name))), self._bytes()
        except Py4JJavaError as e:
            if "FileNotFound" in str(e.java_exception):
                return None
            raise
        try:
            self._io.copyBytes(stream, out, 65536, False)
        finally:
            stream.close()
        return bytes(out.toByteArray()).decode()

    def _create(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(self.uri(name)), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.uri(name)), True)

    def rename(self, old: str, new: str) -> None:
        """Give a file or folder a name that nothing has."""
        if self.exists(new) or not self._fs.rename(self._path(self.uri(old)), self._path(self.uri(new))):
            raise Conflict(self.uri(new))

    def create(self, name: str, text: str) -> None:
        """Write a document that isn't there yet, whole or not at all; ``Conflict`` if it is.

        Not every file system renames only if absent. So a writer first shows a claim and then looks for others': of two writers at least one sees
        the other's claim and withdraws, hence one at most goes on. What was written is read back.
        """
        me = uuid.uuid4().hex
        folder, _, base = name.rpartition("/")
        claim, mark = f"{folder}/.claim-{base}-{me}".lstrip("/"), f".claim-{base}-"
        for i in range(TRIES):
            if self.exists(name):
                raise Conflict(self.uri(name))
            self._create(claim, "")
            try:
                if any(n.startswith(mark) and n != f"{mark}{me}" for n in self.names(folder)):
                    self.delete(claim)
                    time.sleep(random.uniform(0.01, 0.02 * (i + 2)))
                    continue
                if self.exists(name):
                    raise Conflict(self.uri(name))
                temporary = f"{folder}/.new-{base}-{me}".lstrip("/")
                self._create(temporary, text)
                self.rename(temporary, name)
                break
            finally:
                self.delete(claim)
        else:
            raise Conflict(f"{self.uri(name)} is claimed by {[n for n in self.names(folder) if n.startswith(mark)]}; remove these if their writers are gone")
        if digest(self.read(name) or "") != digest(text):
            raise Conflict(f"{self.uri(name)} was overwritten")

    def versions(self, name: str) -> list[int]:
        return sorted(int(n[1:]) for n in self.names(name) if n.startswith("v") and n[1:].isdigit())

    def latest(self, name: str) -> tuple[int, str | None]:
        """The number and text of a document's last version; (0, None) without one."""
        known = self.versions(name)
        return (known[-1], self.read(f"{name}/v{known[-1]:08d}")) if known else (0, None)

    def put(self, name: str, text: str, expected: int) -> int:
        """The next version of a document, if its last one is still the expected; its number. ``Conflict`` otherwise."""
        now = self.versions(name)[-1:] or [0]
        if now != [expected]:
            raise Conflict(f"{self.uri(name)} is at version {now[0]}, not {expected}")
        self.create(f"{name}/v{expected + 1:08d}", text)
        return expected + 1

    def update(self, name: str, change: Callable[[str | None], str]) -> str:
        """Put what ``change`` makes of the last version, again from the newer one where somebody else was first."""
        for _ in range(TRIES):
            version, text = self.latest(name)
            made = change(text)
            if made == text:
                return made
            try:
                self.put(name, made, version)
                return made
            except Conflict:
                continue
        raise Conflict(f"{self.uri(name)} changes too often")


def as_json(values) -> str:
    return json.dumps(values, indent=2, sort_keys=True) + "\n"
