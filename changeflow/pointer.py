"""Which version of a table is in force: numbered markers, each number taken once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer took the number first; nothing was changed."""


class Pointer:
    """Markers ``<number>`` in ``folder``, each with a JSON object; the highest number rules.

    A marker appears whole and only if its number is free, so of writers that started
    from one version exactly one succeeds. On a local file system it is a hard link; on
    others a rename, which must refuse an existing target and be atomic, as HDFS's is
    (an object store needs a file system that sees to that).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):  # noqa: ANN201
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self.path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self.path(""))]
        return sorted(int(n) for n in names if n.isdigit())

    def number(self) -> int:
        """The number in force; 0 before the first."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self.path(str(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, number: int, content: dict) -> None:
        """Take ``number``; :class:`Conflict` if it is taken."""
        self._fs.mkdirs(self.path(""))
        made = self.path(f"_{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if not self._publish(made, self.path(str(number))):
                raise Conflict(f"version {number} of {self.folder} was taken by another writer")
        finally:
            self._fs.delete(made, False)

    def _publish(self, made, to) -> bool:  # noqa: ANN001
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(made, to)
        local = lambda p: self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("java.lang.String"), 0))
        try:
            self._jvm.java.nio.file.Files.createLink(local(to), local(made))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def forget(self, number: int) -> None:
        self._fs.delete(self.path(str(number)), False)
