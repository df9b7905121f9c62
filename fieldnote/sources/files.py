"""A folder seen through Spark's own file system, whichever that is."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def exact(path: str) -> str:
    """A path that Spark does not take for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def local(self) -> str | None:
        """The folder's path on disk if it lies in a local file system, which all tasks then see under this path."""
        whole = self._fs.makeQualified(self._path("")).toUri()
        return whole.getPath().rstrip("/") if whole.getScheme() == "file" else None

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def is_file(self, name: str = "") -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._path(name)).isFile()

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, without files that Spark hides; none if it isn't there."""
        if not self.exists(name):
            return []
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path(name))]
        return sorted(x for x in found if not x.startswith((".", "_SUCCESS")))

    def size(self, name: str) -> tuple[int, int]:
        """Files and bytes below a folder."""
        if not self.exists(name):
            return 0, 0
        found = self._fs.getContentSummary(self._path(name))
        return found.getFileCount(), found.getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file that is either there as a whole or not at all."""
        if self.exists(name):
            raise FileExistsError(f"{self.root}/{name}")
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}.draft"
        stream = self._fs.create(self._path(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(self._path(draft), self._path(name)):
            raise FileExistsError(f"{self.root}/{name}")

    def move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot move {old} to {new} in {self.root}")

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def inside(self, uri: str) -> str:
        """The name, below this folder, of a file that Spark calls ``uri``."""
        top = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")
        return self._jvm.java.net.URI(uri).getPath()[len(top) + 1 :]

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
