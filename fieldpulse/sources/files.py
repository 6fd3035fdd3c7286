"""Small files in the store that the tables live in (pointers, markers), through Spark's own file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Names, texts and markers under any path that Spark can write to."""

    def __init__(self, spark: SparkSession):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, path: str) -> bool:
        """Make an empty file; False if it is there already (two claims of one path never both succeed)."""
        fs, p = self._at(path)
        try:
            fs.create(p, False).close()
        except Py4JJavaError as exc:
            if "AlreadyExists" in exc.java_exception.getClass().getName():
                return False
            raise
        return True

    def put(self, path: str, text: str) -> None:
        """Write a file that readers see whole or not at all."""
        fs, p = self._at(path)
        _, part = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, p):
            fs.delete(part, False)
            raise OSError(f"cannot write {path}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
