"""Files and folders through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import atexit
import contextlib

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when this process, the application's driver, ends."""
    where, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
            where.getFileSystem(conf).delete(where, True)

    atexit.register(remove)


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        p, fs = self._at(old)
        if not fs.rename(p, self._at(new)[0]):
            raise OSError(f"cannot rename {old} to {new}")

    def size(self, path: str) -> int:
        """Bytes of all files in a folder."""
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength()

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none if it is not there."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def claim(self, path: str, text: str) -> bool:
        """Make a file; False if it is there already."""
        p, fs = self._at(path)
        if not fs.createNewFile(p):
            return False
        self._fill(path, text)
        return True

    def _fill(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(b & 255 for b in self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replace a file as a whole: write beside it, then rename over it in one step, so that one of both is always there."""
        beside = f"{path}.new"
        self._fill(beside, text)
        old, new = self._at(beside)[0], self._at(path)[0]
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self._conf).rename(old, new, how)
