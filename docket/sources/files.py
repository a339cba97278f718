"""Files of the file system that Spark reads from: listing, small texts, and renames that don't overwrite."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """By Hadoop's file context of a path, so that a store that only Spark reaches works, too."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark.sparkContext._jvm
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(base).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self.system = self._path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing where there is none."""
        return sorted(s.getPath().getName() for s in self.system.listStatus(self._path(path))) if self.exists(path) else []

    def write(self, path: str, text: str) -> None:
        out = self.system.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        at = self.system.open(self._path(path))
        try:
            reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(at, "UTF-8"))
            return "\n".join(iter(reader.readLine, None))
        finally:
            at.close()

    def rename(self, source: str, to: str) -> None:
        """Fails where the target exists."""
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        self.context.rename(self._path(source), self._path(to), none)

    def remove(self, path: str) -> None:
        self.system.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self.system.mkdirs(self._path(path))
