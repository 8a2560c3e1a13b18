"""Small files and names on whatever storage a path lies on, by way of Hadoop's client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        where, fs = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def make(self, folder: str) -> None:
        where, fs = self._at(folder)
        fs.mkdirs(where)

    def text(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file beside ``path`` and rename it there; false if another came first."""
        part, fs = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        moved = self.move(part.toString(), path)
        if not moved:
            fs.delete(part, False)
        return moved

    def move(self, path: str, to: str) -> bool:
        """Rename a file; false, and nothing done, where the new name is taken."""
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs
        where, to_path = hadoop.Path(path), hadoop.Path(to)
        context = hadoop.FileContext.getFileContext(
            where.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        ) if where.toUri().getScheme() else hadoop.FileContext.getFileContext(
            self.spark.sparkContext._jsc.hadoopConfiguration())
        if context.util().exists(to_path):
            return False
        options = self.spark.sparkContext._gateway.new_array(
            getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(where, to_path, options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)
