"""Small files and listings through Hadoop's file system, so a table can live wherever Spark can write."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file in one step; False when it is there already."""
        target, draft = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._publish(draft, target):
            self._fs.delete(draft, False)
            return False
        return True

    def _publish(self, draft, target) -> bool:
        """Moves a file to a name that nobody has; one of several writers wins."""
        jvm = self.spark._jvm
        if self._fs.getScheme() == "file":  # a link to a name that exists fails, a rename would replace
            nio = jvm.java.nio.file
            paths = [nio.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (target, draft)]
            try:
                nio.Files.createLink(*paths)
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                    raise
                return False
            self._fs.delete(draft, False)
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(draft, target, options)  # refuses a target that is there, in one step where the store can
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def list(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of the files right below a folder."""
        p = self._path(path)
        if not self._fs.exists(p):
            return []
        return [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(p) if s.isFile()]

    def folders(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"cannot rename {a} to {b}")
