"""Small files and folders in any file system that Spark reads: manifests, pointers, locks.  Tables stay with Spark."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of Spark's file systems; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = urlparse(str(self.fs.getUri())).scheme == "file"

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def is_folder(self, name: str = "") -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._path(name)).isDirectory()

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if self.exists() else []

    def read(self, name: str) -> dict | None:
        """The JSON of a file; None if there is none or it is not whole."""
        try:
            stream = self.fs.open(self._path(name))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return None

    def _fill(self, stream: JavaObject, value: dict) -> None:
        stream.write(json.dumps(value, sort_keys=True).encode())
        stream.close()

    def write(self, name: str, value: dict) -> None:
        """The file appears whole: written beside its place and renamed."""
        part = f".{name}.{uuid.uuid4().hex}"
        self._fill(self.fs.create(self._path(part), True), value)
        if self._local:
            local = lambda n: self._path(n).toUri().getPath()
            os.replace(local(part), local(name))
            return
        self.delete(name)
        self.move(part, name)

    def create(self, name: str, value: dict) -> bool:
        """Whether this call made the file; False if it was there."""
        if self._local:  # Hadoop's local file system looks before it creates
            path = self._path(name).toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                with open(path, "x") as f:
                    json.dump(value, f, sort_keys=True)
            except FileExistsError:
                return False
            return True
        try:
            self._fill(self.fs.create(self._path(name), False), value)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{self.at(name)} could not be renamed to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
