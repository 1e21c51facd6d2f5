"""Numbered manifests in a folder: one version of several tables is put in place at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """The manifests of ``folder``.  A new one is written aside and renamed, which fails if another writer was first."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._utils = jvm.org.apache.commons.io.IOUtils
        self.folder, self._root = folder, self._path(folder)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, default: object = None) -> tuple[int, object]:
        """The number of the last manifest and what it holds; 0 and ``default`` if there is none."""
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(self._root) if s.getPath().getName().isdigit()] if self._fs.exists(self._root) else []
        if not numbers:
            return 0, default
        stream = self._fs.open(self._path(self._root, str(max(numbers))))
        try:
            return max(numbers), json.loads(self._utils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, content: object) -> None:
        """Put ``content`` in place as the manifest that follows number ``after``."""
        self._fs.mkdirs(self._root)
        new, place = self._path(self._root, f"new-{uuid.uuid4().hex}"), self._path(self._root, str(after + 1))
        out = self._fs.create(new, False)
        out.write(json.dumps(content).encode())
        out.close()
        if self._fs.exists(place) or not self._fs.rename(new, place):
            self._fs.delete(new, False)
            raise RuntimeError(f"{self.folder}: another writer was first")
