"""Versions of a store on disk: each is a small file that names the tables it is made of, and appears by one atomic rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """The versions below `root`, a path that all executors reach. Readers see one whole version or another."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/versions/{name}")

    def latest(self) -> int:
        """The number of the latest version; 0 if there is none."""
        at = self._path("x").getParent()
        files = at.getFileSystem(self._conf)
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        return max((int(name[:-5]) for name in names if name.endswith(".json") and name[0].isdigit()), default=0)

    def read(self, version: int) -> dict:
        at = self._path(f"{version:020d}.json")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> None:
        """Makes `version`; an error if another writer has."""
        temporary = self._path(f"tmp-{uuid.uuid4().hex}")
        files = temporary.getFileSystem(self._conf)
        stream = files.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(temporary.toUri() if ":" in self.root else files.getUri(), self._conf)
        java = self.spark._jvm.java.lang
        none = java.reflect.Array.newInstance(java.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:  # a rename to a name that exists fails
            context.rename(context.makeQualified(temporary), context.makeQualified(self._path(f"{version:020d}.json")), none)
        except Exception:
            files.delete(temporary, False)
            raise
