"""A versioned state file that is replaced atomically."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Versions:
    """``v<N>.json`` files in a folder of any file system Spark knows; the highest N is current.

    A version is written under another name and then put in place by one step that fails if the version is there: a
    hard link on a local file system, a rename without overwriting elsewhere. So of two writers one wins, and a
    reader never sees half a state. On object stores, where such a rename isn't atomic, there must be one writer.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def all(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """(version, state); version 0 and an empty state before the first commit."""
        versions = self.all()
        if not versions:
            return 0, {}
        n = version or versions[-1]
        stream = self._fs.open(self._path(f"v{n}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return n, json.loads(text)

    def commit(self, version: int, state: dict) -> None:
        """Make ``state`` version ``version``; it fails if another writer was there first."""
        to, tmp = self._path(f"v{version}.json"), self._path(f"_tmp-{version}-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(tmp.toUri().getPath(), to.toUri().getPath())
            else:
                jvm = self.spark._jvm.org.apache.hadoop.fs
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
                jvm.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, to, none)
        except (FileExistsError, Py4JJavaError) as e:
            raise RuntimeError(f"version {version} was committed by another run") from e
        finally:
            self._fs.delete(tmp, False)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        if not self._fs.exists(self._path(path)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())
