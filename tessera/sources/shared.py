"""Folders that all executors share, and small files in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import EngineError


_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a temporary folder, on a local master only: elsewhere nobody else would see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise EngineError("Io", "spark.checkpoint.dir isn't set; on a cluster it must name a folder that all executors share")
        at = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tessera-"))
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(""))) if self.fs.exists(self.path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, content: str) -> bool:
        """Create the file, which only one writer can, and fill it; False if the name is taken."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
