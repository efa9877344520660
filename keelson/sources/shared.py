"""Folders that all executors share, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own, one to an application, only where it is unset and the master is local."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="keelson-")
        found = _OWN[context.applicationId]
    return found


def fresh_root(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Files:
    """Small files and folders of any store that Spark can write to, from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False if there is one of that name.

        Exclusive where the store's own create is (HDFS, local disks, object stores whose connector writes on condition).
        On other object stores two writers of one name may both be told that they were first.
        """
        if self.exists(path):
            return False
        try:
            out = self._fs.create(self._path(path), False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        return True

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode(errors="replace")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
