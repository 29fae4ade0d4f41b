"""Files and folders of any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A file system as the cluster knows it; paths are texts."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names of what is in a folder; nothing if it isn't there."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} can't be moved to {new}")

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A small file, whole or not at all."""
        aside = f"{path}.part"
        out = self.fs.create(self._path(aside), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.remove(path)
        self.move(aside, path)

    def script(self, path: str, text: str) -> str:
        """A shell script that may be run, and its path for those who run it; the folder must be one that machines share as such."""
        self.write(path, f"#!/bin/sh\n{text}")
        self.fs.setPermission(self._path(path), self.jvm.org.apache.hadoop.fs.permission.FsPermission("755"))
        return path.removeprefix("file:")

    def copy(self, old: str, new: str) -> None:
        """A file of this file system to a path of any, whole or not at all."""
        conf, aside = self.fs.getConf(), f"{new}.part"
        other = self._path(new).getFileSystem(conf)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(old), other, self._path(aside), False, True, conf)
        other.rename(self._path(aside), self._path(new))

    def sha256(self, path: str) -> str:
        """A digest of a file's content, read as a stream."""
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
