"""The file system of a lake, through Hadoop, so that any path that Spark reads will do."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def _linked(path: Path, text: str) -> bool:
    """Hadoop's local rename looks whether the name is taken and then replaces; a hard link is made in one step, or not at all."""
    draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    draft.write_bytes(text.encode())
    try:
        os.link(draft, path)
    except FileExistsError:
        return False
    finally:
        draft.unlink()
    return True


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """The names in a folder, sorted; none if it isn't there."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since something was last written in a folder; parts that are being written count."""
        fs, p = self._at(path)
        newest = max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])
        return self.jvm.java.lang.System.currentTimeMillis() / 1000 - newest / 1000

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file whole or not at all; False if there is one by that name already."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        at = fs.makeQualified(p).toUri()
        if at.getScheme() == "file":
            return _linked(Path(at.getPath()), text)
        draft = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{self.jvm.java.util.UUID.randomUUID()}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return self._moved(draft, p)

    def move(self, source: str, target: str) -> bool:
        """Rename a folder; False if the target exists, which loses the race."""
        fs, p = self._at(target)
        fs.mkdirs(p.getParent())
        if fs.exists(p):
            self.delete(source)
            return False
        return self._moved(self.jvm.org.apache.hadoop.fs.Path(source), p)

    def _moved(self, source, target) -> bool:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        one = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        one[0] = options.NONE  # without OVERWRITE: fails where the target exists
        try:
            context.rename(source, target, one)
        except Exception as fault:
            if "exist" not in str(fault).lower():
                raise
            target.getFileSystem(self.conf).delete(source, True)
            return False
        return True

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)
