"""Small files and folders of tables through the file systems that the engine knows, so that a base may lie anywhere."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import SparkSession


class LocalFiles:
    """A file system that is mounted."""

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def read(self, path: str) -> str:
        return Path(path).read_text(encoding="utf-8")

    def write(self, path: str, text: str) -> None:
        Path(path).write_text(text, encoding="utf-8")

    def replace(self, source: str, target: str) -> None:
        os.replace(source, target)

    def folders(self, path: str) -> list[str]:
        return [p.name for p in Path(path).iterdir() if p.is_dir()] if os.path.isdir(path) else []

    def make(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def delete(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True)


class SharedFiles:
    """Any file system that the session can reach by the address of the path."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(str(path))
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        at, fs = self._at(path)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """At once, where the file system can."""
        (a, _), (b, _) = self._at(source), self._at(target)
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        kinds = self.jvm.java.lang.reflect.Array.newInstance(rename, 1)
        kinds[0] = next(k for k in rename.getEnumConstants() if k.name() == "OVERWRITE")
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), self.conf).rename(a, b, kinds)

    def folders(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []

    def make(self, path: str) -> None:
        at, fs = self._at(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)
