"""Folders on a local disk or on any file system that Spark can read, behind one small interface.

A build's state (registry, pointer, manifests) and its tables lie in one folder. On a single machine that is a directory;
a cluster needs one that all executors see, named by a URL (``hdfs://...``, ``s3a://...``, ``file:///shared/...``).
"""

from __future__ import annotations

import os
import shutil
import stat as modes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    """A file, or a directory that was skipped (its path then ends in ``/``); ``reason`` says why it isn't to be read."""

    path: str
    url: str
    size: int
    modified: int
    reason: str | None = None


class LocalFolder:
    def __init__(self, root: str | Path):
        self.root = Path(root).absolute()

    def url(self, name: str = "") -> str:
        return str(self.root / name)

    def read(self, name: str) -> str | None:
        p = self.root / name
        return p.read_text("utf-8") if p.exists() else None

    def write(self, name: str, text: str) -> None:
        """Replace a file as a whole: no reader sees half of it."""
        target = self.root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        temporary = target.with_name(f".{target.name}.{os.getpid()}")
        temporary.write_text(text, "utf-8")
        os.replace(temporary, target)

    def exists(self, name: str) -> bool:
        return (self.root / name).exists()

    def writable(self) -> bool:
        self.root.mkdir(parents=True, exist_ok=True)
        return os.access(self.root, os.W_OK)

    def claim(self, name: str) -> bool:
        """Create a file if there is none; whether it was created."""
        try:
            os.close(os.open(self.root / name, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True

    def delete(self, name: str) -> None:
        p = self.root / name
        p.unlink(missing_ok=True) if p.is_file() else shutil.rmtree(p, ignore_errors=True)

    def rename(self, old: str, new: str) -> None:
        (self.root / new).parent.mkdir(parents=True, exist_ok=True)
        os.replace(self.root / old, self.root / new)

    def walk(self, skip: Callable[[str], bool]) -> Iterator[Entry]:
        """Files below the root in canonical order; directories that ``skip`` names are not entered."""

        def inside(directory: str, prefix: str) -> Iterator[Entry]:
            with os.scandir(directory) as listed:
                found = sorted(listed, key=lambda e: e.name)
            for e in found:
                path = prefix + e.name
                if e.is_symlink():
                    yield Entry(path, e.path, 0, 0, "symlink")
                elif e.is_dir():
                    if skip(path):
                        yield Entry(path + "/", e.path, 0, 0, "skipped")
                    else:
                        yield from inside(e.path, path + "/")
                else:
                    s = e.stat()
                    regular = modes.S_ISREG(s.st_mode)
                    yield Entry(path, "file:" + e.path, s.st_size, s.st_mtime_ns // 1_000_000, None if regular else "special")

        yield from inside(str(self.root), "")


class SharedFolder:
    """The same over the Hadoop file system API of the session's JVM."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self._bytes = jvm.java.io.ByteArrayOutputStream
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        source, out = self.fs.open(self._at(name)), self._bytes()
        self._io.copyBytes(source, out, 65_536, True)
        return bytes(out.toByteArray()).decode("utf-8")

    def write(self, name: str, text: str) -> None:
        temporary = self._at(f"{name}.{os.getpid()}.tmp")
        out = self.fs.create(temporary, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        self.fs.delete(self._at(name), False)
        self.fs.rename(temporary, self._at(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def writable(self) -> bool:
        return bool(self.fs.mkdirs(self._at("")))

    def claim(self, name: str) -> bool:
        return bool(self.fs.createNewFile(self._at(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._at(new).getParent())
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} can't be moved to {new}")

    def walk(self, skip: Callable[[str], bool]) -> Iterator[Entry]:
        def inside(directory, prefix: str) -> Iterator[Entry]:
            for s in sorted(self.fs.listStatus(directory), key=lambda s: s.getPath().getName()):
                path, url = prefix + s.getPath().getName(), s.getPath().toString()
                if s.isSymlink():
                    yield Entry(path, url, 0, 0, "symlink")
                elif s.isDirectory():
                    if skip(path):
                        yield Entry(path + "/", url, 0, 0, "skipped")
                    else:
                        yield from inside(s.getPath(), path + "/")
                else:
                    yield Entry(path, url, s.getLen(), s.getModificationTime())

        yield from inside(self._at(""), "")


def folder_of(root: str | Path, spark: SparkSession | None = None) -> LocalFolder | SharedFolder:
    """The folder a path or URL names; a URL needs a session."""
    text = str(root)
    if "://" in text and spark is not None:
        return SharedFolder(spark, text)
    return LocalFolder(text.removeprefix("file://"))
