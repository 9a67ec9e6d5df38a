"""Where files lie: the local disk, or any store that Hadoop's file systems reach."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Bytes of a file of ignore rules that are read at most.
RULE_BYTES = 16 << 20


class Store(Protocol):
    def whole(self, path: str) -> str:
        """The path from the store's root on."""

    def exists(self, path: str) -> bool: ...

    def is_folder(self, path: str) -> bool: ...

    def text(self, path: str) -> str | None:
        """A small text file; None if it can't be read."""

    def content(self, path: str) -> bytes: ...

    def why_not(self, path: str) -> str | None:
        """Why a file can't be read; None if it can."""

    def entries(self, folder: str) -> Iterator[tuple[str, str]]:
        """(name, `folder`, `file` or `link`) of what a folder holds."""


def plain(path: str) -> str:
    """A local path without the scheme of its URI."""
    return re.sub("^file:/*", "/", path)


class Local:
    def whole(self, path: str) -> str:
        return os.path.abspath(plain(path)).rstrip("/")

    def exists(self, path: str) -> bool:
        return os.path.exists(plain(path))

    def is_folder(self, path: str) -> bool:
        return os.path.isdir(plain(path))

    def text(self, path: str) -> str | None:
        try:
            with open(plain(path), encoding="utf-8", errors="replace") as f:
                return f.read(RULE_BYTES)
        except OSError:
            return None

    def content(self, path: str) -> bytes:
        with open(plain(path), "rb") as f:
            return f.read()

    def why_not(self, path: str) -> str | None:
        try:
            with open(plain(path), "rb"):
                return None
        except OSError as e:
            return f"could not be read: {e.strerror}"

    def entries(self, folder: str) -> Iterator[tuple[str, str]]:
        with os.scandir(plain(folder)) as found:
            for e in found:
                kind = "link" if e.is_symlink() else "folder" if e.is_dir() else "file" if e.is_file() else "other"
                yield e.name, kind


class Hadoop:
    """A store by its URIs."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.settings = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.settings), where

    def whole(self, path: str) -> str:
        return path.rstrip("/")

    def exists(self, path: str) -> bool:
        files, where = self._at(path)
        return files.exists(where)

    def is_folder(self, path: str) -> bool:
        files, where = self._at(path)
        return files.exists(where) and files.getFileStatus(where).isDirectory()

    def content(self, path: str, most: int = (1 << 31) - 9) -> bytes:
        files, where = self._at(path)
        stream = files.open(where)
        try:
            return bytes(stream.readNBytes(most))
        finally:
            stream.close()

    def text(self, path: str) -> str | None:
        try:
            return self.content(path, RULE_BYTES).decode(errors="replace")
        except Py4JJavaError:
            return None

    def why_not(self, path: str) -> str | None:
        try:
            files, where = self._at(path)
            files.open(where).close()
            return None
        except Py4JJavaError as e:
            return f"could not be read: {e.java_exception.getClass().getSimpleName()}"

    def entries(self, folder: str) -> Iterator[tuple[str, str]]:
        files, where = self._at(folder)
        for status in files.listStatus(where):
            yield status.getPath().getName(), "link" if status.isSymlink() else "folder" if status.isDirectory() else "file"


def store_of(spark: SparkSession | None, path: str) -> Store:
    """The local disk for plain paths and file: URIs, Hadoop's file systems for others."""
    if "://" not in path or path.startswith("file:"):
        return Local()
    if spark is None:
        raise ValueError(f"a session is needed to reach {path!a}")
    return Hadoop(spark)
