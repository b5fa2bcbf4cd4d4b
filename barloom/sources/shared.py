"""Scratch space every executor can reach."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="barloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_listeners: list[list[str]] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing has used before."""
    path = f"{shared_root(spark)}/{purpose}-{uuid4().hex}"
    for names in _listeners:
        names.append(path)
    return path


@contextmanager
def recorded_folders(names: list[str]) -> Iterator[None]:
    """Add the folders made meanwhile to ``names``, so that who asked for the work can discard them."""
    _listeners.append(names)
    try:
        yield
    finally:
        _listeners[:] = (its for its in _listeners if its is not names)  # lists may be equal


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, none if it does not exist."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return []
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of staged copies that are no longer needed."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or absent."""
    files, target = _file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.rename(part, target)


def read_texts(spark: SparkSession, folder: str) -> list[str]:
    """The contents of a folder's complete small files."""
    files, target = _file_system(spark, folder)
    if not files.exists(target):
        return []
    found = []
    for status in files.listStatus(target):
        if not status.getPath().getName().endswith(".part"):
            source = files.open(status.getPath())
            found.append(bytes(source.readAllBytes()).decode())
            source.close()
    return found
