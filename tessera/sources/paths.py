"""The folder that driver and executors share, and small files in it.

``spark.checkpoint.dir`` names the folder. Where the setting is absent, a local master gets a temporary
folder of its own (tests); on a cluster that is an error, as no local folder would be shared.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared working folder of this application."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else ""
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return f"{base.rstrip('/')}/work-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def local(path: str) -> str | None:
    """The plain path of a file on this machine's file system, else None."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes; None if there is no such file."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    data = read_bytes(spark, path)
    return None if data is None else data.decode()


def _temporary(spark: SparkSession, path: str, text: str) -> str:
    temp = f"{path}.{uuid.uuid4().hex}.dbtmp"
    own = local(temp)
    if own is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(own, "wb") as f:
            f.write(text.encode())
            f.flush()
            os.fsync(f.fileno())
        return temp
    fs, p = filesystem(spark, temp)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hflush()
    finally:
        stream.close()
    return temp


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not exist yet, whole or not at all."""
    temp, own = _temporary(spark, path, text), local(path)
    try:
        if own is not None:
            os.link(local(temp), own)  # fails if the name is taken
            os.unlink(local(temp))
            return
        context, modes = _renames(spark, path)
        context.rename(*_two(spark, temp, path), modes(False))
    except Exception as e:
        raise FileExistsError(f"{path}: another writer has made it, or it can't be made") from e


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file over another in one step: a reader, and a crash, leave the old one or the new one."""
    temp, own = _temporary(spark, path, text), local(path)
    if own is not None:
        os.replace(local(temp), own)
        return
    context, modes = _renames(spark, path)
    context.rename(*_two(spark, temp, path), modes(True))


def _two(spark: SparkSession, a: str, b: str):
    return (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (a, b))


def _renames(spark: SparkSession, path: str):
    """Hadoop's file context of a path, whose rename replaces in one step where the store can, and its modes."""
    fs = spark._jvm.org.apache.hadoop.fs
    kind = getattr(fs, "Options$Rename")

    def modes(overwrite: bool):
        out = spark._sc._gateway.new_array(kind, 1)
        out[0] = kind.OVERWRITE if overwrite else kind.NONE
        return out

    return fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration()), modes


class Appender:
    """A file that grows; what is appended is handed to the file system at once, and to its disks on request."""

    def __init__(self, spark: SparkSession, path: str):
        own = local(path)
        self.file = self.stream = None
        self.size = 0
        if own is not None:
            os.makedirs(os.path.dirname(own), exist_ok=True)
            self.file = open(own, "ab")
            self.size = self.file.tell()
            return
        fs, p = filesystem(spark, path)
        there = fs.exists(p)
        self.size = fs.getFileStatus(p).getLen() if there else 0
        self.stream = fs.append(p) if there else fs.create(p, False)

    def append(self, data: bytes, sync: bool = False) -> None:
        if self.file is not None:
            self.file.write(data)
            self.file.flush()
            if sync:
                os.fsync(self.file.fileno())
        else:
            self.stream.write(bytearray(data))
            self.stream.hsync() if sync else self.stream.hflush()
        self.size += len(data)

    def close(self) -> None:
        (self.file or self.stream).close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
