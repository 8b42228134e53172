"""Small helpers over the Hadoop file system that Spark itself uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder and what is in it; a missing one is no error."""
    _fs(spark, path).delete(_path(spark, path), True)


def modified_millis(spark: SparkSession, path: str) -> int:
    return _fs(spark, path).getFileStatus(_path(spark, path)).getModificationTime()


def child_names(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    return [s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path))]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Where that is unset and the
    session is local, a temporary folder serves; on a cluster it would be invisible to the
    executors, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tiffinlake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that readers see whole or not at all: written under a hidden name, then renamed."""
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    fs = _fs(spark, path)
    out = fs.create(_path(spark, hidden), True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(_path(spark, hidden), _path(spark, path)):
        fs.delete(_path(spark, hidden), False)  # someone else was first


def get_text(spark: SparkSession, path: str) -> str:
    """The content of a small text file."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
