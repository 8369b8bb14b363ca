"""What the operators need from the cluster: code on the executors, a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "tidemark.shipped"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the setting is absent (as in local tests) a local folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it again: this cuts its lineage.

    The rows survive the loss of executors. The files are removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the stored tables, removed when the session ends."""
    path = f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _delete_on_exit(spark, path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is run inside."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _path(spark, path)
    fs.delete(hadoop, True)


def newest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The path of the last file, by name, with a prefix; a file that was not finished has another name."""
    hadoop, fs = _path(spark, folder)
    if not fs.exists(hadoop):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    found = sorted(n for n in names if n.startswith(prefix))
    return f"{folder}/{found[-1]}" if found else None


def read_text(spark: SparkSession, path: str) -> str:
    hadoop, fs = _path(spark, path)
    stream = fs.open(hadoop)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    part, fs = _path(spark, f"{path.rpartition('/')[0]}/unfinished-{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(part, _path(spark, path)[0]):
        raise OSError(f"{path} cannot be written")


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
