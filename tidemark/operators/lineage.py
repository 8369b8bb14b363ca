"""What operators need from the cluster: reliable checkpoints, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_core.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._tidemark_sent = True


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder of the cluster and read again.

    The folder is that of ``spark.checkpoint.dir``; only a local session without
    the setting gets one of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        sc.setCheckpointDir(folder)
        # The folder below it is this session's own.
        own = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        own.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(own)
    return df.checkpoint(eager=True)
