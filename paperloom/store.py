"""Tables in the folder that driver and executors share: where a plan's lineage is cut, and intermediate results live."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table up to which it is broadcast.
BROADCAST_ROWS = 500_000


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for columns of an operator's own beside those that are taken, whose case doesn't count."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and everything runs in one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing will read them again."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            with contextlib.suppress(Exception):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast up to BROADCAST_ROWS rows and joined by both sides' keys beyond."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written
