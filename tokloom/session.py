"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches stay small, so that a Python worker holds little beside the JVM heap.
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and bound the Arrow batches.

    The package's folder is put on the workers' path; on a cluster without a shared installation ship the package
    with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or one of our own in local mode only."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(os.environ.get("TMPDIR", "/tmp"), "tokloom-scratch")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tokloom-{sc.applicationId}"


_saved: list[str] = []


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _saved.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tokloom_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the table that ``df`` is, if ``save`` returned it; nothing made from it may still be to run."""
    if path := getattr(df, "_tokloom_path", None):
        _delete(df.sparkSession, path)
        _saved[:] = [p for p in _saved if p != path]


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables saved inside are deleted at the end, but for those given to the function that this yields, which returns them."""
    before, kept = len(_saved), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._tokloom_path)
        return df

    yield keep
    for path in [p for p in _saved[before:] if p not in kept]:
        _delete(spark, path)
        _saved.remove(path)


def is_folder(spark: SparkSession, name: str) -> bool:
    """Whether a path, of any file system that Spark reads, is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def forget(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it only when no DataFrame made from them is still to run."""
    _delete(spark, scratch_dir(spark))
    _saved.clear()
