"""Table access and the shared folder that outlives executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = str(Path(__file__).resolve().parents[2])


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the session was made."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if not sc.master.startswith("local"):
        bundle = shutil.make_archive(f"{tempfile.mkdtemp()}/tidemark", "zip", ROOT, "tidemark")
        sc.addPyFile(bundle)


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Table ``name`` under ``base``; the session clock is pinned to UTC."""
    reach_workers(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting (tests, local runs) gets a folder
    of its own, which goes when the process ends; anywhere else a missing
    setting raises, since a folder of one machine isn't shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_dir, "_local", None)
        if base is None:
            base = shared_dir._local = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


#: Paths given out in this process, for ``release``.
_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete what this process has put into the shared folder; frames that were read from it can't be used any more.  Returns the paths that were there."""
    gone = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever is lost later."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for work heavy per row.

    Only a table of fewer splits than cores is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(3 * cores, key)
