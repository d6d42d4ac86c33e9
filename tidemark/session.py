"""Session and table access shared by all queries."""

from __future__ import annotations

import gc
import os
import re
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tidemark", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()
_TEMPORARY: dict[str, str] = {}  # folder of each local session


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python stages run wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="tidemark-code-"))
        sc.addPyFile(shutil.make_archive(str(base / "tidemark_code"), "zip", root.parent, root.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; all time arithmetic of the queries is in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where it is unset and the session is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.applicationId not in _TEMPORARY:
        _TEMPORARY[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _TEMPORARY[spark.sparkContext.applicationId]


def release(spark: SparkSession) -> None:
    """Have files of finished shuffles and dropped checkpoints removed now, not when the driver next collects its garbage.

    A thread of py4j, which wakes once a second, tells the JVM what Python has dropped: what it has not told yet is told here.
    What the first collection finds is let go by the JVM's reference threads and then frees the rest, so there is a second one;
    without either the files of the last step stay through the next."""
    gc.collect()
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while dropped:
        try:
            client, target = dropped[-1]  # not an object but a sign to stop: left to the thread
            client, target = dropped.pop()
        except (IndexError, TypeError, ValueError):
            break
        client.garbage_collect_object(target, False)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.1)
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder: for Python stages, which an eager checkpoint would run twice.

    In a ``folder`` of its own a table goes when the caller does away with it (:func:`remove`)."""
    ship(df.sparkSession)
    path = f"{folder or shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
