"""Shared-folder tables: cut long lineages and write results so that executor loss costs nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None
_setting = RLock()
#: Marts written side by side: a mart's small jobs and the walks between them leave most cores idle.
AT_ONCE = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Where neither is set, a local session (tests) gets a folder of its own; a cluster is refused, as its
    executors would each write to their own disk and later reads would miss those files.
    """
    global _fallback
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    configured = configured or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="codequarry-")
    return _fallback


@contextmanager
def setting(spark: SparkSession, key: str, value: int | None) -> Iterator[None]:
    """A session setting for the jobs of a ``with`` block, as it was afterwards; None changes nothing. One block at a time has one."""
    if value is None:
        yield
        return
    with _setting:
        before = spark.conf.get(key, None)
        spark.conf.set(key, str(value))
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/codequarry/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``settle`` wrote and that no plan reads any more."""
    context = table.sparkSession.sparkContext
    for path in {name.rpartition("/")[0] for name in table.inputFiles()}:
        if "/codequarry/" in path:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def write_mart(df: DataFrame, path: str, run_date: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write one mart, partitioned by run date (and more columns if named); reruns replace their date."""
    from pyspark.sql import functions as F

    (
        df.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date", *partition_by)
        .parquet(path)
    )
    return path


def write_marts(marts: dict[str, DataFrame | Callable[[], DataFrame]], folder: str, run_date: str) -> dict[str, str]:
    """Write each mart to a folder of its name under ``folder``, ``AT_ONCE`` side by side; its path by name.

    A mart may be given as a function that makes it, so that what it needs is also made side by side.
    """

    def write(name: str) -> str:
        mart = marts[name]
        return write_mart(mart() if callable(mart) else mart, f"{folder.rstrip('/')}/{name}", run_date)

    in_session = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(AT_ONCE) as pool:
        started = {name: pool.submit(in_session(write), name) for name in marts}
        return {name: job.result() for name, job in started.items()}
