"""What every query needs of its session: table reads, the shared checkpoint folder, sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores.

    For costly work on few rows: a small file has one row group, which one task would read and work through alone. Where the
    scan has enough tasks of its own, which is the case for any large input, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a temporary folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            at = got.get()
        else:
            local = tempfile.mkdtemp(prefix="strandforge-")
            atexit.register(partial(shutil.rmtree, local, ignore_errors=True))
            at = "file://" + local
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    The written table survives the loss of any executor; a plan that uses the result several times reads
    the files instead of computing the input again. It is deleted by ``discard_materialised``, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def discard_materialised() -> None:
    """Deletes the tables that ``materialised`` wrote; call it once the results that read them are written."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended, and with it what could delete
            return
