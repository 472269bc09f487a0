"""Sessions, tables and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "sievework", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench; on a cluster the session is the caller's."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder (a file or a directory of files), narrowed to the columns asked for."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def file_system(spark: SparkSession, path: str):
    """The engine's file system of a path, and the path for it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by plain name or URI, on the file system that the engine reads."""
    fs, at = file_system(spark, path)
    return fs.exists(at)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine only where it is unset and the master local."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"sievework-{os.getpid()}")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[str] = []


def _clean() -> None:
    """Remove the tables that this driver wrote; nothing else of the shared folder."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        try:
            fs, at = file_system(spark, _written.pop())
            fs.delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back: what follows neither recomputes it nor depends on an executor.

    Written tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sievework-{uuid.uuid4().hex}"
    if not _written:
        atexit.unregister(_clean)
        atexit.register(_clean)
    _written.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
