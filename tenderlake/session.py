"""Session set-up, table access and shared-storage stages."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Folders that ``stage`` wrote in this process, and those of them that later queries may read again.
_STAGES: list[str] = []
_KEPT: dict[tuple, str] = {}


def build_session(cpus: int | str = "*", name: str = "tenderlake", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows that cost much: spread over all cores if they come in fewer than half as many parts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts, spread if it lies in few files."""
    return spread(table(spark, folder, name))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tenderlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later stages survive lost executors by reading the files again,
    and work that several branches use is done once.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def kept(spark: SparkSession, name: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage ``name`` of the tables of ``folder``: written by the first query of a session that asks for it, read by the others."""
    key = (spark.sparkContext.applicationId, name, folder)
    if key in _KEPT:
        files, path = _file_system(spark, _KEPT[key])
        if files.exists(path):
            return spark.read.parquet(_KEPT[key])
    df = stage(build(), name)
    _KEPT[key] = _STAGES[-1]
    return df


def drop_stages(spark: SparkSession) -> int:
    """Remove what ``stage`` wrote; results that read it must have been written before."""
    gone = 0
    _KEPT.clear()
    while _STAGES:
        files, path = _file_system(spark, _STAGES.pop())
        gone += bool(files.delete(path, True))
    return gone
