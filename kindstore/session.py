"""Session defaults and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kindstore")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The folder of this application's intermediates: below ``spark.checkpoint.dir``, or else below the warehouse.

    Both are shared by the driver and all executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/kindstore-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``work_root``."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> None:
    """Remove all intermediates of this application.

    DataFrames that were made with their help can't be read afterwards, so this is for the
    end of a program, or for between two steps whose results are written.
    """
    place, system = file_system(spark, work_root(spark))
    system.delete(place, True)


def file_system(spark: SparkSession, path: str) -> tuple:
    """A path and the file system that holds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; any other trouble with the path raises."""
    place, system = file_system(spark, path)
    return system.exists(place)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    place, system = file_system(spark, path)
    if not system.exists(place):
        return []
    return [status.getPath().getName() for status in system.listStatus(place) if status.isDirectory()]


# What was shuffled for a written table is not read again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a costly intermediate table once and go on from its files.

    Used where a table is read several times in one plan (a vocabulary, the
    windows of a corpus): the files outlive lost executors, and counting them
    reads footers only. The shuffle files of the write are removed when it has ended, so that
    a chain of written tables holds the shuffles of one step at a time.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
