"""Datastores as Parquet tables partitioned by store and stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindstore.schemas import DATASTORE
from kindstore.operators.prefix import dense_ids
from kindstore.session import exists

PARTITIONS = ("store", "stage", "batch")
_FULL = T.StructType(
    [*DATASTORE.fields, T.StructField("store", T.StringType()), T.StructField("stage", T.IntegerType()), T.StructField("batch", T.LongType())]
)


RANGES = "stage int, first bigint, last bigint, n bigint, store string, batch bigint"


def write_datastore(
    df: DataFrame, path: str, mode: str = "overwrite", batches: list[tuple[str, int]] | None = None
) -> None:
    """Persist ``store, stage, batch, entry_id, key, token``; only given partitions are replaced.

    Files lie in order of the entry id: a file holds one range of ids of a batch, so that a
    filter on the id skips files and row groups. The range of each batch goes into a
    small table beside the data (``entry_ranges``), written last. ``batches`` names the (store,
    batch) pairs of the rows, if they are known.
    """
    for name in ("stage", "batch"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0))
    order = [*PARTITIONS, "entry_id"]
    rows = df.select("entry_id", F.col("key").cast("array<float>").alias("key"), "token", *PARTITIONS)
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )
    if batches is None:
        batches = [(r["store"], r["batch"]) for r in df.select("store", "batch").distinct().collect()]
    _write_ranges(df.sparkSession, path, batches)


def _write_ranges(spark: SparkSession, path: str, batches: list[tuple[str, int]]) -> None:
    """Note the id ranges of written batches: only their ids are read."""
    if not batches:
        return
    own = F.lit(False)
    for store, batch in batches:
        own = own | ((F.col("store") == store) & (F.col("batch") == batch))
    ranges = read_datastore(spark, path).where(own).groupBy("store", "batch", "stage").agg(
        F.min("entry_id").alias("first"), F.max("entry_id").alias("last"), F.count("*").alias("n")
    )
    ranges.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store", "batch").parquet(
        f"{path}/_ranges"
    )


def entry_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``store, batch, stage, first, last, n``: ids of each batch, from the small table beside the data."""
    if not exists(spark, f"{path}/_ranges"):
        return spark.createDataFrame([], RANGES)
    return spark.read.schema(RANGES).parquet(f"{path}/_ranges")


def read_first(spark: SparkSession, path: str, store: str, n: int) -> DataFrame:
    """The first ``n`` entries of a store; asking for more than there are raises.

    The ranges say which batches begin below ``n``: no other folder is listed for reading, and
    within the last of them the order of the files lets the scan skip the rest.
    """
    # A row for each batch, and a store has as many batches as it has grown times.
    mine = entry_ranges(spark, path).where(F.col("store") == store).select("batch", "stage", "first", "n").collect()
    if sum(r["n"] for r in mine) < n:
        raise ValueError(f"datastore has fewer than {n} entries")
    batches = sorted({r["batch"] for r in mine if r["first"] < n})
    kept = read_datastore(spark, path, store).where(F.col("batch").isin(batches))
    return kept.where(F.col("entry_id") < n)


def read_datastore(spark: SparkSession, path: str, store: str | None = None, upto: int | None = None) -> DataFrame:
    """The store, optionally only its stages up to ``upto`` (pruned partitions)."""
    df = spark.read.schema(_FULL).parquet(path)
    if store is not None:
        df = df.where(F.col("store") == store)
    return df if upto is None else df.where(F.col("stage") <= upto)


def datastore_size(spark: SparkSession, path: str, store: str | None = None) -> DataFrame:
    """Entries per store (from Parquet footers); NULL for a store that is not there."""
    if not exists(spark, path):
        return spark.createDataFrame([(store, None)], "store string, n bigint")
    df = read_datastore(spark, path, store)
    if store is None:
        return df.groupBy("store").agg(F.count("*").alias("n"))
    return df.agg(F.lit(store).alias("store"), F.nullif(F.count("*"), F.lit(0)).alias("n"))


def next_entry(spark: SparkSession, path: str, store: str, before: int) -> int:
    """First free id behind all earlier batches: the largest id so far plus one, from the ranges alone."""
    earlier = entry_ranges(spark, path).where((F.col("store") == store) & (F.col("batch") < before))
    return earlier.agg(F.coalesce(F.max("last") + 1, F.lit(0)).alias("n")).first()["n"]


def append_datastore(rows: DataFrame, path: str, store: str, stage: int | str, batch: int, order: str) -> None:
    """Add ``key, token`` rows behind the existing ones of a store, as batch ``batch``.

    Rows are numbered by the unique bigint ``order``. ``stage`` is a number or
    the name of a column. Old rows are untouched and not read, and writing the same batch
    again replaces it with the same ids, so a repeat does no harm. A batch whose range
    is not noted yet (a write that broke off) counts as not there and is written again.
    """
    start = next_entry(rows.sparkSession, path, store, batch)
    numbered = dense_ids(rows, order, "_place")
    which = F.col(stage) if isinstance(stage, str) else F.lit(stage)
    write_datastore(
        numbered.select(
            (F.col("_place") + start).alias("entry_id"),
            "key",
            "token",
            F.lit(store).alias("store"),
            which.cast("int").alias("stage"),
            F.lit(batch).cast("bigint").alias("batch"),
        ),
        path,
        batches=[(store, batch)],
    )
