"""Growth by arriving files: domain after domain, and scoring of new texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindstore.operators.corpus import resume_pending
from kindstore.operators.plugins import Scorer, score_texts
from kindstore.schemas import SCORES
from kindstore.session import exists, materialize
from kindstore.sources.datastore import append_datastore

BUCKETS = 64
ANSWERED = "request_id string, batch bigint, bucket int"


def stream_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """JSON files in order of arrival, one micro-batch per file by default."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def continual_ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    encode: Callable[[DataFrame], DataFrame] = lambda df: df,
    order: str = "vec_id",
    stores: Sequence[str] = ("toxic", "nontoxic"),
) -> StreamingQuery:
    """Append every arriving batch to the datastore at ``path``, store by store.

    Rows carry ``stage, store, key, token`` (after ``encode``) and the unique
    ``order`` column. The checkpoint lists the files that are done, so a rerun
    skips finished domains; a batch repeated after a failure rewrites its own
    partitions with the same ids. A store without a file for some stage keeps
    its earlier entries.
    """

    def add(batch: DataFrame, number: int) -> None:
        # Written once: every store reads it, and numbers its rows apart from carrying them.
        encoded = materialize(encode(batch), "encoded")
        for store in stores:
            append_datastore(encoded.where(F.col("store") == store), path, store, "stage", number, order)

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    stream: DataFrame,
    scorer: Scorer,
    out: str,
    checkpoint: str,
    rate: int = 25,
    partitions: int | None = None,
    interval: float = 1.0,
) -> StreamingQuery:
    """Score arriving ``request_id, text`` rows once, appending the responses.

    Each micro-batch writes its own folder, so that a repeated batch replaces
    itself, and leaves out requests that any other batch has answered. Their ids
    are kept beside ``out`` (``<out>-answered``), in buckets, so a batch reads the
    ids of its own buckets and no response.
    """
    answered = f"{out.rstrip('/')}-answered"
    bucket = F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def score(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pending = batch.dropDuplicates(["request_id"])
        if exists(spark, answered):
            wanted = [r[0] for r in pending.select(bucket).distinct().collect()]  # BUCKETS numbers at most
            done = spark.read.schema(ANSWERED).parquet(answered).where(F.col("batch") != number)
            pending = resume_pending(pending, done.where(F.col("bucket").isin(wanted)))
        answers = score_texts(pending, scorer, rate, partitions, interval)
        folder = f"{out}/batch={number}"
        answers.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
        ids = spark.read.schema(SCORES).json(folder).select("request_id", bucket)
        ids.write.mode("overwrite").partitionBy("bucket").parquet(f"{answered}/batch={number}")

    return (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def count_failures(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.count("error").alias("n_failed"))
