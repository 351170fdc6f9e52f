"""A continual experiment: stores grow stage by stage, and after each stage the mixture is sampled and scored."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.operators.mixing import ensemble, knn_distribution, log_softmax, nucleus_filter, sample_tokens
from kindstore.operators.vectors import update_neighbours
from kindstore.plans.evaluation import continual_eval
from kindstore.session import exists, materialize
from kindstore.sources.datastore import append_datastore, read_datastore


def stage_neighbours(queries: DataFrame, path: str, stage: int, limits: dict[str, int]) -> DataFrame:
    """Neighbours over all entries up to a stage, from those of the stage before and the stage's own entries.

    Kept below ``path`` in a folder for each stage; a complete one is read back, so a run that
    broke off goes on where it stopped.
    """
    spark, place = queries.sparkSession, f"{path}/neighbours/{stage}"
    if not exists(spark, f"{place}/_SUCCESS"):
        before = spark.read.parquet(f"{path}/neighbours/{stage - 1}") if stage else None
        added = read_datastore(spark, f"{path}/datastore").where(F.col("batch") == stage).where(F.col("store").isin(*limits))
        added = added.select("store", "entry_id", "key", "token")
        update_neighbours(queries, before, added, limits).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def continual_run(
    queries: DataFrame,
    lm: DataFrame,
    prompts: DataFrame,
    arrivals: Sequence[DataFrame],
    scorer: Callable[[DataFrame], DataFrame],
    path: str,
    order: str,
    k: int = 1024,
    other_k: int | None = None,
    temperature: float = 100.0,
    alpha: float = 2.0,
    p: float = 0.9,
    draws: int = 25,
    seed: int = 42,
    stores: tuple[str, str] = ("toxic", "nontoxic"),
    threshold: float = 0.5,
) -> DataFrame:
    """Append, retrieve, mix, sample and score for every stage; metrics of all stages, overall and by domain.

    ``arrivals`` holds the rows of each stage: ``store, key, token`` and the unique ``order``.
    A stage is appended to the datastore below ``path``, only its own keys are searched, and neighbours are
    merged with those of the stage before. The distributions are mixed with the model's ``lm`` and
    sampled; ``scorer`` turns ``query_id, draw, token`` into ``query_id, toxicity``. ``prompts`` has a
    row a query: ``prompt_idx`` (its id), ``prompt`` and ``domain``. Everything is written by stage: a
    second run appends nothing again and searches nothing again.
    """
    spark = queries.sparkSession
    limits = dict(zip(stores, (k, k if other_k is None else other_k), strict=True))
    base = materialize(nucleus_filter(log_softmax(lm), p), "kept-tokens")  # every stage reads it
    for stage, rows in enumerate(arrivals):
        samples = f"{path}/samples/stage={stage}"
        if exists(spark, f"{samples}/_SUCCESS"):
            continue
        if not exists(spark, f"{path}/neighbours/{stage}/_SUCCESS"):
            for store in stores:
                append_datastore(rows.where(F.col("store") == store), f"{path}/datastore", store, stage, stage, order)
        near = stage_neighbours(queries, path, stage, limits)
        dist = materialize(knn_distribution(near, temperature), "distributions")  # read twice a store
        subtracted, added = (dist.where(F.col("store") == store) for store in stores)
        mixed = ensemble(base, subtracted, added, alpha)
        sample_tokens(mixed, draws, p, seed).write.mode("overwrite").parquet(samples)
    sampled = spark.read.schema("query_id bigint, draw int, token int, stage int").parquet(f"{path}/samples")
    scored = scorer(sampled).select("stage", F.col("query_id").alias("prompt_idx"), "toxicity")
    return continual_eval(scored, prompts, threshold=threshold)
