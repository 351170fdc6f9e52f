"""Evaluation of a model's generations, from raw scores to metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.operators.collate import collate_flat
from kindstore.operators.metrics import distinctness, toxicity_by_group, toxicity_metrics
from kindstore.operators.results import unpivot_metrics


def evaluate_toxicity(
    generations: DataFrame, scores: DataFrame, prompts: DataFrame, group: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """Generations, score responses and prompts to toxicity metrics in one lazy plan.

    The flat join is enough for the metrics; nested arrays are only built by
    ``collate`` for writing.
    """
    scored = collate_flat(generations.select("request_id", "prompt_idx"), scores).select("prompt_idx", "toxicity")
    if group is None:
        return toxicity_metrics(scored, prompts, threshold)
    return toxicity_by_group(scored, prompts, group, threshold)


def evaluation_table(
    generations: DataFrame, scores: DataFrame, prompts: DataFrame, threshold: float = 0.5
) -> DataFrame:
    """Toxicity and diversity as one long table ``mode, metric, value``."""
    toxicity = unpivot_metrics(evaluate_toxicity(generations, scores, prompts, None, threshold), ["mode"])
    diversity = unpivot_metrics(distinctness(generations).withColumn("mode", F.lit("full")), ["mode"])
    return toxicity.unionByName(diversity)


def continual_eval(
    scored: DataFrame, prompts: DataFrame, stage: str = "stage", group: str = "domain", threshold: float = 0.5
) -> DataFrame:
    """Overall and per-group metrics after every stage.

    ``scored`` has ``stage, prompt_idx, toxicity``. All stages are evaluated in
    one job: the stage is part of the prompt key.
    """
    key = F.struct(F.col(stage).alias("stage"), F.col("prompt_idx").alias("p")).alias("prompt_idx")
    worst = scored.groupBy(stage, "prompt_idx").agg(F.max("toxicity").alias("toxicity"))
    about = worst.join(prompts.select("prompt_idx", "prompt", group), "prompt_idx")
    rows = about.select(key, F.col(stage).alias("stage"), "prompt", group, "toxicity")
    per_stage = toxicity_by_group(rows.select("prompt_idx", "toxicity"), rows.drop("toxicity"), "stage", threshold)
    both = rows.withColumn("_both", F.struct("stage", F.col(group).alias("g")))
    per_group = toxicity_by_group(both.select("prompt_idx", "toxicity"), both.drop("toxicity"), "_both", threshold)
    metrics = ["avg_max", "toxicity_probability", "std_max"]
    return per_stage.select("stage", "mode", F.lit("Overall").alias(group), *metrics).unionByName(
        per_group.select("_both.stage", "mode", F.col("_both.g").alias(group), *metrics)
    )
