"""Join generations to their scores, and nest them under their prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.functions.scalars import whole_div
from kindstore.operators.texts import unpack_scores
from kindstore.schemas import ATTRIBUTES


def best_scores(unpacked: DataFrame) -> DataFrame:
    """One row per request; of repeated answers the fullest one is kept whole.

    Among equally full answers the largest by attribute order is taken.
    """
    filled = sum((F.col(a).isNotNull().cast("int") for a in ATTRIBUTES), F.lit(0))
    best = F.max(F.struct(filled.alias("_filled"), *ATTRIBUTES)).alias("_best")
    return unpacked.groupBy("request_id").agg(best).select("request_id", *[F.col(f"_best.{a}").alias(a) for a in ATTRIBUTES])


def collate_flat(generations: DataFrame, scores: DataFrame) -> DataFrame:
    """Every generation with its eight attributes, NULL where no score came back."""
    return generations.join(best_scores(unpack_scores(scores)), "request_id", "left")


def collate(
    generations: DataFrame, scores: DataFrame, prompts: DataFrame, rows_per_part: int | None = None
) -> DataFrame:
    """One row per prompt with its scored generations in order.

    With ``rows_per_part`` a prompt has a row for each so many positions, numbered by
    ``part``, so that no array grows beyond it; without, its generations stand in
    one row, ``part = 0``, whatever their number.
    Prompts without generations are dropped, as is an old ``generations`` column.
    """
    record = F.struct("pos", "text", *ATTRIBUTES)
    part = F.lit(0) if rows_per_part is None else whole_div(F.col("pos"), rows_per_part).cast("int")
    nested = (
        collate_flat(generations, scores)
        .groupBy("prompt_idx", part.alias("part"))
        .agg(F.sort_array(F.collect_list(record)).alias("_rows"))
        .select(
            "prompt_idx",
            "part",
            F.transform(
                "_rows", lambda r: F.struct(r["text"].alias("text"), *[r[a].alias(a) for a in ATTRIBUTES])
            ).alias("generations"),
        )
    )
    return prompts.drop("generations").join(nested, "prompt_idx")
