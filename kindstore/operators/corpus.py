"""Corpus and prompt preparation: splits, unions, samples, continual domains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindstore.functions.scalars import seed_order
from kindstore.operators.prefix import dense_ids
from kindstore.operators.texts import clean_texts


def _stores(df: DataFrame, toxic: Column, nontoxic: Column) -> DataFrame:
    store = F.when(toxic, "toxic").when(nontoxic, "nontoxic")
    return df.withColumn("store", store).where("store is not null")


def split_by_toxicity(
    df: DataFrame, toxic_gt: float = 0.5, nontoxic_le: float = 0.1, column: str = "toxicity"
) -> DataFrame:
    """Scored corpus: clearly toxic and clearly nontoxic texts; the middle goes."""
    return _stores(df, F.col(column) > toxic_gt, F.col(column) <= nontoxic_le)


def split_by_label(
    df: DataFrame, toxic_ge: float = 0.5, nontoxic_lt: float = 0.1, column: str = "prompt_label"
) -> DataFrame:
    """Labelled prompts: the boundaries fall on the other side than for scores."""
    return _stores(df, F.col(column) >= toxic_ge, F.col(column) < nontoxic_lt)


def identity_filter(df: DataFrame, by: str = "split") -> DataFrame:
    any_one, several = F.col("identity_any") == 1, F.col("more_than_one_identity")
    return df.groupBy(by).agg(
        F.count_if(several).alias("n_multiple"),
        F.count_if(any_one).alias("n_any"),
        F.count_if(any_one & ~several).alias("n_single"),
        F.count_if(F.col("identity_any") == 0).alias("n_none"),
    )


def limit_prompts(df: DataFrame, n: int, done: DataFrame | None = None, order: str = "prompt_idx") -> DataFrame:
    """The first ``n`` prompts in order (unique values), less those already done.

    Only the column of the order is ranked; whole rows are then picked where they lie.
    """
    first = _picked(df, df.select(order).orderBy(order).limit(n), order, n)
    return first if done is None else first.join(done.select(order).distinct(), order, "left_anti")


# Ids that are sent to the rows they pick.
BROADCAST_IDS = 1_000_000


def _picked(df: DataFrame, ids: DataFrame, ident: str, n: int) -> DataFrame:
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, ident, "left_semi")


def holdout_split(df: DataFrame, order: str, percent: float = 5) -> DataFrame:
    """First ``percent`` of the rows are the validation split, the rest trains."""
    cut = df.agg(F.round(F.count("*") * percent / 100).cast("bigint").alias("cut")).scalar()
    split = F.when(F.col("_row") < cut, "validation").otherwise("train")
    return dense_ids(df, order, "_row").withColumn("split", split).drop("_row")


def union_corpora(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


PROMPT_LINE = "\\n- "  # Fixed value: a literal backslash, n, dash, blank.


def dedup_prompt_lines(df: DataFrame, clean: bool = True) -> DataFrame:
    """Distinct lines of the prompts per store, plus every generation as it is.

    Lines are compared before cleaning, so two of them may end up equal.
    """
    pieces = F.split("prompt", PROMPT_LINE.replace("\\", "\\\\"))
    lines = df.select("store", F.explode(pieces).alias("text")).distinct()
    both = lines.unionByName(df.select("store", F.col("generation").alias("text")))
    return clean_texts(both) if clean else both


def cumulative_domains(df: DataFrame, order: Sequence[str], column: str = "domain") -> DataFrame:
    """Training set of stage d = all rows of the domains 0..d."""
    names = F.array(*[F.lit(d) for d in order])
    rank = F.array_position(names, F.col(column)).cast("int") - 1
    return df.where(rank >= 0).withColumn("stage", F.explode(F.sequence(rank, F.lit(len(order) - 1))))


def stratified_sample(df: DataFrame, by: str, n: int = 100, seed: int = 42, ident: str = "id") -> DataFrame:
    """Exactly ``n`` rows per group (all rows of a smaller group)."""
    order = Window.partitionBy(by).orderBy(seed_order(seed, F.col(ident)), ident)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def seeded_sample(df: DataFrame, n: int, seed: int = 42, ident: str = "id") -> DataFrame:
    """At most ``n`` rows by unique ids; the same ones on every run. Only ids are ranked."""
    ids = df.select(ident).orderBy(seed_order(seed, F.col(ident)), ident).limit(n)
    return _picked(df, ids, ident, n)


def cumulative_counts(df: DataFrame, by: str) -> DataFrame:
    """Running total of group sizes, over the aggregated rows."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    upto = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("n_cumulative", F.sum("n").over(upto))


def resume_pending(todo: DataFrame, done: DataFrame, on: str = "request_id", retry_errors: bool = False) -> DataFrame:
    """Work not seen before; a request that failed counts as done unless retried."""
    if retry_errors and "error" in done.columns:
        done = done.where("error is null")
    return todo.join(done.select(on), on, "left_anti")


