"""Writing collated rows, corpora and metric tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kindstore.operators.metrics import MODES


def write_collated(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Append collated rows as JSON lines; warn when some prompts are missing.

    Returns the number of prompts. A prompt may have several rows (parts) of any number, so prompts
    in parts are counted apart, by their ids alone.
    """
    seen = Observation("collated")
    df.observe(seen, F.count("*").alias("n")).write.mode("append").json(path)
    n = df.select("prompt_idx").distinct().count() if "part" in df.columns else seen.get["n"]
    if expected is not None and n != expected:
        warnings.warn(f"{n} collated rows, expected {expected}", stacklevel=2)
    return n


def write_corpus(df: DataFrame, path: str, by: Sequence[str] = ("store",), mode: str = "overwrite") -> None:
    """One folder of JSON records per store (or split, source, domain)."""
    df.write.mode(mode).partitionBy(*by).json(path)


def wide_metrics(df: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Long metrics ``mode, metric, value`` as metrics x modes."""
    return df.groupBy("metric").pivot("mode", list(modes)).agg(F.first("value"))


def grouped_lines(df: DataFrame, group: str, modes: Sequence[str] = MODES) -> DataFrame:
    """Long metrics ``mode, group, metric, value`` as the lines of a CSV with two header rows.

    The first row names the mode of each column and the second its group, in
    order of modes and then groups; the rows below are metrics. A result table
    holds a few numbers per group, so its columns are listed in one row.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode"))
    cells = df.select(place.alias("p"), "mode", F.col(group).cast("string").alias("g"), "metric", "value")
    columns = cells.agg(F.array_sort(F.collect_set(F.struct("p", "mode", F.coalesce("g", F.lit("")).alias("g")))).alias("c"))
    values = cells.groupBy("metric").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.struct("p", "mode", F.coalesce("g", F.lit("")).alias("g")), F.col("value").cast("string")))
        ).alias("v")
    )

    def line(first: Column, rest: Column) -> Column:
        return F.array_join(F.concat(F.array(first), rest), ",", "")

    def quoted(c: Column) -> Column:
        return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    top = F.posexplode(
        F.array(
            line(F.lit(""), F.transform("c", lambda c: quoted(c["mode"]))), line(F.lit(""), F.transform("c", lambda c: quoted(c["g"])))
        )
    )
    head = columns.select(top.alias("_order", "value"))
    body = values.crossJoin(F.broadcast(columns))  # one row on the right
    body = body.select(F.lit(2).alias("_order"), line(quoted(F.col("metric")), F.transform("c", lambda c: F.col("v")[c])).alias("value"))
    return head.unionByName(body)


def write_metrics(df: DataFrame, path: str, group: str | None = None, wide: bool = True, mode: str = "overwrite") -> None:
    """One CSV file of a handful of rows: metrics x modes, long, or with ``group`` metrics x (mode, group)."""
    if group is not None and wide:
        lines = grouped_lines(df, group).repartition(1).sortWithinPartitions("_order", "value").select("value")
        lines.write.mode(mode).option("compression", "none").text(path)
        return
    out = wide_metrics(df) if wide else df
    out.coalesce(1).write.mode(mode).option("header", True).csv(path)
