"""Running offsets and gap-free ids without an unpartitioned window on raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindstore.session import materialize


def running_sum(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """The sum over smaller ``order`` in one task, for tables with few rows by their nature."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("bigint"))


def exclusive_prefix(
    counts: DataFrame, ident: str, amount: str | list[str], out: str | list[str] = "offset"
) -> DataFrame:
    """``ident``, each ``amount`` and the sum of it over all rows with a smaller ``ident``.

    ``ident`` is unique and may be of any orderable type: ids can be dense, spread
    over all 64 bits, or negative; a repeated or NULL one raises, as it has no place. The columns are range-partitioned by it and
    written once (so this runs a job), since the partition numbers must be the same
    for both readers. Each partition is then summed on its own, and the only
    single-task step sees one row per partition.
    """
    amounts, outs = ([x] if isinstance(x, str) else x for x in (amount, out))
    ranged = counts.select(ident, *amounts).repartitionByRange(ident).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy("_part").agg(*[F.sum(x).alias(f"_total{i}") for i, x in enumerate(amounts)])
    # Equal values fall into one range.
    before = Window.partitionBy("_part").orderBy(ident)
    again = F.col(ident).isNull() | F.col(ident).eqNullSafe(F.lag(ident).over(before))
    if not ranged.select(again.alias("_again")).where("_again").isEmpty():
        raise ValueError(f"{ident} must be unique and not null to put rows in order")
    for i in range(len(amounts)):
        totals = running_sum(totals, "_part", f"_total{i}", f"_start{i}")
    starts = totals.select("_part", *[f"_start{i}" for i in range(len(amounts))])
    within = before.rowsBetween(Window.unboundedPreceding, -1)
    local = [F.coalesce(F.sum(x).over(within), F.lit(0)).alias(f"_local{i}") for i, x in enumerate(amounts)]
    # `starts` has a row per partition, so it is always small.
    placed = ranged.select("*", *local).join(F.broadcast(starts), "_part")
    sums = [(F.col(f"_start{i}") + F.col(f"_local{i}")).cast("bigint").alias(x) for i, x in enumerate(outs)]
    return placed.select(ident, *amounts, *sums)


def dense_ids(df: DataFrame, order: str, out: str = "entry_id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of a unique column; only that column is numbered.

    A repeated or NULL value of ``order`` raises.
    """
    places = exclusive_prefix(df.select(order, F.lit(1).alias("_one")), order, "_one", out).drop("_one")
    return df.join(places, order).select(*df.columns, out)
