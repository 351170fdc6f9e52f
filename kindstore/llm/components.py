"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.session import materialize


def _hook(links: DataFrame, upward: bool) -> DataFrame:
    """One step: the neighbours of a node move to the smallest of them.

    ``upward`` moves the larger neighbours (large star), else the smaller ones and
    the node itself (small star).
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    if upward:
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        joined = both.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """The component of every linked node: ``node``, ``component`` (its smallest node).

    ``links`` has two columns ``a`` and ``b`` of one orderable type. Alternating
    large-star and small-star steps shorten every path to a star; each step is a
    grouped minimum and a join, which Spark can split if a node holds a large part
    of all links. Each round is written to the shared folder, which cuts the
    lineage. Nodes without a link to another node are not returned; null nodes are
    ignored; repeated links do no harm.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(ordered, "links")
    before = None
    while True:
        large = materialize(_hook(current, upward=True), "links")
        current = materialize(_hook(large, upward=False), "links")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        now = now.first()
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
