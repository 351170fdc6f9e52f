"""Join with a lookup table whose keys are unique but unevenly used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 2048
SMALL_ROWS = 1_000_000
SMALL_CHARS = 64_000_000


def is_small(lookup: DataFrame, rows: int | None = None, chars: int | None = None) -> bool:
    """Whether a table is proven small enough to broadcast: rows and text are counted."""
    rows, chars = SMALL_ROWS if rows is None else rows, SMALL_CHARS if chars is None else chars
    texts = [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c, t in lookup.dtypes if t == "string"]
    size = lookup.agg(F.count("*").alias("rows"), sum(texts, F.lit(0)).alias("chars")).first()
    return size["rows"] <= rows and size["chars"] <= chars


def lookup_join(
    left: DataFrame, lookup: DataFrame, on: list[str], weight: str | None = None, how: str = "inner"
) -> DataFrame:
    """``left`` joined with ``lookup`` (one row per key), safe for hot keys.

    ``lookup`` should be a written table, as it is counted first. A small one is
    broadcast. Of a large one only the ``HEAVY_ROWS`` keys most used in ``left`` are
    broadcast: ``weight`` names a column of ``lookup`` that holds this use, and
    without one the keys of ``left`` are counted, so that a key which is common
    there but rare, or unknown, where the table came from counts as hot too. Any
    other key then holds at most 1 / HEAVY_ROWS of the rows, so the shuffled join of
    the rest is even.
    """
    payload = [c for c in lookup.columns if c not in (*on, weight)]
    table = lookup.select(*on, *payload)
    if is_small(lookup):
        return left.join(F.broadcast(table), on, how)
    used = lookup.select(*on, F.col(weight).alias("_use")) if weight else left.groupBy(*on).agg(F.count("*").alias("_use"))
    # Both broadcasts hold HEAVY_ROWS rows at most.
    heavy = used.orderBy(F.desc("_use"), *on).limit(HEAVY_ROWS).select(*on)
    hot = left.join(F.broadcast(heavy.join(table, on, how)), on)
    rest = left.join(F.broadcast(heavy), on, "left_anti")
    return hot.unionByName(rest.join(table, on, how))
