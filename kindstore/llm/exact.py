"""Exact deduplication by a tree of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import SPACES, narrow
from kindstore.session import materialize

LANES = 64
FAN_IN = 8
_SAME = ("_digest", "_bytes", "_check")


def normalized(text: Column) -> Column:
    """Every run of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES) -> DataFrame:
    """One narrow row per document: its lane, and digest, length and second hash of its text."""
    text = F.col("_text")
    return (
        narrow(df, _id=id_col, _text=text_col)
        .withColumn("_text", normalized(text))
        .select(
            "_id",
            F.pmod(F.xxhash64("_id"), F.lit(lanes)).cast("int").alias("_lane"),
            F.unhex(F.sha2(text, 256)).alias("_digest"),
            F.octet_length(text).alias("_bytes"),
            F.xxhash64(text).alias("_check"),
        )
    )


def merge_runs(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs become one.

    An entry of a run is a digest with the smallest id and the number of rows
    seen so far. Entries meet only if digest, byte length and second hash all
    agree, so every level verifies what it merges. As the smallest id is a
    structure, Spark sorts each piece of a run and merges sorted pieces; a task
    holds one part of the digests of a run, never a whole run.
    """
    return (
        runs.withColumn("_lane", F.floor(F.col("_lane") / fan_in).cast("int"))
        .groupBy("_lane", *_SAME)
        .agg(F.min("_keep").alias("_keep"), F.sum("_rows").alias("_rows"))
    )


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lanes: int = LANES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Which rows have the same text, white space aside, and which one of them stays.

    Rows are dealt to ``lanes`` runs by a hash of their id, and each run holds a
    digest once. Rounds of ``fan_in``-way merges turn the runs into one; with a
    fan-in of 2 they are the rounds of a binomial tree. The root's answer then
    goes back through the leaves, so no key of that join holds more than
    1 / ``lanes`` of a group of copies. A fan-in of 8 keeps the rounds, each a
    shuffle of narrow rows, at two.

    Returns one row per input row: ``id_col``, ``keep_id`` (smallest id of the
    equal texts), ``group_size``, ``kept``, ``text_sha256`` (of the normalised
    text, lowercase hex).

    Defined cases: a null text is the empty text, and all empty texts are one
    group. A null id counts in its group but stays only if all ids of the group
    are null (``keep_id`` null). Rows that repeat the id that stays are the same
    document and stay with it. Further columns are ignored. No rows give none.
    """
    if fan_in < 2 or lanes < 1:
        raise ValueError("fan_in must be 2 or more and lanes 1 or more")
    rows = materialize(digests(df, id_col, text_col, lanes), "digests")
    leaves = rows.groupBy("_lane", *_SAME).agg(
        F.min(F.struct(F.isnull("_id").alias("missing"), F.col("_id").alias("id"))).alias("_keep"),
        F.count("*").alias("_rows"),
    )
    leaves = materialize(leaves, "digest-runs")
    root, width = leaves, lanes
    while width > 1:
        root, width = merge_runs(root, fan_in), -(-width // fan_in)
    root = root.select(*_SAME, F.col("_keep.id").alias("_keep"), "_rows")
    answers = leaves.select("_lane", *_SAME).join(root, list(_SAME))
    return rows.join(answers, ["_lane", *_SAME]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_rows").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
