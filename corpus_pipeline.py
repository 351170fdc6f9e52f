"""The document pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindstore.llm.base import numbered
from kindstore.llm.bpe import round_trip
from kindstore.llm.exact import exact_groups
from kindstore.llm.language import fit_language, with_language
from kindstore.llm.mixing import membership, mix_sources, word_count
from kindstore.llm.registry import table
from kindstore.llm.simhash import near_groups
from kindstore.session import materialize

LEAST_SCORE = 0.2
RANKS = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (null and empty texts too), or with a hopeless score, go.

    Every row is judged by its own text, repeated ones too; ids play no part. Nothing to learn from
    (an empty table, no language known) gives no rows.
    """
    return with_language(docs, fit_language(docs), least_score=LEAST_SCORE)


def _one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """One row of each group, the one with the smallest id (then the smallest digest of the text, then the other columns).

    ``groups`` gets rows named by id and digest of the text, ``_row``, with their
    ``text``, and returns for each the ``_row`` that names its group as ``name``.
    Rows that agree in id and text have one name, and one of them stays.
    """
    rows = numbered(docs)
    ident, text = (F.col(f"_column{docs.columns.index(c)}") for c in ("doc_id", "text"))
    key = F.struct(ident.isNull().alias("a"), ident.alias("b"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("c"), text.isNull().alias("d"))
    rows = rows.withColumn("_row", key)
    # Rows that agree in all columns become one before any text is shuffled by its key.
    others = F.struct(*[F.col(c) for c in rows.columns[:-1] if c != f"_column{docs.columns.index('text')}"])
    found = groups(rows.select("_row", text.alias("text")))
    stays = found.where(F.col("_row") == F.col(name)).select("_row").distinct()
    least = rows.groupBy("_row").agg(F.min(others).alias("_others")).join(stays, "_row")
    least = least.select(F.col("_row").alias("_r"), F.col("_others").alias("_o"))
    kept = rows.distinct().join(least, (F.col("_row") == F.col("_r")) & others.eqNullSafe(F.col("_o")), "left_semi")
    return kept.drop("_row").toDF(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: the one with the smallest id.

    A null text counts as empty and all empty texts are equal; rows without an id
    go last, so one stays only if its whole group has none. Of rows that agree in id
    and text one stays, the one with the least other columns. An empty table stays empty.
    """
    return _one_of_each(docs, lambda rows: exact_groups(rows, "_row"), "keep_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies: the one with the smallest id.

    Texts without a word, null or empty, are near-copies of each other. Rows without an
    id go last. Of rows that agree in id one stays of each group, the one with the least digest
    of the text; of rows that agree in id and text, the one with the least other columns.
    """
    return _one_of_each(docs, lambda rows: near_groups(rows, "_row"), "component_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or repeated.

    Rows that share id and source are taken equally often, a null id or source is one
    of its own; rows whose text is null or has no word are never taken.
    """
    mixed = mix_sources(docs).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("pattern").alias("_pattern"))
    # All rows of an id and a source are taken equally often.
    times = mixed.agg(F.max(F.expr("int(taken div size)")).alias("_times"))
    ident, text, source = (F.col(f"_column{docs.columns.index(c)}") for c in ("doc_id", "text", "source"))
    rows = numbered(docs).where(word_count(text) > 0)
    joined = rows.join(times, ident.eqNullSafe(F.col("_id")) & (membership(F.array(source)) == F.col("_pattern")))
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times")))
    return copies.select(*rows.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and of what they decode to, as digests; a null text counts as empty."""
    return round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

# Language models and byte-pair merges are not SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
