"""Exact token counts: a histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindstore.llm.bpe import encode_documents

BIN = 1024


def length_histogram(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Number of documents of each encoded length: ``length``, ``n_docs``.

    Counts are summed in each task before the shuffle, so a length that a third
    of all documents share costs one row a task. Null and empty texts have length
    0; repeated rows count each; no rows give an empty histogram.
    """
    return (
        encode_documents(df, ranks_path, pattern, id_col, text_col)
        .select(F.expr("octet_length(ids) div 4").cast("bigint").alias("length"))
        .groupBy("length")
        .agg(F.count("*").alias("n_docs"))
    )


def suffix_sums(histogram: DataFrame, bin_size: int = BIN) -> DataFrame:
    """What a context limit of each occurring length cuts.

    For every ``length`` L of the histogram: ``n_docs`` (of exactly L), ``docs_ge``
    and ``tokens_ge`` (documents of L or more and their tokens), ``docs_longer``,
    ``truncated_total`` (tokens left when each document is cut to L),
    ``lost_tokens`` and ``share_fitting`` (documents of at most L). A limit
    between two lengths is answered from the next longer one, see
    ``truncated_totals``; a quantile is the first length whose share reaches it.

    Sums run within bins of lengths and over the totals of bins, so no task sorts
    all lengths.
    """
    rows = histogram.withColumn("_bin", F.floor(F.col("length") / bin_size)).withColumn(
        "_tokens", F.col("length") * F.col("n_docs")
    )
    totals = rows.groupBy("_bin").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_bin",
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"_later{c}") for c in ("_d", "_t")],
        *[F.sum(c).over(every).alias(f"_all{c}") for c in ("_d", "_t")],
    )
    within = Window.partitionBy("_bin").orderBy(F.desc("length"))
    docs = F.col("_later_d") + F.sum("n_docs").over(within)
    tokens = F.col("_later_t") + F.sum("_tokens").over(within)
    return (
        rows.join(totals, "_bin")
        .withColumn("docs_ge", docs)
        .withColumn("tokens_ge", tokens)
        .withColumn("truncated_total", F.col("_all_t") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge"))
        .select(
            "length",
            "n_docs",
            "docs_ge",
            "tokens_ge",
            (F.col("docs_ge") - F.col("n_docs")).alias("docs_longer"),
            "truncated_total",
            (F.col("_all_t") - F.col("truncated_total")).alias("lost_tokens"),
            ((F.col("_all_d") - F.col("docs_ge") + F.col("n_docs")) / F.col("_all_d")).alias("share_fitting"),
        )
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Token totals when documents are cut to each of ``limits``: ``limit``, ``truncated_total``.

    Exact for any limit: with the next longer length L and its suffix sums, the
    total at L less (L - limit) for each document of L or more. Beyond the
    longest document it is the total of all tokens; 0 without rows.
    """
    asked = sums.sparkSession.createDataFrame([(int(n),) for n in limits], "limit bigint")
    whole = sums.agg(F.coalesce(F.max(F.col("truncated_total")), F.lit(0)).alias("_whole"))
    found = (
        sums.select("length", "docs_ge", "truncated_total")
        .join(F.broadcast(asked), F.col("length") >= F.col("limit"))
        .groupBy("limit")
        .agg(F.min_by(F.struct("length", "docs_ge", "truncated_total"), "length").alias("_next"))
    )
    at = F.col("_next.truncated_total") - (F.col("_next.length") - F.col("limit")) * F.col("_next.docs_ge")
    return (
        asked.join(found, "limit", "left")
        .join(F.broadcast(whole))
        .select("limit", F.coalesce(at, F.col("_whole")).alias("truncated_total"))
    )


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The shortest length that the given share of documents does not exceed: ``share``, ``length``."""
    asked = sums.sparkSession.createDataFrame([(float(q),) for q in shares], "share double")
    return (
        sums.select("length", "share_fitting")
        .join(F.broadcast(asked), F.col("share_fitting") >= F.col("share"))
        .groupBy("share")
        .agg(F.min("length").alias("length"))
    )
