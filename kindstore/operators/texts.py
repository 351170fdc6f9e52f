"""Projections, flattening and cleaning of prompts, generations and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindstore.functions.scalars import strip_whitespace
from kindstore.operators.prefix import exclusive_prefix
from kindstore.schemas import ATTRIBUTES


def normalize_texts(df: DataFrame, column: str = "generations") -> DataFrame:
    """Turn any of the text shapes into ``array<string>``, decided by the schema."""
    kind = df.schema[column].dataType
    col = F.col(column)
    if isinstance(kind, T.StringType):
        texts = F.array(col)
    elif isinstance(kind, T.StructType) and "text" in kind.names:
        texts = F.array(col["text"])
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        texts = col
    elif (
        isinstance(kind, T.ArrayType)
        and isinstance(kind.elementType, T.StructType)
        and "text" in kind.elementType.names
    ):
        texts = F.transform(col, lambda x: x["text"])
    else:
        raise TypeError(f"column {column} is {kind.simpleString()}: expected text, a record with a text, or a list")
    return df.withColumn(column, texts)


def flatten_generations(df: DataFrame, column: str = "generations", n: int | None = None) -> DataFrame:
    """One row per generation with ``request_id = generation-<running number>``.

    With a fixed list length ``n`` the number is plain arithmetic on
    ``prompt_idx``; otherwise it is a running sum of the list lengths.
    """
    texts = normalize_texts(df, column)
    if n is None:
        sizes = texts.select("prompt_idx", F.size(column).cast("bigint").alias("_n"))
        starts = exclusive_prefix(sizes, "prompt_idx", "_n", "_start").select("prompt_idx", "_start")
        texts = texts.join(starts, "prompt_idx")
    else:
        texts = texts.withColumn("_start", F.col("prompt_idx") * n)
    return texts.select("prompt_idx", "_start", F.posexplode(column).alias("pos", "text")).select(
        F.concat(F.lit("generation-"), (F.col("_start") + F.col("pos")).cast("string")).alias("request_id"),
        "prompt_idx",
        F.col("pos").cast("bigint").alias("pos"),
        "text",
    )


def _probabilities(scores: Column) -> Column:
    """The score map with lower-case keys; any other score type is an error."""
    fine = F.forall(
        F.map_values(scores),
        lambda v: v["summaryScore"]["type"].eqNullSafe("PROBABILITY")
        & F.forall(
            F.coalesce(v["spanScores"], F.array().cast("array<struct<begin:int,end:int,score:struct<value:double,type:string>>>")),
            lambda s: s["score"]["type"].eqNullSafe("PROBABILITY"),
        ),
    )
    lowered = F.transform_keys(scores, lambda k, _: F.lower(k))
    return F.when(scores.isNotNull() & ~fine, F.raise_error(F.lit("score type is not PROBABILITY"))).otherwise(lowered)


def unpack_scores(scores: DataFrame) -> DataFrame:
    """``request_id`` and one nullable double per attribute."""
    lowered = scores.select("request_id", _probabilities(F.col("response.attributeScores")).alias("_scores"))
    return lowered.select(
        "request_id", *[F.col("_scores")[a]["summaryScore"]["value"].alias(a) for a in ATTRIBUTES]
    )


def unpack_spans(scores: DataFrame) -> DataFrame:
    """One row ``(request_id, begin, end, attribute, value)`` per scored span."""
    return (
        scores.select("request_id", F.explode(_probabilities(F.col("response.attributeScores"))).alias("attribute", "_s"))
        .select("request_id", "attribute", F.explode("_s.spanScores").alias("_span"))
        .select(
            "request_id",
            F.col("_span.begin").alias("begin"),
            F.col("_span.end").alias("end"),
            "attribute",
            F.col("_span.score.value").alias("value"),
        )
    )


def spans_by_attribute(spans: DataFrame) -> DataFrame:
    """Span rows side by side: one column per attribute."""
    return spans.groupBy("request_id", "begin", "end").pivot("attribute", list(ATTRIBUTES)).agg(F.max("value"))


def rescore_prompts(prompts: DataFrame, scores: DataFrame, carry: bool = False) -> DataFrame:
    """Replace the prompt record by its text and newly returned scores.

    ``scores`` holds ``prompt_idx`` and the attributes. With ``carry`` the old
    toxicity is kept as ``original_toxicity``, and the ``id`` and ``split`` of
    the old record move up.
    """
    fields = prompts.schema["prompt"].dataType.names
    kept = []
    if carry:
        kept = [F.col(f"prompt.{c}").alias(c) for c in ("id", "split") if c in fields]
        if "toxicity" in fields:
            kept.append(F.col("prompt.toxicity").alias("original_toxicity"))
    replaced = {"id", "split"} & set(fields) if carry else set()
    others = [c for c in prompts.columns if c not in ("prompt", "prompt_idx") and c not in replaced]
    new = scores.select("prompt_idx", F.struct(*ATTRIBUTES).alias("_new"))
    return prompts.join(new, "prompt_idx", "left").select(
        "prompt_idx",
        *others,
        F.struct(F.col("prompt.text").alias("text"), *[F.col(f"_new.{a}").alias(a) for a in ATTRIBUTES]).alias("prompt"),
        *kept,
    )


def wrap_prompts(df: DataFrame, column: str = "text", toxicity: float = 1.0) -> DataFrame:
    record = F.struct(F.col(column).alias("text"), F.lit(toxicity).cast("double").alias("toxicity"))
    return df.withColumn("prompt", record).drop(*([column] if column != "prompt" else []))


def binarize_flags(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """1 where the fraction reaches the threshold, else 0; NULL counts as 0."""
    return df.withColumns({c: F.when(F.col(c) >= threshold, 1).otherwise(0) for c in columns})


def _active(domains: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(d) == 1, F.lit(d)) for d in domains]))


def assign_domain(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Name of the single active flag; rows without one are dropped, several raise."""
    active = F.col("_active")
    name = F.when(F.size(active) == 1, active[0]).when(
        F.size(active) > 1, F.raise_error(F.lit("row with more than one domain"))
    )
    return (
        df.withColumn("_active", _active(domains))
        .where(F.size("_active") > 0)
        .withColumn("domain", name)
        .drop("_active")
    )


def assign_domains_multi(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    return df.withColumn("domain", F.array_join(_active(domains), ", "))


def remap_values(df: DataFrame, column: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Replace values by dictionary; a value that is not listed becomes NULL."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return df.withColumn(out or column, F.create_map(*pairs)[F.col(column)])


def clean_numbers(df: DataFrame, columns: Sequence[str], none_as: float | None = None) -> DataFrame:
    """Numbers from text: ``-`` is missing, thousands commas go, ``None`` takes a given value."""

    def number(c: str) -> Column:
        digits = F.regexp_replace(F.nullif(F.col(c), F.lit("-")), ",", "")
        filled = F.lit(None if none_as is None else float(none_as)).cast("double")
        return F.when(F.col(c) == "None", filled).otherwise(digits.try_cast("double"))

    return df.withColumns({c: number(c) for c in columns})


def row_totals(df: DataFrame, groups: Mapping[str, Sequence[str]], divisor: float = 3600.0) -> DataFrame:
    """Row-wise sums of column groups, in hours by default; missing parts count as 0."""
    out = {}
    for name, columns in groups.items():
        total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
        out[name] = total / F.lit(float(divisor))
    return df.withColumns(out)


def clean_texts(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop literal ``\\n``, then outer dashes, then outer white space."""
    no_breaks = F.regexp_replace(F.col(column), r"\\n", "")
    return df.withColumn(column, strip_whitespace(F.btrim(no_breaks, F.lit("-"))))


def extract_domains(paths: DataFrame, column: str = "path") -> DataFrame:
    """Sorted distinct domains of per-domain corpus file names."""
    name = F.regexp_extract(column, r"identity_(.*?)_(toxic|nontoxic)\.json", 1)
    return paths.select(name.alias("domain")).where("domain <> ''").distinct().orderBy("domain")
