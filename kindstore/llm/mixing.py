"""Mixing overlapping sources to target weights."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindstore.llm.base import WORDS, narrow
from kindstore.llm.flow import route, water_fill
from kindstore.session import materialize

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 11
LEVELS = 2
# Tables with a row for each membership pattern are broadcast up to so many patterns, and shuffled beyond.
BROADCAST_PATTERNS = 100_000
# The flow runs on the driver over a row for each pattern; it holds so many.
MOST_PATTERNS = 1_000_000


def _small(df: DataFrame, patterns: int) -> DataFrame:
    return F.broadcast(df) if patterns <= BROADCAST_PATTERNS else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def membership(sources: Column) -> Column:
    """The membership pattern of an array of sources: a sorted JSON array."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))


def _code_points(name: str | None) -> tuple:
    return (name is None, [ord(c) for c in name or ""])


def plan_mix(patterns: list[tuple[str, int]], weights=WEIGHTS, repeats: int = REPEATS) -> tuple[dict, list[tuple]]:
    """Targets of the sources, and for each pattern the words that the mix takes of it.

    ``patterns``: JSON arrays of source names with the words of their documents.
    Sources come in code point order, null last, with the weights repeating.
    """
    members = [json.loads(key) for key, _ in patterns]
    names = sorted({name for group in members for name in group}, key=_code_points)
    number = {name: i for i, name in enumerate(names)}
    sizes = [0] * len(names)
    for group, (_, size) in zip(members, patterns, strict=True):
        for name in group:
            sizes[number[name]] += size
    total = sum(size for _, size in patterns)
    share = [weights[i % len(weights)] for i in range(len(names))]
    targets = water_fill(sizes, share, repeats)
    if sum(sizes) > total:  # overlapping sources: shares of what there is, not of what is counted twice
        targets = [t * total / sum(sizes) for t in targets]
    quotas = [int(t + 0.5) for t in targets]
    flows = route([size for _, size in patterns], [[number[n] for n in g] for g in members], quotas, repeats)
    taken = [(key, size, sum(flow.values())) for (key, size), flow in zip(patterns, flows, strict=True)]
    return {name: (sizes[i], targets[i]) for name, i in number.items()}, taken


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = SEED,
    levels: int = LEVELS,
    most_patterns: int = MOST_PATTERNS,
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    ``source_col`` is a source or an array of sources (a document may belong to
    several). Documents are summed by membership pattern; a minimum-cost flow
    routes each pattern's words, repeated up to ``repeats`` times at rising cost,
    to the sources' quotas (see ``flow``). The driver holds one row per pattern
    and per source, never per document; more than ``most_patterns`` patterns raise. Of a pattern, all documents are taken as
    often as the flow holds its size, and of the rest each in the order of a seeded
    hash that still fits, then the one further document nearest to what is left.
    That goes in rounds: one ends at the first document that does not fit, and the
    next goes on after it with those no larger than what is left, until none is. What
    is left falls below the size that did not fit, so there are no more rounds than
    different sizes; in the hash's random order they grow with the logarithm of the documents.
    Each stop is found digit by digit of the hash, so the last sort sees 1 / 256 ** ``levels`` of a pattern.

    Returns one row per input row: ``id_col``, ``size``, ``pattern`` (JSON array),
    ``source_size`` and ``target`` (of the first source of the pattern), ``taken``
    (a multiple of the size, at most ``repeats`` times).

    Defined cases: null text has size 0 and is never taken; a null source is a
    source of its own, last in order; an empty array belongs to no source and is
    never taken. Rows that repeat an id are taken or left together; null ids count
    as one id. Further columns are ignored; no rows give none. Reruns agree.
    """
    rows = narrow(df, _id=id_col, _text=text_col, _source=source_col)
    source = F.col("_source")
    if rows.schema["_source"].dataType.typeName() != "array":
        source = F.array(source)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
    rows = rows.select("_id", membership(source).alias("_pattern"), word_count(F.col("_text")).alias("_size"), order.alias("_order"))
    rows = materialize(rows, "mix-sizes")
    sums = rows.groupBy("_pattern").agg(F.sum("_size").alias("n")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns: give documents fewer, larger sources")
    sums = [(r["_pattern"], r["n"]) for r in sums]
    sources, taken = plan_mix(sorted(sums), weights, repeats)
    spark = df.sparkSession
    rests = {key: words % size for key, size, words in taken if size and words % size}
    held = _small(spark.createDataFrame([(key,) for key in rests], "_pattern string"), len(taken))
    # Rows that repeat an id are one unit of the order.
    units = rows.where("_size > 0").join(held, "_pattern").groupBy("_pattern", "_order")
    units = materialize(units.agg(F.sum("_size").alias("_size"), F.count("*").alias("_n")), "mix-units")
    stops, gaps = _fill_up(units, rests, levels)
    table = []
    for key, size, words in taken:
        names = sorted(json.loads(key), key=_code_points)
        whole, target = sources[names[0]] if names else (0, 0.0)
        table.append((key, whole, target, words // size if size else 0, stops.get(key, []), gaps.get(key, 0)))
    schema = (
        "_pattern string, _source_size bigint, _target double, _times bigint,"
        " _stops array<struct<order: string, most: bigint>>, _gap bigint"
    )
    plan = _small(spark.createDataFrame(table, schema), len(table))
    # What a later round may take gets smaller, so a unit that an earlier one left out stays out.
    inside = F.exists("_stops", lambda s: (F.col("_order") <= s["order"]) & (F.col("_unit") <= s["most"]))
    off = F.abs(F.col("_unit") - F.col("_gap"))
    fits = units.withColumnRenamed("_size", "_unit").join(plan, "_pattern").where(~inside & (off < F.col("_gap")))
    fill = fits.groupBy("_pattern").agg(F.min(F.struct(off.alias("off"), "_order")).alias("_fill"))
    repeated = units.where("_n > 1").select("_pattern", "_order", F.col("_size").alias("_whole"))
    cut = rows.join(plan, "_pattern").join(repeated, ["_pattern", "_order"], "left")
    cut = cut.withColumn("_unit", F.coalesce("_whole", "_size")).withColumn("_inside", inside & (F.col("_size") > 0))
    cut = cut.join(_small(fill, len(table)), "_pattern", "left")
    filling = F.coalesce((F.col("_order") == F.col("_fill._order")) & (F.col("_size") > 0) & ~F.col("_inside"), F.lit(False))
    return cut.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_pattern").alias("pattern"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * (F.col("_times") + (F.col("_inside") | filling).cast("bigint"))).alias("taken"),
    )


def _fill_up(units: DataFrame, rests: dict[str, int], levels: int) -> tuple[dict, dict]:
    """Where each round stops in each pattern, with the largest size it may take, and the words left at the end."""
    spark = units.sparkSession
    stops, gaps = {key: [] for key in rests}, dict(rests)
    most, open_, first = dict.fromkeys(rests, (1 << 63) - 1), set(rests), True
    while open_:
        if not first:
            state = [(key, stops[key][-1][0], most[key]) for key in open_]
            state = _small(spark.createDataFrame(state, "_pattern string, _after string, _most bigint"), len(state))
            units = units.join(state, "_pattern").where((F.col("_order") > F.col("_after")) & (F.col("_size") <= F.col("_most")))
            units = materialize(units.select("_pattern", "_order", "_size"), "mix-units")
        sums = {r["_pattern"]: r["n"] for r in units.groupBy("_pattern").agg(F.sum("_size").alias("n")).collect()}
        open_ &= sums.keys()
        crossing = {key: gaps[key] for key in open_ if sums[key] > gaps[key]}
        for key in open_ - crossing.keys():  # all that is left fits; no digit comes after g
            stops[key].append(("g", most[key]))
            gaps[key] -= sums[key]
        for r in _cuts(units, crossing, levels).collect() if crossing else ():
            stops[r["_pattern"]].append((r["_stop"], most[r["_pattern"]]))
            gaps[r["_pattern"]] = most[r["_pattern"]] = r["_gap"]
        open_ = {key for key in crossing if gaps[key]}
        first = False
    return stops, gaps


def _cuts(units: DataFrame, rests: dict[str, int], levels: int) -> DataFrame:
    """For each pattern, the last unit in hash order that still fits, and the words left after it.

    ``_pattern``, ``_stop`` and ``_gap``. Without a unit that fits, the stop is the
    digits of the hash before the first.
    """
    spark = units.sparkSession
    state = spark.createDataFrame([(key, "", left) for key, left in rests.items()], "_pattern string, _prefix string, _left bigint")
    rows = units.select("_pattern", "_order", "_size")
    for level in range(1, levels + 1):
        digits = F.substring("_order", 1, 2 * level)
        inside = rows.join(_small(state, len(rests)), "_pattern").where(F.col("_order").startswith(F.col("_prefix")))
        sums = inside.groupBy("_pattern", "_left", digits.alias("_digits")).agg(F.sum("_size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_pattern").orderBy("_digits"))
        crossing = sums.withColumn("_upto", upto).where("_upto > _left").groupBy("_pattern")
        state = crossing.agg(F.min(F.struct("_digits", (F.col("_left") - F.col("_upto") + F.col("_sum")).alias("left"))).alias("_s"))
        state = state.select("_pattern", F.col("_s._digits").alias("_prefix"), F.col("_s.left").alias("_left"))
        state = materialize(state, "mix-cut")
    last = rows.join(_small(state, len(rests)), "_pattern").where(F.col("_order").startswith(F.col("_prefix")))
    upto = F.sum("_size").over(Window.partitionBy("_pattern").orderBy("_order"))
    fitting = last.withColumn("_upto", upto).where("_upto <= _left").groupBy("_pattern")
    fitting = fitting.agg(F.max(F.struct("_order", "_upto")).alias("_last"))
    return state.join(_small(fitting, len(rests)), "_pattern", "left").select(
        "_pattern",
        F.coalesce("_last._order", "_prefix").alias("_stop"),
        (F.col("_left") - F.coalesce(F.col("_last._upto"), F.lit(0))).alias("_gap"),
    )
