"""Experiment sweeps and analysis of result tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindstore.functions.scalars import ratio
from kindstore.operators.mixing import both_sides, knn_distribution, log_softmax
from kindstore.operators.texts import remap_values
from kindstore.session import materialize

# Readable names of the toxicity metrics.
METRIC_NAMES = {"avg_max": "Expected Maximum Toxicity", "toxicity_probability": "Toxicity Probability"}


def relative_to_base(df: DataFrame, metrics: Sequence[str], model: str = "model", key: str = "base") -> DataFrame:
    """(value - base) / base per metric, against the row whose model is the base."""
    base = df.where(F.col(model) == F.col(key)).select(key, *[F.col(m).alias(f"_base_{m}") for m in metrics])
    joined = df.join(base, key, "left")
    changes = {m: ratio(F.col(m) - F.col(f"_base_{m}"), F.col(f"_base_{m}")) for m in metrics}
    kind = F.when(F.col(model) == F.col(key), "base").otherwise("mitigated")
    return joined.withColumns(changes).withColumn("kind", kind).drop(*[f"_base_{m}" for m in metrics])


def group_counts(df: DataFrame, by: str | Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    extra = [F.count_distinct(c).alias(f"n_distinct_{c}") for c in distinct]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *extra)


def flag_sums(df: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(f).cast("bigint").alias(f) for f in flags])


def exact_quantiles(
    df: DataFrame, by: str, column: str, shares: Sequence[float], bins: int = 4096, few: int = 100_000
) -> DataFrame:
    """Quantiles per group with linear interpolation: ``by, share, quantile``.

    Values are counted once and written. Each wanted rank then narrows the range
    that holds it: values are counted in ``bins`` ranges between the smallest and
    largest, and the one with the rank is cut again by its own extremes, until no
    range holds more than ``few`` distinct values. So an outlier costs one round
    more, and no task sorts a whole group. Runs jobs when called.
    """
    rows = df.where(F.col(column).isNotNull()).groupBy(by, F.col(column).cast("double").alias("_v")).agg(
        F.count("*").alias("_n")
    )
    rows = materialize(rows, "value-counts")
    extent = [F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_values")]
    about = rows.groupBy(by).agg(F.sum("_n").alias("_all"), *extent)
    exact = F.col("share") * (F.col("_all") - 1)
    ranks = (
        about.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .withColumn("_exact", exact)
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_exact"), F.ceil("_exact")))))
        .withColumn("_start", F.lit(0).cast("bigint"))
    )
    while True:
        ranks = materialize(ranks.select(by, "share", "_exact", "_rank", "_start", "_low", "_high", "_values"), "ranks")
        ranges = ranks.select(by, "_start", "_low", "_high").distinct()
        inside = rows.join(ranges, by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        if (ranks.agg(F.max("_values")).first()[0] or 0) <= few:
            break
        # Halves, as the width of a range may overflow; of an endless range only the ends are split off.
        width = F.col("_high") / 2 - F.col("_low") / 2
        place = F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / width * bins), F.lit(bins - 1))
        ends = F.when(F.col("_v") == F.col("_low"), 0).when(F.col("_v") == F.col("_high"), bins - 1).otherwise(1)
        bin_no = F.when(width < float("inf"), place).otherwise(ends)
        upto = Window.partitionBy(by, "_start").orderBy("_bin")
        sizes = (
            inside.where("_high > _low")
            .withColumn("_bin", bin_no.cast("int"))
            .groupBy(by, "_start", "_bin")
            .agg(F.sum("_n").alias("_size"), *extent)
            .withColumn("_end", F.col("_start") + F.sum("_size").over(upto))
        )
        fixed = ranks.where("_values = 1")
        sizes = sizes.withColumn("_begin", F.col("_end") - F.col("_size"))
        open_ranks = ranks.where("_values > 1").drop("_low", "_high", "_values")
        narrowed = open_ranks.join(sizes, [by, "_start"]).where("_rank >= _begin and _rank < _end")
        ranks = narrowed.withColumn("_start", F.col("_begin")).select(*fixed.columns).unionByName(fixed)
    within = Window.partitionBy(by, "_start").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.select(by, "_start", "_v", "_n", (F.col("_start") + F.sum("_n").over(within)).alias("_upto"))
    hit = ranks.join(placed, [by, "_start"]).where("_rank < _upto and _rank >= _upto - _n")
    over = F.col("_exact") - F.floor("_exact")
    weight = F.when(F.col("_rank") == F.floor("_exact"), 1 - over).otherwise(over)
    return hit.groupBy(by, "share").agg(F.sum(F.col("_v") * weight).alias("quantile"))


def describe_by_group(df: DataFrame, by: str, column: str, digits: int | None = 3) -> DataFrame:
    """count, mean, std, min, quartiles and max per group, smallest group first."""
    basic = df.groupBy(by).agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    quartiles = exact_quantiles(df, by, column, (0.25, 0.5, 0.75)).groupBy(by).pivot("share", [0.25, 0.5, 0.75])
    wide = quartiles.agg(F.first("quantile")).toDF(by, "p25", "p50", "p75")
    out = basic.join(wide, by, "left").select(by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in out.columns[2:]})
    return out.orderBy("count", by)


def pivot_mean(
    df: DataFrame, rows: Sequence[str], cols: str, value: str, values: Sequence, drop: Sequence = ()
) -> DataFrame:
    """Pivot table with a mean; ``drop`` leaves columns of the result out."""
    kept = [v for v in values if v not in set(drop)]
    return df.groupBy(*rows).pivot(cols, kept).agg(F.avg(value))


def unpivot_metrics(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    drop: Sequence[str] = ("std_max",),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Wide to long, without ``drop``, with readable metric names."""
    values = [c for c in (values or df.columns) if c not in set(ids) and c not in set(drop)]
    long = df.unpivot(list(ids), values, "metric", "value")
    return long if rename is None else remap_values(long, "metric", rename)


def sort_results(df: DataFrame, by: Sequence[str] = ("metric", "value"), digits: int = 2) -> DataFrame:
    ordered = df.orderBy(*[F.desc(c) for c in by])
    return ordered.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def vary_one_axis(df: DataFrame, x: str, y: str, fixed: Mapping[str, float]) -> DataFrame:
    """Slices of a two-parameter sweep: vary ``x``, vary ``y``, vary both together."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col(y) == fixed[y], F.lit(f"vary_{x}")),
            F.when(F.col(x) == fixed[x], F.lit(f"vary_{y}")),
            F.when(F.col(x) == F.col(y), F.lit("vary_both")),
        )
    )
    return df.withColumn("slice", F.explode(kinds)).orderBy("slice", x, y)


def concat_results(parts: Mapping[str, DataFrame], tag: str = "experiment") -> DataFrame:
    """Stack tables with a tag; columns a table lacks are NULL."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def timing_stats(df: DataFrame, by: str, column: str, order: str | None = None) -> DataFrame:
    """Mean, population deviation, total and count of durations per group.

    With ``order`` each group's first measurement (the warm-up) is left out.
    """
    if order is not None:
        first = df.groupBy(by).agg(F.min(order).alias("_first"))
        df = df.join(first, by).where(F.col(order) > F.col("_first"))
    return df.groupBy(by).agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
        F.sum(column).alias("total"),
    )


def grid(
    *,
    k: Sequence[int],
    other_k: Sequence[int] | int,
    alpha: tuple[float, float, float],
    temperature: Sequence[float] = (100.0,),
) -> list[tuple]:
    """Settings of a sweep: zipped k pairs, a single value going with every k, each with all alphas and temperatures."""
    others = [other_k] * len(k) if isinstance(other_k, int) else list(other_k)
    if len(others) != len(k):
        raise ValueError("both lists of k need the same length")
    low, high, step = alpha
    # Up to the end, and one step past it where the step does not divide the range.
    alphas = [low + i * step for i in range(math.ceil((high - low) / step - 1e-9) + 1)]
    return [(a, b, float(x), float(t)) for a, b in zip(k, others) for x in alphas for t in temperature]


def sweep_grid(
    neighbours: DataFrame,
    lm: DataFrame,
    settings: Sequence[tuple[int, int, float, float]],
    stores: tuple[str, str] = ("toxic", "nontoxic"),
) -> DataFrame:
    """The ensemble for every (k, other k, alpha, temperature), from one retrieval at the largest k.

    A store has one distribution for each of its k and temperatures, whatever else
    varies. The model's rows meet the distributions once for each (k, other k, temperature), and the
    values of alpha, which only weigh what was found, are applied at the end.
    """
    groups = sorted({(a, b, float(t)) for a, b, _, t in settings})
    alphas = [sorted({float(x) for a, b, x, t in settings if (a, b, float(t)) == group}) for group in groups]
    sides = []
    for place, store in enumerate(stores):
        wanted = sorted({(group[place], group[2]) for group in groups})
        every = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), F.lit(t).alias("t")) for i, (k, t) in enumerate(wanted)]))
        near = neighbours.where(F.col("store") == store).select("*", every.alias("_p")).where(F.col("rank") <= F.col("_p.k"))
        key = F.struct(F.col("_p.c").alias("c"), F.col("query_id").alias("q")).alias("query_id")
        dist = knn_distribution(near.select(key, "store", "dist", "token", F.col("_p.t").alias("temperature")), F.col("temperature"))
        # Usually one group for each pair and temperature: k and other k are zipped.
        users = [[g for g, group in enumerate(groups) if (group[place], group[2]) == pair] for pair in wanted]
        shared = F.array(*[F.array(*[F.lit(g) for g in own]) for own in users])
        dist = dist.select("*", F.explode(F.get(shared, F.col("query_id.c"))).alias("_g"))
        sides.append(dist.select(F.struct(F.col("_g").alias("g"), F.col("query_id.q").alias("q")).alias("query_id"), "token", "logp"))
    base = lm if "batch_id" in lm.columns else lm.withColumn("batch_id", F.lit(0).cast("bigint"))
    base = base.select("*", F.explode(F.array(*[F.lit(g) for g in range(len(groups))])).alias("g"))
    base = base.select(
        F.struct("g", F.col("query_id").alias("q")).alias("query_id"), F.struct("g", F.col("batch_id").alias("b")).alias("batch_id"), "token", "logp"
    )
    weights = F.array(*[F.array(*[F.lit(x) for x in own]) for own in alphas])
    both = both_sides(base, *sides).select("*", F.explode(F.get(weights, F.col("query_id.g"))).alias("alpha"))
    key = F.struct("query_id.g", "alpha", F.col("query_id.q").alias("q")).alias("query_id")
    mixed = log_softmax(both.select(key, "token", (F.col("logp") + F.col("alpha") * (F.col("_add") - F.col("_sub"))).alias("logp")))
    about = F.array(*[F.struct(F.lit(a).alias("k"), F.lit(b).alias("other_k"), F.lit(t).alias("temperature")) for a, b, t in groups])
    return mixed.select("*", F.get(about, F.col("query_id.g")).alias("_p")).select(
        "_p.k", "_p.other_k", "query_id.alpha", "_p.temperature", F.col("query_id.q").alias("query_id"), "token", "logp"
    )
