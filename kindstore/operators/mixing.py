"""Next-token distributions: filters, normalisation and ensembles in log space.

All tables are sparse, ``query_id, token, logp``; a token that is absent has
probability zero. ``batch_id`` is optional; without it all queries are one batch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindstore.functions.scalars import log_add_exp

FLOOR = -50.0  # Fixed value: log-probabilities at or below it are patched.
METHOD_ORDERS = (("subtract", "add"), ("add", "subtract"))


def log_softmax(df: DataFrame, by: str = "query_id", column: str = "logp") -> DataFrame:
    group = Window.partitionBy(by)
    shifted = df.withColumn("_x", F.col(column) - F.max(column).over(group))
    return shifted.withColumn(column, F.col("_x") - F.ln(F.sum(F.exp("_x")).over(group))).drop("_x")


def nucleus_filter(df: DataFrame, p: float = 0.9, mark: bool = False) -> DataFrame:
    """Keep a token while the probability mass before it is at most ``p``.

    The token that crosses ``p`` stays, and so does the first one. ``p = 0``
    switches the filter off. With ``mark`` cut tokens stay with a NULL ``logp``.
    """
    if not p:
        return df
    before = (
        Window.partitionBy("query_id")
        .orderBy(F.desc("logp"), "token")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = df.withColumn("_before", F.coalesce(F.sum(F.exp("logp")).over(before), F.lit(0.0)))
    kept = F.col("_before") <= p
    if mark:
        return ranked.withColumn("logp", F.when(kept, F.col("logp"))).drop("_before")
    return ranked.where(kept).drop("_before")


def knn_distribution(neighbours: DataFrame, temperature: float | Column = 100.0, by: tuple[str, ...] = ("query_id", "store")) -> DataFrame:
    """softmax(-dist / T) over a query's neighbours, summed by token; T may be a column.

    ``by`` may name further columns that part a query's lists, such as a setting.
    """
    group = Window.partitionBy(*by)
    nearest = F.min("dist").over(group)
    weight = neighbours.withColumn("_w", F.exp((nearest - F.col("dist")) / temperature))
    share = weight.withColumn("_p", F.col("_w") / F.sum("_w").over(group))
    return (
        share.groupBy(*by, "token")
        .agg(F.sum("_p").alias("_p"))
        .where("_p > 0")
        .select(*by, "token", F.ln("_p").alias("logp"))
    )


def _with_batch(df: DataFrame) -> DataFrame:
    return df if "batch_id" in df.columns else df.withColumn("batch_id", F.lit(0).cast("bigint"))


def _floors(df: DataFrame, by: list[str], floor: float, name: str) -> DataFrame:
    """Smallest log-probability above the floor, one row per batch (or query)."""
    return df.where(F.col("logp") > floor).groupBy(*by).agg(F.min("logp").alias(name))


def patch_floor(df: DataFrame, floor: float = FLOOR, scope: str = "batch") -> DataFrame:
    """Replace values at or below the floor by the smallest one above it.

    The minimum spans the whole batch of a store, as an aggregate that is
    joined back, so a large batch is not gathered in one task.
    """
    df = _with_batch(df)
    by = [c for c in ("batch_id", "store") if c in df.columns] + (["query_id"] if scope == "query" else [])
    lows = _floors(df, by, floor, "_low")
    patched = F.when(F.col("logp") <= floor, F.col("_low")).otherwise(F.col("logp"))
    return df.join(lows, by, "left").withColumn("logp", patched).drop("_low")


def interpolate(lm: DataFrame, knn: DataFrame, lmbda: float = 0.25) -> DataFrame:
    """ln((1 - l) p_lm + l p_knn); with l = 0 or 1 one side alone."""
    if lmbda in (0, 1):
        return (knn if lmbda else lm).select("query_id", "token", "logp")
    a = lm.select("query_id", "token", (F.col("logp") + math.log(1 - lmbda)).alias("_a"))
    b = knn.select("query_id", "token", (F.col("logp") + math.log(lmbda)).alias("_b"))
    return a.join(b, ["query_id", "token"], "full").select(
        "query_id", "token", log_add_exp(F.col("_a"), F.col("_b")).alias("logp")
    )


def interpolate_discourage(lm: DataFrame, knn: DataFrame, lmbda: float = 0.25) -> DataFrame:
    """ln(max((1 + l) p_lm - l p_knn, 0)), not renormalised; zero means absent."""
    other = knn.select("query_id", "token", F.exp("logp").alias("_p_knn"))
    p = (1 + lmbda) * F.exp("logp") - lmbda * F.coalesce("_p_knn", F.lit(0.0))
    return (
        lm.join(other, ["query_id", "token"], "left")
        .withColumn("_p", p)
        .where("_p > 0")
        .select("query_id", "token", F.ln("_p").alias("logp"))
    )


def _store_side(lm: DataFrame, store: DataFrame, name: str, floor: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """A store's usable log-probabilities and its floor per batch."""
    batches = lm.groupBy("query_id").agg(F.first("batch_id").alias("batch_id"))
    present = store.where(F.col("logp") > floor).select("query_id", "token", "logp")
    lows = _floors(present.join(batches, "query_id"), by, floor, f"_{name}_low")
    return present.withColumnRenamed("logp", f"_{name}"), lows


def _patched(lm: DataFrame, store: DataFrame, name: str, floor: float, by: list[str]) -> DataFrame:
    present, lows = _store_side(lm, store, name, floor, by)
    return (
        lm.join(present, ["query_id", "token"], "left")
        .join(lows, by, "left")
        .withColumn(f"_{name}", F.coalesce(f"_{name}", f"_{name}_low", "logp"))
        .drop(f"_{name}_low")
    )


def _scope(scope: str) -> list[str]:
    return ["batch_id"] if scope == "batch" else ["batch_id", "query_id"]


def _finish(df: DataFrame, score: Column) -> DataFrame:
    return log_softmax(df.select("query_id", "token", score.alias("logp")))


def _weight(alpha: float | Column) -> Column:
    return alpha if isinstance(alpha, Column) else F.lit(float(alpha))


def ensemble(
    lm: DataFrame,
    sub: DataFrame,
    add: DataFrame,
    alpha: float | Column = 2.0,
    floor: float = FLOOR,
    scope: str = "batch",
) -> DataFrame:
    """log_softmax(lm + alpha (added' - subtracted')) for two stores.

    A token missing from a store is far below the floor, so it takes the
    store's smallest value above the floor within the batch. Tokens that the
    language model cut stay cut, hence only its own rows are needed. For a store
    without a usable token in the batch the language model stands in, as in
    ``ensemble_single``. ``alpha`` may be a column of ``lm``.
    """
    both = both_sides(lm, sub, add, floor, scope)
    return _finish(both, F.col("logp") + _weight(alpha) * (F.col("_add") - F.col("_sub")))


def both_sides(lm: DataFrame, sub: DataFrame, add: DataFrame, floor: float = FLOOR, scope: str = "batch") -> DataFrame:
    """The model's rows with what each store says of them, patched: columns ``_sub`` and ``_add``."""
    lm = _with_batch(lm)
    return _patched(_patched(lm, sub, "sub", floor, _scope(scope)), add, "add", floor, _scope(scope))


def ensemble_single(
    lm: DataFrame,
    knn: DataFrame,
    alpha: float = 2.0,
    order: tuple[str, str] = ("subtract", "add"),
    floor: float = FLOOR,
    scope: str = "batch",
) -> DataFrame:
    """The ensemble with one store, the language model standing in for the other.

    ``lm`` has a row for every vocabulary token, NULL where it was cut
    (``nucleus_filter(mark=True)``). It is patched as well and the patched
    values are the base term, so cut tokens come back at the floor.
    """
    if tuple(order) not in METHOD_ORDERS:
        raise ValueError(f"order must be one of {METHOD_ORDERS}")
    lm, by = _with_batch(lm), _scope(scope)
    lows = _floors(lm, by, floor, "_lm_low")
    usable = F.when(F.col("logp") > floor, F.col("logp"))
    full = lm.join(lows, by, "left").withColumn("logp", F.coalesce(usable, "_lm_low")).drop("_lm_low")
    both = _patched(full, knn, "knn", floor, by)
    gap = F.col("logp") - F.col("_knn") if tuple(order) == METHOD_ORDERS[0] else F.col("_knn") - F.col("logp")
    return _finish(both, F.col("logp") + float(alpha) * gap)


def ensemble_experts(
    lm: DataFrame, expert: DataFrame | None = None, anti: DataFrame | None = None, alpha: float = 2.0
) -> DataFrame:
    """log_softmax(lm + alpha (expert - anti)), unpatched; a missing model is lm."""
    joined, sides = lm, {}
    for name, model in (("_expert", expert), ("_anti", anti)):
        if model is None:
            sides[name] = F.col("logp")
        else:
            other = model.select("query_id", "token", F.col("logp").alias(name))
            joined, sides[name] = joined.join(other, ["query_id", "token"]), F.col(name)
    return _finish(joined, F.col("logp") + float(alpha) * (sides["_expert"] - sides["_anti"]))


def sample_tokens(dist: DataFrame, n: int, p: float = 0.9, seed: int = 42) -> DataFrame:
    """``n`` reproducible draws per query from the nucleus of the distribution.

    Every token owns an interval of [0, 1) and keeps the draws that fall in it. A
    query's draws are made once, put among the ends of the intervals in order, and each takes the last
    token that begins before it: one hash a draw, and one pass over the tokens.
    """
    whole = Window.partitionBy("query_id")
    # The order of the nucleus serves the intervals too, so tokens are sorted once.
    order = whole.orderBy(F.desc("logp"), "token")
    weight = F.exp(F.col("logp") - F.max("logp").over(whole))
    kept = nucleus_filter(dist, p).withColumn("_w", weight)
    kept = kept.withColumn("_p", F.col("_w") / F.sum("_w").over(whole))
    placed = kept.select(
        "query_id",
        "token",
        F.coalesce(F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_low"),
        F.row_number().over(order).alias("_place"),
    )

    def position(draw: Column) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string"), F.lit(":"), draw.cast("string")))
        return F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / F.lit(16777216.0)

    def event(at: Column, place: Column, token: Column, draw: Column) -> Column:
        return F.struct(at.alias("at"), place.alias("place"), token.alias("token"), draw.alias("draw"))

    nothing, behind = F.lit(None).cast("int"), F.lit((1 << 31) - 1)
    begin = F.array(event(F.col("_low"), F.col("_place"), F.col("token"), nothing))
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda d: event(position(d), behind, nothing.cast(kept.schema["token"].dataType), d))
    events = placed.select("query_id", F.explode(F.when(F.col("_place") == 1, F.concat(begin, draws)).otherwise(begin)).alias("_e"))
    # A draw stands behind all tokens that begin where it falls.
    upto = Window.partitionBy("query_id").orderBy("_e.at", "_e.place").rowsBetween(Window.unboundedPreceding, 0)
    taken = events.select("query_id", F.col("_e.draw").alias("draw"), F.last("_e.token", ignorenulls=True).over(upto).alias("token"))
    return taken.where("draw IS NOT NULL").select("query_id", "draw", "token")
