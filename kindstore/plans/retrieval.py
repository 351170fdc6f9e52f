"""Retrieval and ensembling end to end, one plan per step of generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindstore.operators import mixing
from kindstore.operators.mixing import ensemble, knn_distribution, log_softmax, nucleus_filter
from kindstore.operators.vectors import knn_exact, recompute_dists, two_store_retrieve
from kindstore.session import materialize

METHODS = ("ensemble", "interpolate", "interpolate_discourage")


def retrieve(
    queries: DataFrame,
    keys: DataFrame,
    k: int = 1024,
    other_k: int | None = None,
    stores: Sequence[str] = ("toxic", "nontoxic"),
) -> DataFrame:
    """Neighbours of one or two stores, searched once and written.

    What follows reads them several times (distributions, floors, sweeps); from
    files that costs no second search.
    """
    if len(stores) == 1:
        near = knn_exact(queries, keys.where(F.col("store") == stores[0]), k)
    else:
        near = two_store_retrieve(queries, keys.where(F.col("store").isin(*stores)), k, other_k, tuple(stores))
    return materialize(near, "neighbours")


def retrieve_and_mix(
    queries: DataFrame,
    lm: DataFrame,
    keys: DataFrame,
    method: str = "ensemble",
    k: int = 1024,
    other_k: int | None = None,
    temperature: float = 100.0,
    alpha: float = 2.0,
    lmbda: float = 0.25,
    p: float = 0.9,
    stores: Sequence[str] = ("toxic", "nontoxic"),
    order: tuple[str, str] = ("subtract", "add"),
    recompute: bool = False,
) -> DataFrame:
    """Any mixing method, end to end, with one or two stores.

    Two stores are for the ensemble only. ``order`` says what the first store does:
    with ("subtract", "add") its tokens become rarer and the second store's (or the
    model's own, if there is one store) more frequent. ``recompute`` takes exact
    distances of the neighbours before they are weighted, for approximate ones. The neighbours
    are written once, so this runs a job.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if tuple(order) not in mixing.METHOD_ORDERS:
        raise ValueError(f"order must be one of {mixing.METHOD_ORDERS}")
    if len(stores) not in (1, 2) or (len(stores) == 2 and method != "ensemble"):
        raise ValueError("one store, or two for the ensemble")
    near = retrieve(queries, keys, k, other_k, stores)
    if recompute:
        near = recompute_dists(near, queries, keys)
    dist = knn_distribution(near, temperature)
    full = log_softmax(lm)
    if len(stores) == 2:
        named = dict(zip(order, stores, strict=True))
        sides = (dist.where(F.col("store") == named[side]) for side in ("subtract", "add"))
        return ensemble(nucleus_filter(full, p), *sides, alpha)
    if method == "ensemble":
        return mixing.ensemble_single(nucleus_filter(full, p, mark=True), dist, alpha, order)
    return getattr(mixing, method)(nucleus_filter(full, p), dist, lmbda)


def retrieve_and_ensemble(
    queries: DataFrame,
    lm: DataFrame,
    keys: DataFrame,
    k: int = 1024,
    other_k: int | None = None,
    temperature: float = 100.0,
    alpha: float = 2.0,
    p: float = 0.9,
    stores: tuple[str, str] = ("toxic", "nontoxic"),
) -> DataFrame:
    """Neighbours of both stores -> distributions -> mixed with the model's own.

    ``lm`` holds logits or log-probabilities over the vocabulary per query.
    """
    return retrieve_and_mix(queries, lm, keys, "ensemble", k, other_k, temperature, alpha, p=p, stores=stores)


def continual_mixtures(
    queries: DataFrame,
    lm: DataFrame,
    keys: DataFrame,
    stages: Sequence[int],
    k: int = 1024,
    other_k: int | None = None,
    temperature: float = 100.0,
    alpha: float = 2.0,
    p: float = 0.9,
    stores: tuple[str, str] = ("toxic", "nontoxic"),
) -> DataFrame:
    """The mixture after every stage, over the entries of that stage and before."""
    staged = keys.where(F.col("stage") <= max(stages)).withColumn("part", F.col("stage"))
    limits = dict(zip(stores, (k, k if other_k is None else other_k), strict=True))
    reach = {store: list(stages) for store in stores}
    mixed = _mixtures_of_parts(queries, lm, staged, limits, reach, temperature, alpha, p)
    stage = F.get(F.array(*[F.lit(s) for s in stages]), F.col("setting"))
    return mixed.select(stage.alias("stage"), "query_id", "token", "logp")


def sweep_sizes(
    queries: DataFrame,
    lm: DataFrame,
    keys: DataFrame,
    sizes: Sequence[tuple[int | None, int | None]],
    k: int = 1024,
    other_k: int | None = None,
    temperature: float = 100.0,
    alpha: float = 2.0,
    p: float = 0.9,
    stores: tuple[str, str] = ("toxic", "nontoxic"),
) -> DataFrame:
    """The mixture for every pair of store sizes: entries with an id below the size, None for all.

    Sizes cut each store into parts, and each part is searched once however many
    pairs include it. Returns ``size``, ``other_size``, ``query_id, token, logp``.
    """
    limits = dict(zip(stores, (k, k if other_k is None else other_k), strict=True))
    part, reach = F.lit(None).cast("int"), {}
    for store, wanted in zip(stores, zip(*sizes, strict=True), strict=True):
        cuts = sorted({n for n in wanted if n is not None})
        place = F.lit(None).cast("int") if None not in wanted else F.lit(len(cuts))
        for i in reversed(range(len(cuts))):
            place = F.when(F.col("entry_id") < cuts[i], i).otherwise(place)
        part = F.when(F.col("store") == store, place).otherwise(part)
        reach[store] = [len(cuts) if n is None else cuts.index(n) for n in wanted]
    parted = keys.withColumn("part", part).where(F.col("part").isNotNull())
    mixed = _mixtures_of_parts(queries, lm, parted, limits, reach, temperature, alpha, p)
    named = [
        F.get(F.array(*[F.lit(pair[i]).cast("bigint") for pair in sizes]), F.col("setting")).alias(name)
        for i, name in enumerate(("size", "other_size"))
    ]
    return mixed.select(*named, "query_id", "token", "logp")


def _mixtures_of_parts(
    queries: DataFrame,
    lm: DataFrame,
    keys: DataFrame,
    limits: dict[str, int],
    reach: dict[str, list[int]],
    temperature: float,
    alpha: float,
    p: float,
) -> DataFrame:
    """Mixtures of several settings, each over the keys whose ``part`` is at most the setting's ``reach``.

    Each part is searched once. The k best of parts 0..n are among the k best of
    each of them, so only neighbours are repeated for later settings, never keys.
    ``limits`` holds the k of the two stores. Returns ``setting`` (the place in
    ``reach``), ``query_id, token, logp``.
    """
    first, second = limits
    label = F.concat_ws("@", "store", F.col("part").cast("string"))
    parted = keys.where(F.col("store").isin(*limits)).withColumn("store", label)
    wanted = {f"{store}@{i}": n for store, n in limits.items() for i in range(max(reach[store]) + 1)}
    part = F.split_part("store", F.lit("@"), F.lit(2)).cast("int")
    kind = F.split_part("store", F.lit("@"), F.lit(1))
    near = knn_exact(queries, parted, wanted).select("query_id", kind.alias("store"), part.alias("part"), "entry_id", "dist", "token")
    # A query's neighbours are put in order once: among them, a row's rank in a setting is the rows so far that the setting reaches.
    upto = Window.partitionBy("query_id", "store").orderBy("dist", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    limit = F.when(F.col("store") == first, limits[first]).otherwise(limits[second])
    settings = range(len(reach[first]))
    within = [F.col("part") <= F.when(F.col("store") == first, reach[first][i]).otherwise(reach[second][i]) for i in settings]
    ranks = {f"_rank{i}": F.sum(within[i].cast("int")).over(upto) for i in settings}
    held = F.array(*[F.when(within[i] & (F.col(f"_rank{i}") <= limit), i) for i in settings])
    best = near.select("*", *[rank.alias(name) for name, rank in ranks.items()]).select(
        "query_id", "store", "dist", "token", F.explode(F.array_compact(held)).alias("setting")
    )

    key = F.struct("setting", F.col("query_id").alias("q")).alias("query_id")
    # Both are read several times by the ensemble.
    dist = materialize(knn_distribution(best, temperature, ("query_id", "store", "setting")), "distributions")
    dist = dist.select(key, "store", "token", "logp")
    base = materialize(nucleus_filter(log_softmax(lm), p), "kept-tokens")
    if "batch_id" not in base.columns:
        base = base.withColumn("batch_id", F.lit(0).cast("bigint"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))).alias("setting")
    base = base.select("*", every).select(key, F.struct("setting", "batch_id").alias("batch_id"), "token", "logp")
    mixed = ensemble(base, dist.where(F.col("store") == first), dist.where(F.col("store") == second), alpha)
    return mixed.select("query_id.setting", F.col("query_id.q").alias("query_id"), "token", "logp")
