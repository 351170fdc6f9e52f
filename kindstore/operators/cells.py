"""Searches over keys by cell: exact by bounds on the cells, or by compressed residuals with exact distances at the end.

Tables: keys by cell ``store, entry_id, key, token, cell`` (``vectors.ivf_assign``),
centroids ``cell, centroid``, radii ``store, cell, radius, n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindstore.operators.kernel import TopK, matrix
from kindstore.operators.vectors import (
    Amount,
    _best,
    _by_blocks,
    _centroid_rows,
    _codebook_array,
    _reach,
    probe_cells,
    recompute_dists,
)
from kindstore.session import materialize

# Distances of a chunk of queries to all cells held at a time.
CHUNK_NUMBERS = 1 << 22
FIRST_PROBES = 8
GROWTH = 4
# What rounding may take off a squared distance computed by a matrix product, as a share of the squared lengths.
ROUNDING = 1e-12


def _own_centroids(cells: np.ndarray, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The centroid of each row's cell; ``known`` rises."""
    return rows[np.searchsorted(known, cells)]


def cell_radii(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """``store, cell, radius, n``: the largest distance of a key of a cell to its centre, and the cell's keys."""
    shared = _centroid_rows(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.asarray(batch.column("cell"))
            gaps = matrix(batch.column("key")) - _own_centroids(cells, known, rows)
            far = pa.array(np.sqrt((gaps * gaps).sum(1)))
            table = pa.table([batch.column("store"), batch.column("cell"), far], names=["store", "cell", "far"])
            found = table.group_by(["store", "cell"]).aggregate([("far", "max"), ("far", "count")])
            yield from found.select(["store", "cell", "far_max", "far_count"]).rename_columns(["store", "cell", "radius", "n"]).to_batches()

    partial = assigned.select("store", "cell", "key").mapInArrow(run, "store string, cell int, radius double, n bigint")
    return partial.groupBy("store", "cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))


def _radius_rows(radii: DataFrame, known: np.ndarray) -> dict[str, np.ndarray]:
    """For each store the radius of each cell, -infinity for a cell without keys of it."""
    table = radii.groupBy("store", "cell").agg(F.max("radius").alias("radius")).toArrow()  # a row a store and cell
    out: dict[str, np.ndarray] = {}
    places = np.searchsorted(known, np.asarray(table.column("cell")))
    for store, place, radius in zip(table.column("store").to_pylist(), places, table.column("radius").to_pylist(), strict=True):
        out.setdefault(store, np.full(len(known), -np.inf))[place] = radius
    return out


def _bounded_probes(queries: DataFrame, shared, low: int, high: int) -> DataFrame:
    """Cells number ``low`` to ``high`` - 1 of each query that may hold a neighbour within its limits.

    A key lies no nearer to a query than the query to the cell's centre, less the cell's
    radius. Cells are ordered by the smallest such bound over the stores, which does not change from
    round to round, so each cell has its turn in exactly one round.
    """
    schema = queries.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, radii = shared.value
        lengths = np.einsum("ij,ij->i", rows, rows)
        step = max(1, CHUNK_NUMBERS // len(known))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                points = matrix(part.column("embedding"))
                limits = [dict(row) if row else {} for row in part.column("limits").to_pylist()]
                own = np.einsum("ij,ij->i", points, points)[:, None] + lengths[None]
                gaps = np.sqrt(np.maximum(own - 2 * points @ rows.T - ROUNDING * (own + 1), 0))
                least, wanted = np.full(gaps.shape, np.inf), np.zeros(gaps.shape, bool)
                for store, radius in radii.items():
                    bound = np.maximum(gaps - radius * (1 + ROUNDING), 0) ** 2
                    limit = np.array([row.get(store, np.inf) for row in limits]) * (1 + ROUNDING)
                    wanted |= np.isfinite(bound) & (bound <= limit[:, None])
                    np.minimum(least, bound, out=least)
                turn = np.argsort(least, axis=1, kind="stable")[:, low:high]
                row, place = np.nonzero(np.take_along_axis(wanted, turn, 1))
                yield part.take(pa.array(row)).append_column("cell", pa.array(known[turn[row, place]], pa.int32()))

    return queries.mapInArrow(run, schema)


def ivf_search_bounded(
    queries: DataFrame, keys: DataFrame, centroids: DataFrame, radii: DataFrame, k: Amount = 1024, first: int = FIRST_PROBES, growth: int = GROWTH
) -> DataFrame:
    """The exact k nearest keys by cells, reading only cells that can hold one.

    Cells are probed in the order of the least distance that a key in them can have, in
    rounds of ``first``, then up to ``growth`` times as many cells a query. After each round a query knows its k-th
    distance, and a cell is left out if its bound is beyond it in every store. So the
    result equals ``vectors.knn_exact``, and well separated cells need few probes. A round is a
    job; there are about log(cells / first) / log(growth) of them. ``radii``: ``cell_radii``
    of all keys.
    """
    known, rows = _centroid_rows(centroids).value
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((known, rows, _radius_rows(radii, known)))
    plain = queries.select("query_id", "embedding")
    asked = plain.withColumn("limits", F.lit(None).cast("map<string,double>"))
    best, low, high = None, 0, min(first, len(known))
    while low < len(known):
        probes = materialize(_bounded_probes(asked, shared, low, high), "probes")
        low, high = high, min(len(known), high * growth)
        if probes.isEmpty():
            continue
        found = _by_blocks(probes, keys, k, "l2").drop("rank")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(_best(found, k, "l2"), "nearest")
        asked = plain.join(_reach(best, k, "l2"), "query_id", "left")
    if best is None:  # no queries, no cells or no keys
        schema = "query_id bigint, store string, rank int, entry_id bigint, dist double, token int"
        return spark.createDataFrame([], schema)
    return best


def probes_for_recall(
    queries: DataFrame, keys: DataFrame, centroids: DataFrame, exact: DataFrame, target: float = 0.9
) -> DataFrame:
    """``store, nprobe, recall``: the fewest nearest cells in which the target share of the exact neighbours lies.

    ``exact`` are exact neighbours of ``queries``, a sample of those to come (from
    ``ivf_search_bounded``, say). What a search of so many cells finds of them is known
    without running it: a neighbour is found if and only if its cell is probed.
    """
    shared = _centroid_rows(centroids)
    cells = exact.select("query_id", "store", "entry_id").join(keys.select("store", "entry_id", "cell"), ["store", "entry_id"])
    # At most k entries a store and query.
    lists = cells.groupBy("query_id").agg(F.collect_list(F.struct("store", "cell")).alias("found"))
    rows = lists.join(queries.select("query_id", "embedding"), "query_id").select("embedding", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            top = TopK(matrix(batch.column("embedding")), len(known))
            top.add(centres, known, known)
            turn = np.empty((batch.num_rows, len(known)), np.int64)
            turn[top.qi, np.searchsorted(known, top.ids)] = np.arange(len(top.qi)) % len(known)
            lists = batch.column("found")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            fields = lists.flatten()
            place = turn[owner, np.searchsorted(known, np.asarray(fields.field("cell")))]
            table = pa.table([fields.field("store"), pa.array(place)], names=["store", "place"])
            counted = table.group_by(["store", "place"]).aggregate([("place", "count")])
            yield from counted.select(["store", "place", "place_count"]).rename_columns(["store", "place", "n"]).to_batches()

    counts = rows.mapInArrow(run, "store string, place bigint, n bigint").groupBy("store", "place").agg(F.sum("n").alias("n"))
    # A row for each place among the cells, so at most MAX_CENTROIDS a store.
    upto = F.sum("n").over(Window.partitionBy("store").orderBy("place"))
    share = (upto / F.sum("n").over(Window.partitionBy("store"))).alias("recall")
    reached = counts.select("store", (F.col("place") + 1).cast("int").alias("nprobe"), share).where(F.col("recall") >= target)
    return reached.groupBy("store").agg(F.min("nprobe").alias("nprobe"), F.min("recall").alias("recall"))


# --- compressed residuals ------------------------------------------------------


def _less_centroids(df: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """``vector`` less the centroid of the row's cell, in double precision."""
    shared = _centroid_rows(centroids)
    wide = df.withColumn(vector, F.col(vector).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            left = matrix(batch.column(vector)) - _own_centroids(np.asarray(batch.column("cell")), known, rows)
            offsets = pa.array(np.arange(0, left.size + 1, left.shape[1]), pa.int32())
            place = batch.schema.get_field_index(vector)
            yield batch.set_column(place, vector, pa.ListArray.from_arrays(offsets, pa.array(left.ravel())))

    return wide.mapInArrow(run, wide.schema)


def residuals(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Keys less the centroid of their cell, to train codebooks on (``vectors.pq_train``)."""
    return _less_centroids(assigned, "key", centroids)


def residual_codes(assigned: DataFrame, centroids: DataFrame, codebooks: DataFrame) -> DataFrame:
    """``store, entry_id, token, cell, code``: a byte for each part of a key's residual, the number of its codeword."""
    books = _codebook_array(codebooks)
    if books.value.shape[1] > 256:
        raise ValueError("a code is one byte: at most 256 codewords")
    rows = residuals(assigned.select("store", "entry_id", "token", "cell", "key"), centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = matrix(batch.column("key")).reshape(batch.num_rows, len(books.value), -1)
            codes = np.empty(parts.shape[:2], np.uint8)
            numbers = np.arange(books.value.shape[1])
            for s, book in enumerate(books.value):
                top = TopK(parts[:, s], 1)
                top.add(book, numbers, numbers)
                codes[:, s] = top.ids
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed], ["store", "entry_id", "token", "cell", "code"])

    return rows.mapInArrow(run, "store string, entry_id bigint, token int, cell int, code binary")


def code_search(
    queries: DataFrame,
    coded: DataFrame,
    centroids: DataFrame,
    codebooks: DataFrame,
    k: Amount = 1024,
    nprobe: int = 32,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Approximate distances from codes of residuals, within the probed cells.

    In each cell that it probes, a query's own residual is measured to the codewords
    that stand for the keys. ``coded``: ``residual_codes``; no key is read.
    """
    probes = probe_cells(queries, centroids, nprobe) if probes is None else probes
    near = _less_centroids(probes, "embedding", centroids)
    keys = coded.select("cell", "store", "entry_id", F.col("code").alias("key"), "token")
    return _by_blocks(near, keys, k, "pq", _codebook_array(codebooks))


def rerank(neighbours: DataFrame, queries: DataFrame, keys: DataFrame, k: Amount) -> DataFrame:
    """The ``k`` best of a longer list of approximate neighbours by their exact distances."""
    return _best(recompute_dists(neighbours, queries, keys).drop("rank"), k, "l2")
