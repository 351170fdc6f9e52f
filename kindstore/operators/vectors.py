"""Nearest-neighbour joins between query vectors and datastore keys.

Tables: queries ``query_id, embedding``; keys ``store, entry_id, key, token``;
result ``query_id, store, rank, entry_id, dist, token``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindstore.functions.scalars import seed_order, whole_div
from kindstore.operators.kernel import TopK, code_matrix, decoded, first_of_each, matrix
from kindstore.session import materialize, work_folder

QUERY_BLOCK = 4096
# Keys that a task holds at a time.
KEY_BLOCK = 1 << 14
# Blocks of queries that are sent to the keys one after another; more queries are dealt over tasks and keys stream past them.
ROUNDS = 4
# Queries of one task, and the neighbours that it holds: all lists, and about three times those of the store that is being merged.
# Keys are shuffled once a block, so a block is as large as memory allows.
TASK_QUERIES = 1 << 16
TASK_ROWS = 10 << 20
# Keys of the first pass of an exact search, and how many times more the passes have seen after each further one.
FIRST_KEYS = 1 << 20
GROWTH = 16
# Rows of a stream of keys that are searched together.
STREAM_ROWS = 1 << 15
# Bytes of a table of vectors that is broadcast, as every worker holds it, and bytes up to which keys are shuffled to blocks instead.
SHARED_BYTES = 1 << 28
COPIED_BYTES = 1 << 26
MAX_CENTROIDS = 65536
_FOUND = "query_id bigint, store string, entry_id bigint, dist double, token int"
_RANKED = "query_id bigint, store string, rank int, entry_id bigint, dist double, token int"

Amount = int | dict[str, int]


def _per_store(k: Amount, store: str) -> int:
    return k if isinstance(k, int) else k.get(store, 0)


def _emit(query_ids, store, top: TopK) -> pa.RecordBatch:
    sign = -1.0 if top.metric == "dot" else 1.0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids[top.qi], pa.int64()),
            pa.array([store] * len(top.qi), pa.string()),
            pa.array(top.ids, pa.int64()),
            pa.array(sign * top.dist, pa.float64()),
            pa.array(top.token, pa.int32()),
        ],
        names=["query_id", "store", "entry_id", "dist", "token"],
    )


def _limits(column, store: str) -> np.ndarray | None:
    """Per query, the distance of its k-th neighbour so far in a store; infinite where there is none."""
    known = [dict(row) if row else {} for row in column.to_pylist()]
    return np.array([row.get(store, np.inf) for row in known])


def _search(tops: dict, query_rows: np.ndarray, limits, k: Amount, metric: str, batch) -> None:
    """Feed one Arrow batch of keys to the running top-k of each store."""
    column = batch.column("store")
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    names, places = column.dictionary.to_pylist(), np.asarray(column.indices)
    keys = matrix(batch.column("key"))
    ids, tokens = np.asarray(batch.column("entry_id")), np.asarray(batch.column("token"))
    for number, store in enumerate(names):
        wanted = _per_store(k, store)
        if wanted < 1:
            continue
        if store not in tops:
            tops[store] = TopK(query_rows, wanted, metric, None if limits is None else _limits(limits, store))
        rows = places == number
        tops[store].add(keys[rows], ids[rows], tokens[rows])


def _best(found: DataFrame, k: Amount, metric: str) -> DataFrame:
    """Merge the partial results; the rank filter also prunes before the shuffle."""
    nearest = F.desc("dist") if metric == "dot" else F.asc("dist")
    order = Window.partitionBy("query_id", "store").orderBy(nearest, "entry_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    most = k if isinstance(k, int) else max(k.values())
    ranked = ranked.where(F.col("rank") <= most)
    if not isinstance(k, int):
        limits = F.create_map(*[F.lit(x) for pair in k.items() for x in pair])
        ranked = ranked.where(F.col("rank") <= limits[F.col("store")])
    return ranked.select("query_id", "store", "rank", "entry_id", "dist", "token")


def _by_broadcast(queries: pa.Table, keys: DataFrame, k: Amount, metric: str) -> DataFrame:
    """At most QUERY_BLOCK queries go to every task; keys are read where they lie."""
    query_ids = np.asarray(queries.column("query_id").combine_chunks())
    limits = queries.column("limits").combine_chunks() if "limits" in queries.column_names else None
    shared = keys.sparkSession.sparkContext.broadcast((query_ids, matrix(queries.column("embedding")), limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, limits = shared.value
        tops: dict = {}
        held: list[pa.RecordBatch] = []

        def search() -> None:
            if held:
                _search(tops, rows, limits, k, metric, pa.Table.from_batches(held).combine_chunks())
                held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= STREAM_ROWS:
                search()
        search()
        for store, top in tops.items():
            yield _emit(ids, store, top)

    return keys.select("store", "entry_id", "key", "token").mapInArrow(run, _FOUND)


class _Block:
    """The k best of a block of queries, from rows in order of cell: first a cell's queries, then its keys by store."""

    def __init__(self, k: Amount, metric: str, codebooks: np.ndarray | None):
        self.k, self.metric, self.codebooks = k, metric, codebooks
        self.places: dict[int, int] = {}
        self.best: dict[str, tuple] = {}
        self.fresh: dict[str, list[tuple]] = {}
        self.reach: dict[str, np.ndarray] = {}
        self.cell, self.store = None, None
        self.queries: list[pa.RecordBatch] = []
        self.keys: list[pa.RecordBatch] = []
        self.held, self.owner, self.top = 0, None, None

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows of one cell and store, or queries of one cell."""
        cell, kind, store = rows.column("cell")[0].as_py(), rows.column("_kind")[0].as_py(), rows.column("store")[0].as_py()
        if cell != self.cell:
            self.close()
            self.queries, self.owner, self.cell = [], None, cell
        if kind == 0:
            self.queries.append(rows)
            return
        if store != self.store:
            self.close()
            self.store = store
        if store is not None and self.queries and _per_store(self.k, store) > 0:
            self.keys.append(rows)
            self.held += rows.num_rows
            # A longer list is merged less often.
            if self.held >= min(1 << 16, max(KEY_BLOCK, 64 * _per_store(self.k, store))):
                self._search()

    def _open(self) -> None:
        if self.owner is None:
            asked = pa.Table.from_batches(self.queries).combine_chunks()
            ids = np.asarray(asked.column("query_id").combine_chunks()).tolist()
            self.owner = np.array([self.places.setdefault(q, len(self.places)) for q in ids])
            self.vectors = matrix(asked.column("embedding"))
            self.limits = asked.column("limits").combine_chunks() if "limits" in asked.column_names else None
        reach = self._reached()[self.owner]
        if self.limits is not None:
            reach = np.minimum(reach, _limits(self.limits, self.store))
        self.top = TopK(self.vectors, _per_store(self.k, self.store), "l2" if self.metric == "pq" else self.metric, reach)

    def _search(self) -> None:
        if not self.keys:
            return
        if self.top is None:
            self._open()
        table = pa.Table.from_batches(self.keys).combine_chunks()
        # The distance to a code's vector is the sum of the distances to its codewords.
        found = decoded(code_matrix(table.column("key")), self.codebooks) if self.metric == "pq" else matrix(table.column("key"))
        ids, tokens = (np.asarray(table.column(c).combine_chunks()) for c in ("entry_id", "token"))
        self.top.add(found, ids, tokens)
        self.keys, self.held = [], 0

    def close(self) -> None:
        """Keep what a cell's keys of one store gave."""
        self._search()
        if self.top is not None:
            top, reach = self.top, self._reached()
            self.fresh.setdefault(self.store, []).append((self.owner[top.qi], top.ids, top.dist, top.token))
            np.minimum.at(reach, self.owner, top.limit)
            self.reach[self.store] = reach
            # Lists are merged when they have doubled.
            if sum(len(x[0]) for x in self.fresh[self.store]) > len(self.best.get(self.store, ((),))[0]):
                self._merge(self.store)
        self.top, self.store = None, None

    def _reached(self) -> np.ndarray:
        """For each query a distance within which its k best of the store lie."""
        reach = np.full(len(self.places), np.inf)
        known = self.reach.get(self.store, reach[:0])
        reach[: len(known)] = known
        return reach

    def _merge(self, store: str) -> None:
        parts = [self.best[store]] if store in self.best else []
        owner, ids, dist, token = (np.concatenate(x) for x in zip(*parts, *self.fresh.pop(store), strict=True))
        k = _per_store(self.k, store)
        near = dist <= self.reach[store][owner]
        owner, ids, dist, token = owner[near], ids[near], dist[near], token[near]
        chosen, owner = first_of_each(owner, dist, ids, k)
        self.best[store] = (owner, ids[chosen], dist[chosen], token[chosen])
        last = np.full(len(self.reach[store]), np.inf)
        last[owner] = dist[chosen]  # the last write is the worst kept
        full = np.bincount(owner, minlength=len(last)) >= k
        self.reach[store][full] = np.minimum(self.reach[store], last)[full]

    def found(self) -> Iterator[pa.RecordBatch]:
        self.close()
        for store in list(self.fresh):
            self._merge(store)
        queries = np.fromiter(self.places, np.int64, len(self.places))
        sign = -1.0 if self.metric == "dot" else 1.0
        for store, (owner, ids, dist, token) in self.best.items():
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1
            for s in range(0, len(owner), KEY_BLOCK):
                part = slice(s, s + KEY_BLOCK)
                n = len(owner[part])
                columns = [
                    pa.array(queries[owner[part]], pa.int64()), pa.array([store] * n, pa.string()), pa.array(rank[part], pa.int32()),
                    pa.array(ids[part], pa.int64()), pa.array(sign * dist[part], pa.float64()), pa.array(token[part], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "store", "rank", "entry_id", "dist", "token"])


def _alike(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of neighbouring rows that agree in cell, kind and store."""
    stores = batch.column("store").dictionary_encode().indices.fill_null(-1)
    marks = np.stack([np.asarray(x).astype(np.int64) for x in (batch.column("cell"), batch.column("_kind"), stores)])
    cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(low, high - low)


def _shared(rows: DataFrame, vector: str, order: list[str], copies: int | None = None):
    """A table of vectors as a broadcast Arrow stream of one batch, in the order of some columns; None if it is too large.

    None also if so many ``copies`` of it are few bytes. Runs a job that measures it, and one that fetches it.
    """
    kind = rows.schema[vector].dataType
    if kind.typeName() == "array":
        size, width = F.size(vector), 8 if kind.elementType.typeName() in ("double", "long") else 4
    else:
        size, width = F.length(vector), 1
    held = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("numbers")).first()
    total = held["numbers"] * width + held["rows"] * 8 * len(rows.columns)
    if total > SHARED_BYTES or copies is not None and copies * total <= COPIED_BYTES:
        return None
    table = rows.toArrow()
    table = table.sort_by([(c, "ascending") for c in order]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _read_shared(shared) -> pa.RecordBatch | None:
    """The one batch of a broadcast table; None if it has no row."""
    batches = [b for b in pa.ipc.open_stream(shared.value) if b.num_rows]
    return batches[0] if batches else None


def _keys_of_cells(shared) -> dict[int, list[pa.RecordBatch]]:
    """Slices of the broadcast keys of each cell, by store."""
    keys, cells = _read_shared(shared), {}
    for part in _alike(keys) if keys is not None else ():
        rows = cells.setdefault(part.column("cell")[0].as_py(), [])
        rows.extend(part.slice(s, KEY_BLOCK) for s in range(0, part.num_rows, KEY_BLOCK))
    return cells


def _by_blocks(queries: DataFrame, keys: DataFrame, k: Amount, metric: str, codebooks=None) -> DataFrame:
    """Neighbours with their ranks, for any number of queries and of keys per ``cell``.

    Queries are dealt over blocks by hash, as many as the neighbours of a block fit a task. A task has one block, and
    the keys of each cell that its queries probe stream past it in order of cell and store. It holds the k best of its queries
    over all cells, the vectors of one cell's queries and a few thousand keys, so a query returns its k best only,
    however many cells or keys there are, and nothing is left to merge. Keys of up to ``SHARED_BYTES`` are broadcast and stream
    past a block from there; more, or very few, are shuffled to each block that probes their cell. Runs jobs that count the queries and measure the keys.
    """
    spark = keys.sparkSession
    if not isinstance(k, int):
        keys = keys.where(F.col("store").isin([store for store, n in k.items() if n > 0]))
    size = queries.agg(F.approx_count_distinct("query_id").alias("queries"), F.approx_count_distinct("cell").alias("cells")).first()
    most = max(1, 5 * k if isinstance(k, int) else sum(k.values()) + 3 * max(k.values(), default=0))
    blocks = -(-max(1, size["queries"]) // max(1, min(TASK_QUERIES, TASK_ROWS // most)))
    # Whole waves of tasks.
    cores = spark.sparkContext.defaultParallelism
    blocks = -(-blocks // cores) * cores
    queries = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    known = ["limits"] if "limits" in queries.columns else []
    own = ["query_id", "embedding", *known]
    shared = _shared(keys.select("cell", F.lit(1).alias("_kind"), "store", "entry_id", "key", "token"), "key", ["cell", "store"], blocks)
    if shared is not None:
        asked = queries.select("_block", "cell", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("store"), *own)
        asked = asked.repartitionById(blocks, "_block").drop("_block").sortWithinPartitions("cell")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, cells, cell = _Block(k, metric, None if codebooks is None else codebooks.value), None, None
            for part in (p for batch in batches if batch.num_rows for p in _alike(batch)):
                if cells is None:
                    cells = _keys_of_cells(shared)
                now = part.column("cell")[0].as_py()
                if now != cell:
                    for rows in cells.get(cell, ()):
                        block.add(rows)
                cell = now
                block.add(part)
            for rows in cells.get(cell, ()) if cells else ():
                block.add(rows)
            yield from block.found()

        return asked.mapInArrow(near, _RANKED)
    # A row a cell, with the blocks that probe it.
    wanted = queries.groupBy("cell").agg(F.collect_set("_block").alias("_blocks"))
    wanted = F.broadcast(wanted) if size["cells"] * blocks <= BROADCAST_IDS else wanted
    left = keys.join(wanted, "cell").select(
        F.explode("_blocks").alias("_block"), "cell", F.lit(1).alias("_kind"), "store", "entry_id", "key", "token",
        *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in own],
    )
    right = queries.select(
        "_block", "cell", F.lit(0).alias("_kind"),
        *[F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in ("store", "entry_id", "key", "token")],
        *own,
    )
    rows = left.unionByName(right).repartitionById(blocks, "_block").drop("_block").sortWithinPartitions("cell", "_kind", "store")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(k, metric, None if codebooks is None else codebooks.value)
        for batch in batches:
            if batch.num_rows:
                for part in _alike(batch):
                    block.add(part)
        yield from block.found()

    return rows.mapInArrow(run, _RANKED)


def _many(queries: DataFrame, block: int) -> bool:
    return queries.count() > ROUNDS * block


def _whole(queries: DataFrame, keys: DataFrame, k: Amount, metric: str) -> DataFrame:
    """Many queries against all keys."""
    keys = keys.select("store", "entry_id", "key", "token", F.lit(0).alias("cell"))
    return _by_blocks(queries.withColumn("cell", F.lit(0)), keys, k, metric)


def _pass(queries: DataFrame, keys: DataFrame, k: Amount, block: int, metric: str) -> DataFrame:
    """The k best of each task or block, by the path that suits the number of queries."""
    probe = queries.limit(block + 1).toArrow()
    if probe.num_rows == 0:
        return keys.sparkSession.createDataFrame([], _FOUND)
    if probe.num_rows <= block:
        return _by_broadcast(probe, keys, k, metric)
    if _many(queries, block):
        return _whole(queries, keys, k, metric).drop("rank")
    return _by_rounds(queries, keys, k, block, metric)


def _by_rounds(queries: DataFrame, keys: DataFrame, k: Amount, block: int, metric: str) -> DataFrame:
    """Blocks of queries one after another, each sent to the keys where they lie.

    A block is about ``block`` queries by hash; its k best of each task are
    written before the next one is sent. The keys are read once a block and never shuffled.
    """
    spark = keys.sparkSession
    rounds = -(-queries.count() // block)
    turn = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
    queries = materialize(queries.withColumn("_turn", turn.cast("int")).repartition("_turn"), "query-blocks")
    path = work_folder(spark, "found-by-block")
    for number in range(rounds):
        probe = queries.where(F.col("_turn") == number).drop("_turn").toArrow()
        if probe.num_rows:
            _by_broadcast(probe, keys, k, metric).write.parquet(f"{path}/turn={number}")
    return spark.read.schema(_FOUND).parquet(path).drop("turn")


def _exact(queries: DataFrame, keys: DataFrame, k: Amount, block: int, metric: str) -> DataFrame:
    """Exact search in passes over growing shares of the keys.

    The first pass sees about FIRST_KEYS keys, each further one brings what was
    seen to GROWTH times as many. A pass returns only pairs within the distance
    that the k-th neighbour has so far, which keeps all of the true k best. So a
    query returns about GROWTH * k rows a pass instead of k for each block of keys,
    and the passes grow with the logarithm of the keys. Up to FIRST_KEYS keys there
    is one pass and nothing is written. More than ROUNDS blocks of queries are dealt over
    the tasks instead, and all keys stream past each task once (``_by_blocks``).
    """
    if "store" not in keys.columns:
        keys = keys.withColumn("store", F.lit("all"))
    queries = queries.select("query_id", "embedding")
    if _many(queries, block):
        return _whole(queries, keys, k, metric)
    total, seen = keys.count(), FIRST_KEYS
    if total <= seen:
        return _best(_pass(queries, keys, k, block, metric), k, metric)
    # A hash puts each key into exactly one pass.
    place = F.pmod(F.xxhash64("entry_id", "store"), F.lit(1 << 30))
    low, best = 0, None
    while low < 1 << 30:
        high = min(1 << 30, max(low + 1, (seen << 30) // total))
        found = _pass(queries, keys.where((place >= low) & (place < high)), k, block, metric)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = _best(found, k, metric)
        low, seen = high, seen * GROWTH
        if low < 1 << 30:
            best = materialize(best, "nearest")
            queries = queries.select("query_id", "embedding").join(_reach(best, k, metric), "query_id", "left")
    return best


def _reach(best: DataFrame, k: Amount, metric: str) -> DataFrame:
    """``query_id, limits``: the distance of the k-th neighbour in each store that has k."""
    wanted = F.lit(k) if isinstance(k, int) else F.create_map(*[F.lit(x) for pair in k.items() for x in pair])[F.col("store")]
    dist = -F.col("dist") if metric == "dot" else F.col("dist")
    last = best.where(F.col("rank") == wanted)
    return last.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("store", dist))).alias("limits"))


def knn_exact(queries: DataFrame, keys: DataFrame, k: Amount = 1024, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest keys per query and store by squared L2; ties by entry id.

    The query side is counted (up to ``block``). A small one is sent to the key
    partitions, a larger one in up to ``ROUNDS`` blocks, one after another, each a job; the keys are
    not shuffled. Beyond a million keys the search goes in passes (``_exact``), each a job. Of still more
    queries each task takes a block, past which the keys stream.
    """
    return _exact(queries, keys, k, block, "l2")


def knn_dot(queries: DataFrame, keys: DataFrame, k: Amount = 1024, block: int = QUERY_BLOCK) -> DataFrame:
    """The same by inner product, largest first."""
    return _exact(queries, keys, k, block, "dot")


def update_neighbours(
    queries: DataFrame, best: DataFrame | None, added: DataFrame, k: Amount = 1024, block: int = QUERY_BLOCK
) -> DataFrame:
    """The k nearest keys of a store that has grown, from those before and the added keys alone.

    ``best`` is the (written) result for the entries before, None at the beginning. Its k-th distances limit
    the search of the ``added`` keys, so few pairs come back; keys that were there before are not read.
    """
    if best is None:
        return knn_exact(queries, added, k, block)
    # Counted, dealt and searched: joined with the limits once.
    limited = materialize(queries.select("query_id", "embedding").join(_reach(best, k, "l2"), "query_id", "left"), "limited-queries")
    found = _pass(limited, added, k, block, "l2")
    return _best(found.unionByName(best.drop("rank")), k, "l2")


def two_store_retrieve(
    queries: DataFrame,
    keys: DataFrame,
    k: int = 1024,
    other_k: int | None = None,
    stores: tuple[str, str] = ("toxic", "nontoxic"),
) -> DataFrame:
    """Both stores searched in one pass, each with its own k."""
    return knn_exact(queries, keys, {stores[0]: k, stores[1]: k if other_k is None else other_k})


# Wanted ids that are broadcast to the keys, and neighbours measured together.
BROADCAST_IDS = 1_000_000
PAIRS = 1 << 15


def _measured(neighbours: DataFrame, held, asked) -> DataFrame:
    """Neighbours with distances to broadcast keys (in order of store and id) and queries (in order of id)."""
    names = ["query_id", "store", "rank", "entry_id", "dist", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries = _read_shared(held), _read_shared(asked)
        if keys is None or queries is None:
            return
        ids, known = np.asarray(keys.column("entry_id")), np.asarray(queries.column("query_id"))
        by_store = "store" in keys.schema.names
        stores = keys.column("store").dictionary_encode() if by_store else None
        bounds = np.searchsorted(np.asarray(stores.indices), np.arange(len(stores.dictionary) + 1)) if by_store else [0, len(ids)]
        number_of = {store: i for i, store in enumerate(stores.dictionary.to_pylist())} if by_store else {}
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("query_id").is_valid(), batch.column("entry_id").is_valid()))
            if not batch.num_rows:
                continue
            wanted, query = np.asarray(batch.column("entry_id")), np.asarray(batch.column("query_id"))
            own = np.array([number_of.get(s, -1) for s in batch.column("store").to_pylist()]) if by_store else np.zeros(len(wanted), int)
            low, high = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
            for number in range(len(bounds) - 1):
                rows, of = own == number, ids[bounds[number] : bounds[number + 1]]
                low[rows] = bounds[number] + np.searchsorted(of, wanted[rows])
                high[rows] = bounds[number] + np.searchsorted(of, wanted[rows], "right")
            place = np.minimum(np.searchsorted(known, query), len(known) - 1)
            # As in a join, a neighbour has a row for each key with its id.
            times = np.where(known[place] == query, high - low, 0)
            row = np.repeat(np.arange(len(times)), times)
            at = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for s in range(0, len(row), PAIRS):
                some = row[s : s + PAIRS]
                gaps = matrix(keys.column("key").take(pa.array(at[s : s + PAIRS]))) - matrix(queries.column("embedding").take(pa.array(place[some])))
                found = batch.take(pa.array(some)).append_column("dist", pa.array((gaps * gaps).sum(1)))
                yield found.select(names)

    return neighbours.select("query_id", "store", "rank", "entry_id", "token").mapInArrow(run, _RANKED)


def recompute_dists(neighbours: DataFrame, queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Exact distances for retrieved ids; their order stays as it was.

    Keys and queries of up to ``SHARED_BYTES`` each are broadcast, and neighbours are measured where they lie. Of larger tables,
    only keys that are someone's neighbour move (up to ``BROADCAST_IDS`` of them are
    picked where they lie), and a query's vector goes once to the block of queries that it
    is measured in, not once a neighbour; ``neighbours`` is then read twice. Runs a job.
    """
    by = ["store", "entry_id"] if "store" in keys.columns else ["entry_id"]
    held = _shared(keys.select(*by, "key").dropna(subset=by), "key", by)
    asked = None if held is None else _shared(queries.select("query_id", "embedding").dropna(subset=["query_id"]), "embedding", ["query_id"])
    if asked is not None:
        return _measured(neighbours, held, asked)
    wanted = neighbours.select(*by).distinct()
    counts = neighbours.agg(F.count("*").alias("pairs"), F.count_distinct(*by).alias("ids")).first()
    wanted = F.broadcast(wanted) if counts["ids"] <= BROADCAST_IDS else wanted
    blocks = max(1, -(-counts["pairs"] // PAIRS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block")
    own = keys.select(*by, "key").join(wanted, by, "left_semi")
    left = neighbours.select("query_id", "store", "rank", "entry_id", "token").join(own, by)
    right = queries.select("query_id", "embedding").join(neighbours.select("query_id").distinct(), "query_id", "left_semi")
    names = ["query_id", "store", "rank", "entry_id", "dist", "token"]

    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        pairs, rows = pairs.combine_chunks(), rows.combine_chunks()
        dist = np.empty(0)
        ids = np.asarray(rows.column("query_id")) if rows.num_rows else np.empty(0, np.int64)
        pairs = pairs.filter(pa.array(np.isin(np.asarray(pairs.column("query_id")), ids)))
        if pairs.num_rows:
            order = np.argsort(ids)
            place = order[np.searchsorted(ids[order], np.asarray(pairs.column("query_id")))]
            gaps = matrix(pairs.column("key")) - matrix(rows.column("embedding"))[place]
            dist = (gaps * gaps).sum(1)
        return pairs.append_column("dist", pa.array(dist)).select(names)

    kinds = "query_id bigint, store string, rank int, entry_id bigint, dist double, token int"
    return left.select("*", block).groupBy("_block").cogroup(right.select("*", block).groupBy("_block")).applyInArrow(run, kinds)


# Entries of one row of a packed token stream, and rows that one task packs (fewer than Spark aggregates in memory).
PACK = 4096
TASK_PACKS = 96


def pack_tokens(store: DataFrame, pack: int = PACK) -> DataFrame:
    """The token stream of each store in blocks: ``store, block, ids, tokens``, in order of the entry id.

    A block has the entries ``block * pack`` up to the next one's. Written once, it serves any
    number of ``neighbour_context`` calls. ``store`` is counted: each task packs a few blocks. Entries are put
    together where they lie, so neighbouring ones move as a list of tokens and their first id.
    """
    rows = store.select("store", "entry_id", "token", whole_div(F.col("entry_id"), pack).alias("block"))
    tasks = max(store.sparkSession.sparkContext.defaultParallelism, -(-store.count() // (TASK_PACKS * pack)))
    pieces = rows.select("store", "block", "entry_id", "token").mapInArrow(_pieces, _PIECES).repartition(tasks, "store", "block")
    parts = F.sort_array(F.collect_list(F.struct("first", "ids", "tokens"))).alias("_p")  # at most ``pack`` entries
    packed = pieces.groupBy("store", "block").agg(parts)
    # Pieces without gaps that follow one another are in order as they are.
    gapless = F.forall("_p", lambda p: p["ids"].isNull() & p["first"].isNotNull())
    after = F.forall(
        F.sequence(F.lit(1), F.size("_p") - 1),
        lambda i: F.get("_p", i)["first"] >= F.get("_p", i - 1)["first"] + F.size(F.get("_p", i - 1)["tokens"]),
    )
    in_order = gapless & ((F.size("_p") == 1) | after)
    own = F.transform("_p", lambda p: F.coalesce(p["ids"], F.sequence(p["first"], p["first"] + F.size(p["tokens"]) - 1), F.transform(p["tokens"], lambda _: F.lit(None).cast("bigint"))))
    entries = F.arrays_zip(F.flatten(own).alias("entry_id"), F.flatten(F.transform("_p", lambda p: p["tokens"])).alias("token"))
    entries = packed.withColumn("_ok", in_order).select("store", "block", F.when(F.col("_ok"), entries).otherwise(F.sort_array(entries)).alias("_e"))
    return entries.select(
        "store",
        "block",
        F.transform("_e", lambda e: e["entry_id"]).alias("ids"),
        F.transform("_e", lambda e: e["token"]).alias("tokens"),
    )


_PIECES = "store string, block bigint, first bigint, ids array<bigint>, tokens array<int>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a batch as a list for each store and block; ``ids`` only where they have gaps."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in ("store", "entry_id")]).combine_chunks()
        stores = np.asarray(rows.column("store").combine_chunks().dictionary_encode().indices.fill_null(-1))
        blocks, ids = rows.column("block").combine_chunks(), rows.column("entry_id").combine_chunks()
        known = np.asarray(ids.is_valid())
        block, number = np.asarray(blocks.fill_null(0)), np.asarray(ids.fill_null(0))
        new = np.r_[True, (stores[1:] != stores[:-1]) | (block[1:] != block[:-1]) | (known[1:] != known[:-1])]
        heads = np.flatnonzero(new)
        ends = np.r_[heads[1:], len(number)]
        steps = np.r_[0, np.cumsum(np.diff(number) != 1)]
        gaps = (steps[ends - 1] != steps[heads]) & known[heads]
        first = blocks.take(pa.array(heads)), ids.take(pa.array(heads))
        offsets = pa.array(np.r_[heads, len(number)], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, ids, mask=pa.array(~gaps))
        tokens = pa.ListArray.from_arrays(offsets, rows.column("token").combine_chunks())
        names = ["store", "block", "first", "ids", "tokens"]
        yield pa.RecordBatch.from_arrays([rows.column("store").combine_chunks().take(pa.array(heads)), *first, lists, tokens], names=names)


def neighbour_context(neighbours: DataFrame, store: DataFrame, tokens: int = 30, top: int = 3, pack: int = PACK) -> DataFrame:
    """The tokens before each of the first neighbours, and its next token.

    ``store`` has a row an entry, or is packed (``pack_tokens`` with the same ``pack``). A context is
    a slice of one block or of two neighbouring ones, so a neighbour asks for two
    rows at most, found by block number. The context is NULL for entries too close to the start of the
    store.
    """
    if tokens > pack:
        raise ValueError("a context may not be longer than a block")
    packed = store if "tokens" in store.columns else pack_tokens(store, pack)
    first = neighbours.where(F.col("rank") <= top)
    low, high = F.col("entry_id") - tokens, F.col("entry_id") - 1
    wanted = first.where(F.col("entry_id") >= tokens).select(
        "query_id",
        "store",
        "rank",
        low.alias("_low"),
        high.alias("_high"),
        F.explode(F.array_distinct(F.array(whole_div(low, pack), whole_div(high, pack)))).alias("block"),
    )
    # Ids without gaps are places and stay behind; with gaps the block is searched.
    least, most = F.get("ids", F.lit(0)), F.element_at("ids", -1)
    blocks = packed.select(
        "store", "block", least.alias("_least"), most.alias("_most"), "tokens", F.when(most - least + 1 != F.size("ids"), F.col("ids")).alias("ids")
    )
    begin, end = F.greatest("_low", "_least"), F.least("_high", "_most")
    gapless = F.col("ids").isNull()
    sliced = F.slice("tokens", (begin - F.col("_least") + 1).cast("int"), F.greatest(end - begin + 1, F.lit(0)).cast("int"))
    searched = F.transform(
        F.filter(F.arrays_zip("ids", "tokens"), lambda e: (e["ids"] >= F.col("_low")) & (e["ids"] <= F.col("_high"))),
        lambda e: e["tokens"],
    )
    piece = F.when(gapless & (end < begin), F.array().cast("array<int>")).when(gapless, sliced).otherwise(searched)
    pieces = wanted.join(blocks, ["store", "block"]).select("query_id", "store", "rank", "block", piece.alias("_piece"))
    contexts = (
        pieces.groupBy("query_id", "store", "rank")
        .agg(F.sort_array(F.collect_list(F.struct("block", "_piece"))).alias("_c"))
        .select("query_id", "store", "rank", F.flatten(F.transform("_c", lambda c: c["_piece"])).alias("context"))
        .where(F.size("context") > 0)
    )
    return first.join(contexts, ["query_id", "store", "rank"], "left").select(
        "query_id", "store", "rank", "entry_id", "context", F.col("token").alias("next_token")
    )


# --- inverted file -----------------------------------------------------------


def ivf_train(
    keys: DataFrame, cells: int = 4096, fraction: float | None = None, seed: int = 1, method: str = "kmeans"
) -> DataFrame:
    """``cell, centroid`` of all keys, or of a seeded ``fraction`` of them if one is given.

    ``kmeans`` runs Spark's distributed k-means; ``sample`` takes the first
    keys in seeded order as centroids, which SQL can repeat.
    """
    if cells > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} cells")
    order = seed_order(seed, F.col("entry_id"))
    if method == "sample":
        chosen = keys.orderBy(order, "entry_id").limit(cells)
        rank = F.row_number().over(Window.orderBy(order, "entry_id")) - 1  # over `cells` rows
        return chosen.select(rank.cast("int").alias("cell"), F.col("key").alias("centroid"))
    if method != "kmeans":
        raise ValueError("method is kmeans or sample")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = keys.select("entry_id", "key")
    if fraction is not None:
        # Rows whose hash lies below the wanted share: no sort of the store.
        share = int(fraction * (1 << 24))
        rows = rows.where(F.conv(F.substring(order, 1, 6), 16, 10).cast("bigint") < share)
    vectors = rows.select(array_to_vector(F.col("key").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=20).fit(vectors)
    data = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return keys.sparkSession.createDataFrame(data, "cell int, centroid array<double>")


def _centroid_rows(centroids: DataFrame):
    table = centroids.select("cell", "centroid").orderBy("cell").limit(MAX_CENTROIDS + 1).toArrow()
    if table.num_rows > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} centroids")
    rows = (np.asarray(table.column("cell").combine_chunks()).astype(np.int64), matrix(table.column("centroid")))
    return centroids.sparkSession.sparkContext.broadcast(rows)


def _nearest_cells(df: DataFrame, vector: str, centroids: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` with each of their ``n`` nearest cells."""
    shared = _centroid_rows(centroids)
    schema = df.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, rows = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            top = TopK(matrix(batch.column(vector)), n)
            top.add(rows, cells, cells)
            repeated = batch.take(pa.array(top.qi))
            yield repeated.append_column("cell", pa.array(top.ids, pa.int32()))

    return df.mapInArrow(run, schema)


def ivf_assign(keys: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid of every key, as column ``cell``."""
    return _nearest_cells(keys, "key", centroids, 1)


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``query_id, embedding, cell`` for the ``nprobe`` nearest cells of each query."""
    return _nearest_cells(queries.select("query_id", "embedding"), "embedding", centroids, nprobe)


def ivf_search(
    queries: DataFrame,
    keys: DataFrame,
    centroids: DataFrame,
    k: Amount = 1024,
    nprobe: int = 32,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Exact distances within the ``nprobe`` nearest cells of each query.

    ``keys`` carries its ``cell`` (``ivf_assign``); ``sources.index`` keeps keys by
    cell in files, so that they are assigned once and the cells not probed are not read.
    """
    if "store" not in keys.columns:
        keys = keys.withColumn("store", F.lit("all"))
    probes = probe_cells(queries, centroids, nprobe) if probes is None else probes
    return _by_blocks(probes, keys, k, "l2")


# --- product quantisation ----------------------------------------------------

MAX_CODES = 256

START_KEYS = 16


def pq_train(
    keys: DataFrame,
    subspaces: int = 64,
    codes: int = 256,
    seed: int = 1,
    method: str = "kmeans",
    rounds: int = 15,
) -> DataFrame:
    """Codebooks ``subspace, code, codeword`` of all keys.

    ``sample`` takes the first ``codes`` keys in seeded order. ``kmeans`` begins with
    such keys and runs ``rounds`` of Lloyd's algorithm over every key: each task assigns its keys to the broadcast codebooks and
    returns one sum a code, and Spark adds the sums of the tasks. The driver holds
    codebooks only.
    """
    if codes > MAX_CODES:
        raise ValueError(f"at most {MAX_CODES} codes")
    order = seed_order(seed, F.col("entry_id"))
    chosen = keys.orderBy(order, "entry_id").limit(codes).select(
        "entry_id", order.alias("_order"), F.col("key").cast("array<double>").alias("_key")
    )
    width = F.floor(F.size("_key") / subspaces).cast("int")
    parts = chosen.withColumn("_width", width).select(
        "entry_id",
        "_order",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(subspaces - 1)),
                lambda s: F.slice("_key", s * F.col("_width") + 1, F.col("_width")),
            )
        ).alias("subspace", "codeword"),
    )
    rank = F.row_number().over(Window.partitionBy("subspace").orderBy("_order", "entry_id")) - 1
    first = parts.select("subspace", rank.cast("int").alias("code"), "codeword")
    if method == "sample":
        return first
    if method != "kmeans":
        raise ValueError("method is kmeans or sample")
    spark = keys.sparkSession
    # Where to begin: the first different codewords among a few keys a code. Every round reads all keys.
    begin = keys.orderBy(order, "entry_id").limit(START_KEYS * codes).select(F.col("key").cast("array<double>").alias("key"))
    points = matrix(begin.toArrow().column("key")).astype(np.float64)
    if not len(points):
        return first
    count, width = min(codes, len(points)), points.shape[1] // subspaces
    centres = np.zeros((subspaces, count, width))
    for s in range(subspaces):
        part = points[:, s * width : (s + 1) * width]
        _, firsts = np.unique(part, axis=0, return_index=True)
        centres[s] = part[np.resize(np.sort(firsts), count)]
    places = [(s, c) for s in range(subspaces) for c in range(count)]
    names = ["subspace", "code", "n", "total"]
    kinds = "subspace int, code int, n bigint, total array<double>"
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            sizes, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape)
            for batch in batches:
                points = matrix(batch.column(0)).astype(np.float64)
                for s, book in enumerate(books):
                    part = points[:, s * book.shape[1] : (s + 1) * book.shape[1]]
                    owner = ((book**2).sum(1)[None] - 2 * part @ book.T).argmin(1)
                    sizes[s] += np.bincount(owner, minlength=len(book))
                    np.add.at(sums[s], owner, part)
            s, c = np.nonzero(sizes)
            totals = pa.array(sums[s, c].tolist(), pa.list_(pa.float64()))
            columns = [pa.array(s.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(sizes[s, c]), totals]
            yield pa.RecordBatch.from_arrays(columns, names)

        partial = keys.select("key").mapInArrow(assign, kinds)
        # Sums of each number of a codeword over the tasks, put together again by place.
        numbers = partial.select("subspace", "code", "n", F.posexplode("total").alias("place", "x"))
        numbers = numbers.groupBy("subspace", "code", "place").agg((F.sum("x") / F.sum("n")).alias("x"))
        for row in numbers.collect():
            centres[row["subspace"], row["code"], row["place"]] = row["x"]
        shared.unpersist()
    data = [(s, c, centres[s, c].tolist()) for s, c in places]
    return spark.createDataFrame(data, "subspace int, code int, codeword array<double>")


def _codebook_array(codebooks: DataFrame):
    """(subspace, code, width); at most 256 codes for each part of one vector."""
    table = codebooks.select("subspace", "code", "codeword").orderBy("subspace", "code").toArrow()
    n = int(max(table.column("subspace").to_pylist())) + 1
    rows = matrix(table.column("codeword"))
    return codebooks.sparkSession.sparkContext.broadcast(rows.reshape(n, len(rows) // n, -1))


def pq_encode(keys: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Nearest codeword of every part of a key, as ``codes array<int>``."""
    shared = _codebook_array(codebooks)
    schema = keys.withColumn("codes", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = matrix(batch.column("key")).reshape(batch.num_rows, len(books), -1)
            codes = np.empty((batch.num_rows, len(books)), dtype=np.int32)
            numbers = np.arange(books.shape[1])
            for s, book in enumerate(books):
                top = TopK(parts[:, s, :], 1)
                top.add(book, numbers, numbers)
                codes[:, s] = top.ids
            offsets = pa.array(np.arange(0, codes.size + 1, len(books)), pa.int32())
            yield batch.append_column("codes", pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())))

    return keys.mapInArrow(run, schema)


def pq_search(
    queries: DataFrame,
    codes: DataFrame,
    codebooks: DataFrame,
    centroids: DataFrame,
    k: Amount = 1024,
    nprobe: int = 32,
) -> DataFrame:
    """Approximate distances from the codes, within the probed cells.

    ``codes`` has ``cell, store, entry_id, codes, token``. Distances are taken to the
    codewords that the codes stand for; keys are not read.
    """
    if "store" not in codes.columns:
        codes = codes.withColumn("store", F.lit("all"))
    shared = _codebook_array(codebooks)
    probes = probe_cells(queries, centroids, nprobe)
    coded = codes.select("cell", "store", "entry_id", F.col("codes").alias("key"), "token")
    return _by_blocks(probes, coded, k, "pq", shared)


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact k nearest neighbours that the approximate search found."""
    found = approx.where(F.col("rank") <= k).select("query_id", "store", "entry_id", F.lit(1.0).alias("_hit"))
    wanted = exact.where(F.col("rank") <= k).select("query_id", "store", "entry_id")
    hits = wanted.join(found, ["query_id", "store", "entry_id"], "left")
    return hits.groupBy("store").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))


