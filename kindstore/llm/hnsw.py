"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph in each shard.

Rows are dealt to shards by hash, about ``shard_rows`` each, and every shard
becomes one graph: nodes are the different vectors of the shard in a random
order of insertion, a node stands in layers 0 to l with probability M^-l, and in each layer it
links to diverse near nodes among those inserted before it, and these back to it. Both
sides then keep at most M links (2 M in layer 0) by the same rule: a near node is
skipped if a kept one is nearer to it. As a shard is bounded, the nearest nodes before
each node are found by matrix products and not by searching the unfinished graph,
which gives the links of an unlimited construction beam.

The graph is stored as flat arrays, one row a shard: the nodes of each layer, and
``nodes x width`` numbers of neighbours, -1 for none. A search goes from the top layer down, greedily, and keeps a
beam of ``ef`` nodes in layer 0. All queries of a block take their steps together, as array
operations. What the beam holds at the end is measured again in double precision on the
original vectors, and the answers of the shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindstore.llm.base import narrow
from kindstore.operators.kernel import matrix
from kindstore.session import materialize

SHARD_ROWS = 1 << 14
LINKS = 16
# Nearest nodes before a node among which its links are chosen, and linked nodes among which the kept ones are.
CANDIDATES, BACK_CANDIDATES = 64, 96
BEAM = 96
# Nodes of a beam that are expanded in one step.
STEP = 4
# Queries that meet a shard at a time: as many as a shard has rows, so that moving graphs and moving queries cost about the same.
QUERY_BLOCK = 1 << 14
# Numbers of the largest array of a step.
NUMBERS = 1 << 23


def unit_scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that brings the largest part near 1: cosines keep every bit, squares stay finite."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows have equal cosines wherever they stand."""
    left, right = unit_scaled(left), unit_scaled(right)
    return (left * right).sum(1) / (np.sqrt((left * left).sum(1)) * np.sqrt((right * right).sum(1)))


def _directions(vectors: np.ndarray) -> np.ndarray:
    scaled = unit_scaled(vectors)
    return (scaled / np.sqrt((scaled * scaled).sum(1))[:, None]).astype(np.float32)


def _diverse(units: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's nodes (near to far, -1 for none) at most ``most``: diverse ones first, then the nearest left."""
    out = np.full((len(near), most), -1, np.int32)
    step = max(1, NUMBERS // max(1, near.shape[1] * max(near.shape[1], units.shape[1])))
    for low in range(0, len(near), step):
        nodes, own = near[low : low + step], sims[low : low + step]
        rows = units[nodes]
        among = rows @ rows.transpose(0, 2, 1)
        reach = np.full(nodes.shape, -np.inf, np.float32)
        kept, count = np.zeros(nodes.shape, bool), np.zeros(len(nodes), np.int64)
        for r in range(nodes.shape[1]):
            good = (nodes[:, r] >= 0) & (reach[:, r] < own[:, r]) & (count < most)
            kept[:, r] = good
            count += good
            np.maximum(reach, np.where(good[:, None], among[:, r], -np.inf), out=reach)
        # Kept ones first, then the others, each from near to far, then the places without a node.
        order = np.argsort(np.where(nodes < 0, 2, ~kept), axis=1, kind="stable")[:, :most]
        out[low : low + step, : order.shape[1]] = np.take_along_axis(nodes, order, 1)
    return out


def _earlier(units: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes before each node, near to far (-1 for none), and their similarities."""
    n, wide = len(units), min(count, max(1, len(units) - 1))
    near, sims = np.full((n, wide), -1, np.int64), np.full((n, wide), -np.inf, np.float32)
    step = max(1, min(1024, NUMBERS // max(1, n)))
    for low in range(0, n, step):
        high = min(n, low + step)
        found = units[low:high] @ units[:high].T
        found[np.arange(high)[None] >= np.arange(low, high)[:, None]] = -np.inf
        best = np.argpartition(-found, min(wide, high) - 1, axis=1)[:, :wide] if high > wide else np.tile(np.arange(high), (high - low, 1))
        own = np.take_along_axis(found, best, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        best, own = np.take_along_axis(best, order, 1), np.take_along_axis(own, order, 1)
        near[low:high, : best.shape[1]] = np.where(np.isfinite(own), best, -1)
        sims[low:high, : best.shape[1]] = own
    return near, sims


def _layer(units: np.ndarray, links: int, most: int) -> np.ndarray:
    """Neighbours of each node of one layer, ``most`` numbers a node."""
    near, sims = _earlier(units, CANDIDATES)
    forward = _diverse(units, near, sims, links)
    source, place = np.nonzero(forward >= 0)
    target = forward[source, place].astype(np.int64)
    both, other = np.concatenate([source, target]), np.concatenate([target, source])
    sim = np.einsum("ij,ij->i", units[both], units[other])
    order = np.lexsort((other, -sim, both))
    both, other, sim = both[order], other[order], sim[order]
    rank = np.arange(len(both)) - np.searchsorted(both, both)
    fits = rank < BACK_CANDIDATES
    near = np.full((len(units), max(1, rank[fits].max(initial=0) + 1)), -1, np.int64)
    sims = np.full(near.shape, -np.inf, np.float32)
    near[both[fits], rank[fits]], sims[both[fits], rank[fits]] = other[fits], sim[fits]
    return _diverse(units, near, sims, most)


class Graph:
    """Layers of (nodes, neighbours) from 0 up, over unit vectors; neighbours are node numbers of the graph."""

    def __init__(self, units: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.units, self.layers = units, layers

    @classmethod
    def build(cls, units: np.ndarray, levels: np.ndarray, links: int = LINKS) -> Graph:
        layers = []
        for level in range(int(levels.max(initial=0)) + 1):
            nodes = np.flatnonzero(levels >= level)
            found = _layer(units[nodes], links, links if level else 2 * links)
            layers.append((nodes.astype(np.int32), np.where(found < 0, -1, nodes[found]).astype(np.int32)))
        return cls(units, layers)

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Numbers of about the ``beam`` nearest nodes of each query, -1 for none."""
        n, width = len(self.units), self.layers[0][1].shape[1]
        if n <= beam:
            return np.tile(np.arange(n), (len(queries), 1))
        step = max(1, NUMBERS // max(n, STEP * width * self.units.shape[1]))
        found = [self._search(queries[s : s + step], beam) for s in range(0, len(queries), step)]
        return np.concatenate(found) if found else np.empty((0, beam), np.int64)

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """The node in which each query enters layer 0."""
        at = np.full(len(queries), self.layers[-1][0][0], np.int64)
        sim = np.einsum("ij,ij->i", self.units[at], queries)
        for nodes, links in self.layers[:0:-1]:
            row = np.full(len(self.units), -1, np.int64)
            row[nodes] = np.arange(len(nodes))
            moving = np.arange(len(queries))
            while len(moving):
                near = links[row[at[moving]]]
                own = np.einsum("ijk,ik->ij", self.units[near], queries[moving])
                own[near < 0] = -np.inf
                best = own.argmax(1)
                score = own[np.arange(len(moving)), best]
                better = score > sim[moving]
                moving, best, near, score = moving[better], best[better], near[better], score[better]
                at[moving], sim[moving] = near[np.arange(len(moving)), best], score
        return at

    def _search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        links, rows = self.layers[0][1], np.arange(len(queries))
        seen = np.zeros((len(queries), len(self.units)), bool)
        ids, open_ = np.full((len(queries), beam), -1, np.int64), np.zeros((len(queries), beam), bool)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        start = self._descend(queries)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", self.units[start], queries), True
        seen[rows, start] = True
        while len(rows):
            own = open_[rows]
            # The first few open places; sims fall along a row.
            first = np.argsort(~own, axis=1, kind="stable")[:, :STEP]
            wanted = np.take_along_axis(own, first, 1)
            nodes = np.where(wanted, np.take_along_axis(ids[rows], first, 1), -1)
            np.put_along_axis(own, first, False, 1)
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[rows[:, None], near]
            q, c = np.nonzero(fresh)
            seen[rows[q], near[q, c]] = True
            score = np.full(near.shape, -np.inf, np.float32)
            score[q, c] = np.einsum("ij,ij->i", self.units[near[q, c]], queries[rows[q]])
            both = np.concatenate([sims[rows], score], 1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            sims[rows] = np.take_along_axis(both, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, near, -1)], 1), order, 1)
            open_[rows] = np.take_along_axis(np.concatenate([own, fresh], 1), order, 1)
            rows = rows[open_[rows].any(1)]
        return np.where(np.isfinite(sims), ids, -1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all parts finite, one of them not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = narrow(df, _id=id_col, _vector=vector_col)
    rows = rows.select(F.col("_id").cast("bigint").alias("_id"), F.col("_vector").cast("array<double>").alias("_vector"))
    return rows.where(F.col("_id").isNotNull() & usable(F.col("_vector")))


INDEX = "dim int, shard int, shards int, ids binary, firsts binary, vectors binary, nodes array<binary>, links array<binary>"


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, links: int = LINKS, seed: int = 7) -> DataFrame:
    """One row a shard, with its vectors, ids and graph as flat arrays (``INDEX``); every usable row is in it.

    Vectors that are null, zero or hold null or non-finite parts take no part, nor do
    rows without an id. Rows that agree in id and vector count once; equal vectors of a
    shard are one node with all their ids. Vectors of different lengths stand in
    different shards. Rows are dealt by hash of id and vector, so that neither a common
    vector nor a common id fills a shard. An empty table gives an empty index.
    """
    shards = max(1, -(-df.count() // shard_rows))
    rows = _vectors(df, id_col, vector_col).distinct()
    dealt = rows.select(
        "_id", "_vector", F.size("_vector").alias("dim"), F.pmod(F.xxhash64("_id", "_vector"), F.lit(shards)).cast("int").alias("shard")
    )

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("_id").combine_chunks()).astype(np.int64)
        vectors, owner = np.unique(matrix(table.column("_vector")) + 0.0, axis=0, return_inverse=True)
        # Insertion order and levels are random but repeatable; nodes are numbered by insertion.
        shard, dim = table.column("shard")[0].as_py(), vectors.shape[1]
        draw = np.random.default_rng([seed, shard, dim])
        order = draw.permutation(len(vectors))
        levels = np.floor(-np.log(1.0 - draw.random(len(vectors))) / np.log(links)).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        vectors, owner = vectors[order], place[owner.reshape(-1)]
        by_node = np.lexsort((ids, owner))
        firsts = np.searchsorted(owner[by_node], np.arange(len(vectors) + 1))
        graph = Graph.build(_directions(vectors), levels, links)
        row = {
            "dim": dim, "shard": shard, "shards": shards, "ids": ids[by_node].tobytes(), "firsts": firsts.astype(np.int64).tobytes(),
            "vectors": vectors.tobytes(), "nodes": [x.tobytes() for x, _ in graph.layers], "links": [x.tobytes() for _, x in graph.layers],
        }
        kinds = [("dim", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()), *[(c, pa.binary()) for c in ("ids", "firsts", "vectors")]]
        return pa.Table.from_pylist([row], schema=pa.schema([*kinds, *[(c, pa.list_(pa.binary())) for c in ("nodes", "links")]]))

    return dealt.groupBy("dim", "shard").applyInArrow(run, INDEX)


def _found_in(index: dict, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, cosine) of the ``k`` nearest of each query in one shard."""
    vectors = np.frombuffer(index["vectors"], np.float64).reshape(-1, index["dim"])
    own, firsts = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["firsts"], np.int64)
    layers = []
    for nodes, links in zip(index["nodes"], index["links"], strict=True):
        nodes = np.frombuffer(nodes, np.int32)
        layers.append((nodes, np.frombuffer(links, np.int32).reshape(len(nodes), -1)))
    near = Graph(_directions(vectors), layers).search(_directions(queries), beam)
    query, place = np.nonzero(near >= 0)
    node = near[query, place]
    step, score = max(1, NUMBERS // index["dim"]), np.empty(len(node))
    for s in range(0, len(node), step):
        part = slice(s, s + step)
        score[part] = cosines(queries[query[part]], vectors[node[part]])
    # Of the ids of one vector the k smallest and one more (the query's own) are enough.
    many = np.minimum(firsts[node + 1] - firsts[node], k + 1)
    at = np.repeat(np.arange(len(node)), many)
    within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    found, query, score = own[firsts[node[at]] + within], query[at], score[at]
    other = found != ids[query]
    found, query, score = found[other], query[other], score[other]
    # An id with several vectors counts by its nearest one.
    order = np.lexsort((-score, found, query))
    again = np.zeros(len(order), bool)
    again[1:] = (query[order][1:] == query[order][:-1]) & (found[order][1:] == found[order][:-1])
    order = order[~again]
    order = order[np.lexsort((found[order], -score[order], query[order]))]
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[rank < k]
    return ids[query[order]], found[order], score[order]


FOUND = "query_id bigint, vec_id bigint, score double"


def search_index(
    queries: DataFrame, index: DataFrame, k: int = 5, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` nearest of each query by cosine, its own id left out.

    Every query visits every shard; blocks of ``QUERY_BLOCK`` queries meet one shard
    at a time, so a task holds one graph and one block. Ties go to the smaller id.
    Fewer candidates give fewer rows. Queries take part under the same conditions as
    rows of the index; several vectors under one query id answer together,
    each candidate by its largest cosine. ``index`` should be a written table.
    """
    asked = _vectors(queries, id_col, vector_col).distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = index.agg(F.coalesce(F.max("shards"), F.lit(0))).first()[0]
    if not shards:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    block = F.pmod(F.xxhash64("_id", "_vector"), F.lit(blocks)).cast("int").alias("block")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.select("_id", "_vector", F.size("_vector").alias("dim"), block, every)
    by = ["dim", "shard", "block"]

    def run(graphs: pa.Table, rows: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if graphs.num_rows and rows.num_rows:
            ids = np.asarray(rows.column("_id").combine_chunks()).astype(np.int64)
            found = _found_in(graphs.to_pylist()[0], ids, matrix(rows.column("_vector")), k, beam)
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(
    df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM
) -> DataFrame:
    """The table's rows whose id is divisible by ``every`` searched against all its rows."""
    index = materialize(build_index(df, id_col, vector_col, shard_rows), "graph-shards")
    plain = narrow(df, vec_id=id_col, embedding=vector_col)
    return search_index(plain.where(F.col("vec_id") % every == 0), index, k, beam)
