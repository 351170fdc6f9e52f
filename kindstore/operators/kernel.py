"""Numpy helpers that run inside Spark tasks: small, exact top-k of one block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Numbers of the pairs recomputed at a time (they should stay in the cache), and the sides of a block of scores.
PAIR_NUMBERS = 1 << 18
KEY_CHUNK = 1 << 11
QUERY_CHUNK = 256
# Squared lengths that single precision holds with room.
SINGLE = 1e30


def matrix(column) -> np.ndarray:
    """A list<float> Arrow column as a two-dimensional double array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def code_matrix(column) -> np.ndarray:
    """Codes of keys, a row each: from lists of numbers, or from a byte a code."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        packed = b"".join(column.to_pylist())
        return np.frombuffer(packed, np.uint8).reshape(len(column), -1).astype(np.int64)
    return matrix(column).astype(np.int64)


def exact_distances(queries, keys, qi, ki, metric):
    """Distances of pairs, computed one by one: equal keys get equal distances."""
    out = np.empty(len(qi))
    step = max(1, PAIR_NUMBERS // max(1, queries.shape[1]))
    for s in range(0, len(qi), step):
        pair = keys[ki[s : s + step]]
        other = queries[qi[s : s + step]]
        if metric == "l2":
            pair -= other
            other = pair
        pair *= other
        out[s : s + step] = pair.sum(1)
    return out if metric == "l2" else -out


def first_of_each(owner: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` nearest rows of each owner, ties by smaller id, and their owners, rising."""
    order = np.lexsort((ids, dist, owner))
    owner = owner[order]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
    sizes = np.diff(np.r_[heads, len(owner)])
    keep = np.arange(len(owner)) - np.repeat(heads, sizes) < k
    return order[keep], owner[keep]


def decoded(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for: the codeword of each part, one after another."""
    return codebooks[np.arange(len(codebooks)), codes].reshape(len(codes), -1)


class TopK:
    """Running k best keys of every query of a block, ties by smaller id.

    Scores of a block of queries and keys come from one matrix product, in which a
    further column holds the squared length of the key, in single precision unless that leaves too many
    pairs open. Only pairs within the k-th
    distance so far are picked; they are computed again exactly, so equal keys have
    equal distances wherever they sit. ``limit`` may give, for
    each query, a distance beyond which nothing is wanted.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str = "l2", limit: np.ndarray | None = None):
        self.queries, self.k, self.metric = queries, k, metric
        self.limit = np.full(len(queries), np.inf) if limit is None else np.array(limit, dtype=float)
        empty = np.empty(0, dtype=np.int64)
        self._found = [(empty, empty, np.empty(0), empty) for _ in range(0, len(queries), QUERY_CHUNK)]

    def add(self, keys: np.ndarray, ids: np.ndarray, tokens: np.ndarray) -> None:
        if len(keys):
            lengths = np.einsum("ij,ij->i", keys, keys)
            wide = np.column_stack([keys, lengths]) if self.metric == "l2" else keys
            # Squares beyond that do not fit single precision.
            short = wide.astype(np.float32) if lengths.max() < SINGLE else None
            for place in range(len(self._found)):
                self._add(place, keys, wide, short, lengths.max(), ids, tokens)

    def _add(self, place, keys, wide, short, longest, ids, tokens):
        start = place * QUERY_CHUNK
        queries = self.queries[start : start + QUERY_CHUNK]
        lengths = np.einsum("ij,ij->i", queries, queries)
        tall, less = -queries, 0.0
        if self.metric == "l2":
            tall, less = np.column_stack([-2.0 * queries, np.ones(len(queries))]), lengths
        # Both sides of the product and how far its results may be off.
        size = lengths.max() + 2 * longest
        exact = (tall, wide, 1e-9 * (1.0 + size))
        rough = exact
        if short is not None and lengths.max() < SINGLE:
            rough = (tall.astype(np.float32), short, (queries.shape[1] + 8) * 1.2e-7 * size + 1e-30)
        reach = self.limit[start : start + QUERY_CHUNK] - less
        candidates, held, step = [], 0, max(KEY_CHUNK, 16 * self.k)
        for s in range(0, len(keys), step):
            for left, right, slack in (rough, exact):
                scores = left @ right[s : s + step].T
                hits = scores <= (reach + slack).astype(scores.dtype)[:, None]
                many = np.count_nonzero(hits) > 2 * self.k * len(queries)
                if many and scores.shape[1] > self.k:
                    near = np.partition(scores, self.k - 1, axis=1)[:, self.k - 1]
                    reach = np.minimum(reach, near + slack)
                    hits = scores <= (reach + slack).astype(scores.dtype)[:, None]
                    many = np.count_nonzero(hits) > 2 * self.k * len(queries)
                if not many:
                    break
            row, column = np.divmod(np.flatnonzero(hits), scores.shape[1])
            candidates.append((row, column + s, scores[row, column] - slack))
            held += len(row)
            if held > 4 * self.k * len(queries):
                self._settle(place, queries, keys, candidates, reach, ids, tokens)
                reach = np.minimum(reach, self.limit[start : start + QUERY_CHUNK] - less)
                candidates, held = [], 0
        if held:
            self._settle(place, queries, keys, candidates, reach, ids, tokens)

    def _settle(self, place, queries, keys, candidates, reach, ids, tokens):
        """Exact distances of picked pairs, merged with what was found before."""
        start = place * QUERY_CHUNK
        limit = self.limit[start : start + QUERY_CHUNK]
        qi, ki, rough = (np.concatenate(x) for x in zip(*candidates, strict=True))
        still = rough <= reach[qi]
        qi, ki = qi[still], ki[still]
        dist = exact_distances(queries, keys, qi, ki, self.metric)
        wanted = dist <= limit[qi]
        qi, ki, dist = qi[wanted], ki[wanted], dist[wanted]
        old = self._found[place]
        qi, new_ids, dist, new_tokens = (
            np.concatenate(x) for x in zip(old, (qi, ids[ki], dist, tokens[ki]), strict=True)
        )
        chosen, qi = first_of_each(qi, dist, new_ids, self.k)
        self._found[place] = (qi, new_ids[chosen], dist[chosen], new_tokens[chosen])
        full = np.bincount(qi, minlength=len(queries)) >= self.k
        last = limit.copy()
        last[qi] = dist[chosen]  # rows are sorted, so the last write is the worst kept
        self.limit[start : start + QUERY_CHUNK] = np.where(full, last, limit)

    def _column(self, number: int) -> np.ndarray:
        parts = [found[number] for found in self._found]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    @property
    def qi(self) -> np.ndarray:
        """Query places, rising; within a query the rows go from near to far."""
        parts = [found[0] + place * QUERY_CHUNK for place, found in enumerate(self._found)]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    @property
    def ids(self) -> np.ndarray:
        return self._column(1)

    @property
    def dist(self) -> np.ndarray:
        return self._column(2)

    @property
    def token(self) -> np.ndarray:
        return self._column(3)
