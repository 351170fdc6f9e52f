"""Hashed n-gram features of whole texts, and linear models over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import (
    FOLDED_CODES,
    between,
    large_strings,
    mixed,
    narrow,
    span_hashes,
    text_chunks,
    utf8_starts,
    word_spans,
)

# Most rows of a training sample: its features go to the driver, some 8 KB each.
SAMPLE_ROWS = 6400


@dataclass(frozen=True)
class Grams:
    """Which n-grams of lower-cased text are hashed: of UTF-8 bytes, of code points, of words; and buckets of each."""

    bytes: tuple[int, ...] = (1, 2, 3, 4)
    words: tuple[int, ...] = ()
    buckets: int = 2048
    chars: tuple[int, ...] = ()

    @property
    def width(self) -> int:
        return self.buckets * (len(self.bytes) + len(self.chars) + len(self.words))


def lowered(column) -> pa.Array:
    return pc.utf8_lower(large_strings(column))


def gram_blocks(data: np.ndarray, offsets: np.ndarray, grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the bucket at each place, and the first and last place of each text."""
    bits = np.uint64(64 - int(grams.buckets).bit_length() + 1)
    rolled = np.zeros(len(data), np.uint64)
    have = 0
    for n in sorted(grams.bytes):
        while have < n:
            rolled[: len(data) - have] |= data[have:].astype(np.uint64) << np.uint64(8 * have)
            have += 1
        spread = (rolled ^ (rolled >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        spread ^= spread >> np.uint64(29)
        bucket = (spread * np.uint64(0xBF58476D1CE4E5B9)) >> bits
        yield bucket.astype(np.int32), offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
    if grams.chars:
        points, first = code_points(data, offsets)
        yield from _joined(mixed(points), first, grams.chars, bits)
    if grams.words:
        starts, ends, first = word_spans(data, offsets)
        yield from _joined(span_hashes(data, starts, ends, FOLDED_CODES), first, grams.words, bits)


def _joined(units: np.ndarray, first: np.ndarray, orders: tuple[int, ...], bits: np.uint64) -> Iterator[tuple]:
    """Buckets of n-grams of hashed units, whose first of each text is given."""
    for n in orders:
        joined = units.copy()
        for step in range(1, n):
            joined[: len(units) - step] = mixed(joined[: len(units) - step] * np.uint64(31) + units[step:])
        yield (joined >> bits).astype(np.int32), first[:-1], np.maximum(first[1:] - n + 1, first[:-1])


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of each code point as one number, and the first code point of each text (one more than texts)."""
    starts = np.flatnonzero(utf8_starts(data))
    sizes = np.diff(np.append(starts, len(data)))
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint64)
    points = padded[starts]
    for step in range(1, 4):
        points |= np.where(sizes > step, padded[starts + step] << np.uint64(8 * step), np.uint64(0))
    return points, np.searchsorted(starts, offsets)


def shares(data: np.ndarray, offsets: np.ndarray, grams: Grams) -> np.ndarray:
    """Share of each bucket among the n-grams of its kind, a row for each text."""
    docs = len(offsets) - 1
    out = np.zeros((docs, grams.width), np.float32)
    for kind, (bucket, first, last) in enumerate(gram_blocks(data, offsets, grams)):
        begin = kind * grams.buckets
        for doc in range(docs):
            n = last[doc] - first[doc]
            if n > 0:
                counts = np.bincount(bucket[first[doc] : last[doc]], minlength=grams.buckets)
                out[doc, begin : begin + grams.buckets] = counts / n
    return out


def linear_scores(data: np.ndarray, offsets: np.ndarray, grams: Grams, weights: np.ndarray) -> np.ndarray:
    """``shares @ weights``, without building the shares: means of the weights met in a text."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    for kind, (bucket, first, last) in enumerate(gram_blocks(data, offsets, grams)):
        block = weights[kind * grams.buckets : (kind + 1) * grams.buckets]
        n = np.maximum(last - first, 1)
        for column in range(weights.shape[1]):
            out[:, column] += between(block[:, column][bucket], first, last) / n
    return out


def sample_features(rows: DataFrame, grams: Grams, label_kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids as text, labels and shares of a bounded sample with columns ``_key``, ``_label``, ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_chunks(lowered(batch.column(2)), 1 << 20):
                found = (shares(data, offsets, grams) * 1024).astype(np.float16)
                packed = pa.array([row.tobytes() for row in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), packed],
                    ["_key", "_label", "_row"],
                )

    table = rows.select("_key", "_label", "_text").mapInArrow(run, f"_key string, _label {label_kind}, _row binary")
    table = table.toArrow().sort_by("_key")
    packed = b"".join(table.column("_row").to_pylist())
    found = np.frombuffer(packed, np.float16).reshape(-1, grams.width).astype(np.float32) / 1024
    return np.array(table.column("_key").to_pylist()), np.array(table.column("_label").to_pylist()), found


def bounded_sample(rows: DataFrame, by: str, most: int, seed: int, total: int = SAMPLE_ROWS) -> DataFrame:
    """About ``most`` rows at most of each value of ``by``, and ``total`` in all, chosen by a hash of ``_key``.

    ``rows`` should be narrow. Counts give each value its rate, the hash decides,
    so no rows are sorted and the bound holds whatever the size of the table. The
    number of values is small (labels, languages). Rates leave a margin: three
    standard deviations above the bound are possible, no more.
    """
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    most = min(most, max(total // max(len(counts), 1), 1))
    rate = F.lit(0.0)
    for value, count in counts.items():
        if value is not None:
            rate = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, most / count))).otherwise(rate)
    return rows.where(hash_share(F.col("_key"), seed) < rate)


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _minimise(rows: np.ndarray, signs: np.ndarray, weigh: np.ndarray, l2: float, slope, bend: float, steps: int) -> np.ndarray:
    """Accelerated gradient descent on a smooth margin loss; the last weight is the intercept."""
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    share = (weigh / weigh.sum()).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest curvature
        v = x.T @ (share * (x @ v))
        size = np.linalg.norm(v)
        v /= size
    rate = 1.0 / (bend * size + l2)
    w = ahead = np.zeros(x.shape[1], np.float32)
    momentum = 1.0
    for _ in range(steps):
        pull = x.T @ (share * signs * slope(signs * (x @ ahead))) + l2 * np.r_[ahead[:-1], 0].astype(np.float32)
        new = ahead - np.float32(rate) * pull
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + np.float32((momentum - 1) / later) * (new - w)
        w, momentum = new, later
    return w.astype(np.float64)


def _balanced(signs: np.ndarray) -> np.ndarray:
    positive = signs > 0
    n = max(positive.sum(), 1), max((~positive).sum(), 1)
    return np.where(positive, 0.5 / n[0], 0.5 / n[1])


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = (1 / np.sqrt(rows.mean(0) + 1e-5)).astype(np.float32)
    return rows * scale, scale


def fit_logistic(rows: np.ndarray, positive: np.ndarray, l2: float = 1e-4, steps: int = 250, balance: bool = True) -> np.ndarray:
    """Weights (intercept last) of an L2-penalised logistic regression on shares."""
    signs = np.where(positive, 1, -1).astype(np.float32)
    scaled, scale = _scaled(rows)
    weigh = _balanced(signs) if balance else np.ones(len(rows))
    w = _minimise(scaled, signs, weigh, l2, lambda m: -1 / (1 + np.exp(np.clip(m, -30, 30))), 0.25, steps)
    return np.r_[w[:-1] * scale, w[-1]]


def fit_svm(rows: np.ndarray, positive: np.ndarray, l2: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Weights (intercept last) of a linear support vector machine with squared hinge loss."""
    signs = np.where(positive, 1, -1).astype(np.float32)
    scaled, scale = _scaled(rows)
    w = _minimise(scaled, signs, _balanced(signs), l2, lambda m: -2 * np.maximum(1 - m, 0), 2.0, steps)
    return np.r_[w[:-1] * scale, w[-1]]


def fit_sigmoid(scores: np.ndarray, positive: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Platt), fitted by Newton steps."""
    hits, total = positive.sum(), len(positive)
    goal = np.where(positive, (hits + 1) / (hits + 2), 1 / (total - hits + 2))
    middle, spread = scores.mean(), scores.std() + 1e-9
    z = np.stack([(scores - middle) / spread, np.ones(total)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(curve, z.T @ (p - goal) + 1e-3 * w)
    return w[0] / spread, w[1] - w[0] * middle / spread


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def keyed(df: DataFrame, id_col: str, **wanted: str) -> DataFrame:
    """Columns under private names, with ``_id`` and its text ``_key``."""
    return narrow(df, _id=id_col, **wanted).withColumn("_key", F.coalesce(F.col("_id").cast("string"), F.lit("")))
