"""Lookups of the different words or numbers of chunks of rows in tables too large to broadcast.

A chunk asks for each of its keys once. What it asks and what it gets travels in packed rows, one for each chunk and bucket
of keys: ``_bucket, _of, _keys`` there, and ``_of, _bucket, _values`` back, values in the order of the keys.
Table: ``_bucket, _keys, _values``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

ASKED = "_bucket int, _of int, _keys binary"
FOUND = "_of int, _bucket int, _values binary"
TABLE = "_bucket int, _keys binary, _values binary"
# Rows of a table that are packed together, and those of a bucket.
PACKED_ROWS = 1 << 20
BUCKET_ROWS = 1 << 19
_HASH = np.uint64(0x9E3779B97F4A7C15)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, equal bytes of all of them side by side; small and like ones take least."""
    planes = np.ascontiguousarray(np.asarray(numbers, "<i8")).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<i8").ravel()


class Numbers:
    """Keys that are 64-bit numbers: rising, so their gaps are packed."""

    @staticmethod
    def bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> np.uint64(33)).astype(np.int64) % buckets

    @staticmethod
    def pack(keys: np.ndarray) -> bytes:
        return packed(np.diff(keys, prepend=0))

    @staticmethod
    def unpack(data: bytes) -> np.ndarray:
        return np.cumsum(unpacked(data))

    @staticmethod
    def matcher(keys: list[np.ndarray], values: list[np.ndarray], unknown: int) -> Callable[[np.ndarray], np.ndarray]:
        if not keys:
            return lambda asked: np.full(len(asked), unknown)
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]

        def match(asked: np.ndarray) -> np.ndarray:
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return np.where(keys[place] == asked, values[place], unknown)

        return match


class Words:
    """Keys that are words without blanks."""

    @staticmethod
    def bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
        return (pd.util.hash_array(keys, categorize=False) % np.uint64(buckets)).astype(np.int64)

    @staticmethod
    def pack(keys: np.ndarray) -> bytes:
        return pa.compress((joined := " ".join(keys).encode()), codec="zstd", asbytes=True) + len(joined).to_bytes(8, "little")

    @staticmethod
    def unpack(data: bytes) -> np.ndarray:
        joined = pa.decompress(data[:-8], decompressed_size=int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True)
        return np.array(joined.decode().split(" "), object)

    @staticmethod
    def matcher(keys: list[np.ndarray], values: list[np.ndarray], unknown: int) -> Callable[[np.ndarray], np.ndarray]:
        known = {k: v for some, of in zip(keys, values, strict=True) for k, v in zip(some.tolist(), of.tolist(), strict=True)}
        return lambda asked: np.fromiter((known.get(k, unknown) for k in asked.tolist()), np.int64, len(asked))


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
    """The order of rows by bucket, else as they come, and the slice of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    numbers, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(bucket))[: len(starts)]
    return order, ((int(b), slice(s, e)) for b, s, e in zip(numbers, starts.tolist(), ends.tolist(), strict=True))


def asked_rows(of: int, keys: np.ndarray, kind, buckets: int) -> pa.Table:
    """What a chunk asks for: different keys, in rising order."""
    order, parts = by_bucket(kind.bucket(keys, buckets))
    rows = [(b, of, kind.pack(keys[order[part]])) for b, part in parts]
    columns = [*zip(*rows, strict=True)] or [(), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_bucket", "_of", "_keys"])


def answers(found: pa.Table, keys: np.ndarray, kind, buckets: int) -> np.ndarray:
    """The value of each key that a chunk has asked for."""
    order, parts = by_bucket(kind.bucket(keys, buckets))
    given = dict(zip(found.column("_bucket").to_pylist(), found.column("_values").to_pylist(), strict=True))
    out = np.empty(len(keys), np.int64)
    for b, part in parts:
        out[order[part]] = unpacked(given[b])
    return out


def pack_table(table: DataFrame, kind, buckets: int) -> DataFrame:
    """Two columns, keys (different, not null) and numbers, as a packed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pack() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            keys, values = (c.to_numpy(zero_copy_only=False) for c in (rows.column(i).combine_chunks() for i in (0, 1)))
            rise = np.argsort(keys) if keys.dtype != object else np.arange(len(keys))
            keys, values = keys[rise], values[rise]
            order, parts = by_bucket(kind.bucket(keys, buckets))
            out = [(b, kind.pack(keys[order[part]]), packed(values[order[part]])) for b, part in parts]
            held.clear()
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["_bucket", "_keys", "_values"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED_ROWS:
                yield pack()
        if held:
            yield pack()

    return table.mapInArrow(run, TABLE)


def look_up(asked: DataFrame, table: DataFrame, kind, buckets: int, unknown: int) -> DataFrame:
    """``_of, _bucket, _values``: the number of each key that chunks ask for, ``unknown`` if the table has none."""
    table = table.withColumnRenamed("_bucket", "_in").repartition(buckets, "_in")

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        match = kind.matcher(
            [kind.unpack(x) for x in table.column("_keys").to_pylist()], [unpacked(x) for x in table.column("_values").to_pylist()], unknown
        )
        values = [packed(match(kind.unpack(x))) for x in asked.column("_keys").to_pylist()]
        return pa.table([asked.column("_of"), asked.column("_bucket"), pa.array(values, pa.binary())], names=["_of", "_bucket", "_values"])

    return asked.repartition(buckets, "_bucket").groupBy("_bucket").cogroup(table.groupBy("_in")).applyInArrow(run, FOUND)
