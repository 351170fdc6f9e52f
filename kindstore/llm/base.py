"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space in every contract: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
# Bytes of text handled at a time inside a task: bounds the arrays below whatever the batch size.
CHUNK_BYTES = 1 << 21


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns named by position, so that no name clashes."""
    return df.toDF(*[f"_column{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns under private names: ``narrow(df, _id="doc_id")``.

    Columns are found by position, the exact spelling first, so further columns
    with the same name in another case, dots or repeated names do no harm.
    """
    names = df.columns
    plain = numbered(df)

    def place(name: str) -> int:
        for found in (names, [n.lower() for n in names]):
            if name in found:
                return found.index(name)
        raise ValueError(f"there is no column {name!r} among {names}")

    return plain.select(*[F.col(f"_column{place(name)}").alias(new) for new, name in wanted.items()])


def keep_where(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df``, all columns, whose key is in ``wanted`` (null keys match null)."""
    names = df.columns
    plain = numbered(df)
    left = F.col(f"_column{names.index(key)}")
    right = wanted.select(F.col(wanted_key).alias("_wanted"))
    return plain.join(right, left.eqNullSafe(F.col("_wanted")), "left_semi").toDF(*names)


def id_checksum(ident: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))


def large_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Text as one Arrow array without nulls (null becomes empty) and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of whole texts of about ``limit`` bytes.

    Yields first row, end row, the UTF-8 bytes of the run and the offsets of its
    texts in them (one more than texts).
    """
    column = large_strings(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        begin = offsets[first]
        yield first, end, data[begin : offsets[end]], offsets[first : end + 1] - begin
        first = end


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more than texts)."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    if len(data):
        before[1:] = ~solid[:-1] | edge[1:-1]
        after[:-1] = ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(solid & before)
    return starts, np.flatnonzero(solid & after) + 1, np.searchsorted(starts, offsets)


_RANDOM = np.random.default_rng(20240607)
BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_CODES = BYTE_CODES.copy()  # A-Z counts as a-z
FOLDED_CODES[65:91] = BYTE_CODES[97:123]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    have = POWERS.get(base)
    if have is None or len(have) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = POWERS[base] = np.cumprod(steps)
    return have[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit values over all their bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values = values * np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values, wherever it stands: one running sum over all values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(BASE, len(values)), out=sums[1:])
    at_start = _powers(BASE_INVERSE, len(values) + 1)[starts]
    return mixed((sums[ends] - sums[starts]) * at_start + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    return run_hashes(codes[data], starts, ends)


def between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of ``values[first:last]``, for many ranges at once."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    sums = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=sums[1:], dtype=kind)
    return sums[last] - sums[first]


def utf8_starts(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (data & 0xC0) != 0x80
