"""Quality rules: counts of every text, and a calibrated logistic regression over hashed n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import between, mixed, narrow, span_hashes, text_chunks, utf8_starts, word_spans
from kindstore.llm.linear import (
    Grams,
    bounded_sample,
    fit_logistic,
    fit_sigmoid,
    keyed,
    linear_scores,
    lowered,
    sample_features,
    sigmoid,
)

# Fixed values of the base rules.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

GRAMS = Grams(bytes=(), chars=(1, 2, 3), words=(1, 2), buckets=1024)
ROWS_PER_CLASS = 2000
THRESHOLD = 0.5
SEED = 1
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The counts of ``STATS`` for each text, a column each.

    Lines and words that agree in a hash are compared by their bytes, windows by their words.
    """
    starts, ends, first = word_spans(data, offsets)
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    lengths = between(utf8_starts(data), starts, ends)
    chars = between(lengths, first[:-1], first[1:])
    symbols = between(SYMBOLS[data], offsets[:-1], offsets[1:])

    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_start = line_start[data[line_start] != 10]  # others are empty
    line_doc = np.searchsorted(offsets[1:], line_start, side="right")
    stops = np.union1d(breaks, offsets[1:])
    line_end = stops[np.searchsorted(stops, line_start, side="right")] if len(line_start) else line_start
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    lines = line_doc[first_equal(data, line_start, line_end, line_doc) != np.arange(len(line_doc))]
    lines = np.bincount(lines, minlength=docs)

    # Words by number: equal numbers are equal words.
    words = first_equal(data, starts, ends, np.zeros(len(starts), np.int64))
    repeated = np.zeros(docs, np.int64)
    if len(words) >= WINDOW:
        place = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
        rows = np.stack([words[place + step] for step in range(WINDOW)])
        key = doc[place].astype(np.uint64)
        for row in rows:
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + row.astype(np.uint64))
        _, once, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        head, twice = once[back], count[back] > 1
        if not ((rows == rows[:, head]).all() and (doc[place] == doc[place[head]]).all()):  # two windows under one hash
            own = list(zip(doc[place].tolist(), *rows.tolist(), strict=True))
            often = Counter(own)
            twice = np.array([often[window] > 1 for window in own])
        cover = np.zeros(len(words) + 1, np.int64)
        found = place[twice]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + WINDOW, -1)
        repeated = between(np.cumsum(cover)[:-1] > 0, first[:-1], first[1:])
    return np.stack([np.diff(first), chars, symbols, lines, repeated], axis=1).astype(np.int64)


def first_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each span of bytes the first span of its document that is equal to it.

    Spans are brought together by a hash, and the bytes of those that agree are compared.
    """
    key = mixed(span_hashes(data, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once, back = np.unique(key, return_index=True, return_inverse=True)
    first = once[back]
    again = np.flatnonzero(first != np.arange(len(first)))
    head, size = first[again], (ends - starts)[again]
    same = bool(((ends - starts)[head] == size).all() and (doc[head] == doc[again]).all())
    if same and len(again):
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = bool((data[np.repeat(starts[again], size) + within] == data[np.repeat(starts[head], size) + within]).all())
    if not same:  # different spans under one hash
        raw, seen = data.tobytes(), {}
        spans = zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True)
        first = np.array([seen.setdefault((d, raw[a:b]), i) for i, (d, a, b) in enumerate(spans)], np.int64)
    return first


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > MOST_REPEATED_PERCENT * stats[:, 0])


class QualityModel:
    """Logistic regression on shares of n-grams, with probabilities calibrated on rows kept apart."""

    def __init__(self, positive: np.ndarray, rows: np.ndarray, folds: np.ndarray):
        apart = folds == 0
        if len(set(positive[apart])) < 2 or len(set(positive[~apart])) < 2:
            apart = np.ones(len(rows), bool)
        fitted = ~apart if not apart.all() else apart
        weights = fit_logistic(rows[fitted], positive[fitted])
        self.weights, self.offset = weights[:-1, None], weights[-1]
        self.slope, self.shift = fit_sigmoid(rows[apart] @ weights[:-1] + self.offset, positive[apart])

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = linear_scores(data, offsets, GRAMS, self.weights)[:, 0] + self.offset
        return sigmoid(self.slope * raw + self.shift)


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int, seed: int, id_col: str = "doc_id", text_col: str = "text", where=None) -> DataFrame:
    """A bounded sample of labelled documents: ``_key``, ``_label``, ``_text``.

    The sample of label rows is bounded by ``most`` rows a class, so it is
    broadcast; the documents are not shuffled. Null labels are left out; a label
    of an absent document finds nothing; repeated label rows count each.
    """
    known = keyed(labels, id_col, _label=label_col).where("_label IS NOT NULL AND _id IS NOT NULL")
    if where is not None:
        known = known.where(where(F.col("_id")))
    chosen = bounded_sample(known, "_label", most, seed).select(F.col("_id").alias("_wanted"), "_key", "_label")
    texts = narrow(docs, _id=id_col, _text=text_col)
    return texts.join(F.broadcast(chosen), F.col("_id") == F.col("_wanted")).select("_key", "_label", "_text")


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows_per_class: int = ROWS_PER_CLASS,
    seed: int = SEED,
) -> QualityModel | None:
    """Fit on a bounded sample of labelled rows, about ``rows_per_class`` of each class.

    None if labels do not name documents of both classes.
    """
    sample = labelled_rows(docs, labels, label_col, rows_per_class, seed, id_col, text_col)
    keys, label, rows = sample_features(sample, GRAMS, "int")
    if len(set(label.tolist())) < 2:
        return None
    return QualityModel(label > 0, rows, np.arange(len(keys)) % 4)


def quality_rules(
    df: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Counts, base rules and model verdict of every whole text, without a shuffle.

    Returns one row per input row: ``id_col``, the counts of ``STATS``,
    ``base_failed`` (fewer than 20 words, or more than 30 % of the words in
    repeated 8-word windows), ``probability`` (calibrated, of good quality) and
    ``kept`` (base rules passed and probability at or above the fixed threshold).

    Defined cases: null and empty texts have no words and fail; without a model the
    base rules decide and the probability is null; null ids and repeated rows are
    judged each; further columns are ignored; no rows give none. Memory in a task is
    bounded by chunks of whole texts, a very long text being a chunk of its own.
    """
    rows = narrow(df, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", *STATS, "base_failed", "probability", "kept"]
    counts = ", ".join(f"{name} bigint" for name in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = lowered(batch.column(1)) if model is not None else None
            for begin, end, data, offsets in text_chunks(batch.column(1)):
                stats = text_stats(data, offsets)
                failed = base_failed(stats)
                chance, kept = np.full(len(failed), np.nan), ~failed
                if small is not None:
                    chance = np.concatenate(
                        [model.probability(d, o) for _, _, d, o in text_chunks(small.slice(begin, end - begin))]
                    )
                    kept = kept & (chance >= threshold)
                columns = [pa.array(c) for c in stats.T]
                chance = pa.array(chance, mask=np.isnan(chance))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), *columns, pa.array(failed), chance, pa.array(kept)], names
                )

    out = rows.mapInArrow(run, f"_id {kind}, {counts}, base_failed boolean, probability double, kept boolean")
    return out.withColumnRenamed("_id", id_col)
