"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import FOLDED_CODES, id_checksum, narrow, span_hashes, text_chunks, word_spans
from kindstore.llm.linear import lowered, sigmoid
from kindstore.llm.quality import labelled_rows
from kindstore.session import materialize

ROWS_PER_CLASS = 4000
SEED = 7
LEAST_COUNT = 4
PRIOR_EACH = 0.5  # Dirichlet prior of every token, and ...
PRIOR_TOTAL = 500.0  # ... what is spread over the tokens by their frequency
DOUBT = 2.0  # standard errors taken off a log-odds
DRIFT = 0.5  # taken off every token, so that plain text scores below zero
SIGNIFICANT = 0.05
EULER = 0.5772156649015329
# Punctuation (ASCII, neither letter, digit nor white space) is stripped from tokens.
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def held_out(ident: Column) -> Column:
    """Rows whose label must not be learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(id_checksum(ident), F.lit(5)) == 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, all punctuation at its ends stripped, and the first word of each text."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    # The first and last byte of a word that is no punctuation; without one, its first mark stands for it.
    plain = np.append(np.flatnonzero(~MARK[data]), len(data))
    begin = plain[np.searchsorted(plain, starts)]
    end = plain[np.searchsorted(plain, ends) - 1] + 1
    marks = begin >= ends
    begin, end = np.where(marks, starts, begin), np.where(marks, starts + 1, end)
    return span_hashes(data, begin, end, FOLDED_CODES), first


def maximal_segments(first: np.ndarray, last: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple]:
    """All maximal scoring segments of a text (Ruzzo and Tompa), in linear time.

    Given are the positive tokens in order: their places and the running score
    before and after each. Returns (first place, last place, score), disjoint.
    """
    done: list[list] = []  # first, last, running score before, after, nearest earlier one that starts lower
    for f, e, low, high in zip(first.tolist(), last.tolist(), before.tolist(), after.tolist(), strict=True):
        one = [f, e, low, high]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= one[2]:
                j = done[j][4]
            if j < 0 or done[j][3] >= one[3]:
                done.append([*one, j])
                break
            one = [done[j][0], one[1], done[j][2], one[3]]
            del done[j:]
    return [(f, e, high - low) for f, e, low, high, _ in done]


@dataclass
class ToxicityModel:
    """Token scores and the constants of the extreme-value distribution of segment scores."""

    hashes: np.ndarray  # sorted; all other tokens score -DRIFT
    scores: np.ndarray
    rate: float = 1.0
    scale: float = 1.0  # K
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def passages(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
        """Number of tokens and the maximal segments of each text."""
        found, first = tokens(data, offsets)
        value = np.full(len(found), -DRIFT)
        if len(self.hashes) and len(found):
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            known = self.hashes[place] == found
            value[known] = self.scores[place[known]]
        total = np.concatenate([[0.0], np.cumsum(value)])
        good = np.flatnonzero(value > 0)
        edges = np.searchsorted(good, first)
        out = []
        for doc, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            at = good[a:b]
            out.append(maximal_segments(at - first[doc], at - first[doc] + 1, total[at], total[at + 1]) if b > a else [])
        return np.diff(first), out

    def evidence(self, words: np.ndarray, segments: list[list[tuple]]) -> np.ndarray:
        """For each text: best normalised score, and what significant segments add up to above chance."""
        chance = np.log(self.scale * np.maximum(words, 1))
        out = np.zeros((len(words), 2))
        for doc, found in enumerate(segments):
            bits = [self.rate * score - chance[doc] for _, _, score in found]
            out[doc, 0] = max(bits, default=-chance[doc])
            out[doc, 1] = np.log1p(sum(max(b - np.log(SIGNIFICANT), 0) for b in bits))
        out[:, 0] = np.clip(out[:, 0], -15, 15)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(evidence @ self.weights[:2] + self.weights[2])


def _token_scores(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds with Dirichlet priors, less their doubt and the drift; only of tokens that differ."""
    toxic, clean = (np.asarray(counts.column(c), np.float64) for c in ("toxic", "clean"))
    n_toxic, n_clean = (max(float(np.asarray(counts.column(c))[0]), 1.0) for c in ("all_toxic", "all_clean"))
    share = (toxic + clean) / (n_toxic + n_clean)
    prior = PRIOR_EACH + PRIOR_TOTAL * share
    # A class of fewer tokens is weighed up to the other, so that only rates count.
    odds = np.log((toxic + prior) / (n_toxic + PRIOR_TOTAL)) - np.log((clean + prior) / (n_clean + PRIOR_TOTAL))
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * error, 0)
    keep = np.abs(sure) > 0.05
    hashes = np.asarray(counts.column("token")).view(np.uint64)[keep]
    order = np.argsort(hashes)
    return hashes[order], (sure[keep] - DRIFT)[order]


def _rate(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of the moment equation: sum of share * exp(rate * value) = 1."""
    if not (values > 0).any() or (values * share).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (share * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * values)).sum() < 1 else (low, middle)
    return (low + high) / 2


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
    seed: int = SEED,
    least_count: int = LEAST_COUNT,
) -> ToxicityModel | None:
    """Fit on a bounded sample of labelled rows, about ``rows_per_class`` of each class.

    Held-out rows (see ``held_out``) are not learned from. Numbers of documents with a
    token, equal texts once, are summed in Spark; the driver gets the tokens of the sample that occur in ``least_count``
    documents (rarer ones score like unseen ones), and two numbers a document for the calibration, which weighs the classes
    as they occur among all labels but the held-out. None without rows of both classes.
    """
    sample = labelled_rows(
        docs, labels, label_col, rows_per_class, seed, id_col, text_col, where=lambda ident: ~held_out(ident)
    )
    sample = sample.dropDuplicates(["_text", "_label"])
    sample = materialize(sample.withColumn("_label", (F.col("_label") > 0).cast("int")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(0))
            for begin, end, data, offsets in text_chunks(lowered(batch.column(1))):
                found, first = tokens(data, offsets)
                row = np.repeat(np.arange(end - begin), np.diff(first))
                order = np.lexsort((found, row))  # a token counts once in a document
                found, row = found[order], row[order]
                once = np.r_[True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])] if len(found) else row.astype(bool)
                found, of = found[once], label[begin:end][row[once]]
                for kind in (0, 1):
                    token, n = np.unique(found[of == kind], return_counts=True)
                    columns = [pa.array(token.view(np.int64)), pa.array(np.full(len(n), kind, np.int32)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "label", "n"])

    counts = sample.select("_label", "_text").mapInArrow(count, "token bigint, label int, n bigint")
    counts = counts.groupBy("token").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    counts = materialize(counts, "toxicity-tokens")
    totals = counts.agg(F.sum("toxic").alias("all_toxic"), F.sum("clean").alias("all_clean"))
    frequent = counts.where(F.col("toxic") + F.col("clean") >= least_count).join(F.broadcast(totals)).toArrow()
    if not len(frequent):
        return None
    model = ToxicityModel(*_token_scores(frequent))
    known = np.asarray(frequent.column("token")).view(np.uint64)
    share = np.zeros(len(model.hashes))
    order = np.argsort(known)
    clean = np.asarray(frequent.column("clean"), np.float64)
    share = clean[order][np.searchsorted(known[order], model.hashes)] / max(float(frequent.column("all_clean")[0].as_py()), 1)
    model.rate = _rate(np.r_[model.scores, -DRIFT], np.r_[share, max(1 - share.sum(), 0)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_chunks(lowered(batch.column(1))):
                words, segments = model.passages(data, offsets)
                packed = pa.array([[s for *_, s in found] for found in segments], pa.list_(pa.float64()))
                columns = [batch.column(0).slice(begin, end - begin), pa.array(words), packed]
                yield pa.RecordBatch.from_arrays(columns, ["label", "words", "scores"])

    seen = sample.select("_label", "_text").mapInArrow(score, "label int, words bigint, scores array<double>").toArrow()
    label, words = np.asarray(seen.column("label")) > 0, np.asarray(seen.column("words"))
    if label.all() or not label.any():
        return None
    segments = [[(0, 0, s) for s in found] for found in seen.column("scores").to_pylist()]
    best = np.array([max((s for *_, s in found), default=0.0) for found in segments])
    plain = ~label & (words > 0)
    if plain.any():  # a Gumbel variable has mean ln(K n) + Euler's constant, in units of the rate
        model.scale = float(np.exp(np.mean(model.rate * best[plain] - np.log(words[plain])) - EULER))
    learned = narrow(labels, _i=id_col, _l=label_col).where(~held_out(F.col("_i")))
    whole = {r["_l"]: r["count"] for r in learned.groupBy((F.col("_l") > 0).alias("_l")).count().collect()}
    weigh = np.where(label, whole.get(True, 1) / label.sum(), whole.get(False, 1) / (~label).sum())
    model.weights = _calibrate(model.evidence(words, segments), label, weigh)
    return model


def _calibrate(evidence: np.ndarray, label: np.ndarray, weigh: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Weighted logistic regression on the two pieces of evidence, by Newton steps."""
    x = np.c_[evidence, np.ones(len(evidence))]
    weigh = weigh / weigh.mean()
    w = np.zeros(3)
    for _ in range(steps):
        p = sigmoid(x @ w)
        curve = (x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.linalg.solve(curve, x.T @ (weigh * (p - label)) + 1e-2 * w)
    return tuple(float(v) for v in w)


def score_toxicity(df: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxic passages and toxicity of every whole text, in Arrow batches and without a shuffle.

    Returns one row per input row: ``id_col``, ``n_tokens``, ``passages`` (array of
    ``first`` and ``last`` word, last exclusive, ``score`` and ``expected``, the
    number of segments as good that plain text of this length has by chance; all
    with less than 0.05) and ``score`` (probability of being labelled toxic).

    Defined cases: null and empty texts have no passages and the score of no
    evidence; without a model every score is 0; null ids and repeated rows are
    scored each; further columns are ignored; no rows give none.
    """
    rows = narrow(df, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model or ToxicityModel(np.zeros(0, np.uint64), np.zeros(0))
        for batch in batches:
            for begin, end, data, offsets in text_chunks(lowered(batch.column(1))):
                words, segments = use.passages(data, offsets)
                chance = use.probability(use.evidence(words, segments)) if model else np.zeros(len(words))
                listed = [
                    [
                        {"first": f, "last": e, "score": s, "expected": expected}
                        for f, e, s in found
                        if (expected := float(use.scale * n * np.exp(-use.rate * s))) < SIGNIFICANT
                    ]
                    for n, found in zip(words.tolist(), segments, strict=True)
                ]
                columns = [batch.column(0).slice(begin, end - begin), pa.array(words), pa.array(listed, pa.list_(passage))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chance)], ["_id", "n_tokens", "passages", "score"])

    kinds = "array<struct<first: bigint, last: bigint, score: double, expected: double>>"
    out = rows.mapInArrow(run, f"_id {kind}, n_tokens bigint, passages {kinds}, score double")
    return out.withColumnRenamed("_id", id_col)
