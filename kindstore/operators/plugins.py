"""Pluggable batch functions (scorer, encoder) and their defaults made of Spark aggregates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.functions.scalars import words
from kindstore.operators import lookups
from kindstore.operators.skew import is_small, lookup_join
from kindstore.operators.windows import build_vocab, predicted_places, tokenize, tokenize_with, vocabulary_tokenizer, window_losses
from kindstore.schemas import SCORES
from kindstore.session import materialize

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_texts(
    df: DataFrame, scorer: Scorer, rate: int = 25, partitions: int | None = None, interval: float = 1.0
) -> DataFrame:
    """Send ``request_id, text`` to a scorer, ``rate`` texts per interval in all.

    ``scorer`` gets a pandas frame and returns ``request_id, response, error``.
    An exception turns the batch into error rows. The rate is shared by the
    ``partitions`` (the session's parallelism if None, and never more than the
    rate), each waiting between its batches.
    """
    partitions = min(partitions or df.sparkSession.sparkContext.defaultParallelism, rate)
    share = rate // partitions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in batches:
            for start in range(0, len(frame), share):
                part = frame.iloc[start : start + share]
                if last is not None:
                    time.sleep(max(0.0, interval - (time.monotonic() - last)))
                last = time.monotonic()
                try:
                    yield scorer(part)
                except Exception as problem:  # noqa: BLE001 - every failure becomes an error row
                    yield pd.DataFrame(
                        {"request_id": part["request_id"], "response": None, "error": str(problem)}
                    )

    spread = df.select("request_id", "text").repartition(partitions, "request_id")
    return spread.mapInPandas(run, SCORES)


def lexicon(labelled: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``word, n, weight``: log-odds of a word in toxic against other labelled texts."""
    per_word = (
        labelled.select("toxic", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("toxic").cast("bigint").alias("n_toxic"))
    )
    totals = per_word.agg(
        F.struct(F.sum("n").alias("n"), F.sum("n_toxic").alias("toxic"), F.count("*").alias("v")).alias("t")
    ).scalar()
    all_n, toxic_n, size = totals["n"], totals["toxic"], totals["v"]
    in_toxic = F.ln((F.col("n_toxic") + smoothing) / (toxic_n + smoothing * size))
    in_other = F.ln((F.col("n") - F.col("n_toxic") + smoothing) / (all_n - toxic_n + smoothing * size))
    return per_word.select("word", "n", (in_toxic - in_other).alias("weight"))


def lexicon_scores(texts: DataFrame, labels: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Default scorer: logistic of the mean word weight; unseen words weigh nothing."""
    weights = materialize(lexicon(texts.join(labels.select(ident, "toxic"), ident)), "lexicon")
    counted = texts.select(ident, F.explode(words(F.col("text"))).alias("word"))
    found = lookup_join(counted, weights.select("word", "weight"), ["word"], how="left")
    mean = F.sum(F.coalesce("weight", F.lit(0.0))) / F.count("*")
    return found.groupBy(ident).agg((1 / (1 + F.exp(-mean))).alias("toxicity"))


def encode(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str = "entry_id bigint, key array<float>, token int") -> DataFrame:
    """A user's encoder over Arrow batches: pairs or texts in, vectors out."""
    return df.mapInPandas(fn, schema)


# Different bigrams of a model that is broadcast: two 64-bit numbers each.
BROADCAST_BIGRAMS = 4_000_000
_SHIFT = 32
# Marks the count of a word as the first of a pair.
_ALONE = 1 << 62
# Tokens counted together in a task, tokens whose bigrams are looked up together in a model too large to broadcast, and tokens counted in a bucket.
COUNT_TOKENS = 1 << 22
CHUNK_TOKENS = 1 << 21
BUCKET_TOKENS = 1 << 21


class BigramScorer:
    """Add-one bigram log-probabilities of word ids, from sorted arrays; unknown words have id -1."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, size: int):
        order = np.argsort(pairs)
        self.pairs, self.counts, self.size = pairs[order], counts[order], size
        self.before = np.bincount(pairs >> _SHIFT, counts, max(size, 1)).astype(np.int64) if len(pairs) else np.zeros(max(size, 1), np.int64)

    def __call__(self, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The log-probability of each word after the one before it."""
        known = (prev >= 0) & (word >= 0)
        pair = np.where(known, (prev.astype(np.int64) << _SHIFT) | word, -1)
        n, n_prev = np.zeros(len(pair)), np.where(prev >= 0, self.before[np.maximum(prev, 0)], 0)
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            n = np.where(self.pairs[place] == pair, self.counts[place], 0)
        return np.log((n + 1.0) / (n_prev + self.size))

    def of_lists(self, lists: pa.Array) -> np.ndarray:
        """Log-probabilities of all ids of a list array, one after another; NaN for the first of a list."""
        ids, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        out = np.full(len(ids), np.nan)
        if len(ids) > 1:
            out[1:] = self(ids[:-1], ids[1:])
        out[offsets[:-1][np.diff(offsets) > 0]] = np.nan
        return out


class BigramModel:
    """Counts of a corpus by word ids: ``vocab`` (word, n, token) and ``pairs`` (pair, n), both written tables.

    A pair is the id of the word before, shifted by 32 bits, and the id of the word. ``counts`` has them, and the words with another
    behind them as ids with bit 62 set.
    """

    def __init__(self, corpus: DataFrame, column: str = "text", vocab: DataFrame | None = None):
        self.vocab = materialize(build_vocab(corpus, column), "vocab") if vocab is None else vocab
        self.size = self.vocab.count()
        # One broadcast of the vocabulary serves the corpus and all texts scored later.
        self.tokenizer = vocabulary_tokenizer(self.vocab) if is_small(self.vocab.select("word", "token")) else None
        texts = corpus.select(F.monotonically_increasing_id().alias("_row"), F.col(column).alias("text"))
        self.counts = materialize(_counts(self.tokenize(texts, "_row"), self.vocab), "bigrams")
        self.pairs = self.counts.where(F.col("pair") < _ALONE)

    def tokenize(self, texts: DataFrame, ident: str = "doc_id") -> DataFrame:
        """``ident, input_ids`` of texts by the model's vocabulary."""
        if self.tokenizer is None:
            return tokenize(texts, self.vocab, ident)
        return tokenize_with(texts, self.tokenizer, ident)

    def is_small(self) -> bool:
        return self.tokenizer is not None and self.pairs.count() <= BROADCAST_BIGRAMS

    def scorer(self):
        """Makes the ``BigramScorer`` in a task, for models small enough: only arrays are broadcast, as workers may not have this package."""
        table = self.pairs.toArrow()
        arrays = (np.asarray(table.column(c)).astype(np.int64) for c in ("pair", "n"))
        shared = self.pairs.sparkSession.sparkContext.broadcast((*arrays, self.size))
        return lambda: BigramScorer(*shared.value)

    def over_windows(self):
        """The model as ``windows.window_losses`` takes it."""
        if not self.is_small():
            raise ValueError("the model is too large to broadcast")
        scorer = self.scorer()
        return lambda: scorer().of_lists

    def window_losses(self, spans: DataFrame) -> DataFrame:
        """``windows.window_losses`` by this model: broadcast if it is small enough, else looked up by chunks of windows."""
        if self.is_small():
            return window_losses(spans, self.over_windows())
        begin, n = predicted_places(spans)
        # The predicted tokens and the one before them. A window without a predicted token has a row too.
        seen = F.slice("input_ids", begin, F.when(n > 0, n + 1).otherwise(0))
        losses = self._scored(spans.select(F.struct("batch_id", "window_idx").alias("_key"), seen.alias("input_ids")), "nll double, n bigint, n_scored bigint")
        losses = losses.select("_key.*", F.coalesce("nll", F.lit(0.0)).alias("nll"), "n_scored")
        return losses.groupBy("batch_id", "window_idx").agg(F.sum("nll").alias("nll"), F.sum("n_scored").alias("n_scored"))

    def _scored(self, lists: DataFrame, out: str) -> DataFrame:
        """``_key`` and sums or ``input_ids, logp`` of lists of ids (``_key, input_ids``), for a model of any size.

        The lists are written and dealt over chunks of about ``CHUNK_TOKENS`` tokens by their place, once. A chunk looks up each of its different
        bigrams and words once (``lookups``), then each list is scored where it lies. Runs a job that counts tokens.
        """
        spot = F.monotonically_increasing_id().alias("_spot")
        written = materialize(lists.select("_key", "input_ids", spot), "lists")
        tokens = written.agg(F.coalesce(F.sum(F.size("input_ids").cast("bigint")), F.lit(0))).first()[0]
        chunks = max(1, -(-tokens // CHUNK_TOKENS))
        buckets = max(1, -(-self.counts.count() // lookups.BUCKET_ROWS))
        tasks = max(lists.sparkSession.sparkContext.defaultParallelism, chunks)
        chunk = F.pmod(F.xxhash64("_spot"), F.lit(chunks)).cast("int")
        dealt = written.select("_key", "input_ids", chunk.alias("_chunk")).repartition(tasks, "_chunk")
        kind, size = lookups.Numbers, self.size

        def ask(key: tuple, rows: pa.Table) -> pa.Table:
            pairs, before, _ = _pairs_of(rows.column("input_ids").combine_chunks())
            return lookups.asked_rows(key[0].as_py(), np.unique(np.concatenate([pairs[pairs >= 0], before[before >= 0]])), kind, buckets)

        def run(rows: pa.Table, found: pa.Table) -> pa.Table:
            lists = rows.column("input_ids").combine_chunks()
            pairs, before, inside = _pairs_of(lists)
            keys = np.unique(np.concatenate([pairs[pairs >= 0], before[before >= 0]]))
            # Words and pairs that were not asked for are unknown: they have no count.
            counts = np.append(lookups.answers(found, keys, kind, buckets), 0)
            n, n_prev = (counts[np.where(x >= 0, np.searchsorted(keys, x), len(keys))] for x in (pairs, before))
            logp = np.full(len(inside), np.nan)
            logp[inside] = np.log((n + 1.0) / (n_prev + size))
            if "logp" in out:
                scores = pa.ListArray.from_arrays(_offsets(lists), pa.array(logp, mask=np.isnan(logp)))
                return pa.table([rows.column("_key"), lists, scores], names=["_key", "input_ids", "logp"])
            return pa.table([rows.column("_key"), *_sums(lists, logp)], names=["_key", "nll", "n", "n_scored"])

        asked = dealt.groupBy("_chunk").applyInArrow(ask, lookups.ASKED)
        found = lookups.look_up(asked, lookups.pack_table(self.counts, kind, buckets), kind, buckets, 0)
        return dealt.groupBy("_chunk").cogroup(found.groupBy("_of")).applyInArrow(run, f"_key {written.schema['_key'].dataType.simpleString()}, {out}")


def _offsets(lists: pa.Array) -> pa.Array:
    return pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32())


def _pairs_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id of lists that has one before it, the pair and the marked id before, -1 if unknown; and which ids these are."""
    ids, offsets = np.asarray(lists.flatten()).astype(np.int64), np.asarray(_offsets(lists))
    inside = np.ones(len(ids), bool)
    inside[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inside)
    prev, word = ids[at - 1], ids[at]
    pairs = np.where((prev >= 0) & (word >= 0), prev << _SHIFT | word, -1)
    return pairs, np.where(prev >= 0, prev | _ALONE, -1), inside


def _sums(lists: pa.Array, logp: np.ndarray) -> list[pa.Array]:
    """Loss (NULL without a scored token), tokens and scored tokens of each list."""
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    row, scored = np.repeat(np.arange(len(n)), n), ~np.isnan(logp)
    # Numpy gives whole numbers where there is nothing to add.
    nll, count = np.bincount(row[scored], -logp[scored], len(n)).astype(float), np.bincount(row[scored], minlength=len(n))
    return [pa.array(nll, mask=count == 0), pa.array(n), pa.array(count)]


def _counts(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``pair, n`` of lists of ids: each pair, and each word with one behind it.

    Counted in each task first, then by buckets that pairs are packed for, so a pair moves as a few bytes once a few million tokens.
    """
    buckets = max(1, -(-(vocab.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            order, parts = lookups.by_bucket(lookups.Numbers.bucket(pairs, buckets))
            rows = [(b, lookups.Numbers.pack(pairs[order[p]]), lookups.packed(n[order[p]])) for b, p in parts]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            columns = [*zip(*rows, strict=True)] or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_bucket", "_keys", "_values"])

        for batch in batches:
            pairs, before, _ = _pairs_of(batch.column(0))
            held += [pairs[pairs >= 0], before[pairs >= 0]]
            size += len(pairs)
            if size >= COUNT_TOKENS:
                yield packed()
                size = 0
        if held:
            yield packed()

    def add(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([lookups.Numbers.unpack(x) for x in rows.column("_keys").to_pylist()])
        n = np.concatenate([lookups.unpacked(x) for x in rows.column("_values").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return pa.table([pa.array(keys[heads]), pa.array(np.add.reduceat(n, heads))], names=["pair", "n"])

    partial = tokens.select("input_ids").mapInArrow(count, lookups.TABLE)
    return partial.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(add, "pair bigint, n bigint")


def _scored_tokens(texts: DataFrame, model: BigramModel, keys: list[str]) -> DataFrame:
    """``keys, pos, token, logp`` for models of any size; the first token of a text has no ``logp``."""
    tokens = _keyed(texts, model, keys)
    if model.is_small():
        scorer, kind = model.scorer(), tokens.schema["_key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = scorer()
            for batch in batches:
                lists = batch.column("input_ids")
                logp = score.of_lists(lists)
                scores = pa.ListArray.from_arrays(_offsets(lists), pa.array(logp, mask=np.isnan(logp)))
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=["_key", "input_ids", "logp"])

        scored = tokens.mapInArrow(run, f"_key {kind}, input_ids array<int>, logp array<double>")
    else:
        scored = model._scored(tokens, "input_ids array<int>, logp array<double>")
    placed = scored.select("_key", F.posexplode(F.arrays_zip("input_ids", "logp")).alias("pos", "_t"))
    return placed.select("_key.*", "pos", F.col("_t.input_ids").alias("token"), F.col("_t.logp").alias("logp"))


def _keyed(texts: DataFrame, model: BigramModel, keys: list[str]) -> DataFrame:
    """``_key, input_ids``: texts are told apart by their keys; NULL keys too."""
    return model.tokenize(texts.select(F.struct(*keys).alias("_key"), "text"), "_key").select("_key", "input_ids")


def text_losses(texts: DataFrame, corpus: DataFrame | BigramModel, keys: list[str]) -> DataFrame:
    """``keys, nll, n, n_scored``: loss, tokens and scored tokens of each text under the bigram model of a corpus.

    ``texts`` has ``keys`` and ``text``. A model small enough is broadcast and texts are
    scored where they lie; of a larger one, the different bigrams of a chunk of texts are looked up.
    """
    model = corpus if isinstance(corpus, BigramModel) else BigramModel(corpus)
    if not model.is_small():
        losses = model._scored(_keyed(texts, model, keys), "nll double, n bigint, n_scored bigint").select("_key.*", "nll", "n", "n_scored")
        # Texts that share their keys are one.
        return losses.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("nll", "n", "n_scored")])
    scorer, make = model.scorer(), model.tokenizer
    rows = texts.where(F.col("text").isNotNull()).select(*keys, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, score = make(), scorer()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = encode(batch.column("text"))
            columns = _sums(lists, score.of_lists(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keys, "nll", "n", "n_scored"])

    return rows.mapInArrow(run, f"{kinds}, nll double, n bigint, n_scored bigint")


def ngram_logprobs(texts: DataFrame, corpus: DataFrame | BigramModel, keys: list[str]) -> DataFrame:
    """Default language model: add-one bigram log-probability of every token: ``keys, pos, token, logp``.

    ``texts`` has ``keys`` and ``text``; words are ids of the corpus' vocabulary, -1 if it has none. The
    first token of a text has a NULL ``logp``. ``text_losses`` gives their sums without a row a token.
    """
    model = corpus if isinstance(corpus, BigramModel) else BigramModel(corpus)
    return _scored_tokens(texts, model, keys)
