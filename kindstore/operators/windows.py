"""Vocabulary, token streams, windows and (context, next token) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindstore.functions.scalars import strip_whitespace, whole_div, words
from kindstore.operators import lookups
from kindstore.operators.prefix import exclusive_prefix, running_sum
from kindstore.operators.skew import SMALL_ROWS, is_small, lookup_join
from kindstore.session import materialize

MASK = -100  # Fixed value: label of a token that is not predicted.


def build_vocab(texts: DataFrame, column: str = "text") -> DataFrame:
    """``word, n, token``: ids by falling frequency, equal ones by md5 of the word.

    The rank is a sum of three offsets (frequency class, md5 bucket, place in
    the bucket), so that even the large class of words seen once is ranked by
    4096 tasks and not by one.
    """
    counts = texts.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    hashed = counts.withColumn("_md5", F.md5("word")).withColumn(
        "_bucket", F.conv(F.substring("_md5", 1, 3), 16, 10).cast("int")
    )
    sizes = hashed.groupBy("n", "_bucket").agg(F.count("*").alias("_size"))
    classes = sizes.groupBy("n").agg(F.sum("_size").alias("_size")).withColumn("_order", -F.col("n"))
    # d different frequencies need at least d (d + 1) / 2 words of text, so 10**14 words have fewer
    # than 15 million classes: narrow rows that one task can order.
    class_start = running_sum(classes, "_order", "_size", "_class_start").select("n", "_class_start")
    before = Window.partitionBy("n").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("_bucket_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .join(class_start, "n")
        .select("n", "_bucket", (F.col("_class_start") + F.col("_bucket_start")).alias("_first"))
    )
    place = F.row_number().over(Window.partitionBy("n", "_bucket").orderBy("_md5", "word"))
    return (
        hashed.withColumn("_place", place)
        .join(starts, ["n", "_bucket"])
        .select("word", "n", (F.col("_first") + F.col("_place") - 1).cast("int").alias("token"))
    )


def _to_tokens(split: DataFrame, vocab: DataFrame, keys: list[str], unknown: int) -> DataFrame:
    placed = split.select(*keys, F.posexplode("_words").alias("pos", "word"))
    found = lookup_join(placed, vocab.select("word", "token"), ["word"], how="left")
    entry = F.struct("pos", F.coalesce("token", F.lit(unknown)).alias("token"))
    return (
        found.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("_tokens"))
        .select(*keys, F.transform("_tokens", lambda t: t["token"]).alias("input_ids"))
    )


# A tokenizer is made once a task and then gets batches: Arrow strings in, Arrow lists of 32-bit ids out.
Tokenizer = Callable[[], Callable[[pa.Array], pa.Array]]


def tokenize_with(texts: DataFrame, tokenizer: Tokenizer, ident: str = "doc_id", column: str = "text") -> DataFrame:
    """``ident, input_ids`` by any tokenizer, where the texts lie; NULL texts are left out.

    ``tokenizer()`` runs once in each task and may load a model or a table; what it
    returns is called with one batch of texts after another.
    """
    rows = texts.where(F.col(column).isNotNull()).select(F.col(ident), F.col(column).alias("_text"))
    kind = rows.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        for batch in batches:
            ids = encode(batch.column(1)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[ident, "input_ids"])

    return rows.mapInArrow(run, f"{ident} {kind}, input_ids array<int>")


def vocabulary_tokenizer(vocab: DataFrame, unknown: int = -1) -> Tokenizer:
    """Words by single blanks and their ids, from a vocabulary that is broadcast (see ``skew.is_small``).

    The words of a batch are dictionary-encoded, so each different one is looked up once.
    """
    if not is_small(vocab.select("word", "token")):
        raise ValueError("the vocabulary is too large to broadcast: tokenize() joins it instead")
    return _broadcast_tokenizer(vocab, unknown)


def _broadcast_tokenizer(vocab: DataFrame, unknown: int) -> Tokenizer:
    sink = pa.BufferOutputStream()
    table = vocab.select("word", "token").toArrow()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    shared = vocab.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    return lambda: _encoder(pa.ipc.open_stream(shared.value).read_all(), unknown)


def _encoder(known: pa.Table, unknown: int) -> Callable[[pa.Array], pa.Array]:
    """Texts to lists of ids of their words, each different word of a batch looked up once."""
    tokens = dict(zip(known.column("word").to_pylist(), known.column("token").to_pylist(), strict=True))

    def encode(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        placed = lists.flatten().dictionary_encode()
        ids = np.fromiter((tokens.get(w, unknown) for w in placed.dictionary.to_pylist()), np.int32, len(placed.dictionary))
        return pa.ListArray.from_arrays(lists.offsets, pa.array(ids[np.asarray(placed.indices)], pa.int32()))

    return encode


# Characters of texts that are looked up together in a vocabulary too large to broadcast.
CHUNK_CHARS = 1 << 24


def _tokenize_by_chunks(texts: DataFrame, vocab: DataFrame, ident: str, column: str, unknown: int) -> DataFrame:
    """``ident, input_ids`` with a vocabulary of any size; NULL texts are left out.

    Texts are dealt over chunks of about ``CHUNK_CHARS`` characters, once. Only the different words of a chunk are looked up in
    the vocabulary, packed by buckets of words (``lookups``), so a word meets it once a chunk at most, however often it is used;
    a chunk's texts then get the ids of its own words. Runs a job that counts characters and words.
    """
    rows = texts.where(F.col(column).isNotNull()).select(F.col(ident), F.col(column).alias("_text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    chunks = max(1, -(-chars // CHUNK_CHARS))
    # As many words of the vocabulary in a bucket as of all chunks.
    buckets = max(1, -(-vocab.count() // lookups.BUCKET_ROWS), -(-chunks // 8))
    chunk = F.pmod(F.xxhash64(ident, "_text"), F.lit(chunks)).cast("int")
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, chunks)
    dealt = rows.withColumn("_chunk", chunk).repartition(tasks, "_chunk")

    def split(texts: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """The words of texts as lists, as places in the different ones, and these in order."""
        lists = pc.split_pattern(texts.column("_text").combine_chunks(), " ")
        placed = lists.flatten().dictionary_encode()
        return lists, placed, np.asarray(pc.sort_indices(placed.dictionary))

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        _, placed, rise = split(texts)
        return lookups.asked_rows(key[0].as_py(), placed.dictionary.to_numpy(zero_copy_only=False)[rise], lookups.Words, buckets)

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        lists, placed, rise = split(texts)
        ids = np.empty(len(rise), np.int32)
        ids[rise] = lookups.answers(found, placed.dictionary.to_numpy(zero_copy_only=False)[rise], lookups.Words, buckets)
        tokens = pa.ListArray.from_arrays(lists.offsets, pa.array(ids[np.asarray(placed.indices)], pa.int32()))
        return pa.table([texts.column(ident), tokens], names=[ident, "input_ids"])

    known = lookups.pack_table(vocab.select("word", "token").dropna(), lookups.Words, buckets)
    asked = dealt.groupBy("_chunk").applyInArrow(ask, lookups.ASKED)
    found = lookups.look_up(asked, known, lookups.Words, buckets, unknown)
    schema = T.StructType([rows.schema[ident], T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
    return dealt.groupBy("_chunk").cogroup(found.groupBy("_of")).applyInArrow(run, schema)


def tokenize(texts: DataFrame, vocab: DataFrame, ident: str = "doc_id", column: str = "text", unknown: int = -1) -> DataFrame:
    """``ident, input_ids`` with a (written) word vocabulary; unseen words get ``unknown``.

    A vocabulary small enough to broadcast is looked up where the texts lie, without a
    shuffle; with a larger one, the different words of a chunk of texts are joined.
    """
    if is_small(vocab.select("word", "token")):
        return tokenize_with(texts, _broadcast_tokenizer(vocab, unknown), ident, column)
    return _tokenize_by_chunks(texts, vocab, ident, column, unknown)


# Tokens of a row that carries neighbouring windows to one task, and the rows of a task (fewer than Spark aggregates in memory).
RUN_TOKENS = 1 << 15
TASK_RUNS = 96


def _written(tokens: DataFrame, ident: str) -> DataFrame:
    """The tokens and their numbers, written: ``_ident, input_ids, _n``."""
    count = F.size("input_ids").cast("bigint").alias("_n")
    return materialize(tokens.select(F.col(ident).alias("_ident"), "input_ids", count), "tokens")


def _runs(tokens: DataFrame, placed: DataFrame, low: Column, last: Column, begin: Column, end: Column, by: list[str]) -> DataFrame:
    """``by``, ``_tokens``, ``_all``: the joined tokens from ``begin`` to ``end`` of each of the runs low..last that a text reaches.

    ``tokens`` are written. Few offsets are sent to them, of more the tokens stream past a table of offsets, unsorted.
    """
    held = tokens.agg(F.count("*").alias("rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("tokens")).first()
    placed = F.broadcast(placed) if held["rows"] <= SMALL_ROWS else placed.hint("shuffle_hash")
    cut = tokens.drop("_n").join(placed, "_ident").withColumn("_run", F.explode(F.sequence(low, last)))
    start, stop = F.greatest(begin, F.col("_from")), F.least(end, F.col("_to"))
    pieces = cut.withColumn("_start", start).select(
        *by,
        "_all",
        "_start",
        F.slice("input_ids", (F.col("_start") - F.col("_from") + 1).cast("int"), (stop - F.col("_start")).cast("int")).alias("_piece"),
    )
    tasks = max(tokens.sparkSession.sparkContext.defaultParallelism, -(-held["tokens"] // (RUN_TOKENS * TASK_RUNS)))
    parts = F.sort_array(F.collect_list(F.struct("_start", "_piece"))).alias("_parts")
    whole = pieces.repartition(tasks, *by).groupBy(*by).agg(parts, F.max("_all").alias("_all"))
    return whole.select(*by, F.flatten(F.transform("_parts", lambda p: p["_piece"])).alias("_tokens"), "_all")


def window_spans(
    tokens: DataFrame, block: int = 1024, stride: int = 512, batch_size: int = 1000, ident: str = "doc_id"
) -> DataFrame:
    """Overlapping windows over the joined tokens of every ``batch_size`` texts, without padding.

    ``batch_id, window_idx, input_ids, first``: a window predicts its tokens from place
    ``first`` on, those before it are repeated context. ``n_pairs`` of its tokens are predicted, and ``pairs_before``
    of the windows before it in the batch. The tail beyond a multiple of
    ``block`` is dropped when a batch has at least one block. The tokens are written
    once; offsets come from a table of ids and lengths. Pieces of texts are put together to
    runs of windows of about ``RUN_TOKENS`` tokens, so a token moves once and not once a window, and
    windows are cut from their run.
    """
    if stride > block:
        raise ValueError("stride must not exceed the block size")
    tokens = _written(tokens, ident)
    sizes = tokens.select("_ident", "_n", F.lit(1).alias("_one"))
    # Batches go by position, so ids may have gaps.
    places = exclusive_prefix(sizes, "_ident", ["_one", "_n"], ["_place", "_at"])
    whole = Window.partitionBy("batch_id")
    total = F.sum("_n").over(whole)
    placed = (
        places.withColumn("batch_id", whole_div(F.col("_place"), batch_size))
        .withColumn("_from", F.col("_at") - F.min("_at").over(whole))
        .withColumn("_all", F.when(total >= block, total - total % block).otherwise(total))
        .withColumn("_to", F.least(F.col("_from") + F.col("_n"), F.col("_all")))
        .where("_to > _from")
        .select("_ident", "batch_id", "_from", "_to", "_all")
    )
    some = max(1, RUN_TOKENS // stride)  # windows of a run

    def window_begin(number: Column) -> Column:
        return F.greatest(number * stride + (stride - block), F.lit(0))

    last = F.least(whole_div(F.col("_to") + (block - 1), stride) - 1, whole_div(F.col("_all") - 1, stride))
    low, high = whole_div(whole_div(F.col("_from"), stride), some), whole_div(last, some)
    head = F.col("_run") * some
    end = F.least((head + some) * stride, F.col("_all"))
    runs = _runs(tokens, placed, low, high, window_begin(head), end, ["batch_id", "_run"])
    windows = runs.withColumn(
        "window_idx", F.explode(F.sequence(head, F.least(head + (some - 1), whole_div(F.col("_all") - 1, stride))))
    )
    i = F.col("window_idx")
    begin, end = window_begin(i), F.least(i * stride + stride, F.col("_all"))
    # A batch has no context before its first token, and windows that do not overlap have none before each first one.
    lost = i if block == stride else F.least(i, F.lit(1))
    return windows.select(
        "batch_id",
        "window_idx",
        F.slice("_tokens", (begin - window_begin(head) + 1).cast("int"), (end - begin).cast("int")).alias("input_ids"),
        (i * stride - begin).cast("int").alias("first"),
        (end - begin - F.greatest(i * stride - begin, F.lit(1))).cast("int").alias("n_pairs"),
        (i * stride - lost).cast("bigint").alias("pairs_before"),
    )


def sliding_windows(
    tokens: DataFrame,
    block: int = 1024,
    stride: int = 512,
    batch_size: int = 1000,
    pad: int = 0,
    ident: str = "doc_id",
) -> DataFrame:
    """``window_spans`` as padded arrays: ``input_ids``, ``labels`` (context masked), ``attention_mask`` (all ones).

    Each window predicts ``stride`` new tokens; the repeated context before them is masked in ``labels``.
    """
    spans = window_spans(tokens, block, stride, batch_size, ident)
    missing = F.lit(block) - F.size("input_ids")
    return spans.select(
        "batch_id",
        "window_idx",
        F.concat("input_ids", F.array_repeat(F.lit(pad), missing)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(MASK), F.col("first")),
            F.slice("input_ids", F.col("first") + 1, F.lit(block)),
            F.array_repeat(F.lit(MASK), missing),
        ).alias("labels"),
        F.array_repeat(F.lit(1), block).alias("attention_mask"),
    )


def fixed_blocks(tokens: DataFrame, block: int, ident: str = "doc_id") -> DataFrame:
    """Non-overlapping blocks over the whole token stream; the short rest goes. The tokens are written once."""
    tokens = _written(tokens, ident)
    starts = exclusive_prefix(tokens.select("_ident", "_n"), "_ident", "_n", "_from")
    placed = starts.withColumn("_to", F.col("_from") + F.col("_n")).where("_to > _from")
    placed = placed.select("_ident", "_from", "_to", F.col("_to").alias("_all"))
    some = max(1, RUN_TOKENS // block)  # blocks of a run
    size = some * block
    begin = F.col("_run") * size
    runs = _runs(tokens, placed, whole_div(F.col("_from"), size), whole_div(F.col("_to") - 1, size), begin, begin + size, ["_run"])
    # The last run may be short: whole blocks only.
    whole = runs.withColumn("_whole", whole_div(F.size("_tokens"), block)).where("_whole > 0")
    return whole.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_whole") - 1))).select(
        (F.col("_run") * some + F.col("_i")).alias("block_idx"),
        F.slice("_tokens", (F.col("_i") * block + 1).cast("int"), F.lit(block)).alias("input_ids"),
    )


# What Python's ``str.splitlines`` takes for a line end.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def line_blocks(texts: DataFrame, vocab: DataFrame, block: int, ident: str = "doc_id", column: str = "text", unknown: int = -1) -> DataFrame:
    """One block per line that is not blank, cut to the block size.

    Lines are looked up like texts (see ``tokenize``). Runs a job that looks for repeated ids.
    """
    lines = texts.select(ident, F.posexplode(F.split(column, LINE_END)).alias("line", "_text")).where(
        strip_whitespace(F.col("_text")) != ""
    )
    # Texts that share an id share their lines too: their words are joined one by one.
    if texts.groupBy(ident).count().where("count > 1").isEmpty():
        cut = lines.select(F.struct(ident, "line").alias("_line"), F.substring_index("_text", " ", block).alias("_text"))
        found = tokenize(cut, vocab, "_line", "_text", unknown)
        return found.select(F.col("_line")[ident].alias(ident), F.col("_line")["line"].alias("line"), "input_ids")
    split = lines.select(ident, "line", F.slice(words(F.col("_text")), 1, block).alias("_words"))
    return _to_tokens(split, vocab, [ident, "line"], unknown)


def _shifted_labels() -> Column:
    return F.slice("labels", 2, F.greatest(F.size("labels") - 1, F.lit(0)))


def token_counts(windows: DataFrame, by: str | None = None) -> DataFrame:
    """Predicted tokens: labels that are not masked, without each window's first."""
    n = F.size(F.filter(_shifted_labels(), lambda x: x != MASK))
    grouped = windows.groupBy(by) if by else windows.groupBy()
    return grouped.agg(F.sum(n).cast("bigint").alias("n_tokens"), F.count("*").alias("n_windows"))


def predicted_places(windows: DataFrame) -> tuple[Column, Column]:
    """First predicted place and number of predicted tokens of each window; a window's first token has no context."""
    if "first" in windows.columns:
        begin = F.greatest(F.col("first"), F.lit(1))
        return begin, F.greatest(F.size("input_ids") - begin, F.lit(0))
    # Labels are masked before and behind one run of tokens.
    shifted = _shifted_labels()
    n = F.size(F.filter(shifted, lambda x: x != MASK))
    first = F.array_position(F.transform(shifted, lambda x: x != MASK), True)
    return F.greatest(first, F.lit(1)).cast("int"), n


def number_windows(windows: DataFrame) -> DataFrame:
    """Add the id of each window's first pair, ``first_entry``, and its pairs: (position, next token).

    Takes ``window_spans`` or ``sliding_windows``. Ids are gap-free in window order:
    offsets within a batch, plus the offset of the batch. Spans know their own place in the batch and need
    the offsets of the batches only, so they are numbered where they lie. ``windows`` should be a
    written table, as it is read twice.
    """
    begin, n = predicted_places(windows)
    tokens = F.slice("input_ids", begin + 1, n)
    pairs = F.transform(tokens, lambda token, i: F.struct((begin - 1 + i).alias("pos"), token.alias("token")))
    if "pairs_before" in windows.columns:
        totals = windows.groupBy("batch_id").agg(F.max(F.col("pairs_before") + F.col("n_pairs")).alias("_n"))
        starts = exclusive_prefix(totals, "batch_id", "_n", "_batch_start").select("batch_id", "_batch_start")
        starts = F.broadcast(starts) if is_small(starts) else starts
        first = (F.col("_batch_start") + F.col("pairs_before")).alias("first_entry")
        return windows.join(starts, "batch_id").select(*windows.columns, first).withColumn("pairs", pairs)
    counted = windows.select("batch_id", "window_idx", n.cast("bigint").alias("_n"))
    totals = counted.groupBy("batch_id").agg(F.sum("_n").alias("_n"))
    starts = exclusive_prefix(totals, "batch_id", "_n", "_batch_start").select("batch_id", "_batch_start")
    before = Window.partitionBy("batch_id").orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(starts, "batch_id")
        .select("batch_id", "window_idx", (F.col("_batch_start") + F.col("_before")).cast("bigint").alias("first_entry"))
    )
    return windows.join(firsts, ["batch_id", "window_idx"]).withColumn("pairs", pairs)


def next_token_pairs(windows: DataFrame, size: int | None = None) -> DataFrame:
    """(context position, next token) rows with gap-free ids; ``size`` keeps the first ones."""
    begin, n = predicted_places(windows)
    out = (
        number_windows(windows)
        .select("batch_id", "window_idx", "first_entry", begin.alias("_begin"), F.posexplode(F.slice("input_ids", begin + 1, n)).alias("_k", "token"))
        .select(
            (F.col("first_entry") + F.col("_k")).alias("entry_id"),
            "batch_id",
            "window_idx",
            (F.col("_begin") - 1 + F.col("_k")).alias("pos"),
            "token",
        )
    )
    return out if size is None else out.where(F.col("entry_id") < size)


def window_losses(windows: DataFrame, model: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """``batch_id, window_idx, nll, n_scored``: the loss of each window's predicted tokens.

    ``model()`` is made once a task; it gets the ``input_ids`` of a batch of windows
    (an Arrow list array) and returns the log-probability of every token given those before it in its window,
    one after another, NaN where it gives none. The context that windows repeat is masked, so each token
    of a batch counts once. Takes ``window_spans`` or ``sliding_windows``.
    """
    begin, n = predicted_places(windows)
    rows = windows.select("batch_id", "window_idx", begin.alias("_begin"), n.cast("int").alias("_n"), "input_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("input_ids")
            logp = np.asarray(score(lists), np.float64)
            size = np.asarray(pc.list_value_length(lists))
            place = np.arange(len(logp)) - np.repeat(np.cumsum(size) - size, size)
            low, high = (np.asarray(batch.column(c)) for c in ("_begin", "_n"))
            counts = (place >= np.repeat(low, size)) & (place < np.repeat(low + high, size)) & ~np.isnan(logp)
            row = np.repeat(np.arange(len(size)), size)[counts]
            nll = np.bincount(row, -logp[counts], len(size)).astype(float)
            found = [pa.array(nll), pa.array(np.bincount(row, minlength=len(size)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], ["batch_id", "window_idx", "nll", "n_scored"])

    return rows.mapInArrow(run, "batch_id bigint, window_idx bigint, nll double, n_scored bigint")


WINDOWS_PER_CHUNK = 256


def _hashed_context(part: pa.RecordBatch, dim: int, context: int) -> pa.RecordBatch:
    """Keys of all pairs of a few windows at once."""
    windows = part.column("input_ids")
    flat = windows.flatten().to_numpy()
    width = np.asarray(pc.list_value_length(windows))
    starts = np.cumsum(width) - width
    n = part.column("_pairs").to_numpy()
    row = np.repeat(np.arange(part.num_rows), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    pos = part.column("_begin").to_numpy()[row] - 1 + place
    at = starts[row] + pos
    key = np.zeros((len(row), dim), dtype=np.float32)
    for t in range(context):
        known = np.nonzero(pos >= t)[0]
        tokens = flat[at[known] - t]
        key[known, tokens % dim] += np.float32(2.0**-t)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part.column("first_entry").to_numpy()[row] + place, pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, dim), pa.int32()), pa.array(key.ravel())),
            pa.array(flat[at + 1], pa.int32()),
        ],
        names=["entry_id", "key", "token"],
    )


def context_keys(numbered: DataFrame, dim: int = 16, context: int = 4) -> DataFrame:
    """The default encoder: a hashed bag of the last context tokens.

    The token t places back adds 2**-t to dimension ``token mod dim``. It takes
    numbered windows, one row each, and returns ``entry_id, key, token``; a real
    encoder does the same with a model's hidden states. Pairs are taken from the windows' tokens by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, WINDOWS_PER_CHUNK):
                part = batch.slice(start, WINDOWS_PER_CHUNK)
                yield _hashed_context(part, dim, context)

    begin, n = predicted_places(numbered)
    places = [begin.cast("int").alias("_begin"), n.cast("int").alias("_pairs")]
    return numbered.select("first_entry", "input_ids", *places).mapInArrow(
        run, "entry_id bigint, key array<float>, token int"
    )


def build_datastore(
    texts: DataFrame,
    vocab: DataFrame | None = None,
    encoder: Callable[[DataFrame], DataFrame] = context_keys,
    block: int = 1024,
    stride: int = 512,
    batch_size: int = 1000,
    size: int | None = None,
    ident: str = "doc_id",
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Corpus -> tokens -> windows -> pairs -> ``entry_id, key, token``.

    Tokens come from ``tokenizer`` (see ``tokenize_with``), or from a word vocabulary,
    that of the texts if none is given. Vocabulary, tokens and windows are written on the way, as
    each is read more than once.
    """
    if tokenizer is not None:
        tokens = tokenize_with(texts, tokenizer, ident)
    else:
        vocab = materialize(build_vocab(texts), "vocab") if vocab is None else vocab
        tokens = tokenize(texts, vocab, ident)
    windows = materialize(window_spans(tokens, block, stride, batch_size, ident), "windows")
    store = encoder(number_windows(windows))
    return store if size is None else store.where(F.col("entry_id") < size)


def truncate_datastore(keys: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entries; asking for more than there are raises at once.

    Counting a written store reads footers only, and the filter reaches the scan.
    """
    if keys.count() < n:
        raise ValueError(f"datastore has fewer than {n} entries")
    return keys.where(F.col("entry_id") < n)
