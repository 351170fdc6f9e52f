"""Vocabulary, windows and datastores built from the documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindstore.catalog.registry import part, query, r6, rounded
from kindstore.functions.scalars import hash24, whole_div
from kindstore.operators import windows
from kindstore.operators.metrics import corpus_perplexity
from kindstore.operators.plugins import BigramModel
from kindstore.operators.vectors import PACK, neighbour_context, pack_tokens
from kindstore.session import materialize

BLOCK, STRIDE, BATCH = 1024, 512, 100
TASK_WINDOWS = 1024
DIM = 16  # of the default encoder

part(
    "word_places",
    "SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents",
)
part(
    "vocab",
    """
SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, md5(word), word) - 1 AS INTEGER) AS token
FROM (SELECT word, count(*) AS n FROM word_places GROUP BY word)""",
)
part("token_places", "SELECT doc_id, pos, token FROM word_places JOIN vocab USING (word)")
part(
    "batch_places",
    f"""
SELECT batch_id, o, token, CASE WHEN total >= {BLOCK} THEN total - total % {BLOCK} ELSE total END AS total FROM (
  SELECT doc_id // {BATCH} AS batch_id, token, row_number() OVER (PARTITION BY doc_id // {BATCH} ORDER BY doc_id, pos) - 1 AS o,
         count(*) OVER (PARTITION BY doc_id // {BATCH}) AS total FROM token_places)""",
)
part(
    "window_places",
    f"""
SELECT batch_id, window_idx, o, token, total, greatest(window_idx * {STRIDE} + {STRIDE - BLOCK}, 0) AS first FROM (
  SELECT *, unnest(range(o // {STRIDE}, least((o + {BLOCK}) // {STRIDE} - 1, (total - 1) // {STRIDE}) + 1)) AS window_idx
  FROM batch_places WHERE o < total)""",
)
part(
    "windows_sql",
    f"""
SELECT batch_id, window_idx, list_concat(list(token ORDER BY o), list_transform(range({BLOCK} - count(*)), lambda i: 0)) AS input_ids,
       list_concat(list(CASE WHEN o < window_idx * {STRIDE} THEN -100 ELSE token END ORDER BY o), list_transform(range({BLOCK} - count(*)), lambda i: -100)) AS labels
FROM window_places GROUP BY batch_id, window_idx""",
)


def vocabulary(t):
    return materialize(windows.build_vocab(t.documents), "vocab")


def tokens(t):
    return windows.tokenize(t.documents, vocabulary(t))


def sliding(t):
    return windows.sliding_windows(tokens(t), BLOCK, STRIDE, BATCH)


def spans(t):
    """The same windows without padding, written."""
    return materialize(windows.window_spans(tokens(t), BLOCK, STRIDE, BATCH), "windows")


def _joined(column: str):
    return F.md5(F.array_join(column, ","))


@query("build_vocab", "SELECT word, n, token FROM vocab")
def build_vocab(t):
    return windows.build_vocab(t.documents)


@query(
    "tokenize",
    "SELECT doc_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(token, ',' ORDER BY pos)) AS digest FROM token_places GROUP BY doc_id",
)
def tokenize(t):
    return tokens(t).select("doc_id", F.size("input_ids").alias("n"), _joined("input_ids").alias("digest"))


@query(
    "sliding_windows",
    f"""
SELECT batch_id, window_idx, md5(array_to_string(input_ids, ',')) AS inputs, md5(array_to_string(labels, ',')) AS labels, {BLOCK} AS n_attended
FROM windows_sql""",
)
def sliding_windows(t):
    return sliding(t).select(
        "batch_id",
        "window_idx",
        _joined("input_ids").alias("inputs"),
        _joined("labels").alias("labels"),
        F.size("attention_mask").alias("n_attended"),
    )


@query(
    "token_counts",
    """
SELECT batch_id, CAST(sum(len(list_filter(labels[2:], lambda x: x <> -100))) AS BIGINT) AS n_tokens, count(*) AS n_windows
FROM windows_sql GROUP BY batch_id""",
)
def token_counts(t):
    return windows.token_counts(sliding(t), "batch_id")


part(
    "pairs",
    f"""
SELECT row_number() OVER (ORDER BY batch_id, window_idx, o) - 1 AS entry_id, batch_id, window_idx, o, first, token
FROM window_places WHERE o >= window_idx * {STRIDE} AND o > first""",
)


@query(
    "next_token_pairs",
    """
SELECT batch_id, window_idx, count(*) AS n, min(entry_id) AS first_entry, max(entry_id) AS last_entry,
       md5(string_agg(entry_id || ':' || (o - first - 1) || ':' || token, ',' ORDER BY entry_id)) AS digest
FROM pairs GROUP BY batch_id, window_idx""",
)
def next_token_pairs(t):
    found = spans(t)
    # Windows are dealt out before their pairs are made, so that pairs need not move to be grouped by window.
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-found.count() // TASK_WINDOWS))
    pairs = windows.next_token_pairs(found.repartition(tasks, "batch_id", "window_idx"))
    line = F.concat_ws(":", "entry_id", "pos", "token")
    # A window has at most BLOCK pairs, so the digest list is short.
    return pairs.groupBy("batch_id", "window_idx").agg(
        F.count("*").alias("n"),
        F.min("entry_id").alias("first_entry"),
        F.max("entry_id").alias("last_entry"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_id", line.alias("l")))), lambda x: x["l"]), ",")).alias("digest"),
    )


@query(
    "fixed_blocks",
    f"""
SELECT o // {BLOCK} AS block_idx, md5(string_agg(token, ',' ORDER BY o)) AS digest
FROM (SELECT token, row_number() OVER (ORDER BY doc_id, pos) - 1 AS o FROM token_places) GROUP BY 1 HAVING count(*) = {BLOCK}""",
)
def fixed_blocks(t):
    return windows.fixed_blocks(materialize(tokens(t), "tokens"), BLOCK).select("block_idx", _joined("input_ids").alias("digest"))


part(
    "line_words",
    """
SELECT doc_id, line, unnest(string_split(l, ' ')[1:1024]) AS word, generate_subscripts(string_split(l, ' ')[1:1024], 1) AS pos FROM (
  SELECT doc_id, unnest(lines) AS l, generate_subscripts(lines, 1) - 1 AS line FROM (
    SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS lines FROM documents))
WHERE trim(l, ' ' || chr(9)) <> ''""",
)


@query(
    "line_blocks",
    """
SELECT doc_id, CAST(line AS INTEGER) AS line, md5(string_agg(coalesce(token, -1), ',' ORDER BY pos)) AS digest
FROM line_words LEFT JOIN vocab USING (word) GROUP BY doc_id, line""",
)
def line_blocks(t):
    blocks = windows.line_blocks(t.documents, vocabulary(t), BLOCK)
    return blocks.select("doc_id", "line", _joined("input_ids").alias("digest"))


part(
    "recent",
    """
SELECT c.entry_id, c.token, b.back - 1 AS back, p.token AS context
FROM pairs c CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS back) b
JOIN window_places p ON p.batch_id = c.batch_id AND p.window_idx = c.window_idx AND p.o = c.o - b.back""",
)
part(
    "encoded",
    """
SELECT entry_id, token, context % 16 AS dim, sum(pow(2.0, -back)) AS value FROM recent GROUP BY ALL""",
)


@query(
    "build_datastore",
    """
SELECT e.token, d.n, e.first_entry, e.last_entry, round(d.weight, 6) AS weight, round(d.place, 6) AS place FROM (
  SELECT token, count(*) AS n, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM pairs GROUP BY token) e
JOIN (SELECT token, count(DISTINCT entry_id) AS n, sum(value) AS weight, sum(value * value * (dim + 1)) AS place FROM encoded GROUP BY token) d USING (token)""",
)
def build_datastore(t):
    store = windows.build_datastore(t.documents, block=BLOCK, stride=STRIDE, batch_size=BATCH)
    key = [F.get("key", F.lit(i)).cast("double") for i in range(DIM)]
    weight = sum(key, F.lit(0.0))
    place = sum((x * x * (i + 1) for i, x in enumerate(key)), F.lit(0.0))
    return store.groupBy("token").agg(
        F.count("*").alias("n"),
        F.min("entry_id").alias("first_entry"),
        F.max("entry_id").alias("last_entry"),
        F.round(F.sum(weight), 6).alias("weight"),
        F.round(F.sum(place), 6).alias("place"),
    )



@query(
    "truncate_datastore",
    "SELECT token, count(*) AS n, max(entry_id) AS last_entry FROM pairs WHERE entry_id < 50000 GROUP BY token",
)
def truncate_datastore(t):
    store = windows.next_token_pairs(spans(t)).select("entry_id", "token")
    return windows.truncate_datastore(store, 50000).groupBy("token").agg(
        F.count("*").alias("n"), F.max("entry_id").alias("last_entry")
    )


part(
    "some_neighbours",
    """
SELECT doc_id AS query_id, rank, (doc_id * 7919 + rank * 104729 + CAST('0x'||substr(md5('n:'||doc_id||':'||rank),1,6) AS BIGINT)) % (SELECT count(*) FROM pairs) AS entry_id
FROM (SELECT doc_id, unnest([1, 2, 3]) AS rank FROM documents)""",
)


@query(
    "neighbour_context",
    """
SELECT n.query_id, n.rank, n.entry_id, p.token AS next_token,
       (SELECT string_agg(c.token, ' ' ORDER BY c.entry_id) FROM pairs c WHERE c.entry_id BETWEEN n.entry_id - 30 AND n.entry_id - 1 AND n.entry_id >= 30) AS context
FROM some_neighbours n JOIN pairs p USING (entry_id)""",
)
def _neighbour_context(t):
    pairs = windows.next_token_pairs(spans(t))
    packed = materialize(pack_tokens(pairs.select(F.lit("all").alias("store"), "entry_id", "token")), "packed")
    size = packed.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).scalar()

    draw = hash24(F.lit("n:"), F.col("query_id"), F.lit(":"), F.col("rank"))
    found = (
        t("documents")
        .select(F.col("doc_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
        .withColumn("entry_id", (F.col("query_id") * 7919 + F.col("rank") * 104729 + draw) % size)
        .where("entry_id >= 0")
        .withColumn("block", whole_div(F.col("entry_id"), PACK))
        .join(packed.select("store", "block", "tokens"), "block")
        # Ids have no gaps, so they are places.
        .select("query_id", "store", "rank", "entry_id", F.get("tokens", (F.col("entry_id") % PACK).cast("int")).alias("token"))
    )
    return neighbour_context(found, packed).select(
        "query_id", "rank", "entry_id", "next_token", F.array_join("context", " ").alias("context")
    )


def byte_tokenizer():
    """A tokenizer of the plug-in kind: the bytes of a text."""

    def encode(texts):
        _, offsets, data = texts.cast(pa.large_binary()).buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        tokens = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(tokens))

    return encode


@query("tokenize_with", "SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n, md5(hex(encode(text))) AS digest FROM documents")
def tokenize_with(t):
    """Any tokenizer of Arrow batches; here one token a byte."""
    found = windows.tokenize_with(t.documents, byte_tokenizer)
    digits = F.transform("input_ids", lambda x: F.lpad(F.hex(x), 2, "0"))
    return found.select("doc_id", F.size("input_ids").alias("n"), F.md5(F.array_join(digits, "")).alias("digest"))


part(
    "byte_places",
    """
SELECT doc_id, p AS pos, CAST('0x' || substr(h, 2 * p + 1, 2) AS INTEGER) AS token FROM (
  SELECT doc_id, h, unnest(range(len(h) // 2)) AS p FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))""",
)
part(
    "byte_batches",
    f"""
SELECT batch_id, o, token, CASE WHEN total >= {BLOCK} THEN total - total % {BLOCK} ELSE total END AS total FROM (
  SELECT doc_id // {BATCH} AS batch_id, token, row_number() OVER (PARTITION BY doc_id // {BATCH} ORDER BY doc_id, pos) - 1 AS o,
         count(*) OVER (PARTITION BY doc_id // {BATCH}) AS total FROM byte_places)""",
)


@query(
    "build_datastore_bytes",
    "SELECT token, count(*) AS n FROM byte_batches WHERE o BETWEEN 1 AND total - 1 GROUP BY token",
)
def build_datastore_bytes(t):
    """A datastore over the tokens of a plug-in tokenizer: how often each is predicted."""
    store = windows.build_datastore(t.documents, block=BLOCK, stride=STRIDE, batch_size=BATCH, tokenizer=byte_tokenizer)
    return store.groupBy("token").agg(F.count("*").alias("n"))


part(
    "pair_counts",
    """
SELECT prev, token, count(*) AS n FROM (SELECT token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM token_places)
WHERE prev IS NOT NULL GROUP BY prev, token""",
)
part("prev_counts", "SELECT prev, sum(n) AS n_prev FROM pair_counts GROUP BY prev")
part(
    "stream_logprobs",
    """
SELECT batch_id, o, ln((coalesce(n, 0) + 1) / (coalesce(n_prev, 0) + (SELECT count(*) FROM vocab))) AS logp
FROM (SELECT batch_id, o, token, lag(token) OVER (PARTITION BY batch_id ORDER BY o) AS prev FROM batch_places WHERE o < total)
LEFT JOIN pair_counts USING (prev, token) LEFT JOIN prev_counts USING (prev) WHERE o > 0""",
)


@query("window_perplexity", f"SELECT {r6('exp(-avg(logp))', 'perplexity')} FROM stream_logprobs")
def window_perplexity(t):
    """Perplexity over windows by a model of Arrow batches; the context that windows repeat counts once."""
    model = BigramModel(t.documents, vocab=vocabulary(t))
    words = model.tokenize(t.documents)
    found = windows.window_spans(words, BLOCK, STRIDE, BATCH)
    return rounded(corpus_perplexity(model.window_losses(found)))


@query("window_losses", f"SELECT batch_id, {r6('-sum(logp)', 'nll')}, count(*) AS n_scored FROM stream_logprobs GROUP BY batch_id")
def window_losses(t):
    model = BigramModel(t.documents, vocab=vocabulary(t))
    words = model.tokenize(t.documents)
    losses = model.window_losses(windows.sliding_windows(words, BLOCK, STRIDE, BATCH))
    return rounded(losses.groupBy("batch_id").agg(F.sum("nll").alias("nll"), F.sum("n_scored").alias("n_scored")))
