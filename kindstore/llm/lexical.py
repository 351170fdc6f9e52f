"""Ranked lexical search: documents scanned by an Aho-Corasick automaton of all item terms.

No index of the documents is made or read. An item is a short text (a benchmark
question, say); the terms of all items go into one automaton, which finds their
occurrences in each document while the text streams by. A first scan gives what
the weights need (documents, their terms, documents of each item term), a second
one the term frequencies and scores.

The automaton works on bytes. A text is first mapped byte by byte: A-Z to a-z, all
that is no part of a term to a blank. Every term is stored with a blank at both
ends, and a text gets one in front and behind, so that only whole terms match;
neighbours share the blank between them, which the automaton's overlapping
matches allow. Every byte from 0x80 on belongs to a term, so bytes and code points
give the same terms.

Items are cut into blocks of about ``BLOCK_POSTINGS`` different (item, term) pairs.
A block is what the driver gathers and broadcasts at a time; further items mean
further scans and never a larger automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindstore.llm.base import narrow, text_chunks
from kindstore.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_POSTINGS = 1 << 18
# Entries of a score table of documents x items that a task fills at a time.
TABLE_CELLS = 1 << 20
# Best rows of the tasks are merged in slices first, then over the slices.
SLICES = 32

BYTES = np.full(256, 32, np.uint8)
for _byte in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    BYTES[_byte] = _byte + 32 if 0x41 <= _byte < 0x5B else _byte


class Block:
    """The terms of some items: the automaton's words, and the items and repeats that each term maps to."""

    def __init__(self, terms: list[str], term: np.ndarray, item: np.ndarray, times: np.ndarray, n_items: int):
        self.terms, self.n_items = terms, n_items
        order = np.argsort(term, kind="stable")
        self.first = np.searchsorted(term[order], np.arange(len(terms) + 1))
        self.item, self.times = item[order].astype(np.int64), times[order].astype(np.int64)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        """Built once in each process that scans."""
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for number, term in enumerate(self.terms):
                found.add_word(f" {term.encode().decode('latin-1')} ", number)
            if self.terms:
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and (text, term, occurrences) of the block's terms, in order of text and term."""
        n = len(offsets) - 1
        # One blank more before each text, and one behind the last.
        row = np.repeat(np.arange(n), np.diff(offsets))
        mapped = np.full(len(data) + n + 1, 32, np.uint8)
        mapped[np.arange(len(data)) + row + 1] = BYTES[data]
        begins = offsets[:-1] + np.arange(n)
        solid = mapped != 32
        starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        total = np.diff(np.searchsorted(starts, np.append(begins, len(mapped))))
        if not self.terms:
            empty = np.empty(0, np.int64)
            return total, empty, empty, empty
        hits = self.automaton.iter(mapped.tobytes().decode("latin-1"))
        flat = np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2)
        # A match ends on its closing blank, which for the last term of a text is the next text's opening one.
        text = np.searchsorted(begins, flat[:, 0] - 1, side="right") - 1
        pair, occurrences = np.unique(text * len(self.terms) + flat[:, 1], return_counts=True)
        return total, pair // len(self.terms), pair % len(self.terms), occurrences


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term, times`` of each item; rows that repeat id and text count once, texts of one id add up."""
    rows = narrow(items, _item=id_col, _text=text_col).where(F.col("_text").isNotNull()).distinct()
    terms = F.regexp_extract_all(F.translate("_text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return (
        rows.select(F.col("_item").alias("item_id"), F.explode(terms).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("times"))
    )


def item_blocks(postings: DataFrame, block_postings: int = BLOCK_POSTINGS) -> Iterator[tuple[pa.Array, Block]]:
    """The items in blocks, one at a time on the driver: their ids by number, and their terms."""
    n = max(1, -(-postings.count() // block_postings))
    for number in range(n):
        part = postings.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == number)
        table = part.select("item_id", "term", "times").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        ids = table.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        words = table.column("term").combine_chunks().dictionary_encode()
        places = (np.asarray(x.indices).astype(np.int64) for x in (words, ids))
        yield ids.dictionary, Block(words.dictionary.to_pylist(), *places, np.asarray(table.column("times")), len(ids.dictionary))


def _texts(batch: pa.RecordBatch):
    for first, end, data, offsets in text_chunks(batch.column("_text")):
        yield first, end, data, offsets


def term_statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and for each term of the block the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        holding, n_docs, n_terms = np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, data, offsets in _texts(batch):
                total, _, term, _ = block.counts(data, offsets)
                holding += np.bincount(term, minlength=len(block.terms))
                n_docs, n_terms = n_docs + int((total > 0).sum()), n_terms + int(total.sum())
        found = np.flatnonzero(holding)
        place, n = np.concatenate([[-2, -1], found]), np.concatenate([[n_docs, n_terms], holding[found]])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["place", "n"])

    counts = docs.select("_text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most one row a term of the block, and two
    place, n = np.asarray(table.column("place")), np.asarray(table.column("n"))
    totals = dict(zip(place.tolist(), n.tolist(), strict=True))
    holding = np.zeros(len(block.terms), np.int64)
    holding[place[place >= 0]] = n[place >= 0]
    return totals.get(-2, 0), totals.get(-1, 0), holding


def _best(ids: np.ndarray, known: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of each item: high score first, then small id, rows without an id last."""
    order = np.lexsort((ids, ~known, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def score_documents(docs: DataFrame, block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item_no, doc_id, score``: the ``k`` best documents of each item in each task."""
    shared = docs.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        step = max(1, TABLE_CELLS // max(1, block.n_items))
        fan = np.diff(block.first)
        least = np.zeros(block.n_items, np.int64)
        best = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            column = batch.column("_id")
            known, ids = np.asarray(column.is_valid()), np.asarray(column.cast(pa.int64()).fill_null(0))
            for start, _, data, offsets in _texts(batch):
                total, text, term, tf = block.counts(data, offsets)
                m = 25 + 75 * total * n_docs // max(1, n_terms)
                impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[text]))
                for low in range(0, len(total), step):
                    rows = slice(*np.searchsorted(text, [low, low + step]))
                    # Each found term of a text goes to all items that it maps to.
                    width = fan[term[rows]]
                    at = np.repeat(np.arange(rows.start, rows.stop), width)
                    within = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
                    place = block.first[term[at]] + within
                    scores = np.zeros((min(step, len(total) - low), block.n_items), np.int64)
                    np.add.at(scores, (text[at] - low, block.item[place]), impact[at] * block.times[place])
                    doc, item = np.nonzero((scores >= least[None]) & (scores > 0))
                    row = start + low + doc
                    best = [np.concatenate(x) for x in zip(best, (ids[row], known[row], item, scores[doc, item]), strict=True)]
                    keep = _best(*best, k)
                    best = [x[keep] for x in best]
                    full = np.bincount(best[2], minlength=block.n_items) >= k
                    last = np.zeros(block.n_items, np.int64)
                    last[best[2]] = best[3]  # from high to low, so the last one stays
                    least = np.where(full, last, 0)
        ids, known, item, score = best
        columns = [pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=~known), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_no", "doc_id", "score"])

    return docs.mapInArrow(run, "item_no bigint, doc_id bigint, score bigint")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item by term weights.

    The score of a document sums, over the item's terms with repeats, the term's
    weight ``floor(1000 ln((2N + 2) / (2 df + 1)))`` times
    ``10^9 tf div (1000 tf + 8 m)`` with ``m = 25 + (75 n N) div L`` (N documents with a
    term, L all terms, n those of the document), in 64-bit integers.

    Null and empty texts hold no term and are never returned; an item without a
    known term has no rows. Every row is a document, repeated ones too. Ties go
    to the smaller id, rows without an id come last. Rows that repeat an item's
    id and text count once, different texts under one id (null too) add up. Either
    table may be empty and may have further columns of any name. Runs jobs.
    """
    spark = docs.sparkSession
    wanted = narrow(docs, _id=id_col, _text=text_col)
    item_type = narrow(items, _item=item_col).schema["_item"].dataType
    postings = materialize(item_terms(items, item_col, item_text), "item-terms")
    nearest = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id bigint, score bigint")
    for ids, block in item_blocks(postings, block_postings):
        n_docs, n_terms, holding = term_statistics(wanted, block)
        if not n_docs:
            continue
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)
        found = score_documents(wanted, block, weights, n_docs, n_terms, k)
        names = spark.createDataFrame(pa.table({"item_no": np.arange(len(ids)), "item_id": ids}))
        found = found.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
        sliced = Window.partitionBy("item_no", "_slice").orderBy(*nearest)
        found = found.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*nearest)))
        ranked = ranked.where(F.col("rank") <= k).join(F.broadcast(names), "item_no")  # at most BLOCK_POSTINGS names
        out = out.unionByName(ranked.select(F.col("item_id").cast(item_type).alias("item_id"), "rank", "doc_id", "score"))
    return out
