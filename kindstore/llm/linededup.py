"""Line deduplication by pairwise alignment.

Lines are told apart by 128 bits of BLAKE2b of their bytes, so two lines that differ
are never taken for one, whoever wrote them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import narrow, run_hashes, text_chunks, word_spans
from kindstore.session import materialize

LEAST_WORDS = 20
# Tasks over which the documents that point to one earlier document are spread.
SLOTS = 64
_DOC = ("_id", "_mark")
_LINES = ("_lines", "_more", "_words")


def text_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """Lines of each text and their shortest runs: ``_id``, ``_mark``, ``_lines``, ``_more``, ``_words``, ``_runs``.

    Lines end at a line feed; ``_lines`` and ``_more`` are the halves of their digests and
    ``_words`` their numbers of words. A line without a word has digest 0. ``_runs`` are
    hashes of runs of lines, see ``shortest_runs``. ``_mark`` (a hash of the text) tells
    apart rows that share an id.
    """
    rows = narrow(df, _id=id_col, _text=text_col).select("_id", F.xxhash64("_text").alias("_mark"), "_text")
    kind = rows.schema["_id"].dataType.simpleString()

    def lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_chunks(batch.column(2)):
                digests, words, bounds = line_digests(data, offsets)
                runs, edges = shortest_runs(digests[:, 0], words, bounds, least_words)
                columns = [c.slice(begin, end - begin) for c in batch.columns[:2]]
                columns += [lists(bounds, np.ascontiguousarray(digests[:, half])) for half in (0, 1)]
                columns += [lists(bounds, words), lists(edges, runs)]
                yield pa.RecordBatch.from_arrays(columns, [*_DOC, *_LINES, "_runs"])

    lists_of = ", ".join(f"{name} array<bigint>" for name in (*_LINES, "_runs"))
    return rows.mapInArrow(run, f"_id {kind}, _mark bigint, {lists_of}")


def shortest_runs(
    hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, least_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shortest runs of lines with ``least_words`` words from and up to each line, and each text's first.

    Two texts with a common block of so many words share such a run, and the shared
    runs of a block cover all its lines with words: a line from which no run fits
    into the block lies in the one that ends with it.
    """
    upto = np.concatenate([[0], np.cumsum(words)])
    at = np.flatnonzero(words > 0)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at]
    last = np.searchsorted(upto[1:], upto[at] + least_words)
    first = np.searchsorted(upto, upto[at + 1] - least_words, side="right") - 1
    starts = np.concatenate([at, first])
    stops = np.concatenate([last, at]) + 1
    text = np.concatenate([text, text])
    inside = (starts >= bounds[text]) & (stops <= bounds[text + 1])
    starts, stops, text = starts[inside], stops[inside], text[inside]
    keys = run_hashes(hashes.view(np.uint64), starts, stops).view(np.int64)
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[once], np.searchsorted(text[once], np.arange(len(bounds)))


def line_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest (two halves) and words of each line, and the first line of each text (one more than texts)."""
    breaks = np.flatnonzero(data == 10)
    # A text has one line more than it has line feeds, even if it is empty.
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    start, end = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1], np.int64)
    is_first = np.zeros(bounds[-1], bool)
    is_first[bounds[:-1]] = True
    is_last = np.zeros(bounds[-1], bool)
    is_last[bounds[1:] - 1] = True
    start[is_first], start[~is_first] = offsets[:-1], breaks + 1
    end[is_last], end[~is_last] = offsets[1:], breaks
    words_at, _, _ = word_spans(data, offsets)
    words = np.searchsorted(words_at, end) - np.searchsorted(words_at, start)
    worded, raw = np.flatnonzero(words), data.tobytes()
    spans = zip(start[worded].tolist(), end[worded].tolist(), strict=True)
    digests = np.zeros((len(words), 2), np.int64)
    digests[worded] = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in spans), np.int64).reshape(-1, 2)
    return digests, words.astype(np.int64), bounds


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned lines of two texts: equal ends, then lines unique in both in their longest common order, then between.

    Where lines are common but none is unique in both, the first of a line meets
    the first, the second the second, and so on. Lines without a word (0) are
    aligned as neighbours only.
    """
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        anchors = _in_order(_unique_pairs(a, alo, ahi, b, blo, bhi) or _nth_pairs(a, alo, ahi, b, blo, bhi))
        if anchors:
            edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
            out += anchors
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def _unique_pairs(a, alo, ahi, b, blo, bhi) -> list[tuple[int, int]]:
    def once(lines, lo, hi):
        seen: dict[int, int] = {}
        for i in range(lo, hi):
            seen[lines[i]] = -1 if lines[i] in seen else i
        return seen

    mine, theirs = once(a, alo, ahi), once(b, blo, bhi)
    return [(i, theirs[line]) for line, i in mine.items() if line and i >= 0 and theirs.get(line, -1) >= 0]


def _nth_pairs(a, alo, ahi, b, blo, bhi) -> list[tuple[int, int]]:
    places: dict[int, deque[int]] = {}
    for j in range(blo, bhi):
        places.setdefault(b[j], deque()).append(j)
    return [(i, places[a[i]].popleft()) for i in range(alo, ahi) if a[i] and places.get(a[i])]


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both (piles and back pointers)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for at, (_, j) in enumerate(pairs):
        place = bisect_left(tops, j)
        back.append(piles[place - 1] if place else -1)
        if place == len(tops):
            tops.append(j)
            piles.append(at)
        else:
            tops[place], piles[place] = j, at
    out = []
    at = piles[-1] if piles else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def _blocks(earlier: list, later: list, words: list[int], least_words: int) -> set[int]:
    out, block, held, before = set(), [], 0, None
    for i, j in [*patience(earlier, later), (-2, -2)]:
        if before != (i - 1, j - 1):
            out.update(block if held >= least_words else ())
            block, held = [], 0
        if j >= 0:
            block.append(j)
            held += words[j]
        before = (i, j)
    return out


# Two random numbers for hashes of runs: a prime modulus and a base.
_PRIME, _BASE = (1 << 61) - 1, 0x1C3A9F0B2D47E685 % ((1 << 61) - 1)


def _runs(lines: list[int], words: list[int], least_words: int) -> list[tuple[int, int, int]]:
    """Shortest runs of lines with ``least_words`` words from and up to each line with words: start, end, hash."""
    upto, powers, held = [0], [1], [0]
    for line, n in zip(lines, words, strict=True):
        upto.append((upto[-1] * _BASE + line + 1) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
        held.append(held[-1] + n)
    out = set()
    for at, n in enumerate(words):
        if n:
            out.add((at, bisect_left(held, held[at] + least_words)))
            # The last place with at least so many words less.
            out.add((bisect_left(held, held[at + 1] - least_words + 1) - 1, at + 1))
    spans = sorted((a, b) for a, b in out if 0 <= a and b <= len(lines))
    return [(a, b, (upto[b] - upto[a] * powers[b - a]) % _PRIME) for a, b in spans]


def common_lines(earlier: list[int], later: list[int], words: list[int], least_words: int) -> list[int]:
    """Lines of the later text in aligned blocks of at least ``least_words`` words.

    An alignment keeps one order, and a block that moved, repeats or is outvoted by
    short lines elsewhere is left out of it. If the later text has a line left that the earlier one
    has too, runs of lines with so many words that both have and that are not yet
    deleted (open runs) are looked for. First the texts are aligned again with all else blanked out,
    then each run that is still open is aligned on its own with its first occurrence.
    So every common run is aligned in the end, in time about linear in the lines.
    """
    found = _blocks(earlier, later, words, least_words)
    known = set(earlier)
    if not any(n and at not in found and later[at] in known for at, n in enumerate(words)):
        return sorted(found)
    size = dict(zip(later, words, strict=True))
    # A line that the later text lacks is in no common run: enough words, and a number of its own.
    theirs: dict[int, list[tuple[int, int]]] = {}
    for a, b, key in _runs(earlier, [size.get(line, least_words) for line in earlier], least_words):
        theirs.setdefault(key, []).append((a, b))
    mine = [(a, b, key) for a, b, key in _runs(later, words, least_words) if key in theirs]

    def still_open() -> list[tuple[int, int, int]]:
        return [(a, b, key) for a, b, key in mine if any(words[at] and at not in found for at in range(a, b))]

    runs = still_open()
    if runs:
        left, right = [-1] * len(earlier), [-2] * len(later)
        for a, b, _ in runs:
            right[a:b] = later[a:b]
        for key in {key for *_, key in runs}:
            for a, b in theirs[key]:
                left[a:b] = earlier[a:b]
        found |= _blocks(left, right, words, least_words)
        runs = still_open()
    for a, b, key in runs:
        c, d = theirs[key][0]
        found |= {a + at for at in _blocks(earlier[c:d], later[a:b], words[a:b], least_words)}
    return sorted(found)


def copied_lines(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The lines to delete of each document: ``_id``, ``_mark``, ``_delete``, ``_from`` (ids of earlier documents).

    Documents meet by hashes of lines that are rare by their length: ``_runs``, made with the
    same ``least_words``, are lines that hold together as many words as a block needs (often
    a single one), so frequent short lines bring no one together unless their neighbours agree too.
    A pair without a rare line, sharing only passages that very many have, meets by them all the same. Each run points
    from every document that has it to the earliest that has it: a run of n
    documents gives n - 1 pairs, not n * (n - 1) / 2, whether it is rare or common,
    and each line of a common block is in a run whose earliest holder is aligned. The
    pairs of an earlier document stream past its lines, which a task holds once, in ``SLOTS`` streams.
    """
    rows = lines.where("_id IS NOT NULL")
    posts = materialize(rows.select(*_DOC, F.explode("_runs").alias("_run")), "line-postings")
    doc = F.struct(*_DOC)
    firsts = posts.groupBy("_run").agg(F.min(doc).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot run.
    firsts = materialize(firsts.select("_run", "_first"), "line-firsts")
    pairs = posts.join(firsts, "_run").where(doc > F.col("_first")).select(*_DOC, "_first").distinct()
    pairs = materialize(pairs.withColumn("_slot", F.pmod(F.xxhash64(*_DOC), F.lit(SLOTS)).cast("int")), "line-pairs")
    texts = rows.drop("_runs").dropDuplicates(list(_DOC))
    # An earlier document goes before the later ones that point to it, once for each slot that they are in.
    earlier = texts.select(doc.alias("_first"), *_LINES).join(pairs.select("_first", "_slot").distinct(), "_first")
    kind = rows.schema["_id"].dataType.simpleString()
    earlier = earlier.select("_first", "_slot", F.lit(0).alias("_part"), F.lit(None).cast(kind).alias("_id"), F.lit(None).cast("bigint").alias("_mark"), *_LINES)
    later = pairs.join(texts, list(_DOC)).select("_first", "_slot", F.lit(1).alias("_part"), *_DOC, *_LINES)
    deal = ["_first", "_slot"]
    both = earlier.unionByName(later).repartition(*deal).sortWithinPartitions(*deal, "_part")
    both = both.select("_part", F.col("_first._id").alias("_from"), *_DOC, *_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[int, int], int] = {}
        held: list[int] = []
        for batch in batches:
            out, rows = [], []
            for at in range(batch.num_rows):
                halves = zip(batch.column("_lines")[at].as_py(), batch.column("_more")[at].as_py(), strict=True)
                if not batch.column("_part")[at].as_py():
                    numbers = {(0, 0): 0}
                    held = [numbers.setdefault(line, len(numbers)) for line in halves]
                    continue
                own = dict(numbers)
                lines = [own.setdefault(line, len(own)) for line in halves]
                rows.append(at)
                out.append(common_lines(held, lines, batch.column("_words")[at].as_py(), least_words))
            if rows:
                columns = [batch.column(name).take(pa.array(rows)) for name in (*_DOC, "_from")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int32()))], [*_DOC, "_from", "_found"])

    found = both.mapInArrow(run, f"_id {kind}, _mark bigint, _from {kind}, _found array<int>")
    found = found.select(*_DOC, "_from", F.explode("_found").alias("_at"))
    # At most one entry for each line of a document and each earlier document it points to.
    return found.groupBy(*_DOC).agg(
        F.array_sort(F.collect_set("_at")).alias("_delete"), F.array_sort(F.collect_set("_from")).alias("_from")
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Delete from each document the blocks of lines that an earlier document has.

    Documents are ordered by id. A document is aligned by patience diff with the
    earliest document of each of its runs of ``least_words`` words; aligned lines
    that follow each other in both are a block, and blocks of so many words or more
    are deleted from the later document. Common runs that the order of the alignment leaves
    out are aligned again, see ``common_lines``. What is deleted stays in an earlier one.

    Returns one row per input row: ``id_col``, ``n_lines``, ``deleted_lines`` (places
    from 0), ``copied_from`` (ids) and ``text`` (what is left; null stays null).

    Defined cases: null and empty texts have no line with a word and stay; rows
    with a null id have no order and stay; rows that repeat id and text are one
    document and lose the same lines; rows that share an id but not the text are
    ordered by a hash of the text; further columns are ignored; no rows give none.
    """
    lines = materialize(text_lines(df, id_col, text_col, least_words), "text-lines")
    copies = copied_lines(lines, least_words)
    rows = narrow(df, _id=id_col, _text=text_col).withColumn("_mark", F.xxhash64("_text"))
    rows = rows.join(copies, list(_DOC), "left")
    # A column of its own, so that it is split once a row and not once a line.
    rows = rows.withColumn("_split", F.split("_text", "\n", -1)).withColumn("_count", F.size("_split"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("_count") - 1), F.col("_delete"))
    left = F.array_join(F.transform(kept, lambda i: F.get("_split", i)), "\n")
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_text").isNull(), 0).otherwise(F.col("_count")).cast("bigint").alias("n_lines"),
        F.coalesce("_delete", F.array().cast("array<int>")).alias("deleted_lines"),
        F.coalesce("_from", F.array().cast(copies.schema["_from"].dataType)).alias("copied_from"),
        F.when(F.col("_delete").isNull(), F.col("_text")).otherwise(left).alias("text"),
    )
