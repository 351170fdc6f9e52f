"""Near-duplicates by SimHash: fingerprints, and a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import SPACE, narrow, text_chunks, word_spans
from kindstore.llm.components import connected
from kindstore.session import materialize

BITS = 64
ERRORS = 4
SHINGLE = 4
# Fingerprints of one trie that a task should see at most before the trie is split further.
NODE_ROWS = 100_000
# Node pairs handled at a time in a task, and pairs of fingerprints compared when a node pair is small.
FRONTIER = 1 << 16
LEAF_PAIRS = 64


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """The SimHash of every whole text: ``_id`` and ``_print`` (64 bits in a long).

    A-Z are lower-cased, words joined by one blank, and every run of ``width``
    words (all words, if fewer) hashed with XXH64, seed 42. A bit is set if more
    than half of the hashes have it. Texts without a word, and null, give 0.
    """
    rows = narrow(df, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32

    def prints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, first = word_spans(data, offsets)
        docs = len(offsets) - 1
        solid = ~SPACE[data]
        # Write the words one after another, each followed by a blank.
        number = np.cumsum(solid) - 1
        word = np.zeros(len(data), np.int64)
        word[starts] = 1
        target = (number + np.cumsum(word) - 1)[solid]
        plain = np.full(len(target) + len(starts), 32, np.uint8)
        plain[target] = fold[data[solid]]
        lengths = ends - starts
        begin = np.cumsum(lengths + 1) - lengths - 1
        end = begin + lengths
        n = np.diff(first)
        shingles = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        bounds = np.concatenate([[0], np.cumsum(shingles)])
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], shingles)
        last = np.minimum(place + width, np.repeat(first[1:], shingles)) - 1
        text, digest = plain.tobytes(), xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(text[a:b], 42) for a, b in zip(begin[place].tolist(), end[last].tolist(), strict=True)),
            np.uint64,
            bounds[-1],
        )
        out = np.zeros(docs, np.uint64)
        filled = np.flatnonzero(shingles)
        if len(filled):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, bounds[filled], axis=0, dtype=np.int32)
            packed = np.packbits(2 * ones > shingles[filled, None], axis=1, bitorder="little")
            out[filled] = np.ascontiguousarray(packed).view(np.uint64)[:, 0]
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prints(data, offsets) for _, _, data, offsets in text_chunks(batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["_id", "_print"])

    return rows.mapInArrow(run, f"_id {kind}, _print bigint")


def block_bounds(bits: int, errors: int) -> list[int]:
    """Bit positions that cut a fingerprint into ``errors + 1`` blocks of nearly equal size."""
    return [bits * i // (errors + 1) for i in range(errors + 2)]


def budgets(turn: int, bits: int = BITS, errors: int = ERRORS) -> list[int]:
    """Errors allowed among the first 1, 2, ... bits of the trie that begins with block ``turn``.

    Of the rotations of errors + 1 block counts that sum to at most ``errors``,
    one has every running sum below its number of blocks. Each pair within reach
    is therefore met in a rotation with no error in the first block, at most one
    in the first two, and so on.
    """
    edges = block_bounds(bits, errors)
    sizes = [edges[i + 1] - edges[i] for i in range(errors + 1)]
    turned = sizes[turn:] + sizes[:turn]
    return [block for block, size in enumerate(turned) for _ in range(size)]


def join_trie(prints: np.ndarray, trie: np.ndarray, own: np.ndarray, errors: int, bits: int, depth: int) -> np.ndarray:
    """Join binary tries with themselves, and say which fingerprints are connected.

    ``prints`` are rotated fingerprints sorted by ``trie`` and value; ``trie``
    tells them apart by trie (rotation and root), and ``own`` is the budget row of
    each trie's rotation. Node pairs descend together from the pair (root, root):
    children with equal bits keep the number of differing bits, others add one,
    and a pair beyond the budget of its depth goes. A node is a range of the
    sorted array. Small pairs are compared directly. Pairs of nodes that already
    belong to one component go too: they can add no connection. Returns for each
    row the smallest row of its component in this trie.
    """
    count = len(prints)
    parent = np.arange(count)
    roots = np.flatnonzero(np.r_[True, trie[1:] != trie[:-1]]) if count else np.zeros(0, np.int64)
    ends = np.r_[roots[1:], count] if count else roots
    allowed = np.array([budgets(t, bits, errors) for t in range(errors + 1)])
    stack = [(depth, roots, ends, roots, ends, np.zeros(len(roots), np.int64), own[roots])] if count else []
    changes = np.zeros(count + 1, np.int64)

    def settle(left: np.ndarray, right: np.ndarray) -> None:
        nonlocal changes
        moved = False
        while True:
            a, b = parent[left], parent[right]
            open_pairs = a != b
            if not open_pairs.any():
                break
            left, right, a, b = left[open_pairs], right[open_pairs], a[open_pairs], b[open_pairs]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            moved = True
            while not np.array_equal(parent[parent], parent):
                np.copyto(parent, parent[parent])
        if moved:
            changes = np.r_[0, 0, np.cumsum(parent[1:] != parent[:-1])]

    changes = np.r_[0, np.arange(count)] if count else changes
    while stack:
        level, alo, ahi, blo, bhi, wrong, turn = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((level, *(x[half:] for x in (alo, ahi, blo, bhi, wrong, turn))))
            stack.append((level, *(x[:half] for x in (alo, ahi, blo, bhi, wrong, turn))))
            continue
        # changes[i + 1] counts the places up to row i where the component changes.
        joined = (parent[alo] == parent[blo]) & (changes[ahi] == changes[alo + 1]) & (changes[bhi] == changes[blo + 1])
        live = ~joined & ((alo != blo) | (ahi - alo > 1))
        small = live & (((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (level == bits))
        if small.any():
            rows = (bhi - blo)[small]
            sizes = (ahi - alo)[small] * rows
            pair = np.repeat(np.arange(len(sizes)), sizes)
            offset = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            left, right = alo[small][pair] + offset // rows[pair], blo[small][pair] + offset % rows[pair]
            near = (left < right) & (np.bitwise_count(prints[left] ^ prints[right]) <= errors)
            if near.any():
                settle(left[near], right[near])
        deep = live & ~small
        if not deep.any():
            continue
        alo, ahi, blo, bhi, wrong, turn = (x[deep] for x in (alo, ahi, blo, bhi, wrong, turn))
        bit = np.uint64(bits - 1 - level)
        # First row of the one-child of each node: the bit is sorted within a node.
        amid, bmid = (_first_one(prints, lo, hi, bit) for lo, hi in ((alo, ahi), (blo, bhi)))
        same = (alo == blo) & (ahi == bhi)
        parts = []
        for a0, a1, b0, b1, differ, use in (
            (alo, amid, blo, bmid, 0, slice(None)),
            (amid, ahi, bmid, bhi, 0, slice(None)),
            (alo, amid, bmid, bhi, 1, slice(None)),
            (amid, ahi, blo, bmid, 1, ~same),
        ):
            part = [x[use] for x in (a0, a1, b0, b1, wrong + differ, turn)]
            good = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= allowed[part[5], level])
            parts.append([x[good] for x in part])
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(merged[0]):
            stack.append((level + 1, *merged))
    return parent


def _first_one(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each range, sorted by the bit, the first row with the bit set (the end if none)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ranges = lo < hi
        if not open_ranges.any():
            return lo
        middle = (lo + hi) >> 1
        one = np.zeros(len(lo), bool)
        one[open_ranges] = (prints[middle[open_ranges]] >> bit & np.uint64(1)) == 1
        hi = np.where(open_ranges & one, middle, hi)
        lo = np.where(open_ranges & ~one, middle + 1, lo)


def near_links(
    prints: DataFrame,
    print_col: str = "_print",
    errors: int = ERRORS,
    bits: int = BITS,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """Links that connect all fingerprints at ``errors`` or fewer differing bits: ``a``, ``b``.

    ``prints`` holds distinct fingerprints. Each goes into errors + 1 tries, which
    are rotations of its blocks (see ``budgets``), and a trie is cut into subtries
    by its first block, which must agree. A subtrie that holds more than
    ``node_rows`` is cut again by its second block, of which one bit may differ: a
    fingerprint then also visits the subtries where one of its zero bits is one.
    Tasks join subtries with themselves and return at most one link a row, to the
    smallest fingerprint of its component there; the components of the links are
    those of all pairs within reach.
    """
    edges = block_bounds(bits, errors)
    turned = []
    for turn in range(errors + 1):
        low = edges[turn]
        value = F.col(print_col)
        rotated = value if low == 0 else F.shiftleft(value, low).bitwiseOR(F.shiftrightunsigned(value, bits - low))
        size = edges[turn + 1] - low
        after = (edges + [bits + e for e in edges[1:]])[turn + 2] - edges[turn + 1]
        turned.append(
            F.struct(
                F.lit(turn).alias("turn"),
                F.shiftrightunsigned(rotated, bits - size).alias("root"),
                F.shiftrightunsigned(rotated, bits - size - after).alias("node"),
                F.lit(after).alias("extra"),
                rotated.alias("value"),
            )
        )
    rows = prints.select(F.explode(F.array(*turned)).alias("_t")).select("_t.*")
    # A row for each first block at most: 5 * 2^13 rows.
    crowded = (
        rows.groupBy("turn", "root").count().where(F.col("count") > node_rows).select("turn", "root", F.lit(True).alias("cut"))
    )
    rows = rows.join(F.broadcast(crowded), ["turn", "root"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    step = F.expr("transform(sequence(0, extra - 1), i -> shiftleft(1L, i))")
    visits = F.array_union(
        F.array(F.col("node")),
        F.transform(F.filter(step, lambda x: F.col("node").bitwiseAND(x) == 0), lambda x: F.col("node").bitwiseOR(x)),
    )
    placed = rows.select(
        "turn",
        "value",
        "node",
        "cut",
        F.explode(F.when(F.col("cut"), visits).otherwise(F.array("root"))).alias("trie"),
    ).select("turn", "value", "cut", "trie", (~F.col("cut") | (F.col("node") == F.col("trie"))).alias("home"))
    schema = "a bigint, b bigint"
    deal = [F.col("turn"), F.col("cut"), F.col("trie")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = _keys(batch)
            last = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(last):  # all but the last trie of the batch are whole
                yield links(pa.Table.from_batches([*held, batch.slice(0, last[-1] + 1)]))
                held = [batch.slice(last[-1] + 1)]
            elif held and (_keys(held[-1])[-1] != keys[0]).any():
                yield links(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield links(pa.Table.from_batches(held))

    def _keys(batch) -> np.ndarray:
        return np.stack([np.asarray(batch.column(name)).astype(np.int64) for name in ("turn", "cut", "trie")], axis=1)

    def links(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        turn, cut, trie, home = (np.asarray(table.column(c)) for c in ("turn", "cut", "trie", "home"))
        value = np.asarray(table.column("value")).view(np.uint64)
        order = np.lexsort((value, trie, cut, turn))
        turn, cut, trie, value = (x[order] for x in (turn, cut, trie, value))
        key = np.cumsum(np.r_[True, (turn[1:] != turn[:-1]) | (cut[1:] != cut[:-1]) | (trie[1:] != trie[:-1])])
        parent = join_trie(value, key, turn, errors, bits, 0)
        linked = np.flatnonzero(parent != np.arange(len(parent)))
        low = np.array(edges)[turn]

        def back(rows: np.ndarray) -> pa.Array:
            moved, by = value[rows], low[rows].astype(np.uint64)
            whole = (moved >> by) | np.where(by > 0, moved << (np.uint64(bits) - by), np.uint64(0))
            return pa.array(whole.view(np.int64))

        return pa.RecordBatch.from_arrays([back(linked), back(parent[linked])], ["a", "b"])

    return placed.repartition(*deal).sortWithinPartitions(*deal).mapInArrow(run, schema)


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    errors: int = ERRORS,
    width: int = SHINGLE,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """Groups of near-copies: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints link at ``errors`` or fewer differing bits; a group is all that
    links reach, named by its smallest id. Rows with one fingerprint become one
    before anything is joined, so copies cost nothing; links and components are
    tables, never on the driver.

    Defined cases: texts without a word (null too) have fingerprint zero and link
    like any other; a null id belongs to its group, whose name is null only if all
    its ids are; repeated rows come back each; further columns are ignored; no rows
    give none.
    """
    rows = materialize(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = materialize(rows.groupBy("_print").agg(F.min("_id").alias("_least")), "distinct-fingerprints")
    groups = connected(near_links(distinct, errors=errors, node_rows=node_rows))
    named = distinct.join(groups.withColumnRenamed("node", "_print"), "_print", "left").withColumn(
        "_group", F.coalesce("component", "_print")
    )
    named = materialize(named.select("_print", "_group", "_least"), "fingerprint-groups")
    linked = named.join(groups.select(F.col("component").alias("_group")).distinct(), "_group", "left_semi")
    least = linked.groupBy("_group").agg(F.min("_least").alias("_first"))
    names = named.join(least, "_group", "left").select(
        "_print", F.when(F.col("_first").isNull(), F.col("_least")).otherwise(F.col("_first")).alias("_name")
    )
    return rows.join(names, "_print").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_name").alias("component_id"),
    )
