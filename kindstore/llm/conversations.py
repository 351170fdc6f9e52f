"""Conversation structure repair: cheapest edits to system? (user assistant)*, by Four-Russians block tables.

Every row of a conversation is one of a few symbols (what its role begins with,
what is wrong with it). Let g(state) be the least cost of all edits from a row on,
for each state of the little automaton of wanted roles. Any state reaches any other
by a few insertions, so g less its least entry takes only a handful of values
(``VECTORS``), and a row maps each of them to another one and a cost. For every
block of ``BLOCK`` symbols and every vector behind it the vector in front of it
and the cost between them are tabulated once, so a conversation costs one lookup a
block. Where edits are wanted, a block is expanded again backward, row by row, from
the vector behind it, and the edits are read off forward: at each place the
first letter in ASCII order that keeps the cost least. So ties are settled
over the whole conversation, not within a block.

The tables also make long conversations parallel. Rows are put in order by range
partitions and cut into chunks of 2 ** ``CHUNK_BITS`` places. A chunk first returns, for each
of its conversations, the map from every vector behind it to the one in front, then,
the vector behind it being known, its edits for each of the four states in
which it may be entered. Between chunks only those maps are chained, in a
stream over one narrow row a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kindstore.llm.base import narrow
from kindstore.session import materialize

WORD_CHAR = r"[^\x20\x09-\x0D]"
# States: nothing written, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
# Roles by first letter, and what is wrong: nothing, truncated, or to be deleted whatever the role.
S, U, A, OTHER = range(4)
FINE, CUT, GONE = 0, 4, 8
PADDING = 9
SYMBOLS = 10
# A blank or duplicate row has one symbol for all roles.
SYMBOL = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8], np.int64)
BLOCK = 4
CHUNK_BITS = 12
INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {(START, S): SYSTEM, (START, U): USER, (SYSTEM, U): USER, (USER, A): ASSISTANT, (ASSISTANT, U): USER}
INSERT_COST, REROLE_COST, DELETE_COST, CUT_COST = 2, 2, 3, 1
# What is to be inserted behind the last row.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """Ways to take a row in a state without an insertion before it, in ASCII order: letter, cost, next state."""
    found = [("D", DELETE_COST, state)]
    if symbol < GONE:
        more = CUT_COST if symbol >= CUT else 0
        if (state, symbol % 4) in KEEP:
            found.append(("K", more, KEEP[state, symbol % 4]))
        found.append(("R", REROLE_COST + more, INSERT[state]))
    return found


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs in front of a row from those behind it; insertions before the row included."""
    if symbol == PADDING:
        return after
    least = [min(cost + after[to] for _, cost, to in _edits(state, symbol)) for state in range(4)]
    for _ in range(3):  # at most three insertions lead from one state to any other
        least = [min(least[state], INSERT_COST + least[INSERT[state]]) for state in range(4)]
    return tuple(least)


END = (0, 2 * INSERT_COST, INSERT_COST, 0)


class Tables:
    """Vectors by number, and what one symbol or a block of them does to each."""

    def __init__(self):
        self.vectors, number, steps = [END], {END: 0}, []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                found = _before(symbol, vector)
                low = min(found)
                least = tuple(x - low for x in found)
                if least not in number:
                    number[least] = len(self.vectors)
                    self.vectors.append(least)
                row.append((number[least], low))
            steps.append(row)
        table = np.array(steps, np.int64)
        self.to, self.cost = table[:, :, 0], table[:, :, 1]
        # A block is a number in base SYMBOLS, its first row the highest digit; the last row comes first.
        self.block_to, self.block_cost = self.to, self.cost
        for _ in range(BLOCK - 1):
            cost = self.block_cost[:, :, None] + self.cost[self.block_to]
            self.block_cost = cost.transpose(0, 2, 1).reshape(len(table), -1)
            self.block_to = self.to[self.block_to].transpose(0, 2, 1).reshape(len(table), -1)
        self._traces: dict = {}

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """The numbers of a conversation's blocks; the last one is padded with rows that change nothing."""
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, PADDING, np.int64)
        padded[: len(symbols)] = symbols
        return padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def maps(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the blocks the one in front of them, and the cost between."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for block in blocks[::-1].tolist():
            cost += self.block_cost[at, block]
            at = self.block_to[at, block]
        return at, cost

    def trace_block(self, block: int, behind: int, state: int) -> tuple[tuple[str, ...], int]:
        """The letters of each row of a block (insertions before a row go with it), and the state left."""
        key = (block, behind, state)
        if key not in self._traces:
            symbols = [block // SYMBOLS**p % SYMBOLS for p in range(BLOCK - 1, -1, -1)]
            vectors, extra = [behind], []
            for symbol in symbols[::-1]:
                extra.append(int(self.cost[vectors[-1], symbol]))
                vectors.append(int(self.to[vectors[-1], symbol]))
            vectors, extra, letters = vectors[::-1], extra[::-1], []
            for place, symbol in enumerate(symbols):
                here, after, own = self.vectors[vectors[place]], self.vectors[vectors[place + 1]], ""
                while symbol != PADDING:
                    # All ways to go on from here at least cost; the ASCII-least one is taken.
                    ways = [(w, to) for w, cost, to in _edits(state, symbol) if cost + after[to] == here[state] + extra[place]]
                    if INSERT_COST + here[INSERT[state]] == here[state]:
                        ways.append(("I", INSERT[state]))
                    letter, state = min(ways)
                    own += letter
                    if letter != "I":
                        break
                letters.append(own)
            self._traces[key] = tuple(letters), state
        return self._traces[key]

    def trace(self, blocks: np.ndarray, behind: int, state: int) -> tuple[list[str], int]:
        """The letters of every row (padding included), entering in ``state`` with the vector behind known."""
        after, at = [], behind
        for block in blocks[::-1].tolist():
            after.append(at)
            at = int(self.block_to[at, block])
        letters: list[str] = []
        for block, vector in zip(blocks.tolist(), after[::-1], strict=True):
            own, state = self.trace_block(block, vector, state)
            letters.extend(own)
        return letters, state


@cache
def tables() -> Tables:
    return Tables()


def _symbol_column():
    first = F.substring("_role", 1, 1)
    role = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)
    return role + F.when(F.col("_blank") | F.col("_seen"), GONE).when(F.col("_cut"), CUT).otherwise(FINE)


def ordered_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Different rows of each conversation in order: ``_conv, _turn, _role, _digest, _n, _place, _code`` and flags.

    Rows that agree in all of (conversation, turn, role, text) become one with
    their number ``_n`` before anything is shuffled by conversation. Texts stay
    behind; their digests stand for them. Written, so that places are fixed.
    """
    plain = narrow(df, _conv=conv, _turn=turn, _role=role, _text=text)
    plain = plain.withColumn("_role", F.coalesce("_role", F.lit(" "))).withColumn("_text", F.coalesce("_text", F.lit(" ")))
    last = F.regexp_extract("_text", rf"({WORD_CHAR})[\x20\x09-\x0D]*\z", 1)
    rows = plain.select(
        "_conv", "_turn", "_role", F.sha2("_text", 256).alias("_digest"), (last == "").alias("_blank"), (~last.isin(".", "!", "?")).alias("_cut")
    )
    rows = rows.groupBy("_conv", "_turn", "_role", "_digest", "_blank", "_cut").agg(F.count("*").alias("_n"))
    rows = materialize(rows, "conversation-rows")
    # The first turn of each (role, text): one flag a different row, found by a join that the turn spreads.
    firsts = rows.groupBy("_conv", "_role", "_digest").agg(
        F.min("_turn").alias("_first"), F.max(F.col("_turn").isNull()).alias("_early")
    )
    firsts = firsts.select(
        F.col("_conv").alias("_c"), F.col("_role").alias("_r"), F.col("_digest").alias("_d"),
        F.when(~F.col("_early"), F.col("_first")).alias("_t"), F.lit(True).alias("_is_first"),
    )
    same = (
        F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_role") == F.col("_r"))
        & (F.col("_digest") == F.col("_d")) & F.col("_turn").eqNullSafe(F.col("_t"))
    )
    flagged = rows.join(firsts, same, "left").withColumn("_seen", F.col("_is_first").isNull())
    placed = flagged.select("_conv", "_turn", "_role", "_digest", "_n", "_blank", "_cut", "_seen", _symbol_column().cast("int").alias("_code"))
    order = ["_conv", "_turn", "_role", "_digest"]  # ascending puts nulls first
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "conversation-order")


def _segments(rows: DataFrame) -> DataFrame:
    """A row for each conversation of each chunk: its codes in order, and the map of every vector behind it."""
    kind = rows.schema["_conv"].dataType.simpleString()
    schema = f"_conv {kind}, _chunk bigint, codes binary, copies array<bigint>, places array<bigint>, maps array<int>, costs array<bigint>"

    def run(table: pa.Table) -> pa.Table:
        known = tables()
        table = table.combine_chunks().sort_by("_place")
        code, n, place = (np.asarray(table.column(c)) for c in ("_code", "_n", "_place"))
        conv = table.column("_conv").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(conv)) + 1).tolist(), len(conv)]
        out = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            maps, costs = known.maps(known.blocks(SYMBOL[code[low:high]]))
            out.append((code[low:high].astype(np.uint8).tobytes(), n[low:high], place[low:high], maps, costs))
        codes, *lists = zip(*out, strict=True)
        firsts = pa.array(edges[:-1], pa.int64())
        arrays = [table.column("_conv").take(firsts), table.column("_chunk").take(firsts), pa.array(codes, pa.binary())]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        arrays += [pa.array([x.tolist() for x in values], pa.list_(k)) for values, k in zip(lists, kinds, strict=True)]
        return pa.table(arrays, names=["_conv", "_chunk", "codes", "copies", "places", "maps", "costs"])

    chunked = rows.select("_conv", "_place", "_n", "_code", F.shiftright("_place", CHUNK_BITS).alias("_chunk"))
    return chunked.groupBy("_chunk").applyInArrow(run, schema)


def _schema(df: DataFrame, *dropped: str, more: str) -> str:
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in dropped]
    return ", ".join([*kept, more])


def _chained(segments: DataFrame) -> DataFrame:
    """Add the vectors ``behind`` and in ``front`` of each segment, chained from the end of each conversation."""
    streamed = segments.repartition("_conv").sortWithinPartitions("_conv", F.desc("_chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, front = object(), 0
        for batch in batches:
            behind, fronts, spent = [], [], []
            columns = (batch.column(name).to_pylist() for name in ("_conv", "maps", "costs"))
            for own, maps, costs in zip(*columns, strict=True):
                at = front if own == conv else 0
                conv, front = own, maps[at]
                behind.append(at)
                fronts.append(front)
                spent.append(costs[at])
            batch = batch.drop_columns(["maps", "costs"])
            for name, values, kind in (("behind", behind, pa.int32()), ("front", fronts, pa.int32()), ("spent", spent, pa.int64())):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    return streamed.mapInArrow(run, _schema(segments, "maps", "costs", more="behind int, front int, spent bigint"))


def _traced(segments: DataFrame) -> DataFrame:
    """Add the edits of each segment for the four states it may be entered in: letters of each row, states left."""
    spread = segments.repartition("_chunk", "_conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            letters, states = [], []
            for codes, behind in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist(), strict=True):
                blocks = known.blocks(SYMBOL[np.frombuffer(codes, np.uint8)])
                found = [known.trace(blocks, behind, state) for state in range(4)]
                letters.append([own[: len(codes)] for own, _ in found])
                states.append([state for _, state in found])
            batch = batch.append_column("letters", pa.array(letters, pa.list_(pa.list_(pa.string()))))
            yield batch.append_column("states", pa.array(states, pa.list_(pa.int32())))

    return spread.mapInArrow(run, _schema(spread, more="letters array<array<string>>, states array<int>"))


LEGAL = np.zeros((4, 4), bool)
LEGAL[S, U] = LEGAL[U, A] = LEGAL[A, U] = True


def _entered(segments: DataFrame) -> DataFrame:
    """Choose the edits by the state in which a segment is entered, chained from the start of each conversation.

    Also the cost of the segment, and its neighbours that are no user after
    system or assistant and no assistant after user; the row before it counts.
    """
    streamed = segments.repartition("_conv").sortWithinPartitions("_conv", "_chunk")
    names = ["_conv", "_chunk", "codes", "copies", "places"]
    schema = _schema(segments, *[c for c in segments.columns if c not in names], more="letters array<string>, entry int, cost bigint, illegal bigint, tail string")
    arrow = to_arrow_schema(segments.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        held, state, before = None, START, -1  # a segment goes out when it is known whether it is the last
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    if held["_conv"] != row["_conv"]:
                        held["tail"], state, before = TAIL[state], START, -1
                    out.append(held)
                role = np.frombuffer(row["codes"], np.uint8) % 4
                illegal = int((~LEGAL[role[:-1], role[1:]]).sum()) + int(before >= 0 and not LEGAL[before, role[0]])
                cost = row["spent"] + (known.vectors[row["front"]][START] if before < 0 else 0)
                # Copies of a row follow it: they go, and no role may follow itself.
                extra = sum(row["copies"]) - len(row["copies"])
                held = {name: row[name] for name in names} | {"letters": row["letters"][state], "entry": state, "tail": ""}
                held |= {"cost": cost + DELETE_COST * extra, "illegal": illegal + extra}
                state, before = row["states"][state], int(role[-1])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"tail": TAIL[state]}], schema=arrow)

    return streamed.mapInArrow(run, schema)


def _edit_rows(segments: DataFrame) -> DataFrame:
    """One row an edit: ``_conv, place, step, edit, times, new_role`` (the role given to a reroled or inserted row)."""
    spread = segments.repartition("_chunk", "_conv").select("_conv", "codes", "copies", "places", "letters", "entry", "tail")
    kind = segments.schema["_conv"].dataType.simpleString()
    names = {USER: "user", ASSISTANT: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, rows = [], []
            for number, row in enumerate(batch.select(batch.schema.names[1:]).to_pylist()):
                state, before = row["entry"], len(rows)
                for code, n, place, letters in zip(row["codes"], row["copies"], row["places"], row["letters"], strict=True):
                    for step, letter in enumerate(letters):
                        if letter == "K":
                            state = KEEP[state, code % 4]
                        elif letter != "D":
                            state = INSERT[state]
                        rows.append((place, step, letter, 1, names[state] if letter in "IR" else None))
                    if n > 1:
                        rows.append((place, len(letters), "D", n - 1, None))
                for letter in row["tail"]:
                    state = INSERT[state]
                    rows.append((place, len(rows), letter, 1, names[state]))
                origin += [number] * (len(rows) - before)
            if rows:
                places, steps, letters, times, roles = zip(*rows, strict=True)
                arrays = [pa.array(places, pa.int64()), pa.array(steps, pa.int64()), pa.array(letters, pa.string())]
                arrays += [pa.array(times, pa.int64()), pa.array(roles, pa.string())]
                conv = batch.column("_conv").take(pa.array(origin, pa.int64()))
                yield pa.RecordBatch.from_arrays([conv, *arrays], names=["_conv", "place", "step", "edit", "times", "new_role"])

    return spread.mapInArrow(run, f"_conv {kind}, place bigint, step bigint, edit string, times bigint, new_role string")


class Repair(NamedTuple):
    """``report``: a row a conversation. ``edits``: a row an edit, in the order of (place, step)."""

    report: DataFrame
    edits: DataFrame


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """The cheapest edits that make every conversation an optional system row and pairs of user and assistant.

    Rows go by turn (nulls first), rows of one turn by role and by the SHA-256 of the
    text. A row is blank (no character but white space), else a duplicate (role and text
    stand earlier in the conversation), else truncated (its last character but
    white space is none of ``.!?``). Roles count by their first letter. Edits: Keep (0),
    Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go), Insert
    an empty user or assistant row (2); a truncated row that stays costs 1 more.
    Of the cheapest edits those whose letters come first in ASCII order are taken.

    ``report``: ``conv_id, gaps`` (turns between the least and the largest that no
    row has), ``blank, duplicate, truncated`` (rows), ``illegal`` (neighbours as they come
    that are not system-user, user-assistant, assistant-user), ``cost, audit`` (the letters).
    ``edits``: ``conv_id, place, step, edit, times`` (deleted copies of a row are one
    edit), ``turn, role`` (after the edit), ``text`` (null for a deleted row).

    A null role or text counts as one blank; null turns are one more turn without a
    number; a null conversation id is a conversation. Repeated rows are
    duplicates, empty tables give empty results, further columns are ignored. Runs jobs.
    """
    rows = ordered_rows(df, conv_col, turn_col, role_col, text_col)
    found = materialize(_entered(_traced(_chained(_segments(rows)))), "conversation-edits")
    gone = F.col("_blank") | F.col("_seen")
    counts = rows.groupBy("_conv").agg(
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.sum(F.when(F.col("_blank"), F.col("_n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("_blank"), 0).otherwise(F.col("_n") - F.when(F.col("_seen"), 0).otherwise(1))).alias("duplicate"),
        F.sum((F.col("_cut") & ~gone).cast("bigint")).alias("truncated"),
    )
    own = F.transform(F.arrays_zip("letters", "copies"), lambda r: F.concat(r["letters"], F.repeat(F.lit("D"), (r["copies"] - 1).cast("int"))))
    pieces = found.select("_conv", "_chunk", "cost", "illegal", F.concat(F.array_join(own, ""), F.col("tail")).alias("_piece"))
    whole = pieces.groupBy("_conv").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.sort_array(F.collect_list(F.struct("_chunk", "_piece"))).alias("_pieces"),
    )
    whole = whole.select(F.col("_conv").alias("_c"), "illegal", "cost", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("audit"))
    report = counts.join(whole, F.col("_conv").eqNullSafe(F.col("_c"))).select(
        F.col("_conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    # Of rows that agree in all four columns at most one stays, so edits find their text by them.
    plain = narrow(df, _conv=conv_col, _turn=turn_col, _role=role_col, _text=text_col)
    texts = plain.select(
        F.col("_conv").alias("_c"), F.col("_turn").alias("_t"), F.coalesce("_role", F.lit(" ")).alias("_r"),
        F.coalesce("_text", F.lit(" ")).alias("_text"),
    ).withColumn("_d", F.sha2("_text", 256))
    edits = _edit_rows(found).join(rows.select(F.col("_place").alias("place"), "_turn", "_role", "_digest"), "place")
    stays = F.col("edit").isin("K", "R")
    kept = edits.where(stays).join(
        texts.dropDuplicates(["_c", "_t", "_r", "_d"]),
        F.col("_conv").eqNullSafe(F.col("_c")) & F.col("_turn").eqNullSafe(F.col("_t"))
        & (F.col("_role") == F.col("_r")) & (F.col("_digest") == F.col("_d")),
    )
    others = edits.where(~stays).withColumn("_text", F.when(F.col("edit") == "I", F.lit("")))
    turn = F.when(F.col("edit") != "I", F.col("_turn")).alias("turn")
    columns = [F.col("_conv").alias("conv_id"), "place", "step", "edit", "times", turn, F.coalesce("new_role", "_role").alias("role"), F.col("_text").alias("text")]
    return Repair(report, kept.select(*columns).unionByName(others.select(*columns)))


def repaired_digests(edits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the digest of each conversation's rows ``role:text``, joined by line feeds.

    One digest over a whole conversation can't be cut, so its rows stream through
    one task in order; only the running digest is held.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    lines = edits.select("conv_id", "place", "step", F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).alias("line"))
    streamed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").select("conv_id", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, any_line = None, None, False
        arrow = None
        for batch in batches:
            arrow, done = batch.schema.field("conv_id").type, []
            for own, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or own != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest, any_line = own, hashlib.sha256(), False
                if line is not None:
                    digest.update((b"\n" if any_line else b"") + line.encode())
                    any_line = True
            if done:
                yield _digest_rows(done, arrow)
        if digest is not None:
            yield _digest_rows([(conv, digest.hexdigest())], arrow)

    return streamed.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _digest_rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    convs, digests = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with faults by crc32 of ``conv_id:turn`` modulo 20 (nulls are one blank).

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's.
    """
    plain = narrow(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    marked = plain.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("_times"),
    )
    # Not by a sequence to 0: that one counts down.
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_times")))
    return marked.withColumn("_copy", copies).select("conv_id", "turn", "role", "text")


def repair_damaged(df: DataFrame) -> DataFrame:
    """The report of every conversation after ``damage``, with the digest of what the repair leaves.

    A conversation that loses all rows has zeros, an empty audit and the digest of the empty text.
    """
    found = repair_conversations(damage(df))
    ids = narrow(df, _id="conv_id").distinct()
    digests = repaired_digests(found.edits)
    report = ids.join(found.report, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    report = report.join(digests, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return report.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
