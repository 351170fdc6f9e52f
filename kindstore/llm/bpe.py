"""Byte-level BPE through a sentencepiece model written straight from a rank file."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindstore.llm.base import large_strings, narrow

# Entries, and bytes of their words and ids, that a task remembers before it starts afresh: bounds memory, not results.
CACHE_ENTRIES = 500_000
CACHE_BYTES = 64 << 20
GROUP_CHARS = 1 << 20
# Byte b is written as this code point in pieces: no white space, nothing that sentencepiece treats apart.
FIRST_CODE = 0x100
BYTE_LETTERS = {b: FIRST_CODE + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its id in each line. A vocabulary, so of bounded size."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def letters(token: bytes) -> str:
    return token.decode("latin-1").translate(BYTE_LETTERS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece BPE model of a rank file.

    Piece i is the token of rank i with its bytes mapped to letters, scored -i, so
    that the best-scored merge is the one of lowest rank. Free ids become unused
    pieces, and the unknown piece comes last (every byte is a piece, so it never
    appears). Normalisation is the identity, without dummy blank.
    """
    # Fixed values of the model format: types of pieces and of the model, field numbers.
    normal, unknown, unused, bpe = 1, 2, 5, 2
    by_rank = {rank: token for token, rank in ranks.items()}
    size = max(by_rank, default=-1) + 1
    pieces = []
    for rank in range(size):
        name, kind = (letters(by_rank[rank]), normal) if rank in by_rank else (f"<free{rank}>", unused)
        pieces.append(_field(1, name.encode()) + _field(2, -float(rank)) + _field(3, kind))
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, size)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes whole texts inside a task; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {token: np.uint32(rank).tobytes() for token, rank in ranks.items()}
        # The same white space in every library: the Unicode property.
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.cut = regex.compile(pattern).findall
        self.words: dict[str, bytes | None] = {}
        self.held = 0

    def _tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens: a whole vocabulary entry as itself, others by merges."""
        raw = [token.encode() for token in tokens]
        ids = list(map(self.whole.get, raw))
        new = [place for place, known in enumerate(ids) if known is None]
        merged = self.model.encode([letters(raw[place]) for place in new], num_threads=1) if new else []
        packed = np.fromiter(chain.from_iterable(merged), np.dtype("<u4")).tobytes()
        begin = 0
        for place, found in zip(new, merged, strict=True):
            ids[place] = packed[begin : (begin := begin + 4 * len(found))]
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(self._tokens(self.cut(text)))

    def _learn(self, words: set[str]) -> None:
        """Encode words, each after a blank; those with white space at an end are marked None."""
        inner = [w for w in words if w and not (w[0].isspace() or w[-1].isspace())]
        self.words.update(dict.fromkeys(words))
        if not inner:
            return
        tokens = self.cut(" " + " ".join(inner))
        ids = self._tokens(tokens)
        starts = [place for place, token in enumerate(tokens) if token[0] == " "]
        for word, begin, end in zip(inner, starts, [*starts[1:], len(tokens)], strict=True):
            self.words[word] = found = ids[begin] if end == begin + 1 else b"".join(ids[begin:end])
            self.held += len(word) + len(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        No match of the pattern runs over the place before a blank that stands
        between two other characters. Texts are cut there, and each distinct word
        with its blank is encoded once. A text in which a blank touches other
        white space is cut by the pattern as a whole.
        """
        if len(self.words) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            self.words, self.held = {}, 0
        split = [text.split(" ") for text in texts]
        self._learn(set(chain.from_iterable(islice(words, 1, None) for words in split)) - self.words.keys())
        out = []
        for text, words in zip(texts, split, strict=True):
            first, rest = words[0], list(map(self.words.__getitem__, islice(words, 1, None)))
            if rest and (not first or first[-1].isspace() or None in rest):
                out.append(self._plain(text))
            else:
                out.append(self._plain(first) + b"".join(rest))
        return out


def _groups(column, limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of a bounded number of characters, with the first row of each run."""
    begin, texts, held = 0, [], 0
    for row, text in enumerate(large_strings(column)):
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= limit:
            yield begin, texts
            begin, texts, held = row + 1, [], 0
    if texts:
        yield begin, texts


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts: ``id_col`` and ``ids`` (binary, little-endian unsigned 32-bit integers).

    Each match of ``pattern`` is encoded on its own: a match that is a token
    becomes that token, others are merged by lowest rank. There are no special
    tokens. The vocabulary is read once on the driver (a file of bounded size) and
    goes to the tasks with the function; no shuffle takes place.

    Defined cases: null and empty texts have no ids; repeated rows and rows with
    null ids are encoded each; further columns are ignored; no rows give none.
    """
    ranks = read_ranks(ranks_path)
    model = model_bytes(ranks)
    rows = narrow(df, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, model, pattern)
        for batch in batches:
            for begin, texts in _groups(batch.column(1)):
                ids = pa.array(encoder.encode(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), ids], ["_id", "ids"])

    return rows.mapInArrow(run, f"_id {kind}, ids binary").select(F.col("_id").alias(id_col), "ids")


def decode(ids: bytes, token: Callable[[int], bytes]) -> bytes:
    """The bytes of packed ids, by the inverse mapping."""
    return b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))


def decode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of encoded documents, by the inverse mapping: ``id_col`` and ``decoded`` (binary).

    Null ids give no bytes. An id outside the vocabulary or a length that is no
    multiple of four raises.
    """
    ranks = read_ranks(ranks_path)
    rows = narrow(df, _id=id_col, _ids=ids_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in ranks.items()}.__getitem__
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                decoded = [decode(ids.as_py() or b"", token) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decoded, pa.binary())], ["_id", "decoded"])

    return rows.mapInArrow(run, f"_id {kind}, decoded binary").select(F.col("_id").alias(id_col), "decoded")


def round_trip(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, decode the ids and digest both: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The same as ``encode_documents`` and ``decode_documents`` one after the other, in
    one Python worker instead of two. Defined cases as there.
    """
    ranks = read_ranks(ranks_path)
    model = model_bytes(ranks)
    rows = narrow(df, _id=id_col, _text=text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, model, pattern)
        token = {rank: raw for raw, rank in ranks.items()}.__getitem__
        for batch in batches:
            for begin, texts in _groups(batch.column(1)):
                ids = encoder.encode(texts)
                decoded = [decode(x, token) for x in ids]
                columns = [batch.column(0).slice(begin, len(texts)), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_ids", "_decoded"])

    return rows.mapInArrow(run, f"_id {kind}, _ids binary, _decoded binary").select(
        F.col("_id").alias(id_col),
        F.expr("octet_length(_ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )
