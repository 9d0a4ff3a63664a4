"""Byte-level BPE by a sentencepiece model written from a table of ranks."""

from __future__ import annotations

import base64
import codecs
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters that stand for the 256 bytes: one block of letters without spaces or marks.
BYTES = "".join(chr(0x100 + b) for b in range(256))
_TO_BYTES = codecs.charmap_build(BYTES)
#: Encoded parts a task remembers, the longest one it remembers, and the parts it gathers before it encodes them.
REMEMBERED, REMEMBERED_CHARS, HELD = 250_000, 64, 100_000
#: Rows whose Python objects a task holds at once.
ROWS = 512
#: Fields of the model file: pieces, trainer and normaliser; type BPE, kinds of pieces (fixed values of its format).
_PIECES, _TRAINER, _NORMALIZER, _BPE, _NORMAL, _UNKNOWN = 1, 2, 3, 2, 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks; the file is read on the driver and must hold every single byte."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no token for the bytes {missing}")
    return ranks


def mapped(data: bytes) -> str:
    """A character for every byte."""
    return codecs.charmap_decode(data, "strict", BYTES)[0]


def unmapped(text: str) -> bytes:
    return codecs.charmap_encode(text, "strict", _TO_BYTES)[0]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece of id i has rank order i; earlier ranks merge first.

    Pieces are tokens with a character for every byte, scored by negative rank;
    the text is taken as it is.  The unknown piece, which no text needs, comes last.
    """
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        pieces.append(_field(1, mapped(token).encode()) + _field(2, float(-rank)) + _field(3, _NORMAL))
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN))
    # kind of model; number of pieces; ids of the special pieces: unknown, none for begin, end and padding
    none = 2**64 - 1
    trainer = _field(3, _BPE) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(k, none) for k in (41, 42, 43))
    # no added, removed or escaped spaces
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(_PIECES, p) for p in pieces) + _field(_TRAINER, trainer) + _field(_NORMALIZER, normalizer)


class _Encoder:
    """Ids of texts as little-endian bytes; parts met before are remembered, up to a bound."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = np.array(sorted(ranks.values()), "<u4")
        # a part that is a token needs no merges
        self.tokens = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.parts, self.known = regex.compile(pattern), {}

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of parts; those that are no token go through the model together."""
        found = {p: self.tokens.get(p.encode()) for p in new}
        rest = [p for p, ids in found.items() if ids is None]
        ids = self.pieces.encode([mapped(p.encode()) for p in rest], num_threads=1) if rest else []
        data = self.ids[np.fromiter(itertools.chain.from_iterable(ids), np.int64)].tobytes()
        start = 0
        for part, n in zip(rest, map(len, ids), strict=True):
            found[part] = data[start: start + 4 * n]
            start += 4 * n
        self.known.update(found)

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        parts = set().union(*(found for _, found in waiting))
        new = parts.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, parts
        self._learn(list(new))
        for at, found in waiting:
            out[at].append(b"".join(map(self.known.__getitem__, found)))
        for part in new:
            if len(part) > REMEMBERED_CHARS:
                del self.known[part]
        waiting.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for at, text in enumerate(texts):
            matches = (m.group() for m in self.parts.finditer(text or "")) if len(text or "") > HELD else iter(self.parts.findall(text or ""))
            while found := list(itertools.islice(matches, HELD)):
                waiting.append((at, found))
                held += len(found)
                if held >= HELD:
                    self._flush(waiting, out)
                    held = 0
        if waiting:
            self._flush(waiting, out)
        return [b"".join(x) for x in out]


def _in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """The documents with their token ids in a column ``to``: unsigned 32-bit integers, little-endian, as binary.

    Every match of ``pattern`` is encoded by itself.  A null or empty text has no
    ids; texts of any length are encoded whole.  Rows are kept as they are, with all
    their columns; a column named ``to`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((piece_model(ranks), ranks))
    kept = [c for c in docs.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(*shared.value, pattern)
        for batch in batches:
            for part in _in_slices(batch):
                found = encoder.encode(part.column(kept.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*kept, to])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(to, T.BinaryType())])
    return docs.select(*kept).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids in a column ``to``, by the pieces of the model mapped back to bytes.

    Null ids decode to no bytes; an id without a token fails.  Rows are kept with all their
    columns; a column named ``to`` is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast((piece_model(ranks), sorted(ranks.values())))
    kept = [c for c in rows.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, order = shared.value
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = {rank: unmapped(piece) for rank, piece in zip(order, pieces.id_to_piece(list(range(len(order)))), strict=True)}
        for batch in batches:
            for part in _in_slices(batch):
                found = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(kept.index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*kept, to])

    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(to, T.BinaryType())])
    return rows.select(*kept).mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    ranks = read_ranks(path or public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    return decode_ids(encoded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
