"""Byte-level BPE by sentencepiece: a model written straight from a rank file, its pieces the byte strings in printable
letters, scored by negative rank, with identity normalisation."""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from corkboard.llm.common import trim
from corkboard.llm.pretokens import CACHE_BYTES, Cache, Splitter, byte_letters, packed

#: Field numbers and kinds of the public sentencepiece_model.proto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, BYTE_FALLBACK, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 3, 4, 35, 40, 41, 42, 43, 45
BPE = 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5
#: The unknown piece that the library asks for; its letter stands for no byte.
UNKNOWN_PIECE = "⁇"


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised model whose piece ids are the ranks, which must be 0, 1, 2 ...; the unknown piece comes after them."""
    letters = byte_letters()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    out = []
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(letters[b] for b in piece).encode()
        out.append(_bytes(PIECES, _bytes(PIECE, name) + _varint(SCORE << 3 | 5) + struct.pack("<f", -rank) + _number(TYPE, NORMAL)))
    out.append(_bytes(PIECES, _bytes(PIECE, UNKNOWN_PIECE.encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", 0.0) + _number(TYPE, UNKNOWN)))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(ranks) + 1) + _number(BYTE_FALLBACK, 0) + _number(UNK_ID, len(ranks)) + _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1) + _bytes(UNK_PIECE, UNKNOWN_PIECE.encode())
    normalizer = _bytes(NAME, b"identity") + _number(ADD_DUMMY_PREFIX, 0) + _number(REMOVE_EXTRA_WHITESPACES, 0) + _number(ESCAPE_WHITESPACES, 0)
    return b"".join(out) + _bytes(TRAINER, trainer) + _bytes(NORMALIZER, normalizer)


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encodes and decodes by pre-token. A pre-token that is itself a piece is that piece, whatever merges would give."""

    def __init__(self, file: str, pattern: str, most: int = CACHE_BYTES):
        import sentencepiece

        self.ranks = read_ranks(file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.split = Splitter(pattern)
        letters = byte_letters()
        self.to_letters = dict(enumerate(letters))
        to_byte = {c: b for b, c in enumerate(letters)}
        self.piece_bytes = [bytes(map(to_byte.__getitem__, p)) for p in self.model.id_to_piece(list(range(len(self.ranks))))]
        self.names = list(map(str, range(len(self.ranks))))
        self.cache = Cache(lambda pieces: packed(self._ids(pieces)), most)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        mapped = [p.decode("latin-1").translate(self.to_letters) for p in raw]
        found = self.model.encode(mapped, num_threads=1)
        return [[self.ranks[r]] if r in self.ranks else ids for r, ids in zip(raw, found, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.cache.joined([self.split(t) for t in texts])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: each piece's letters back to bytes."""
        return b"".join(map(self.piece_bytes.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def byte_bpe(file: str, pattern: str, most: int = CACHE_BYTES) -> ByteBpe:
    return ByteBpe(file, pattern, most)


def encode(docs: DataFrame, file: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids array<int> added; null text counts as empty and has no ids. A column ids is replaced."""
    kept = docs.drop("ids")

    def encoded(batches):
        bpe = byte_bpe(file, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                rows = batch.slice(first, 100)
                ids = _id_lists(bpe.encode([t or "" for t in rows.column(text).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(encoded, StructType([*kept.schema.fields]).add("ids", ArrayType(IntegerType())))


def decode(rows: DataFrame, file: str, pattern: str) -> DataFrame:
    """rows with decoded binary added: the bytes of ids; null ids count as none."""
    kept = rows.drop("decoded")

    def decoded(batches):
        bpe = byte_bpe(file, pattern)
        for batch in batches:
            out = [bpe.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(decoded, StructType([*kept.schema.fields]).add("decoded", BinaryType()))


def round_trip(docs: DataFrame, file: str, pattern: str, with_ids: bool = False, keep: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids and the columns of `keep` if asked, of each row: encoded, decoded again, told by
    digests. Null text counts as empty: no ids, digests of nothing. Each document's own ids are decoded, by the model's
    pieces. Rows come in the order that they have in their partition. With `most`, a task's cache takes that many bytes, and its
    worker gives the model back too: for plans whose other stages need the memory."""

    def digested(batches):
        bpe = byte_bpe(file, pattern) if most is None else byte_bpe(file, pattern, most)
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, 100):
                    rows = batch.slice(first, 100)
                    n, told, back = [], [], []
                    encoded = bpe.encode([t or "" for t in rows.column("text").to_pylist()])
                    for found in encoded:
                        ids = np.frombuffer(found, "<u4").tolist()
                        n.append(len(ids))
                        told.append(hashlib.sha256(bpe.decimal(ids).encode()).hexdigest())
                        back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    columns = {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(told, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                    if with_ids:
                        columns["ids"] = _id_lists(encoded)
                    columns |= {c: rows.column(c) for c in keep}
                    yield pa.RecordBatch.from_pydict(columns)
        finally:  # a worker's later tasks may be of other stages
            bpe.cache.forget()
            if most is not None:
                byte_bpe.cache_clear()
                del bpe
                gc.collect()  # it is part of a cycle
            trim()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += (", ids array<int>" if with_ids else "") + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(digested, schema)


def _id_lists(encoded: list[bytes]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded])])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))
