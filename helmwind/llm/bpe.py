"""Byte-level BPE through a sentencepiece model serialised straight from the vocabulary.

Every byte becomes one private character, every vocabulary entry a piece of such
characters scored by its negative rank, and normalisation is the identity. The
pre-tokens of the split pattern are encoded one by one, so merges never cross them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwind.llm.common import documents

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Private characters of the 256 bytes start here; none is white space or a sentencepiece mark.
BYTE_BASE = 0x100
#: Pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
#: Longer pre-tokens are encoded but not remembered, so the memory is bounded in bytes as well.
REMEMBERED_BYTES = 64
MAX_VOCABULARY_BYTES = 16 << 20


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def private(data: bytes) -> str:
    """Bytes as private characters."""
    return data.decode("latin-1").translate(_PRIVATE)


_PRIVATE = {b: BYTE_BASE + b for b in range(256)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is <unk>, then one piece per vocabulary entry in rank order.

    Fixed numbers of the public sentencepiece schema: pieces 1 (piece 1, score 2,
    type 3 with 2 = unknown), trainer_spec 2 (model_type 3 with 2 = BPE,
    vocab_size 4), normalizer_spec 3 (name 1, add_dummy_prefix 3,
    remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, private(token).encode()) + _field(2, float(-rank))))
    out.append(_field(2, _field(3, 2) + _field(4, len(ranks) + 1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, blob: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(blob)
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = np.array([0] + [rank for _, rank in order], dtype="<u4")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in order}
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens as little-endian bytes; an entry of the vocabulary is its own id."""
        found, rest = {}, []
        for token in tokens:
            rank = self.ranks.get(token.encode("utf-8"))
            if rank is None:
                rest.append(token)
            else:
                found[token] = struct.pack("<I", rank)
        if rest:
            pieces = self.model.encode([private(t.encode("utf-8")) for t in rest], out_type=int, num_threads=1)
            for token, ids in zip(rest, pieces):
                found[token] = self.rank_of_piece[ids].tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as consecutive little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        known = self.known
        new = {t for t in tokens if t not in known}
        if not new:
            return b"".join([known[t] for t in tokens])
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(tokens)
        learnt = self._learn(sorted(new))
        known.update((t, ids) for t, ids in learnt.items() if len(t) <= REMEMBERED_BYTES)
        return b"".join([learnt.get(t) or known[t] for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encode_decode(docs: DataFrame, blob: bytes, carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns the ``carry`` columns (doc_id unless stated), n_tokens, ids_sha256,
    decoded_sha256 and, with ``with_ids``, ids array<int>. A null text is empty and
    has no ids; repeated rows are encoded each; an empty table gives an empty result;
    other columns are ignored.
    The vocabulary file is broadcast; it is refused above 16 MB.
    """
    if len(blob) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    carry = ["doc_id"] if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in carry) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, ids_sha, decoded_sha, kept = [], [], [], []
                for text in batch.column(batch.num_columns - 1):
                    ids = coder.encode(text.as_py() or "")
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(np.frombuffer(ids, dtype="<i4"))
                columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = [*carry, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*carry, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read(MAX_VOCABULARY_BYTES + 1)


def op2_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    blob = read_vocabulary(vocabulary or public_tokenizers.path(VOCABULARY))
    return encode_decode(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")), blob)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents' columns but text, and their token ids, counts and digests.

    A column of the documents that is named like one of these gets the prefix doc_.
    Null texts have no ids; repeated rows are encoded each; texts are encoded whole; an
    empty table gives an empty result.
    """
    blob = read_vocabulary(public_tokenizers.path(VOCABULARY))
    inner = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    carry = [f"c{i}" for i, c in enumerate(docs.columns) if c != "text"]
    found = encode_decode(inner.withColumn("text", F.col(f"c{docs.columns.index('text')}")), blob, carry=carry, with_ids=True)
    made = {"n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    names = [c if c not in made else f"doc_{c}" for c in docs.columns if c != "text"]
    return found.select(*[F.col(x).alias(c) for x, c in zip(carry, names)], *(c for c in found.columns if c in made))
