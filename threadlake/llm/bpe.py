"""Byte-level BPE through a sentencepiece model serialised from the vocabulary.

The rank file's tokens become pieces: each byte is mapped to one printable
character and a piece's score is its negative rank, so that sentencepiece's "best
scored pair first, leftmost on ties" is the rank order.  Normalisation is the
identity and no dummy prefix is added.  A text is cut by the pre-token pattern and
each pre-token is encoded alone; decoding maps ids back to the vocabulary's bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import table

#: Pre-tokens whose ids a worker remembers, and the longest one that it does.
MEMO, MEMO_CHARS = 400_000, 32


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece 1 + r is the token of rank r."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))

    pieces = [piece("<unk>", 0.0, 2)] + [piece("".join(chars[b] for b in token), -float(rank), 1) for rank, token in enumerate(tokens)]
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces)))  # model_type BPE, vocab_size
    identity = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))  # no dummy prefix, white space untouched
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, identity)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not consecutive")
    return [ranks[r] for r in range(len(ranks))]


class ByteBpe:
    """Encoder and decoder of one vocabulary in one Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        # the pattern's \s is the White_Space property, without U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.mapping = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.memo: dict[str, list[int]] = {}

    def _ids(self, token: str) -> list[int]:
        mapped = token.encode().decode("latin-1").translate(self.mapping)
        ids = [i - 1 for i in self.model.encode(mapped)]
        if len(token) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for token in self.split(text):
            ids = memo.get(token)
            out += self._ids(token) if ids is None else ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def _codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids array<int>, decoded binary for every row of docs.

    Null and empty texts have no ids and decode to no bytes.  No special tokens.
    Rows are independent: repeated ids and null ids are returned as they come.
    ``ranks_path`` must be readable where Python workers run.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids, decoded, start, size = [], [], at, 0
                while at < batch.num_rows and size < 1_000_000:
                    one = codec.encode(batch.column(1)[at].as_py() or "")
                    decoded.append(codec.decode(one))
                    ids.append(np.array(one, dtype=np.int32))
                    size, at = size + len(one), at + 1
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), lists, pa.array(decoded, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    coded = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
