"""Byte-level BPE encoding and decoding (operator 5).

The ``tokenizers`` library runs over Arrow batches. The vocabulary's own split
pattern cuts a text into pieces that the merges never cross, so each distinct
piece is encoded once per worker and looked up afterwards; the piece table is
bounded and only saves time. Token strings of the library spell bytes as
printable characters; :func:`byte_alphabet` is that table, its reverse gives
the bytes of each id, and cumulative byte lengths give character offsets.

Nulls and empty texts have no tokens and decode to no bytes. Characters that a
token boundary cuts belong to every token that holds one of their bytes.
Repeated rows give repeated results; input columns whose names clash with the
output are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import small_batches, table, without

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces that a worker remembers; further pieces are encoded anew.
PIECES = 400_000


def byte_alphabet() -> list[str]:
    """Character that spells each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Codec:
    """One worker's tokenizer, piece table and reversed byte table."""

    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(pattern).findall
        spelled = {c: b for b, c in enumerate(byte_alphabet())}
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_of = {str(i): bytes(spelled[c] for c in s) for s, i in vocab.items() if all(c in spelled for c in s)}
        self.pieces: dict[str, str] = {}

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by one space."""
        known, cut = self.pieces, [self.split(t) for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in known})
        full = len(known) + len(new) > PIECES
        extra: dict[str, str] = {} if full else known
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                extra[p] = " ".join(map(str, e.ids))
        if not full:
            return [" ".join(map(known.__getitem__, pieces)) for pieces in cut]
        return [" ".join([known[p] if p in known else extra[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""

    def offsets(self, text: str, ids: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of each token in code points."""
        sizes = np.array([len(self.bytes_of[i]) for i in ids.split(" ")] if ids else [], dtype=np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return (char_of[ends - sizes], char_of[ends - 1] + 1) if len(ends) else (ends, ends)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: str, pattern: str) -> Codec:
    key = (vocabulary, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def _runs(texts: list[str], most: int = 4_000_000):
    """Slices of a batch that hold at most ``most`` characters, or one text."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    yield start, len(texts)


def encode(docs: DataFrame, text_col: str = "text", *, vocabulary: str | None = None, pattern: str | None = None, ids: bool = True, offsets: bool = False, digests: bool = False, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens`` and, as asked for, ``ids``, ``starts``/``ends``, and the SHA-256 of the joined ids and of the decoded bytes."""
    small_batches(docs.sparkSession)
    path, pat = default_vocabulary()
    path, pat = vocabulary or path, pattern or pat
    new = [("n_tokens", T.LongType())]
    new += [("ids", T.ArrayType(T.IntegerType()))] * ids
    new += [("starts", T.ArrayType(T.IntegerType())), ("ends", T.ArrayType(T.IntegerType()))] * offsets
    new += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] * digests
    source = without(docs, [n for n, _ in new if n.lower() != text_col.lower()])
    schema = T.StructType([f for f in source.schema.fields if keep_text or f.name != text_col] + [T.StructField(n, t) for n, t in new])

    def run(batches):
        c = codec(path, pat)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            for a, b in _runs(texts):
                part = texts[a:b]
                joined = c.encode(part)
                cols = [batch.column(i).slice(a, b - a) for i, f in enumerate(batch.schema) if keep_text or f.name != text_col]
                cols.append(pa.array([s.count(" ") + 1 if s else 0 for s in joined], pa.int64()))
                if ids:
                    flat = [np.array(s.split(" ") if s else [], dtype=np.int32) for s in joined]
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, flat)], dtype=np.int32), np.concatenate([*flat, np.zeros(0, np.int32)])))
                if offsets:
                    spans = [c.offsets(t, s) for t, s in zip(part, joined)]
                    cols += [pa.array([list(map(int, s[k])) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                if digests:
                    cols.append(pa.array([hashlib.sha256(s.encode()).hexdigest() for s in joined]))
                    cols.append(pa.array([hashlib.sha256(c.decode(s)).hexdigest() for s in joined]))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", *, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every row with the bytes that its ids spell (``out_col``, binary; null ids: no bytes)."""
    path, pat = default_vocabulary()
    path, pat = vocabulary or path, pattern or pat
    source = without(rows, [out_col])
    schema = T.StructType([*source.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        c = codec(path, pat)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            found = [b"".join(c.bytes_of[str(i)] for i in x or ()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ids=False, digests=True)
