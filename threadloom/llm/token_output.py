"""Token-ID / binary output in directly addressable codes, and token counts.

A document's ids are cut into chunks of ``CHUNK`` bits, lowest first. Level 0 holds the first chunk
of every id, level 1 the second chunk of those ids that have one, and so on. A bitmap of each level says which
of its entries go on, and a rank directory holds the number of set bits before every block of
``BLOCK`` bits. Token i is read from level 0 at i; while the bit is set, its place on the next level
is the rank of the bit. No block is decoded.

Layout of ``codes`` (little endian): u32 number of ids, u8 number of levels, u8 chunk bits,
u16 block bits; then for each level u32 number of entries, the entries (one byte each), the bitmap
(least bit first, whole bytes) and the directory (u32 for each block begun).

Defined results. Null or empty text: no ids, 0 levels, an 8-byte record. Repeated rows and null
doc_ids are written like any row. Very long texts are one record. An empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from . import bpe
from ._spark import only

CHUNK, BLOCK = 8, 512
SCHEMA = "doc_id long, n_tokens long, codes binary"


def encode(ids: np.ndarray) -> bytes:
    values, parts, levels = ids.astype(np.uint32), [], 0
    while len(values):
        rest = values >> CHUNK
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
        directory = (np.cumsum(counts) - counts).astype("<u4")
        parts += [struct.pack("<I", len(values)), (values & ((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
        values = rest[more]
        levels += 1
    return struct.pack("<IBBH", len(ids), levels, CHUNK, BLOCK) + b"".join(parts)


class Codes:
    """Random access to the ids of one record."""

    def __init__(self, record: bytes):
        self.n, levels, self.chunk, self.block = struct.unpack_from("<IBBH", record)
        self.levels, at = [], 8
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", record, at)
            bitmap, directory = at + 4 + n, at + 4 + n + (n + 7) // 8
            self.levels.append((at + 4, bitmap, directory))
            at = directory + 4 * ((n + self.block - 1) // self.block)
        self.record = record

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (entries, bitmap, directory) in enumerate(self.levels):
            value |= self.record[entries + i] << (level * self.chunk)
            if not self.record[bitmap + i // 8] >> (i % 8) & 1:
                break
            block = i // self.block
            (rank,) = struct.unpack_from("<I", self.record, directory + 4 * block)
            start = block * self.block
            bits = int.from_bytes(self.record[bitmap + start // 8 : bitmap + i // 8 + 1], "little") & ((1 << (i - start)) - 1)
            i = rank + bits.bit_count()
        return value


def decode(record: bytes) -> np.ndarray:
    """All ids of a record."""
    n, levels, chunk, block = struct.unpack_from("<IBBH", record)
    out, at, where = np.zeros(n, np.uint32), 8, np.arange(n)
    for level in range(levels):
        (m,) = struct.unpack_from("<I", record, at)
        out[where] |= np.frombuffer(record, np.uint8, m, at + 4).astype(np.uint32) << (level * chunk)
        bits = np.unpackbits(np.frombuffer(record, np.uint8, (m + 7) // 8, at + 4 + m), bitorder="little")[:m]
        where = where[bits > 0]
        at += 4 + m + (m + 7) // 8 + 4 * ((m + block - 1) // block)
    return out


def token_output(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, place: str | None = None) -> DataFrame:
    """doc_id, n_tokens, codes of every row, and the column ``place`` (long) if one is named. Rows stay in their order."""
    also = [place] if place else []

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = bpe.token_ids(batch["text"].cast(pa.string()), vocabulary)
        codes = [encode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.record_batch([batch["doc_id"], pa.array(np.diff(ends)), pa.array(codes, pa.binary()), *(batch[c] for c in also)], ["doc_id", "n_tokens", "codes", *also])

    rows = only(docs, doc_id="long", text="string", **dict.fromkeys(also, "long"))
    return rows.mapInArrow(T.per_slice(fn), ", ".join([SCHEMA, *(f"`{c}` long" for c in also)]))


def token_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every row, by heap-and-linked-list merging. Null or empty text has 0 tokens;
    repeated rows and null doc_ids are counted like any row, very long texts whole; ties between pairs of one rank are merged from the
    left; other columns may have any name; an empty table gives an empty result."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch["doc_id"], pa.array(bpe.token_counts(batch["text"].cast(pa.string()), vocabulary))], ["doc_id", "n_tokens"])

    return only(docs, doc_id="long", text="string").mapInArrow(T.per_slice(fn, most=2 * T.SLICE_BYTES), "doc_id long, n_tokens long")
