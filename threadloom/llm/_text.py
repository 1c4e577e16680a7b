"""Vectorised text primitives shared by the corpus operators.

Everything here works on whole Arrow batches: Arrow splits and dictionary-encodes the
words, each *distinct* word of a slice is normalised and hashed once, and numpy does the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes of text handled at once; bounds a worker's memory whatever a batch holds.
SLICE_BYTES = 3_000_000


_RANDOM = np.random.default_rng(20_201)
_BYTES = _RANDOM.integers(0, 1 << 64, 256, U64)
_PLACES = _RANDOM.integers(0, 1 << 64, 1 << 12, U64) | U64(1)


def normal(words: pa.Array) -> pa.Array:
    """Words as the corpus operators compare them: lower case, letters and digits only."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pN]+", "")


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes (sum over bytes of a random number for the byte times one for its place, then
    mixed); 0 for an empty string. Strings of over 4096 bytes are hashed one by one."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    if n == 0:
        return np.zeros(0, U64)
    at = np.frombuffer(strings.buffers()[1], np.int64, n + 1, strings.offset * 8)
    size = np.diff(at)
    raw = strings.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    starts = at[:-1] - at[0]
    place = np.arange(len(data)) - np.repeat(starts, size)
    out = np.zeros(n, U64)
    some = size > 0
    with np.errstate(over="ignore"):
        if some.any():
            out[some] = np.add.reduceat(_BYTES[data] * _PLACES[place & 4095], starts[some])
        out = mix(out + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    for k in np.flatnonzero(size > 4096):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + size[k]].tobytes())
    return np.where(some, np.maximum(out, U64(1)), U64(0))


def slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch, each of at most ``most`` bytes of text or of one row."""
    most = most or SLICE_BYTES
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between white space, of all texts in order, as indices into their distinct
    words, and where each text begins and ends among them. A null text has no word."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    encoded = flat.dictionary_encode()
    ids = encoded.indices.to_numpy(zero_copy_only=False)
    ends = np.asarray(parts.offsets)[: len(texts) + 1].astype(np.int64)
    return ids, encoded.dictionary, ends - ends[0]


def keep(ids: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements under a mask, and the offsets that then hold."""
    count = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=count[1:])
    return ids[mask], count[offsets]


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words that have letters or digits, as indices into hashes of the distinct ones; those hashes; each
    text's offsets."""
    ids, vocabulary, offsets = split(texts)
    table = hash_strings(normal(vocabulary))
    mask = table[ids] != 0 if len(table) else np.zeros(0, bool)
    ids, offsets = keep(ids, offsets, mask)
    return ids, table, offsets


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words that have letters or digits, and each text's offsets."""
    ids, table, offsets = word_table(texts)
    return (table[ids] if len(table) else np.zeros(0, U64)), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: makes the order of the values that of random numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each place on (the last n - 1 places are left out)."""
    count = max(0, len(hashes) - n + 1)
    total = np.zeros(count, U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * U64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    return mix(total)


def gram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text; a shorter text is one gram of all its
    words, and a text without words has none."""
    if len(hashes) == 0:
        return hashes
    return np.unique(grams(hashes, min(n, len(hashes))))


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", most: int | None = None):
    """A function for ``mapInArrow`` that applies ``fn`` to bounded parts of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    return run


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel in ``a``."""
    place: dict = {}
    for k, x in enumerate(a):
        place[x] = place.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = place.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()
