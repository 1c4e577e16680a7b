"""Benchmark decontamination by latent semantic retrieval.

1. One pass turns every text into terms and keeps them, two bytes a word, in the shared folder; all later passes read only
   those. The benchmark's words are terms of their own, all other words are hashed to ``OTHER`` terms.
2. A pass counts in how many passages (blocks of ``BLOCK`` words) each term occurs.
3. Another gives the product A'(A W) of the TF-IDF matrix A of all passages with a random matrix W: each task
   sends one small dense sum, and the sums are added in a streaming reduction. The leading right singular vectors and
   values follow from it by the Nyström form of the randomised decomposition.
4. Items and windows are compared by the cosine of their latent coordinates (scaled to unit variance); windows are folded in by the
   words that items have at all. A window is about as long as its items (the next power of two, half overlapping), over the whole of every
   text. Every window is a query against every item of its length, by matrix products; where it or a neighbour
   reaches ``COSINE`` it is a candidate.
5. For candidates the longest common subsequence is computed, over the window and half a window on both sides; not for those that can't
   reach it: of the item's rarest words, more than it may lack, ``SURPLUS`` must be in the span (an exact bound). A document leaks an item if the
   subsequence holds ``LCS`` of the item's words, and ``ANSWER`` of those of its answer (the last sentence
   of three words or more, whole).

The benchmark is worked through in shards of ``SHARD`` items, so that neither the driver nor a broadcast holds more, however many there are.

Recall. Steps 1 to 3 and 5 lose nothing; step 4 is approximate: see the README for measured recall by how much of an item is replaced.

Defined results. Null or empty texts and items, or without letters: never a leak. Items with a null
item_id aren't looked for; null doc_ids are left out of leaks(); drop_leaks judges their rows by their texts like any other. Very long texts
are searched whole. Repeated rows and items give equal rows once; of several spans of a document with one item the one with the longest subsequence is
given, of ties the first. With an empty benchmark or no documents the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import durable, only, row_key, settle, without

BLOCK, OTHER, RANK, EXTRA, CHUNKS, SHARD = 32, 8192, 48, 8, 16, 20_000
COSINE, LCS, ANSWER, SHORTEST, SURPLUS = 0.2, 0.6, 0.5, 16, 3
#: Entries of a matrix of cosines, and bytes of terms, that are held at once.
ENTRIES, TERM_BYTES = 4_000_000, 400_000


class Items:
    """The benchmark's words, sorted, and each item's words as their places (terms below ``places``; others stand below ``width``)."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted({(k, t) for k, t in rows if k is not None and t})
        hashes, offsets = T.words(pa.array([t for _, t in rows], pa.string()))
        self.known = np.unique(hashes)
        self.places = len(self.known)
        self.width = self.places + OTHER
        self.kind = np.uint16 if self.width < (1 << 16) - 1 else np.uint32
        self.ids, self.words, self.answers = [], [], []
        for (k, text), a, b in zip(rows, offsets[:-1], offsets[1:], strict=True):
            if b > a:
                self.ids.append(k)
                self.words.append(np.searchsorted(self.known, hashes[a:b]))
                last = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if len(s.split()) >= 3]
                tail = len(T.words(pa.array([last[-1]]))[0]) if last else b - a
                self.answers.append(int(min(max(tail, 1), b - a)))
        self.scale = [max(SHORTEST, 1 << int(np.ceil(np.log2(len(w))))) for w in self.words]

    def place(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term of every word, and each text's offsets."""
        ids, table, offsets = T.word_table(texts)
        at = np.searchsorted(self.known, table)
        at[at == len(self.known)] = 0
        places = np.where(self.known[at] == table, at, self.places + (table % T.U64(OTHER)).astype(np.int64)).astype(self.kind)
        return (places[ids] if len(places) else np.zeros(0, self.kind)), offsets

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Terms and offsets from a kept column."""
        size = np.dtype(self.kind).itemsize
        at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        return np.frombuffer(data.tobytes(), self.kind), ((at - at[0]) // size).astype(np.int64)


def kept(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id and terms (binary) of every text with words, in the shared folder."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, offsets = items.place(batch["text"].cast(pa.string()))
        data = pa.py_buffer(places.tobytes())
        ends = pa.py_buffer((offsets * places.itemsize).astype(np.int32).tobytes())
        return pa.record_batch([batch["doc_id"], pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, data])], ["doc_id", "terms"])

    return durable(docs.mapInArrow(T.per_slice(fn), "doc_id long, terms binary"), "terms")


def passages(offsets: np.ndarray) -> np.ndarray:
    """Passage number of every word."""
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    return np.repeat(first, size) + inside // BLOCK


def in_blocks(place: np.ndarray, offsets: np.ndarray, width: int, empty: int) -> np.ndarray:
    """A row for each block of ``width`` words, aligned to each text, filled up with ``empty``."""
    size = np.diff(offsets)
    blocks = -(-size // width)
    first = np.cumsum(blocks) - blocks
    out = np.full(int(blocks.sum()) * width, empty, place.dtype)
    out[np.arange(offsets[-1]) + np.repeat(first * width - offsets[:-1], size)] = place
    return out.reshape(-1, width)


def block_sums(table: np.ndarray, place: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Sums of the table's rows over blocks of ``width`` words, aligned to each text; the table's last row is zero."""
    padded = in_blocks(place, offsets, width, len(table) - 1)
    total = np.zeros((len(padded), table.shape[1]), table.dtype)
    for k in range(width):
        total += table[padded[:, k]]
    return total


def _sum_pass(terms: DataFrame, items: Items, shape: tuple[int, ...], add) -> np.ndarray:
    """Sum over the corpus of what ``add`` adds to an array for each slice of texts; one
    array from each task, reduced chunk by chunk in a stream."""
    kind = np.float32 if len(shape) > 1 else np.float64

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in T.slices(batch, "terms", TERM_BYTES):
                add(total, *items.read(part["terms"]))
        yield pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array([x.astype(kind).tobytes() for x in np.array_split(total, CHUNKS)], pa.binary())], ["chunk", "part"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch["chunk"].to_pylist(), batch["part"], strict=True):
                x = np.frombuffer(part.as_buffer(), kind).astype(np.float64)
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "part"])

    parts = terms.select("terms").mapInArrow(local, "chunk int, part binary").repartition("chunk").mapInArrow(reduce, "chunk int, part binary")
    found = {r["chunk"]: np.frombuffer(r["part"]) for r in parts.collect()}
    flat = np.concatenate([found[k] for k in range(CHUNKS)]) if found else np.zeros(int(np.prod(shape)))
    return flat.reshape(shape)


def latent(terms: DataFrame, items: Items, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """width + 1 x RANK: what each word of a text adds to its latent coordinates (the last row is zero); and in how many passages
    each term occurs."""
    width = items.width

    def count(total: np.ndarray, place: np.ndarray, offsets: np.ndarray) -> None:
        rows = np.sort(in_blocks(place, offsets, BLOCK, width), axis=1)
        new = rows < width
        new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        total[:width] += np.bincount(rows[new], minlength=width)
        total[width] += len(rows)

    df = _sum_pass(terms, items, (width + 1,), count)
    idf = np.log((df[width] + 1) / (df[:width] + 1)) + 0.1
    W = np.random.default_rng(seed).normal(size=(width, RANK + EXTRA))
    projected = np.concatenate([idf[:, None] * W, np.zeros((1, RANK + EXTRA))]).astype(np.float32)
    square = np.append(idf**2, 0.0)[:, None]

    def multiply(total: np.ndarray, place: np.ndarray, offsets: np.ndarray) -> None:
        y = block_sums(projected, place, offsets, BLOCK)
        y /= np.maximum(block_sums(square, place, offsets, BLOCK), 1e-12).astype(np.float32)
        order = np.argsort(place, kind="stable")
        ordered, where = place[order], passages(offsets)[order]
        begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else order
        if len(begins):
            for k, column in enumerate(np.ascontiguousarray(y.T)):  # a column at a time: several times faster than rows
                total[ordered[begins], k] += np.add.reduceat(column[where], begins)

    Y = _sum_pass(terms, items, (width, RANK + EXTRA), multiply) * idf[:, None]
    core = W.T @ Y
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    value = np.maximum(value, 1e-9 * max(value.max(), 1e-12))
    factor = Y @ (vector / np.sqrt(value))
    left, sigma, _ = np.linalg.svd(factor, full_matrices=False)
    keep = sigma[:RANK] > 1e-6 * max(sigma[0], 1e-12)
    table = idf[:, None] * left[:, :RANK][:, keep] / sigma[:RANK][keep]
    return np.concatenate([table, np.zeros((1, table.shape[1]))]).astype(np.float32), df[:width]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def rarest(items: Items, df: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By scale, for the exact bound: where each term's entries begin, the items and weights of the entries (places among the item's rarest
    words), and the weight that each item needs."""
    out = {}
    for s in set(items.scale):
        entries, need = [], np.zeros(len(items.ids))
        for k, w in enumerate(items.words):
            if items.scale[k] == s:
                lacking = len(w) - int(np.ceil(LCS * len(w) - 1e-9))
                rare = w[np.argsort(df[w], kind="stable")][: lacking + SURPLUS]
                need[k] = len(rare) - lacking
                terms, weight = np.unique(rare, return_counts=True)
                entries += [(t, k, c) for t, c in zip(terms.tolist(), weight.tolist(), strict=True)]
        table = np.array(sorted(entries))
        out[s] = (np.searchsorted(table[:, 0], np.arange(items.width + 2)), table[:, 1], table[:, 2], need)
    return out


@dataclass
class Index:
    """What a task needs to search for items; sent to every executor once."""

    items: Items
    table: np.ndarray
    vectors: np.ndarray
    bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def cosines(index: Index, items: np.ndarray, of: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosine of every window, or of its better neighbour in the same text, with every one of the items."""
    near = vectors @ index.vectors[items].T
    out = near.copy()
    for here, there in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        same = (of[here] == of[there])[:, None]
        np.maximum(out[here], near[there], out=out[here], where=same)
    return out


def search(shared, cosine: float):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        index: Index = shared.value
        items, table = index.items, index.table
        place, offsets = items.read(batch["terms"])
        if not len(place):
            return None
        n_items, scales = len(items.ids), sorted(set(items.scale))
        half = scales[0] // 2
        # Sums over half windows of the least scale, aligned to each text; larger windows are sums of those.
        size = np.diff(offsets)
        cells = -(-size // half)
        base = np.concatenate([[0], np.cumsum(cells)])
        starts = np.repeat(offsets[:-1], cells) + half * (np.arange(base[-1]) - np.repeat(base[:-1], cells))
        sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(block_sums(table, place, offsets, half), axis=0, dtype=np.float64)])
        owner = np.repeat(np.arange(len(size)), size)
        best: dict[tuple[int, int], tuple] = {}
        for s in scales:
            step = (s // 2) // half
            count = np.maximum(1, -(-(cells - step) // step)) * (cells > 0)
            first = np.cumsum(count) - count
            of = np.repeat(np.arange(len(size)), count)
            a = base[of] + (np.arange(len(of)) - first[of]) * step
            b = np.minimum(a + 2 * step, base[of + 1])
            vectors = unit((sums[b] - sums[a]).astype(np.float32))
            # The exact bound: weights of the item's rare words in the span (a window and half a one on both sides).
            begin, which, weight, need = index.bounds[s]
            many = (begin[1:] - begin[:-1])[place]
            hit = np.flatnonzero(many)
            many = many[hit]
            entry = np.repeat(begin[place[hit]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            hit = np.repeat(hit, many)
            doc = owner[hit]
            around = ((hit - offsets[doc]) // (s // 2))[:, None] + np.arange(-2, 2)
            doc, entry, around = np.repeat(doc, 4), np.repeat(entry, 4), around.reshape(-1)
            ok = (around >= 0) & (around < count[doc])
            key = np.sort((first[doc[ok]] + around[ok]) * len(which) + entry[ok])
            key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            entry = key % len(which)
            pair = key // len(which) * n_items + which[entry]
            order = np.argsort(pair, kind="stable")
            pair, entry = pair[order], entry[order]
            at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
            got = np.add.reduceat(weight[entry], at) if len(at) else at
            pair = pair[at]
            pair = pair[got >= need[pair % n_items]]
            window, item = pair // n_items, pair % n_items
            mine = np.array([k for k, x in enumerate(items.scale) if x == s])
            near = np.zeros(len(pair), np.float32)
            for k in range(0, len(mine), max(1, ENTRIES // len(of))):
                part = mine[k : k + max(1, ENTRIES // len(of))]
                cosine_of = cosines(index, part, of, vectors)
                here = np.flatnonzero(np.isin(item, part))
                near[here] = cosine_of[window[here], np.searchsorted(part, item[here])]
            for k in np.flatnonzero(near >= cosine):
                w, i, d = int(window[k]), int(item[k]), int(of[window[k]])
                words, begins = items.words[i], int(offsets[d])
                x = int(starts[a[w]])
                x, y = max(x - s // 2, begins), min(x + s + s // 2, int(offsets[d + 1]))
                span = place[x:y].tolist()
                length, m = T.lcs(words.tolist(), span), len(words)
                if length < LCS * m - 1e-9:
                    continue
                tail = words[-items.answers[i] :].tolist()
                answer = T.lcs(tail, span) / len(tail)
                row = (length / m, answer, float(near[k]), x - begins)
                if answer >= ANSWER - 1e-9 and ((d, i) not in best or row[:2] > best[d, i][:2]):
                    best[d, i] = row
        if not best:
            return None
        found = list(best.items())
        ids = batch["doc_id"].to_pylist()
        return pa.record_batch(
            [pa.array([ids[d] for (d, _), _ in found], pa.int64()), pa.array([items.ids[i] for (_, i), _ in found], pa.int64()), *(pa.array([round(float(r[k]), 4) for _, r in found], pa.float64()) for k in range(3)), pa.array([r[3] for _, r in found], pa.int64())],
            ["doc_id", "item_id", "lcs", "answer", "cosine", "word"],
        )

    return T.per_slice(fn, "terms", TERM_BYTES)


SCHEMA = "doc_id long, item_id long, lcs double, answer double, cosine double, word long"


def indexed(terms: DataFrame, items: Items) -> Index:
    table, df = latent(terms, items)
    settle()
    table[items.places :] = 0  # windows are folded in by the words that items have
    return Index(items, table, unit(np.stack([table[w].sum(0) for w in items.words])), rarest(items, df))


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, lcs and answer (shares of words found in order), cosine, word (where the span begins)."""
    spark = docs.sparkSession
    docs = only(docs, doc_id="long", text="string").where("doc_id is not null")
    asked = only(benchmark, item_id="long", text="string").where("item_id is not null and length(text) > 0").distinct()
    shards = -(-asked.count() // SHARD)
    found = spark.createDataFrame([], SCHEMA)
    for k in range(shards):
        items = Items([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect()])
        if items.ids:
            terms = kept(docs, items)
            found = found.unionByName(terms.mapInArrow(search(spark.sparkContext.broadcast(indexed(terms, items)), cosine), SCHEMA))
    return found.distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, each judged by its own text, with all their columns."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    return without(docs, durable(leaks(keyed, benchmark).select("doc_id").distinct(), "leaks"))
