"""Byte-level BPE: the vocabulary file, pieces of a text, and merge counting.

Texts are cut before every blank that follows and precedes a non-blank; a piece of the tokenizer's
pattern never spans such a cut, so tokens of the text are the tokens of its cuts. Arrow
dictionary-encodes the cuts, and each distinct cut of a slice is tokenized once. Texts with runs of three or more blanks, where the pattern looks across blanks, are tokenized whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Where the public vocabulary files lie; a parameter of every operator that needs one.
VOCABULARY = os.environ.get("THREADLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose lengths a worker remembers.
CACHE = 600_000


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    out = np.zeros(max(ranks(path).values()) + 1, np.int64)
    for token, k in ranks(path).items():
        out[k] = len(token)
    return out


def cuts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Cuts of all texts as indices into the distinct ones; which of these begin with the cut's blank and may
    be joined; each text's offsets. Null: none."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, r"\s\s\s|[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]").to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts, " ")
    flat = parts.flatten().dictionary_encode()
    ids, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    ends = np.asarray(parts.offsets).astype(np.int64)
    ends = ends - ends[0]
    n = len(words)
    # A text's first cut has no blank before it; each later one does.
    first = np.zeros(len(ids), bool)
    filled = np.diff(ends) > 0
    first[ends[:-1][filled]] = True
    ids = np.where(first, ids, ids + n)
    keep = np.ones(len(ids), bool)
    empty = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))
    if len(empty):
        keep &= ids != empty[0]
    whole = np.flatnonzero(odd)
    for place, k in enumerate(whole):
        keep[ends[k] : ends[k + 1]] = False
        keep[ends[k]] = True
        ids[ends[k]] = 2 * n + place
    if not keep.all():
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        ids = ids[keep]
    used, ids = np.unique(ids, return_inverse=True)
    plain = words.take(pa.array(used[used < n]))
    after = words.take(pa.array(used[(used >= n) & (used < 2 * n)] - n))
    edge = pc.or_(pc.or_(pc.starts_with(after, "\n"), pc.ends_with(after, "\n")), pc.equal(after, "")).to_numpy(zero_copy_only=False)
    joint = np.zeros(len(used), bool)
    joint[len(plain) : len(plain) + len(after)] = ~edge
    vocabulary = pa.concat_arrays([plain, pc.binary_join_element_wise(" ", after, "").cast(pa.string()), texts.take(pa.array(whole)).cast(pa.string())])
    return ids, vocabulary, joint, ends


def token_ids(texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Token ids (uint16 or uint32) of all texts in order, and each text's offsets."""
    ids, vocabulary, joint, ends = cuts(texts)
    enc = encoding(path).encode_ordinary
    kind = np.uint16 if len(ranks(path)) <= 1 << 16 else np.uint32
    # Cuts that begin with a blank are tokenized as one text, and parted again by the tokens' lengths.
    order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
    joined, others = vocabulary.filter(pa.array(joint)), vocabulary.filter(pa.array(~joint)).to_pylist()
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined), "")[0].as_py() or ""
    together = np.array(enc(text), kind)
    ends_of = np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64))
    reached = np.searchsorted(np.cumsum(lengths(path)[together]), ends_of, side="left") + 1
    rest = [np.array(enc(w), kind) for w in others]
    sizes = np.concatenate([np.diff(reached, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
    size, start = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    size[order] = sizes
    start[order] = np.cumsum(sizes) - sizes
    flat = np.concatenate([together, *rest])
    count = size[ids]
    total = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(start[ids] - total[:-1], count) + np.arange(total[-1])
    return flat[at], total[ends]


_COUNTS: dict[str, int] = {}


def merged_length(piece: bytes, rank: dict[bytes, int]) -> int:
    """Tokens of one piece: its bytes less the merges made. Symbols form a doubly linked list; a heap
    yields the adjacent pair of lowest rank (leftmost of equals), and entries made stale by a merge are skipped."""
    n = len(piece)
    if n < 2 or piece in rank:
        return 1 if n else 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # where the symbol that begins here ends; 0: merged into another
    heap = []
    for k in range(n - 1):
        r = rank.get(piece[k : k + 2])
        if r is not None:
            heap.append((r, k, k + 2))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, k, stop = heapq.heappop(heap)
        j = after[k] if end[k] else n
        if j >= n or end[j] != stop or not end[k]:
            continue
        end[k], end[j] = stop, 0
        nxt = after[k] = after[j]
        if nxt < n:
            before[nxt] = k
            r = rank.get(piece[k : end[nxt]])
            if r is not None:
                heapq.heappush(heap, (r, k, end[nxt]))
        prv = before[k]
        if prv >= 0:
            r = rank.get(piece[prv:stop])
            if r is not None:
                heapq.heappush(heap, (r, prv, stop))
        merges += 1
    return n - merges


_SPLIT = regex.compile(PATTERN)


def piece_length(piece: str, rank: dict[bytes, int]) -> int:
    got = _COUNTS.get(piece)
    if got is None:
        got = merged_length(piece.encode(), rank)
        if len(piece) < 64:
            if len(_COUNTS) >= CACHE:
                _COUNTS.clear()
            _COUNTS[piece] = got
    return got


def token_counts(texts: pa.Array, path: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text."""
    ids, vocabulary, _, ends = cuts(texts)
    rank = ranks(path)
    size = np.zeros(len(vocabulary), np.int64)
    for k, w in enumerate(vocabulary.to_pylist()):
        if w[1:].isalpha() and (w[0] == " " or w[0].isalpha()):
            size[k] = piece_length(w, rank)
        else:
            size[k] = sum([piece_length(p, rank) for p in _SPLIT.findall(w)])
    total = np.concatenate([[0], np.cumsum(size[ids])])[ends]
    return np.diff(total)
