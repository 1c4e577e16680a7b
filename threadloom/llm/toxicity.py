"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of two hashed ones, of the word and of its first letters, so
inflected forms that the labels lack still resemble those they hold. Filters of several widths slide
over the whole text, each keeps its greatest answer (max pooling), and a logistic layer
combines them. Hashes that too few labelled texts hold share the zero embedding.

Scoring never multiplies word vectors: each distinct word's products with all filter slots are looked up
once per slice, and sliding a filter is a sum of shifted rows.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the least hashes of
doc_id. A quarter of them is held out to calibrate one threshold for each language: that with the greatest F1 over the language's own
rows and all others, which together weigh as much as ``BORROWED`` toxic ones. So a language with few toxic rows leans on the others,
one with many hardly does, and there is no number of rows at which it begins to count.

Defined results. Null or empty text: score 0, not toxic. A null or unseen language uses the threshold
of all languages. Labels without one of the two classes: nothing is toxic. Null labels and labels of
unknown documents are left out; of repeated labels the highest counts. Repeated documents are
scored alike, and of a tie between score and threshold the text isn't toxic. Very long texts are scored whole: one toxic passage
anywhere counts as much as in a short text. Every column of the input is kept, whatever its name. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from . import _text as T
from ._spark import bounded, only, settle

SAMPLE = 8_000
DIM, FILTERS, WIDTHS, PREFIX, LEAST = 8, 8, (1, 2, 3), 4, 3
EPOCHS, RATE, BATCH = 3, 0.1, 32
PAD = max(WIDTHS) - 1
#: Toxic rows that the other languages' held-out rows weigh as much as when a language is calibrated.
BORROWED = 15


@dataclass
class Model:
    known: np.ndarray  #: sorted hashes that have an embedding; row k + 1 is that of known[k], row 0 is zero
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  #: width -> (width, DIM, FILTERS)
    bias: np.ndarray  #: of all filters
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float]

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at + 1, 0)


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts with PAD empty places after each; the two hashes of each number (the last
    is the empty place); offsets."""
    ids, vocabulary, offsets = T.split(texts)
    form = T.normal(vocabulary)
    prefix = pc.if_else(pc.greater(pc.utf8_length(form), PREFIX), pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(form, 0, PREFIX), ""), "")
    table = np.zeros((len(vocabulary) + 1, 2), T.U64)
    table[:-1, 0], table[:-1, 1] = T.hash_strings(form), T.hash_strings(prefix)
    mask = (table[:-1, 0] != 0)[ids] if len(table) > 1 else np.zeros(0, bool)
    ids, offsets = T.keep(ids, offsets, mask)
    n = len(offsets) - 1
    padded = np.full(len(ids) + PAD * n, len(table) - 1, np.int32)
    padded[np.arange(len(ids)) + PAD * np.repeat(np.arange(n), np.diff(offsets))] = ids
    return padded, table, offsets + PAD * np.arange(n + 1)


def all_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_rows of very many texts, made part by part."""
    parts = [word_rows(texts.slice(k, 500)) for k in range(0, len(texts), 500)]
    tables = np.concatenate([t[:-1] for _, t, _ in parts])
    forms, first = np.unique(tables[:, 0], return_index=True)
    number = lambda t: np.append(np.searchsorted(forms, t[:-1, 0]), len(forms)).astype(np.int32)
    ids = np.concatenate([number(t)[i] for i, t, _ in parts])
    sizes = np.concatenate([np.diff(o) for _, _, o in parts])
    return ids, np.concatenate([tables[first], np.zeros((1, 2), T.U64)]), np.concatenate([[0], np.cumsum(sizes)])


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of toxicity of each text."""
    ids, table, offsets = word_rows(texts)
    if len(texts) == 0:
        return np.zeros(0)
    vectors = model.embedding[model.rows(table[:, 0])] + model.embedding[model.rows(table[:, 1])]
    pooled, empty = [], ids == len(table) - 1
    for width, weights in model.filters.items():
        answer = np.zeros((len(ids), FILTERS), np.float32)
        for j in range(width):
            answer[: len(ids) - j] += (vectors @ weights[j])[ids[j:]]
        answer[empty] = 0  # a filter that begins past a text's end would reach into the next text
        pooled.append(np.maximum.reduceat(answer, offsets[:-1]))
    z = np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0) @ model.out + model.out_bias
    p = 1 / (1 + np.exp(-z.astype(np.float64)))
    return np.where(np.diff(offsets) > PAD, p, 0.0)


def fit(texts: pa.Array, toxic: np.ndarray, langs: list[str | None], seed: int = 0, informed: bool = True) -> Model:
    """Train by adaptive gradient steps; if ``informed``, the first embedding dimension starts from each hash's log-odds
    (shrunk where few texts hold it), which the first filter of width 1 reads; else all start at random."""
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(toxic)) % 4 == 0
    ids, table, offsets = all_rows(texts)
    both = np.unique(table)
    both = both[both != 0]
    place = np.searchsorted(both, table)
    seen = np.zeros((2, len(both)))
    docs = [np.unique(ids[a : b - PAD]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for k in np.flatnonzero(~held):
        mine = table[docs[k]]
        seen[int(toxic[k]), np.unique(place[docs[k]][mine != 0])] += 1
    enough = seen.sum(0) >= LEAST
    known, count = both[enough], seen[:, enough]
    n = np.array([[(~held & (toxic == c)).sum()] for c in (0, 1)])
    odds = np.log((count[1] + 0.1) / (n[1] + 0.2)) - np.log((count[0] + 0.1) / (n[0] + 0.2))
    odds *= count.sum(0) / (count.sum(0) + LEAST)
    E = np.zeros((len(known) + 1, DIM), np.float32)
    E[1:] = rng.normal(0, 0.02, (len(known), DIM))
    if informed:
        E[1:, 0] = np.clip(odds, -2, 8) / 4
    Ws = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    if informed:
        Ws[WIDTHS[0]][0, 0, 0] = 1.0
    model = Model(known, E, Ws, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -2.0, {})
    if informed:
        model.out[0] = 1.0
    rows = np.stack([model.rows(table[:, 0]), model.rows(table[:, 1])], 1)
    store = {"E": np.full_like(E, 1e-2), "b": np.full_like(model.bias, 1e-2), "o": np.full_like(model.out, 1e-2), "c": 1e-2} | {w: np.full_like(x, 1e-2) for w, x in Ws.items()}
    weight = np.sqrt(max(1, n[0, 0]) / max(1, n[1, 0]))
    train = np.flatnonzero(~held & (np.diff(offsets) > PAD))
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            gW, gb, go, gc, touched, gE = {w: np.zeros_like(x) for w, x in Ws.items()}, np.zeros_like(model.bias), np.zeros_like(model.out), 0.0, [], []
            part = order[at : at + BATCH]
            for k in part:
                r = rows[ids[offsets[k] : offsets[k + 1]]]
                X = E[r[:, 0]] + E[r[:, 1]]
                best, where = [], []
                for w, weights in Ws.items():
                    c = X @ weights[0]
                    for j in range(1, w):
                        c[: len(c) - j] += X[j:] @ weights[j]
                    m = c.argmax(0)
                    where.append(m)
                    best.append(c[m, np.arange(FILTERS)])
                pooled = np.concatenate(best) + model.bias
                h = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-(h @ model.out + model.out_bias)))
                d = (p - toxic[k]) * (weight if toxic[k] else 1.0) / len(part)
                go += d * h
                gc += d
                dh = d * model.out * (pooled > 0)
                gb += dh
                for i, (w, weights) in enumerate(Ws.items()):
                    mine = dh[i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        pos = np.minimum(where[i] + j, len(X) - 1)
                        gW[w][j] += X[pos].T * mine
                        g = (weights[j] * mine).T
                        for side in (0, 1):
                            touched.append(r[pos, side])
                            gE.append(g)
            for w in Ws:
                store[w] += gW[w] ** 2
                Ws[w] -= rate * gW[w] / np.sqrt(store[w])
            for name, x, g in (("b", model.bias, gb), ("o", model.out, go)):
                store[name] += g**2
                x -= rate * g / np.sqrt(store[name])
            store["c"] += gc**2
            model.out_bias -= float(rate * gc / np.sqrt(store["c"]))
            which, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(which), DIM), np.float32)
            np.add.at(g, inverse, np.concatenate(gE))
            g[which == 0] = 0
            store["E"][which] += g**2
            E[which] -= rate * g / np.sqrt(store["E"][which])
    p = np.concatenate([score(model, texts.slice(k, 500)) for k in range(0, len(texts), 500)])
    model.thresholds = calibrate(p[held], toxic[held], [x for x, h in zip(langs, held, strict=True) if h])
    return model


def calibrate(p: np.ndarray, toxic: np.ndarray, langs: list[str | None]) -> dict[str | None, float]:
    """For each language (None: all together) the threshold with the greatest F1 on held-out
    rows (see the module for their weights); of several, the middle of the widest gap between scores."""
    order = np.argsort(-p, kind="stable")
    p, y, langs = p[order], toxic[order], [langs[k] for k in order]

    def best(weight: np.ndarray) -> float:
        f1 = 2 * np.cumsum(weight * y) / (np.cumsum(weight) + (weight * y).sum())
        f1[:-1][p[:-1] == p[1:]] = -1
        gaps = np.append(p[:-1] - p[1:], p[-1])
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)
        k = top[np.argmax(gaps[top])]
        return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)

    if not y.any():
        return {None: 0.5}
    out: dict[str | None, float] = {None: best(np.ones(len(p)))}
    for lang in {x for x in langs if x is not None}:
        mine = np.array([x == lang for x in langs])
        rest = y[~mine].sum()
        out[lang] = best(np.where(mine, 1.0, min(1.0, BORROWED / max(1, rest))))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents; None where the labels lack a class."""
    known = only(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = only(docs, doc_id="long", text="string", lang="string").join(F.broadcast(known), "doc_id")
    # Of several rows of a document the first by text, so that the model is the same however the table is laid out.
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("x")).select("x.text", "x.lang", "toxic").toArrow()
    toxic = (rows["toxic"].to_numpy() > 0).astype(np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return None
    key = [(xxhash.xxh64_intdigest(x or ""), lang or "", y) for x, lang, y in zip(*(rows[c].to_pylist() for c in ("text", "lang", "toxic")), strict=True)]
    order = np.array(sorted(range(len(key)), key=key.__getitem__))
    rows = rows.take(order)
    model = fit(rows["text"].combine_chunks().cast(pa.string()), toxic[order], rows["lang"].to_pylist())
    del rows, key
    settle()
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, columns renamed to their places c0, c1, ..., with ``score`` and ``toxic``."""
    text, lang = (f"c{[x.lower() for x in docs.columns].index(c)}" for c in ("text", "lang"))
    placed = bounded(docs).toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema = StructType([*placed.schema.fields, StructField("score", DoubleType()), StructField("toxic", BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        n = batch.num_rows
        p = score(model, batch[text].cast(pa.string())) if model is not None else np.zeros(n)
        limit = np.array([model.thresholds.get(x, model.thresholds[None]) for x in batch[lang].to_pylist()]) if model is not None else np.ones(n)
        return pa.record_batch([*batch.columns, pa.array(p), pa.array((p > limit) & (p > 0))], [*batch.schema.names, "score", "toxic"])

    return placed.mapInArrow(T.per_slice(fn, text), schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang, score of the documents judged toxic."""
    rows = scored(only(docs, doc_id="long", text="string", lang="string"), train(docs, labels, sample))
    return rows.where("toxic").select(F.col("c0").alias("doc_id"), F.col("c2").alias("lang"), F.round("score", 6).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't judged toxic, with all their columns."""
    return scored(docs, train(docs, labels, sample)).where("not toxic").drop("score", "toxic").toDF(*docs.columns)
