"""Language identification by string kernels.

The blended-spectrum presence kernel counts the character n-grams (1 to 3 letters, one blank between words)
that two texts both hold, normalised by the geometric mean of how many each holds. Nyström
landmarks, labelled texts chosen evenly over the languages, span the features; one kernel ridge regression
for each language against the rest is solved on at most ``SAMPLE`` labelled texts.

A text becomes a row of presence bits over hashed n-grams of the whole text, so kernel
values against all landmarks are one matrix product for a batch, and so are the languages' scores.

Defined results. Null or empty text, or one without letters: language null, margin 0. Rows without a
label aren't trained on, but are classified like any row. A table with fewer than two languages gives
that language (or null) for every text with letters. Ties go to the language first in order.
Repeated rows get equal results; null doc_ids are kept. Very long texts are read whole, but presence counts an n-gram once, however
often it comes. Other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import only, row_key, settle

#: Labelled texts to fit on, landmarks among them, hashed n-gram places, ridge.
SAMPLE, LANDMARKS, PLACES, RIDGE = 2_000, 96, 1 << 13, 1e-3
ORDERS = (1, 2, 3)


def presence(texts: pa.Array) -> np.ndarray:
    """Presence bits (uint8, a row for each text) of the hashed n-grams of letters and single blanks."""
    n = len(texts)
    out = np.zeros((n, PLACES), np.uint8)
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    clean = pc.binary_join_element_wise(" ", pc.utf8_trim_whitespace(clean), " ", "")
    text = "".join(clean.to_pylist())
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64))
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends, prepend=0)) * PLACES
    flat = out.reshape(-1)
    code = np.zeros(len(chars), np.uint32)
    for order in ORDERS:
        size = len(chars) - order + 1
        if size <= 0:
            break
        code = (code[:size] if order > 1 else np.zeros(size, np.uint32)) * np.uint32(0x01000193) + chars[order - 1 :] + np.uint32(order)
        place = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - PLACES.bit_length() + 1)
        inside = owner[:size] == owner[order - 1 :] if order > 1 else slice(None)
        flat[(owner[:size] + place)[inside]] = 1
    out[pc.utf8_length(clean).to_numpy(zero_copy_only=False) <= 2] = 0
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  #: PLACES x landmarks, each column divided by the root of its n-grams
    weights: np.ndarray  #: landmarks x languages

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        held = bits.sum(1, dtype=np.float32)
        return (bits.astype(np.float32) @ self.landmarks) / np.sqrt(np.maximum(held, 1))[:, None]

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return self.kernel(bits) @ self.weights


def fit(texts: pa.Array, langs: list[str]) -> Model:
    languages = sorted(set(langs))
    bits = np.concatenate([presence(texts.slice(k, 200)) for k in range(0, len(texts), 200)])
    y = np.array([languages.index(x) for x in langs])
    each = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))])
    marks = bits[chosen].astype(np.float32)
    model = Model(languages, (marks / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]).T.copy(), np.zeros(0))
    inner = model.kernel(bits[chosen]).astype(np.float64)
    outer = np.concatenate([model.kernel(bits[k : k + 200]) for k in range(0, len(bits), 200)]).astype(np.float64)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # One against the rest, each language's rows weighing as much as all others' together.
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weights = []
    for k in range(len(languages)):
        c = np.where(y == k, 0.5 / max(share[k], 1e-9), 0.5 / max(1 - share[k], 1e-9))
        left = outer.T @ (outer * c[:, None]) + RIDGE * len(y) * inner + 1e-8 * np.eye(len(inner))
        weights.append(np.linalg.solve(left, outer.T @ (c * target[:, k])))
    model.weights = np.stack(weights, 1).astype(np.float32)
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled texts, drawn evenly over the languages: those with the least hashes
    of doc_id and text, each once, of each language. None where no row has a language and letters."""
    rows = only(docs, doc_id="long", text="string", lang="string").where("lang is not null and length(text) > 0").select("lang", row_key().alias("h"), "text")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # Hashes are uniform, so a bound on them takes hardly more rows than wanted from a table of any size.
    bound = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], 1.5 * each / r["count"] + 10 / r["count"])])
    mine = rows.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= bound[F.col("lang")]).dropDuplicates(["lang", "h"]).toPandas()
    mine = mine.sort_values(["h", "lang"]).groupby("lang").head(each)
    model = fit(pa.array(mine["text"], pa.string()), mine["lang"].tolist())
    del mine
    settle()
    return model


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang (as labelled), predicted, margin (best less second score) of every row."""
    narrow = only(docs, doc_id="long", lang="string", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        names, margins = [], []
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            bits = presence(part["text"].cast(pa.string()))
            some = bits.any(1)
            if model is None:
                names += [None] * part.num_rows
                margins += [0.0] * part.num_rows
                continue
            s = model.scores(bits)
            names += [model.languages[x] if ok else None for x, ok in zip(s.argmax(1), some, strict=True)]
            top = np.sort(s, axis=1)
            margins += np.where(some, top[:, -1] - top[:, -2] if s.shape[1] > 1 else 0.0, 0.0).astype(float).tolist()
        return pa.record_batch([batch["doc_id"], batch["lang"], pa.array(names, pa.string()), pa.array(np.round(margins, 4), pa.float64())], ["doc_id", "lang", "predicted", "margin"])

    return narrow.mapInArrow(T.per_slice(fn), "doc_id long, lang string, predicted string, margin double")
