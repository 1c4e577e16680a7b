"""Secret scans by a linear-chain conditional random field.

Words between white space are tagged B (a secret begins), I (it goes on) or O. A word's features are its shape (kinds
of characters, length, entropy, key words, assignment marks), the shapes of its two neighbours, and those of its file
(whether key words, assignments or long mixed words occur at all). Weights are fitted by maximum likelihood (forward-backward, numpy) on
at most ``SAMPLE`` documents, tagged by conservative patterns, into which secrets of many
known formats are written; this is the only part that doesn't cover all data. The documents are those with the least hashes of doc_id and text:
half of them the first ones, half the first ones with a key word, an assignment or a key's prefix among the first ``POOL``. So
the model is the same however the table is laid out, and one scan finds them.

Features belong to distinct words, so all words of a slice are scored by table look-ups. Decoding is exact Viterbi: a run of
B and I can only gain where some word's best gain over O is positive, and can't reach beyond the point where
its losses outweigh all gains of the text; outside these stretches every word is O, inside Viterbi decides.

Defined results. Null or empty text: no secret. Null doc_ids are left out. Repeated rows give equal rows once. Whole texts
are decoded and blocks of a key are tagged, however long. Ties between taggings go to the secret that begins first (B before I before O). Other
columns may have any name. An empty table trains on the written secrets alone and gives an empty result.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import only, row_key, settle

#: Documents fitted on; documents among which those with key words are looked for; words of a training stretch; stretches; gradient steps.
SAMPLE, POOL, STRETCH, STRETCHES, STEPS = 2_000, 20_000, 20, 4_800, 120
B, I, O = 0, 1, 2  # noqa: E741

KEYWORD = r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth)"
#: Patterns of distinct words, each a feature.
SHAPES = [
    KEYWORD,
    KEYWORD + r"[\w-]*[\"']?[=:]",
    r"[=:][\"']?[^=:\"'\s]{8,}",
    r"^[=:]+$",
    r"[=:]$",
    r"^[\"'].*[\"'][,;.]?$",
    r"[0-9]",
    r"[A-Z].*[A-Z]",
    r"^[\"']?[0-9a-f]{16,}[\"']?[.,;]?$",
    r"[0-9a-fA-F]{16,}",
    r"[A-Za-z0-9+/_-]{20,}",
    r"[A-Za-z][0-9][A-Za-z]*[0-9]",
    r"^[\"']?(?:AKIA|ASIA)[0-9A-Z]{12,}",
    r"(?:gh[pousr]_|github_pat_|glpat-|xox[abpr]-|sk-|sk_live_|rk_live_|AIza|npm_)[A-Za-z0-9_-]{10,}",
    r"^[\"']?eyJ[\w-]+\.[\w-]+\.?",
    r"-----",
    r"(?:BEGIN|END|PRIVATE|KEY)",
    r"@[\w.-]+\.\w+",
    r"^[a-z]+://",
    r"^[(+]?[0-9][0-9().-]*[,.;]?$",
    r"^\d{1,3}(?:\.\d{1,3}){3}",
    r"[^\w\s]{3,}",
    r"^[\pL'’-]+[.,!?;:]*$",
    r"^\pL",
]
LENGTHS = (4, 8, 12, 16, 24, 32, 48)
ENTROPIES = (2.5, 3.0, 3.5, 4.0, 4.5)
FEATURES = len(SHAPES) + len(LENGTHS) + len(ENTROPIES) + 1
FILE = 4


def entropy(word: str) -> float:
    count = np.array(list(Counter(word).values()), float)
    p = count / count.sum() if len(count) else count
    return float(-(p * np.log2(p)).sum())


def features(words: pa.Array) -> np.ndarray:
    """A row of 0/1 features for each distinct word."""
    out = np.zeros((len(words), FEATURES), np.float32)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    ends = len(SHAPES) + len(LENGTHS)
    out[:, len(SHAPES) : ends] = size[:, None] >= np.array(LENGTHS)
    out[:, -1] = 1
    for k, shape in enumerate(SHAPES):
        out[:, k] = pc.match_substring_regex(words, shape).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(size >= 12)
    value = np.array([entropy(w) for w in words.take(pa.array(long)).to_pylist()])
    out[long, ends : ends + len(ENTROPIES)] = value.reshape(-1, 1) >= np.array(ENTROPIES)
    return out


def file_features(table: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: a key word, an assignment, a long mixed word occurs; constant."""
    out = np.zeros((len(offsets) - 1, FILE), np.float32)
    out[:, -1] = 1
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        for k, columns in enumerate(([0], [1, 2, 3], [8, 9, 10])):
            flag = table[:, columns].any(1)[ids]
            out[some, k] = np.maximum.reduceat(flag, offsets[:-1][some])
    return out


@dataclass
class Model:
    own: np.ndarray  #: FEATURES x 3, likewise before and after
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    change: np.ndarray  #: 3 x 3, from the row's tag to the column's
    start: np.ndarray


def viterbi(emission: np.ndarray, change: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best tags; first is added to the first word's scores, last to the last one's."""
    score, back = emission[0] + first, []
    for e in emission[1:]:
        s = score[:, None] + change
        back.append(s.argmax(0))
        score = s.max(0) + e
    tags = [int((score + last).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


def decode(emission: np.ndarray, model: Model) -> list[tuple[int, int]]:
    """Runs (from, to) of B I ... in one text's exact best tagging."""
    n = len(emission)
    change = model.change
    # What a word can gain at most by leaving O, with the change that leads to it; what leaving the run can gain.
    gain = emission[:, :2].max(1) - emission[:, O] + max(0.0, (change[:, :2] - change[O, O]).max(), (change[:, :2] - change[:, O : O + 1]).max())
    leave = max(0.0, float((change[:2, O] - change[O, O]).max()), float((model.start[:2] - model.start[O]).max()))
    seeds = np.flatnonzero(gain > 0)
    if not len(seeds):
        return []
    most = float(gain[seeds].sum()) + leave
    cover = np.zeros(n, bool)
    for p in seeds:
        for step in (1, -1):
            lost, q = 0.0, int(p)
            while 0 <= q < n and lost <= most:
                cover[q] = True
                lost += max(0.0, -float(gain[q]))
                q += step
    edges = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
    runs = []
    for a, b in edges.reshape(-1, 2).tolist():
        first = model.start if a == 0 else change[O]
        last = np.zeros(3) if b == n else change[:, O]
        tags = viterbi(emission[a:b], change, first, last)
        at = 0
        while at < len(tags):
            if tags[at] == O:
                at += 1
                continue
            end = at + 1
            while end < len(tags) and tags[end] == I:
                end += 1
            runs.append((a + at, a + end))
            at = end
    return runs


def emissions(model: Model, table: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    own, before, after = (table @ w for w in (model.own, model.before, model.after))
    out = own[ids]
    inner = np.ones(len(ids), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    out[at] += before[ids[at - 1]]
    out[at - 1] += after[ids[at]]
    return out + np.repeat(file_features(table, ids, offsets) @ model.file, np.diff(offsets), axis=0)


_TAGGED = [
    re.compile(r"(?i)^[\"']?[\w-]*(?:passw(?:or)?d|pwd|secret|token|key|auth)[\w-]*[\"']?[=:][\"']?(?=\S*[0-9])[^\s\"'=]{8,}"),
    re.compile(r"^[\"']?(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    re.compile(r"^[\"']?(?:gh[pousr]_|glpat-|xox[abpr]-|sk-|sk_live_|npm_)[A-Za-z0-9_-]{16,}"),
    re.compile(r"^[\"']?eyJ[\w-]{8,}\.[\w-]{8,}\."),
]
#: What each of them, and an assigned value, must hold.
_ODD = re.compile(r"[0-9]|A[KS]IA|gh[pousr]_|glpat-|xox[abpr]-|sk[-_]|npm_|eyJ|^-----BEGIN")


def tag(words: list[str]) -> np.ndarray:
    """Tags by conservative patterns."""
    out = np.full(len(words), O)
    ends = None
    for k, w in enumerate(words):
        if len(w) < 8 or out[k] == I or not _ODD.search(w):
            continue
        before = " ".join(words[max(0, k - 2) : k])
        if any(p.search(w) for p in _TAGGED) or (k and words[k - 1] in ("=", ":") and re.search(KEYWORD, before) and re.match(r"[\"']?(?=\S*[0-9])[\w+/.-]{12,}", w)):
            out[k] = B
        elif w.startswith("-----BEGIN"):
            if ends is None:
                ends = np.flatnonzero(["-----END" in x for x in words])
                closes = np.flatnonzero([x.rstrip(".,;\"'").endswith("-----") for x in words])
            at = np.searchsorted(ends, k)
            if at < len(ends):
                last = closes[closes >= ends[at]]
                out[k] = B
                out[k + 1 : (last[0] if len(last) else ends[at]) + 1] = I
    return out


def written(rng: np.random.Generator) -> list[str]:
    """A made-up secret as words."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    hexa, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    name = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "auth_token", "SECRET_KEY", "access_key", "pwd"])
    letters = pick([string.ascii_letters, string.ascii_lowercase][rng.integers(2)], rng.integers(12, 41))
    value = [pick(hexa, rng.integers(16, 41)), pick(mixed, rng.integers(12, 41)), pick(hexa, 40), letters][rng.integers(4)]
    quote = rng.choice(["", '"', "'"])
    kind = rng.integers(9)
    if kind <= 1:
        return [f"{name}{rng.choice(['=', ':'])}{quote}{value}{quote}"]
    if kind <= 3:
        return ["", str(name), str(rng.choice(["=", ":"])), f"{quote}{value}{quote}"]
    if kind == 4:
        return ["AKIA" + pick(upper, 16)]
    if kind == 5:
        return [rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "npm_", "xoxb-"]) + pick(mixed, 36)]
    if kind == 6:
        return ["eyJ" + pick(mixed, 20) + ".eyJ" + pick(mixed, 40) + "." + pick(mixed, 43)]
    if kind == 7:
        return ["", f"{name}:", value]
    body = [pick(mixed + "+/", 64) for _ in range(rng.integers(2, 6))]
    return ["-----BEGIN", "RSA", "PRIVATE", "KEY-----", *body, "-----END", "RSA", "PRIVATE", "KEY-----"]


def decoy(rng: np.random.Generator) -> list[str]:
    """Words that look out of the ordinary but are no secret."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    low, dig = string.ascii_lowercase, string.digits
    return [
        [f"{pick(low, rng.integers(2, 12))}.{pick(dig, 2)}@mail{pick(dig, 1)}.example.com"],
        [f"{pick(low, 6)}@{pick(low, 7)}.org"],
        [pick(dig, 16)],
        [f"({pick(dig, 3)})", f"{pick(dig, 3)}-{pick(dig, 4)}"],
        [".".join(pick(dig, 2) for _ in range(4))],
        [f"https://{pick(low, 8)}.com/{pick(low, 6)}/{pick(low, 9)}-{pick(low, 7)}?id={pick(dig, 5)}"],
        [pick(low, rng.integers(14, 30))],
        [pick(low, rng.integers(4, 14)) + rng.choice(["&&&", "$$$", "%%%", "***", "###", "!!"])],
        [pick(string.ascii_uppercase, rng.integers(5, 24)) + rng.choice(["", "!!", "."])],
        ["the", str(rng.choice(["password", "token", "secret", "key"])), str(rng.choice(["is", "was", "of", "and"]))],
        [pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2)],
        [str(rng.choice(["|", "=", ":", "-", "*"]))],
        [str(rng.choice(["password", "token", "secret", "key"])) + ":", pick(low, rng.integers(2, 9))],
    ][rng.integers(13)]


def fit(texts: list[str], seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    fallback = "the quick brown fox jumps over 12 lazy dogs and some.body@example.com wrote 192.168.0.1 about it".split()
    docs = [d for d in (t.split() for t in texts) if d] or [fallback]
    stretches, tags, files = [], [], []
    found = [tag(d) for d in docs]
    hits = [(k, int(p)) for k, t in enumerate(found) for p in np.flatnonzero(t == B)]
    for n in range(STRETCHES):
        if hits and n % 6 == 0:
            k, p = hits[rng.integers(len(hits))]
            a = max(0, p - int(rng.integers(STRETCH)))
        else:
            k = int(rng.integers(len(docs)))
            a = int(rng.integers(max(1, len(docs[k]) - STRETCH + 1)))
        words, t = docs[k][a : a + STRETCH], found[k][a : a + STRETCH].copy()
        if len(t) and t[0] == I:
            t[0] = B
        if n % 6:
            true = n % 6 in (1, 2, 3)
            secret = written(rng) if true else decoy(rng)
            marks = [B] + [I] * (len(secret) - 1) if true else [O] * len(secret)
            if secret[0] == "":  # only the value is the secret
                secret = secret[1:]
                marks = [O] * (len(secret) - 1) + [B]
            at = int(rng.integers(len(words) + 1))
            words, t = words[:at] + secret + words[at:], np.concatenate([t[:at], marks, t[at:]]).astype(int)
            k = at + len(secret)
            while k < len(t) and t[k] == I:
                t[k], k = O, k + 1
        stretches.append(words)
        tags.append(t)
    sizes = np.array([len(s) for s in stretches])
    flat = pa.array([w for s in stretches for w in s], pa.string()).dictionary_encode()
    ids, offsets = flat.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    table = features(flat.dictionary)
    file = file_features(table, ids, offsets)
    # By place, then stretch: words and tags; past a stretch's end stands a word without features.
    inside = np.arange(sizes.max())[:, None] < sizes
    place = (np.arange(sizes.max())[:, None] + offsets[:-1])[inside]
    words = np.full(inside.shape, len(table), np.int64)
    words[inside] = ids[place]
    table = np.concatenate([table, np.zeros((1, FEATURES), np.float32)])
    gold_p = np.zeros((*inside.shape, 3), np.float32)
    gold_p[inside] = np.eye(3, dtype=np.float32)[np.concatenate(tags)[place]]

    def observed(p: np.ndarray) -> np.ndarray:
        """Sums of the features of all words, weighed by each tag's chance."""
        count = lambda w, p: table.T @ np.stack([np.bincount(w.ravel(), p[..., k].ravel(), len(table)) for k in range(3)], 1)
        return np.concatenate([count(words, p), count(words[:-1], p[1:]), count(words[1:], p[:-1]), file.T @ p.sum(0)])

    W = np.zeros((3 * FEATURES + FILE, 3))
    change, start = np.zeros((3, 3)), np.zeros(3)
    gold, gold_start = observed(gold_p), gold_p[0].sum(0)
    gold_change = sum(gold_p[t - 1].T @ gold_p[t] for t in range(1, len(gold_p)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (W, change, start)]
    n = len(ids)
    for step in range(1, STEPS + 1):
        w = W.astype(np.float32)
        own, before, after = (table @ w[k * FEATURES : (k + 1) * FEATURES] for k in range(3))
        E = own[words] + file @ w[3 * FEATURES :]
        E[1:] += before[words[:-1]]
        E[:-1] += after[words[1:]]
        chance, expected_change = marginals(E, inside, change.astype(np.float32), start.astype(np.float32))
        chance *= inside[:, :, None]
        grads = [(gold - observed(chance)) / n - 1e-5 * W, (gold_change - expected_change) / n - 1e-5 * change, (gold_start - chance[0].sum(0)) / n - 1e-5 * start]
        for (m1, m2), g, param in zip(moments, grads, (W, change, start), strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            param += 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    W = W.astype(np.float32)
    return Model(W[:FEATURES], W[FEATURES : 2 * FEATURES], W[2 * FEATURES : 3 * FEATURES], W[3 * FEATURES :], change, start)


def marginals(E: np.ndarray, inside: np.ndarray, change: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once: scores by place, sequence and tag; which places a sequence has. The chance of each tag
    at each place, and the expected number of each change in all of them."""
    A = np.exp(change - change.max())
    b = np.exp(E - E.max(2, keepdims=True))
    alpha, beta, scale = np.empty_like(E), np.ones_like(E), np.ones((*inside.shape, 1), E.dtype)
    first = np.exp(start - start.max()) * b[0]
    alpha[0] = first / first.sum(1, keepdims=True)
    for t in range(1, len(E)):
        new = (alpha[t - 1] @ A) * b[t]
        scale[t] = np.where(inside[t, :, None], new.sum(1, keepdims=True), 1.0)
        alpha[t] = np.where(inside[t, :, None], new / scale[t], alpha[t - 1])
    changes = np.zeros((3, 3), E.dtype)
    for t in range(len(E) - 1, 0, -1):
        right = np.where(inside[t, :, None], b[t] * beta[t] / scale[t], 0.0)
        changes += alpha[t - 1].T @ right
        beta[t - 1] = np.where(inside[t, :, None], right @ A.T, 1.0)
    return alpha * beta, changes * A


def train(docs: DataFrame, sample: int = SAMPLE, pool: int = POOL) -> Model:
    """Fit on at most ``sample`` documents, found in one scan: see the module."""
    total = max(1, docs.count())
    rows = only(docs, doc_id="long", text="string").select((row_key().cast("double") / 2.0**64 + 0.5).alias("h"), "text").where("length(text) > 0")
    likely = F.col("text").rlike(KEYWORD + r"[\w-]*[\"']?\s?[=:]|AKIA|-----BEGIN|gh[pousr]_|eyJ")
    half = sample // 2
    # Hashes are uniform: these bounds take hardly more rows than wanted from a table of any size. Rows with one hash are equal.
    many = lambda k: (k + 6 * k**0.5) / total
    some = rows.where(F.col("h") <= many(pool)).withColumn("likely", likely).where((F.col("h") <= many(half)) | F.col("likely"))
    found = some.orderBy("h").limit(pool).toPandas()
    model = fit(found["text"][:half].tolist() + found["text"][found["likely"]][:half].tolist())
    del found
    settle()
    return model


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, word (where the secret begins), words, hint (its first four characters) and digest (xxh64 of it)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        model = shared.value
        ids, vocabulary, offsets = T.split(batch["text"].cast(pa.string()))
        full = pc.not_equal(vocabulary, "").to_numpy(zero_copy_only=False)
        ids, offsets = T.keep(ids, offsets, full[ids]) if len(ids) else (ids, offsets)
        if not len(ids):
            return None
        table = features(vocabulary)
        scores = emissions(model, table, ids, offsets).astype(np.float64)
        best = scores[:, :2].max(1) - scores[:, O] + max(0.0, (model.change[:, :2] - model.change[O, O]).max(), (model.change[:, :2] - model.change[:, O : O + 1]).max())
        some = np.flatnonzero(np.diff(offsets))
        open_ = some[np.maximum.reduceat(best, offsets[:-1][some]) > 0]
        rows = []
        names = batch["doc_id"].to_pylist()
        for k in open_.tolist():
            a, b = int(offsets[k]), int(offsets[k + 1])
            for x, y in decode(scores[a:b], model):
                secret = " ".join(vocabulary[int(w)].as_py() for w in ids[a + x : a + y])
                rows.append((names[k], x, y - x, secret[:4], f"{xxhash.xxh64_intdigest(secret):016x}"))
        if not rows:
            return None
        return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "word", "words", "hint", "digest"])

    return only(docs, doc_id="long", text="string").where("doc_id is not null").mapInArrow(T.per_slice(fn), "doc_id long, word long, words long, hint string, digest string").distinct()
