"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward tables."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import _text as T
from threadloom.llm import bpe, decontaminate, embeddings, jaccard, language, licenses, mixing, secrets, token_output, toxicity
from threadloom.llm.components import groups

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, score int, cell int, `a.b` int"
LONG = "lorem ipsum dolor " * 40_000


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en", "s1"), (1, base, "en", "s1"), (2, base.upper() + "!", "en", "s2"), (3, "", "de", "s1"), (4, None, None, None), (None, base, "en", "s1"), (None, None, None, None),
        (5, LONG, "en", "s1"), (6, "　\n\t ", "fr", ""), (7, "?!,.", "fr", "s3"), (8, "a", "es", "s3"), (9, "é" * 5000, "fr", "s3"),
    ]
    return spark.createDataFrame([(*r, None, "x", 1, 2, 3) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# ---- text ----------------------------------------------------------------------------------


def test_slices_and_hashes():
    texts = pa.array(["a b", None, "", "x" * 10_000, "A. b!"])
    assert [p.num_rows for p in T.slices(pa.record_batch([texts], ["text"]), most=5000)] == [3, 1, 1]
    h, o = T.words(texts)
    assert o.tolist() == [0, 2, 2, 2, 3, 5] and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    part, _ = T.words(texts.slice(4, 1))
    assert part.tolist() == h[3:].tolist()
    assert T.lcs(list("abcde"), list("axcxe")) == 3


# ---- 1 n-gram Jaccard join -----------------------------------------------------------------


def brute_pairs(rows, n, t):
    h, o = T.words(pa.array([x for _, x in rows], pa.string()))
    sets = [(k, set(T.gram_set(h[a:b], n).tolist())) for (k, _), a, b in zip(rows, o[:-1], o[1:], strict=True)]
    return {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and i != j and len(a & b) / len(a | b) >= t}


@pytest.mark.parametrize("block", [jaccard.BIN, 7])
def test_jaccard_recall_on_near_copies(spark, monkeypatch, block):
    """Groups of near copies of different sizes, a passage that many share, and bins of many blocks."""
    monkeypatch.setattr(jaccard, "BIN", block)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(150):
        rows.append((k, [rng.choice(words) for _ in range(rng.randint(10, 160))] + shared * (k % 5 == 0)))
    for k in range(150, 420):  # copies with edits, in groups of different sizes
        text = list(rows[k % 40 if k % 2 else 3][1])
        for _ in range(rng.randint(0, len(text) // 12)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, text))
    rows = [(k, " ".join(w)) for k, w in rows]
    want = brute_pairs(rows, 3, 0.5)
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_a"], r["doc_b"]) for r in found}
    assert len(found) == len(got) and got <= want and len(got) >= 0.97 * len(want) and len(want) > 1000


def test_a_passage_that_very_many_share(spark):
    """Near copies are found however many unlike documents hold the tokens by which they are."""
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(45)) + " " + passage) for k in range(700)]
    rows += [(1000 + k, rows[k][1] + f" more{k}") for k in range(60)]
    want = brute_pairs(rows, 3, 0.5)
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and {(k, 1000 + k) for k in range(60)} <= got


def test_small_sets_are_exact(spark):
    words = ["a", "b", "c", "d", "e"]
    rows = [(k, " ".join(w)) for k, w in enumerate(w for n in (1, 2, 3) for w in itertools.product(words, repeat=n))]
    for n, t in ((1, 0.5), (1, 0.34), (2, 0.5), (1, 0.2)):
        got = {(r["doc_a"], r["doc_b"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), n, t).collect()}
        assert got == brute_pairs(rows, n, t)


def test_bin_pairs_against_all_pairs():
    """No pair is lost by the bound of the token-group matrix: unlike groups, unlike sizes, visitors."""
    rng = np.random.default_rng(1)
    bases = [np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64) * 2) for n in (3, 40, 60, 900, 5000)]
    sets = []
    for k in range(130):
        base = bases[k % 5]
        sets.append(np.unique(np.where(rng.random(len(base)) < 0.3 * rng.random(), rng.integers(1, 1 << 63, len(base)).astype(np.uint64), base)))
    resident = np.arange(130) % 3 > 0
    i, j, sim = jaccard.bin_pairs(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), resident, 0.5)
    got = {(min(a, b), max(a, b)): s for a, b, s in zip(i.tolist(), j.tolist(), sim.tolist(), strict=True)}
    want = {}
    for a, b in itertools.combinations(range(130), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if (resident[a] or resident[b]) and both / (len(sets[a]) + len(sets[b]) - both) >= 0.5:
            want[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
    assert got == want and len(got) == len(i) > 1000


def test_jaccard_awkward(spark):
    got = {tuple(r) for r in jaccard.jaccard_join(awkward(spark)).collect()}
    assert got == {(1, 2, 1.0)}
    kept = jaccard.drop_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert jaccard.jaccard_join(empty(spark)).count() == 0 and jaccard.drop_near_copies(empty(spark)).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e f"), (1, "z y x w"), (2, "a b c d e g"), (None, "q r s t u"), (None, "q r s t u v"), (3, LONG), (4, LONG + "x y z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    # A doc_id with different texts: a row for each pair of sets, none with itself.
    assert sorted((r["doc_a"], r["doc_b"]) for r in jaccard.jaccard_join(odd).collect()) == [(1, 2), (1, 2), (3, 4)]
    assert sorted((r["doc_id"] or 0, r["text"][:1]) for r in jaccard.drop_near_copies(odd).collect()) == [(0, "q"), (1, "a"), (1, "z"), (3, "l")]



def copies_of_one_text(seed, many):
    """Rows of a block for open_bins: near copies of one text and a few others, two thirds of them residents; and its sets."""
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(1, 1 << 63, 60).astype(np.uint64) * 2)
    spare = rng.integers(1, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(len(base)) < rng.choice([0.02, 0.1, 0.2, 0.3, 0.8], p=[0.3, 0.3, 0.25, 0.1, 0.05]), rng.choice(spare, len(base)), base)) for _ in range(many)]
    sets = list({x.tobytes(): x for x in sets}.values())
    resident = np.arange(len(sets)) < 2 * len(sets) // 3
    columns = {"home": pa.array([1] * len(sets)), "block": pa.array([0] * len(sets), pa.int32()), "resident": pa.array(resident), "whole": pa.array(range(len(sets))), "n": pa.array([k % 3 + 1 for k in range(len(sets))])}
    return pa.record_batch(columns | {"grams": T.ragged(T.signed(np.concatenate(sets)), np.cumsum([0, *map(len, sets)]), pa.int64())}), sets, resident


@pytest.mark.parametrize("columns", [jaccard.COLUMNS, 5])
def test_near_copies_are_not_compared_one_by_one(monkeypatch, columns):
    """Links of a block of near copies are those of all pairs, and few entries of the token-group matrix are added up for them."""
    monkeypatch.setattr(jaccard, "COLUMNS", columns, raising=False)
    entries, hits = [], jaccard.hits
    monkeypatch.setattr(jaccard, "hits", lambda table, place, offsets: entries.append(len(place) * table.shape[1]) or hits(table, place, offsets))
    batch, sets, resident = copies_of_one_text(3, 500)
    got = {}
    for out in jaccard.open_bins(0.5, True)(iter([batch])):
        for a, links in zip(out["a"].to_pylist(), out["links"].to_pylist(), strict=True):
            got[a] = got.get(a, 0) + links
    tables = [set(x.tolist()) for x in sets]
    want = [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        if resident[a] and len(tables[a] & tables[b]) >= 0.5 * len(tables[a] | tables[b]):
            want[a] += b % 3 + 1
            want[b] += a % 3 + 1
    assert [got.get(k, 0) for k in range(len(sets))] == want and sum(want) > 50_000
    pairs = int(resident.sum()) * len(sets)
    assert sum(entries) < 20 * pairs  # 43 if groups are opened for all


def test_components_of_near_copies_need_no_links(monkeypatch):
    """Where only components count, near copies of one text aren't compared with each other at all."""
    batch, sets, resident = copies_of_one_text(4, 300)
    whole = {}
    for count in (True, False):
        if not count:
            monkeypatch.setattr(jaccard, "near_links", None)
        parent = np.arange(len(sets))
        for out in jaccard.open_bins(0.5, True, count)(iter([batch])):
            jaccard.unite(parent, out["a"].to_numpy(), out["b"].to_numpy())
        whole[count] = jaccard.roots(parent, np.arange(len(sets))).tolist()
    assert whole[True] == whole[False] and 1 < len(set(whole[True])) < len(sets) / 2


def brute_classes(rows, n=3, t=0.5):
    """doc_id, class_id, links of rows without repetitions."""
    h, o = T.words(pa.array([x for _, x in rows], pa.string()))
    sets = [set(T.gram_set(h[a:b], n).tolist()) for a, b in zip(o[:-1], o[1:], strict=True)]
    near = [[j for j, y in enumerate(sets) if j != i and x and y and len(x & y) >= t * len(x | y)] for i, x in enumerate(sets)]
    out = []
    for i, (k, _) in enumerate(rows):
        seen, new = {i}, {i}
        while new:
            new = {j for m in new for j in near[m]} - seen
            seen |= new
        out.append((k, min((rows[m][0] for m in seen if rows[m][0] is not None), default=None), len(near[i])))
    return sorted(out, key=str)


def test_classes_grow_with_documents_not_pairs(spark, monkeypatch):
    """A row for each document; links as by all pairs, also where bins have many blocks, residents meet visitors in many parts and slices are many."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(30, 60))] for _ in range(25)]
    rows = [(k, list(base[k % 25 if k % 3 else 4])) for k in range(400)]
    for _, text in rows:
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice("abc")
    rows = [(k, " ".join(t)) for k, t in rows] + [(900, "a"), (901, "a b c d"), (902, "b c d"), (903, None), (904, "?!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    pairs = jaccard.jaccard_join(df)
    for small in (False, True):
        if small:
            for name, value in (("BIN", 7), ("MEET", 500), ("BROADCAST_BYTES", 60_000), ("SLICE_BYTES", 100_000)):
                monkeypatch.setattr(jaccard, name, value)
            assert jaccard.slices(1000, 10_000) > 1
        got = sorted(((r["doc_id"], r["class_id"], r["links"]) for r in jaccard.classes(df).collect()), key=str)
        assert got == want and sum(x[2] for x in got) == 2 * pairs.count() > 4000


def test_classes_awkward(spark):
    rows = list(dict.fromkeys((r["doc_id"], r["text"]) for r in awkward(spark).collect()))
    show = lambda df: sorted(((r["doc_id"], r["class_id"], r["links"]) for r in df.collect()), key=str)
    assert show(jaccard.classes(awkward(spark))) == brute_classes(rows) and jaccard.classes(empty(spark)).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e f"), (1, "z y x w"), (2, "a b c d e g"), (None, "q r s t u"), (None, "q r s t u v"), (3, LONG), (4, LONG + "x y z")]
    assert show(jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_classes(rows)


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Where more sets meet than may be broadcast, they are met in slices; no exchange holds texts, and none is left of slices that are over."""
    texts, kept = [], []
    durable = jaccard.durable

    def watch(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        texts.append("Exchange hashpartitioning(row" in plan and "text" in plan)
        kept.append(name)
        return durable(df, name)

    monkeypatch.setattr(jaccard, "durable", watch)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 3000)
    monkeypatch.setattr("threadloom.llm._spark.BROADCAST_BYTES", 3000)
    rows = [(k, f"{' '.join(f'w{k // 2}x{j}' for j in range(30))} {k % 2}") for k in range(200)]
    gone = jaccard.copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert gone.count() == 100 and not any(texts) and kept.count("slice") >= 8


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in groups(spark.createDataFrame(edges, "a long, b long").where("a <> b")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# ---- 2 licenses ----------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"].split()
    edited = " ".join(mit[:20] + ["surprise"] + mit[20:40] + mit[42:])
    rows = [(1, "foo bar " + " ".join(mit) + " baz"), (2, edited.upper()), (3, "Released under the MIT License. " * 3), (4, "the license of the software"), (5, " ".join(reversed(mit)))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["doc_id"], r["license"]): r for r in got}
    assert by[1, "mit"]["first_word"] == 2 and by[1, "mit"]["coverage"] == 1.0 and by[2, "mit"]["coverage"] > 0.9
    assert {k for k in by if k[0] >= 4} == set() and (3, "mit-notice") in by
    assert licenses.scan(awkward(spark)).count() == 0 and licenses.scan(empty(spark)).count() == 0


def test_licenses_awkward(spark):
    """A found license in repeated rows, a null doc_id, one doc_id with two texts, a very long text, clashing columns; relatives of a license."""
    one = "x y z " + licenses.TEMPLATES["cc0-1.0"]
    rows = [(1, one), (1, one), (None, one), (1, "q " + licenses.TEMPLATES["zlib"]), (2, LONG + one + " " + LONG + one), (3, licenses.TEMPLATES["agpl"]), (4, licenses.TEMPLATES["lgpl"]), (5, licenses.TEMPLATES["gpl"]), (6, licenses.TEMPLATES["isc"])]
    got = licenses.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, p int, license string")).collect()
    n = len(LONG.split())
    size = len(licenses.TEMPLATES["cc0-1.0"].split())
    want = [(1, "cc0-1.0", 3), (1, "zlib", 1), (2, "cc0-1.0", n + 3), (2, "cc0-1.0", 2 * n + 6 + size), (3, "agpl", 0), (4, "lgpl", 0), (5, "gpl", 0), (6, "isc", 0)]
    assert sorted((r["doc_id"], r["license"], r["first_word"]) for r in got) == want
    for name, text in licenses.TEMPLATES.items():  # every template is known by itself
        found = licenses.scan(spark.createDataFrame([(1, f"some words before {text} and after")], "doc_id long, text string")).collect() if name in ("mit", "bsd-clauses", "0bsd") else []
        assert all(r["license"] == name for r in found) and (len(found) == 1 or not found)


# ---- 3 language ----------------------------------------------------------------------------


def test_language_held_out(spark, docs):
    train = docs.where("doc_id % 2 = 0")
    model = language.train(train)
    rest = docs.where("doc_id % 2 = 1 and length(text) > 80").toPandas()
    s = model.scores(language.presence(pa.array(rest["text"], pa.string())))
    assert np.mean([model.languages[k] == x for k, x in zip(s.argmax(1), rest["lang"], strict=True)]) > 0.97


def test_language_kernel_is_ngram_overlap():
    texts = ["abc bcd", "bcd", "ÄÖ äö", ""]

    def grams(t):
        t = " " + " ".join(t.lower().split()) + " "
        return {t[k : k + n] for n in language.ORDERS for k in range(len(t) - n + 1)} if t.strip() else set()

    bits = language.presence(pa.array(texts)).astype(int)
    for a, b in itertools.product(range(4), repeat=2):
        assert bits[a] @ bits[b] == len(grams(texts[a]) & grams(texts[b]))


def test_language_scores_by_hand(docs):
    """Scores against sums over n-grams held in common, and weights against the normal equations written out."""
    rows = [(r["text"], r["lang"]) for r in docs.where("length(text) between 40 and 400").orderBy("doc_id").limit(60).collect()]
    model = language.fit(pa.array([t for t, _ in rows]), [x for _, x in rows])
    held = [set(np.flatnonzero(b).tolist()) for b in language.presence(pa.array([t for t, _ in rows]))]
    each = max(1, language.LANDMARKS // len(model.languages))
    marks = [k for x in model.languages for k in [n for n, (_, y) in enumerate(rows) if y == x][:each]]
    kernel = lambda a, b: len(held[a] & held[b]) / np.sqrt(len(held[a]) * len(held[b]))
    outer, inner = (np.array([[kernel(a, b) for b in marks] for a in some]) for some in (range(len(rows)), marks))
    for k, lang in enumerate(model.languages):
        y = np.array([1.0 if x == lang else -1.0 for _, x in rows])
        c = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
        w = np.linalg.solve((outer * c[:, None]).T @ outer + language.RIDGE * len(rows) * inner + 1e-8 * np.eye(len(marks)), outer.T @ (c * y))
        got = model.scores(language.presence(pa.array([t for t, _ in rows])))[:, k]
        assert np.allclose(got, outer @ w, atol=2e-2)


def test_language_awkward(spark):
    got = language.identify(awkward(spark)).collect()
    assert len(got) == 12 and all((r["predicted"] is None) == (r["doc_id"] in (3, 4, 6, 7) or (r["doc_id"] is None and r["lang"] is None)) for r in got)
    assert language.identify(empty(spark)).count() == 0


# ---- 4 and 7 tokens ------------------------------------------------------------------------


def test_tokens_equal_the_tokenizer():
    rng = random.Random(1)
    texts = ["", None, "a   b", "it's 12 x", LONG[:5000]] + ["".join(rng.choice("abé1 \n\t'.,!x  ") for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    enc = bpe.encoding(bpe.VOCABULARY)
    want = [enc.encode_ordinary(t or "") for t in texts]
    ids, ends = bpe.token_ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    assert bpe.token_counts(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice([3, 255, 256, 50_000, 70_000, 1 << 25], n).astype(np.uint32)
        record = token_output.encode(ids)
        codes = token_output.Codes(record)
        assert len(codes) == n and token_output.decode(record).tolist() == ids.tolist() and [codes[k] for k in range(n)] == ids.tolist()
    with pytest.raises(IndexError):
        codes[5000]


def test_token_output(spark, docs):
    enc = bpe.encoding(bpe.VOCABULARY)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_output.token_counts(docs).collect()}
    rows = token_output.token_output(docs).collect()
    assert len(rows) == len(text)
    for r in rows[::9]:
        assert token_output.decode(r["codes"]).tolist() == enc.encode_ordinary(text[r["doc_id"]]) and counts[r["doc_id"]] == r["n_tokens"]
    odd = token_output.token_output(awkward(spark)).collect()
    assert len(odd) == 12 and {r["n_tokens"] for r in odd if r["doc_id"] in (3, 4)} == {0}
    assert token_output.token_counts(empty(spark)).count() == 0 and token_output.token_output(empty(spark)).count() == 0
    want = sorted((r["doc_id"] or 0, len(enc.encode_ordinary(r["text"] or ""))) for r in awkward(spark).collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_output.token_counts(awkward(spark)).collect()) == want


# ---- 5 decontamination ---------------------------------------------------------------------


def test_leaks_verbatim_and_paraphrased(spark, docs):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    rng, planted, rows = random.Random(4), set(), []
    clean = [r["text"] for r in docs.where("length(text) between 300 and 4000").limit(80).collect()]
    for k, (item, text) in enumerate(items):
        words = text.split()
        if len(words) < 18:
            continue
        if k % 2:  # a paraphrase: one word in eight replaced or left out
            words = [w if rng.random() > 0.12 else rng.choice(["", "zzz"]) for w in words]
        around = clean[k % len(clean)].split()
        at = rng.randrange(len(around))
        rows.append((10_000 + k, " ".join(around[:at] + words + around[at:])))
        planted.add((10_000 + k, item))
    rows += [(20_000 + k, t) for k, t in enumerate(clean)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    items = decontaminate.Items(items)
    place, o = items.place(pa.array([t for _, t in rows], pa.string()))
    want = set()  # brute force: every item against every span of every text
    for (d, _), a, b in zip(rows, o[:-1], o[1:], strict=True):
        span = place[a:b].tolist()
        for k, w in zip(items.ids, items.words, strict=True):
            step = max(1, len(w) // 4)
            if any(T.lcs(w.tolist(), span[x : x + 2 * len(w)]) >= decontaminate.LCS * len(w) for x in range(0, max(1, len(span) - len(w) // 2), step)):
                want.add((d, k))
    assert len(planted & got) >= 0.95 * len(planted) and len(want & got) >= 0.9 * len(want) and len(got - want - planted) <= 2


def test_leaks_awkward(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (None, "a"), (2, None), (3, ""), (1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(awkward(spark), bench).collect()}
    assert got == {(1, 1), (2, 1)}
    kept = decontaminate.drop_leaks(awkward(spark), bench)
    assert kept.columns == awkward(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9]
    # A row goes by its own text, not by that of another one with its doc_id; a leak at the end of a very long text counts.
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    odd = spark.createDataFrame([(1, "clean words only here"), (1, item), (None, item), (2, LONG + item), (3, item + " " + item)], "doc_id long, text string")
    one = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r["doc_id"], r["lcs"]) for r in decontaminate.leaks(odd, one).collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert [r["text"] for r in decontaminate.drop_leaks(odd, one).collect()] == ["clean words only here"]
    assert decontaminate.leaks(empty(spark), bench).count() == 0 and decontaminate.leaks(awkward(spark), bench.limit(0)).count() == 0


def test_answers_are_checked_whole():
    """All words of the last sentence count, not only the last ones."""
    answer = " ".join(f"answer{k}" for k in range(30))
    items = decontaminate.Items([(1, "what is it then? " + answer + "."), (2, "no sentence of three words. so. it")])
    assert items.answers == [30, 5]


def test_leaks_in_shards(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    some = docs.where("doc_id < 300")
    one = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(some, bench).collect()}
    monkeypatch.setattr(decontaminate, "SHARD", 15)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(some, bench).collect()} == one and one


# ---- 6 toxicity ----------------------------------------------------------------------------


def made_up(n, seed):
    rng = random.Random(seed)
    words, bad = [f"word{k}" for k in range(600)], ["vile", "rotten", "filthy", "rottenly"]
    rows = []
    for k in range(n):
        toxic = k % 6 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(toxic * rng.randint(1, 3)):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((k, " ".join(text), ["en", "de"][k % 2], int(toxic)))
    return rows


def test_toxicity_held_out_accuracy():
    train, test = made_up(1500, 1), made_up(500, 2)
    model = toxicity.fit(pa.array([r[1] for r in train]), np.array([r[3] for r in train]), [r[2] for r in train])
    p = toxicity.score(model, pa.array([r[1] for r in test]))
    limit = np.array([model.thresholds.get(r[2], model.thresholds[None]) for r in test])
    assert np.mean((p > limit) == np.array([r[3] for r in test])) > 0.98


@pytest.mark.parametrize("informed", [True, False])
def test_toxicity_score_by_direct_convolution(informed):
    """Table look-ups and shifted sums against every filter laid over every place of every text."""
    train = made_up(300, 4)
    model = toxicity.fit(pa.array([r[1] for r in train]), np.array([r[3] for r in train]), [r[2] for r in train], informed=informed)
    texts = [r[1] for r in made_up(40, 5)] + ["vile", "unseen words only", "!!", "", None, "Rotten? filthy; " * 30]
    got = toxicity.score(model, pa.array(texts, pa.string()))
    rows = {int(h): k + 1 for k, h in enumerate(model.known)}
    for text, p in zip(texts, got, strict=True):
        words = [w for w in ("".join(ch for ch in w if ch.isalnum()) for w in (text or "").lower().split()) if w]
        vectors = [sum(model.embedding[rows.get(int(T.hash_strings(pa.array([x]))[0]), 0)] for x in ([w, "^" + w[: toxicity.PREFIX]] if len(w) > toxicity.PREFIX else [w])) for w in words]
        vectors += [np.zeros(toxicity.DIM)] * toxicity.PAD
        pooled = []
        for width, filters in model.filters.items():
            for f in range(toxicity.FILTERS):
                pooled.append(max((sum(vectors[at + j] @ filters[j][:, f] for j in range(width) if at + j < len(vectors)) for at in range(len(vectors))), default=0.0))
        z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias
        assert np.isclose(p, 1 / (1 + np.exp(-z)) if words else 0.0, atol=1e-4)


def test_thresholds_move_with_the_rows_of_a_language():
    """No number of toxic rows switches a language's own threshold on; without any it leans on the others."""
    rng = np.random.default_rng(0)
    p, y, langs = [], [], []
    for lang, n, cut in (("en", 400, 0.3), ("de", 30, 0.7), ("fr", 0, 0.0)):
        for k in range(2 * n):
            toxic = k % 2
            p.append(rng.uniform(cut, 1) if toxic else rng.uniform(0, cut))
            y.append(toxic)
            langs.append(lang)
    p, y, langs = [*p, 0.31, 0.9], [*y, 0, 0], [*langs, "fr", None]
    got = toxicity.calibrate(np.array(p), np.array(y), langs)
    assert abs(got[None] - 0.3) < 0.1 and abs(got["en"] - 0.3) < 0.05 and abs(got["de"] - 0.7) < 0.1 and got["fr"] > 0.3
    few = [toxicity.calibrate(np.array(p[:800] + p[800 : 800 + 2 * n]), np.array(y[:800] + y[800 : 800 + 2 * n]), langs[: 800 + 2 * n])["de"] for n in (1, 5, 14, 15, 30)]
    assert all(b >= a - 0.05 for a, b in zip(few[:-1], few[1:], strict=True)) and few[0] < 0.5 < few[-1] and abs(few[2] - few[3]) < 0.15


def test_models_do_not_depend_on_the_layout(spark, docs):
    """Also where doc_ids repeat with other texts and languages."""
    labels = spark.createDataFrame([(k, k % 3 % 2) for k in range(150)], "doc_id long, toxic int")
    some = docs.where("doc_id < 150").unionByName(docs.where("doc_id between 200 and 240").withColumn("doc_id", F.col("doc_id") - 190)).unionByName(docs.where("doc_id < 5"))
    layouts = [some, some.repartition(7, "text"), some.orderBy(F.desc("text")).coalesce(1)]
    one, *rest = [(toxicity.train(x, labels, 100), language.train(x, 80)) for x in layouts]
    for tox, lang in rest:
        assert np.array_equal(tox.embedding, one[0].embedding) and tox.thresholds == one[0].thresholds
        assert lang.languages == one[1].languages and np.array_equal(lang.weights, one[1].weights)


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(r[0] + 100, r[3], None) for r in made_up(300, 3)] + [(None, 1, 1), (1, None, 0), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    text = spark.createDataFrame([(r[0] + 100, r[1], r[2], "s", None, "x", 1, 2, 3) for r in made_up(300, 3)], SCHEMA)
    table = awkward(spark).unionByName(text)
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and {3, 4, 6, 7} <= {r["doc_id"] for r in kept.collect()}
    assert toxicity.toxic_documents(awkward(spark), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(empty(spark), labels).count() == 0 and toxicity.drop_toxic(awkward(spark), labels.limit(0)).count() == 12


# ---- 8 secrets -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crf(docs):
    return secrets.fit([r["text"] for r in docs.where("doc_id % 2 = 0").collect()])


def test_decode_is_exact_viterbi(crf):
    rng = np.random.default_rng(0)
    for _ in range(300):
        e = rng.normal(0, 3, (rng.integers(1, 30), 3)) - np.array([4.0, 4.0, 0.0]) * (rng.random() < 0.7)
        tags = secrets.viterbi(e, crf.change, crf.start, np.zeros(3))
        runs, k = [], 0
        while k < len(tags):
            end = k + 1
            if tags[k] != secrets.O:
                while end < len(tags) and tags[end] == secrets.I:
                    end += 1
                runs.append((k, end))
            k = end
        assert secrets.decode(e, crf) == runs


def test_secrets_held_out(crf, docs):
    rng = np.random.default_rng(7)
    found = wrong = total = 0
    for r in docs.where("doc_id % 2 = 1").limit(150).collect():
        words, secret = r["text"].split()[:200], secrets.written(rng)
        at = int(rng.integers(len(words) + 1))
        value = [w for w in secret if w]
        words = words[:at] + value + words[at:]
        ids, vocabulary, offsets = T.split(pa.array([" ".join(words)]))
        runs = secrets.decode(secrets.emissions(crf, secrets.features(vocabulary), ids, offsets).astype(float), crf)
        last = at + len(value) - 1
        total += 1
        found += any(a <= last < b for a, b in runs)
        own = set(np.flatnonzero(secrets.tag(words) != secrets.O).tolist())
        wrong += sum(not (set(range(a, b)) & own) and not (a <= last and b > at) for a, b in runs)
    assert found / total > 0.93 and wrong / total < 0.1


def test_secrets_of_letters(crf, docs):
    """Words of letters only have all features; letters-only secrets after a key word are found, the same words in prose aren't."""
    marked, bare = secrets.features(pa.array(["password:", "password"]))
    assert marked[[1, 4]].tolist() == [1, 1] and bare[[1, 4]].tolist() == [0, 0]
    rng = np.random.default_rng(11)
    found = wrong = total = 0
    for r in docs.where("doc_id % 2 = 1").limit(100).collect():
        words = r["text"].split()[:200]
        at = int(rng.integers(len(words) + 1))
        value = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), rng.integers(16, 33)))
        for key, secret in ((["password:", value], True), (["the", "password", "is", "words"], False)):
            ids, vocabulary, offsets = T.split(pa.array([" ".join(words[:at] + key + words[at:])]))
            runs = secrets.decode(secrets.emissions(crf, secrets.features(vocabulary), ids, offsets).astype(float), crf)
            hit = any(a < at + len(key) and b > at for a, b in runs)
            found, wrong = found + (secret and hit), wrong + (not secret and hit)
        total += 1
    assert found / total > 0.9 and wrong / total < 0.05


def test_entropy_of_whole_words():
    """What comes after the first 256 characters of a word counts."""
    rng = np.random.default_rng(5)
    word = "a" * 256 + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 4000))
    ends = len(secrets.SHAPES) + len(secrets.LENGTHS)
    assert secrets.features(pa.array([word]))[0, ends : ends + len(secrets.ENTROPIES)].tolist() == [1] * len(secrets.ENTROPIES)


def test_viterbi_and_marginals_by_enumeration():
    """The best tagging, the chances of tags and the expected changes against all taggings written out."""
    rng = np.random.default_rng(2)
    sizes = [1, 4, 6]
    E, change, start = rng.normal(0, 2, (6, 3, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    inside = np.arange(6)[:, None] < np.array(sizes)
    chance, changes = secrets.marginals(E, inside, change, start)
    want_changes = np.zeros((3, 3))
    for s, n in enumerate(sizes):
        paths = np.array(list(itertools.product(range(3), repeat=n)))
        score = start[paths[:, 0]] + E[np.arange(n), s, paths].sum(1) + change[paths[:, :-1], paths[:, 1:]].sum(1)
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        for t in range(n):
            assert np.allclose(chance[t, s], np.bincount(paths[:, t], weight, 3))
        for t in range(1, n):
            np.add.at(want_changes, (paths[:, t - 1], paths[:, t]), weight)
        assert secrets.viterbi(E[:n, s], change, start, np.zeros(3)).tolist() == paths[score.argmax()].tolist()
    assert np.allclose(changes, want_changes)


def test_long_key_blocks_are_tagged_whole():
    block = ["-----BEGIN", "PRIVATE", "KEY-----", *(f"MII{k}abcdefgh" for k in range(100)), "-----END", "PRIVATE", "KEY-----"]
    tags = secrets.tag(["see", *block, "and", "-----BEGIN", "again"])
    assert tags.tolist() == [secrets.O, secrets.B, *[secrets.I] * (len(block) - 1), secrets.O, secrets.O, secrets.O]


def test_the_model_does_not_depend_on_the_layout(spark, docs):
    some = docs.where("doc_id < 400").unionByName(docs.where("doc_id < 3"))
    layouts = [some, some.repartition(7, "text"), some.orderBy(F.desc("text")).coalesce(1)]
    models = [secrets.train(x, 120, 300) for x in layouts]
    for m in models[1:]:
        assert all(np.array_equal(getattr(m, k), getattr(models[0], k)) for k in ("own", "before", "after", "file", "change", "start"))


def test_secrets_awkward(spark):
    key = "the key is password=8f3ab92c77d1e0aa now"
    rows = [(1, key), (1, key), (None, "password=8f3ab92c77d1e0aa"), (2, "nothing to see here"), (3, None), (4, ""), (5, LONG + key), (6, key + " and " + key)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, `h` int")
    got = secrets.scan(table, sample=200).collect()
    far = len(LONG.split())
    assert sorted((r["doc_id"], r["word"], r["words"], r["hint"]) for r in got) == [(1, 3, 1, "pass"), (5, far + 3, 1, "pass"), (6, 3, 1, "pass"), (6, 9, 1, "pass")]
    assert len({r["digest"] for r in got}) == 1
    assert secrets.scan(empty(spark)).count() == 0 and secrets.scan(awkward(spark), sample=200).count() == 0


# ---- 9 mixing ------------------------------------------------------------------------------


def test_mixing_follows_the_schedule(spark):
    rows = [(k, "w " * (1 + k % 7), "abcd"[min(3, k % 9)]) for k in range(6000)]
    schedule = spark.createDataFrame([(s, g, g / 2, g / 2 + 0.5, u, v) for s, w in {"a": (0.4, 0.2, 0.1), "b": (0.3, 0.2, 0.1), "c": (0.2, 0.2, 0.2), "d": (0.1, 0.4, 0.6)}.items() for g, (u, v) in enumerate(zip(w, w[1:], strict=False))], "src string, segment int, t0 double, t1 double, w0 double, w1 double")
    out = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedule).toPandas()
    assert set(out["doc_id"]) == set(range(6000)) and out["position"].is_monotonic_increasing
    total = out["tokens"].sum()
    knots = {"a": [0.4, 0.2, 0.1], "b": [0.3, 0.2, 0.1], "c": [0.2, 0.2, 0.2], "d": [0.1, 0.4, 0.6]}
    for lo in np.arange(0, 1, 0.1):
        part = out[(out.position >= lo) & (out.position < lo + 0.1)]
        for s, w in knots.items():
            want = np.interp(lo + 0.05, [0, 0.5, 1], w)
            assert abs(part[part.source == s]["tokens"].sum() / part["tokens"].sum() - want) < 0.02
        assert abs(part["tokens"].sum() / total - 0.1) < 0.01


def test_mixing_awkward(spark):
    out = mixing.mixed(awkward(spark))
    assert out.columns == awkward(spark).columns and out.distinct().count() == awkward(spark).distinct().count()
    assert mixing.curriculum(empty(spark)).count() == 0
    rows = mixing.curriculum(awkward(spark)).collect()
    assert sorted({(r["doc_id"] or 0, r["source"], r["tokens"]) for r in rows}) == sorted({(r["doc_id"] or 0, r["source"] or "", len((r["text"] or "").replace("\u3000", "x").split())) for r in awkward(spark).collect()})
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and sum(r["doc_id"] == 1 and r["copy"] == 0 for r in rows) == 2
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["copy"], r["tokens"]) for r in mixing.curriculum(blank).collect()} == {(1, 0, 0), (2, 0, 0)}


# ---- 10 embeddings -------------------------------------------------------------------------


@pytest.mark.parametrize(("top", "cell"), [(300, 60), (10_000, 50), (90, 1000)])
def test_embedding_recall(spark, top, cell):
    """Two levels of cells, one first cell with many second ones, many first ones with one each."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 48))
    x = centres[rng.integers(12, size=900)] * 0.6 + rng.normal(size=(900, 48))
    noise = rng.normal(size=(900, 48))
    near = x + noise * (np.linalg.norm(x, axis=1) / np.linalg.norm(noise, axis=1) * rng.uniform(0, 0.35, 900))[:, None]
    both = np.concatenate([x, near]).astype(np.float32)
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, embedding array<float>")
    got = {(r["a"], r["b"]) for r in embeddings.near_pairs(table, top=top, cell=cell).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 3 and len(want) > 300
    parent = np.arange(1800)
    embeddings.unite(parent, *np.array(sorted(got)).T)
    groups_of = {r["vec_id"]: r["keep"] for r in embeddings.dedup(table, top=top, cell=cell).collect()}
    assert groups_of == dict(enumerate(embeddings.roots(parent, np.arange(1800)).tolist()))


def test_embedding_awkward(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.001], 0), (2, [2.0, 0.001], 0), (3, [0.0, 1.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0], 1), (8, [float("nan"), 1.0], 1), (9, [None, 1.0], 1), (None, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = {r["vec_id"]: (r["keep"], r["kept"]) for r in embeddings.dedup(table).collect()}
    assert got == {1: (1, True), 2: (1, False)} | {k: (k, True) for k in (3, 4, 5, 6, 7, 8, 9)}
    assert embeddings.dedup(table.limit(0)).count() == 0
