"""The corpus queries against DuckDB, and the pipeline against its stages by brute force."""

import json
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from threadloom.llm import _text as T
from threadloom.llm import bpe, mixing, queries, token_output

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    at = [want.columns.index(c) for c in names]
    assert sorted(json.dumps([r[c] for c in names]) for r in df.collect()) == sorted(json.dumps([r[k] for k in at]) for r in want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    now, seen = docs, [docs]
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DIR).cache()
        seen.append(now)
    for before, after in zip(seen[:-2], seen[1:-1], strict=True):
        assert after.columns == docs.columns
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
    clean = [r["doc_id"] for r in seen[1].collect()]
    h, o = T.words(pa.array([text[k] for k in clean], pa.string()))
    sets = {k: set(T.gram_set(h[a:b], 3).tolist()) for k, a, b in zip(clean, o[:-1], o[1:], strict=True)}
    kept = {r["doc_id"] for r in seen[2].collect()}
    for k in clean:  # nobody is dropped without a kept or dropped partner of a smaller number; no kept pair is similar
        partners = [j for j in clean if j != k and sets[k] and sets[j] and len(sets[k] & sets[j]) >= 0.5 * len(sets[k] | sets[j])]
        assert k in kept or any(j < k for j in partners) or any(set(partners) & {j} for j in partners)
        assert k not in kept or not any(j in kept for j in partners)
    assert {r["doc_id"] for r in seen[4].collect()} == {r["doc_id"] for r in seen[3].collect()}
    enc = bpe.encoding(bpe.VOCABULARY)
    for r in seen[5].collect()[::7]:
        assert token_output.decode(r["codes"]).tolist() == enc.encode_ordinary(text[r["doc_id"]])


def awkward_folder(path, rows, items, labels):
    """The tables that the pipeline reads, with columns of clashing names."""
    path.mkdir()
    text, number = pa.string(), pa.int64()
    columns = [("doc_id", number), ("text", text), ("lang", text), ("source", text), ("n_chars", number), ("score", number), ("keep", text), ("row_key", text), ("place", number)]
    full = [(*r, None, 1, "x", "y", 7) for r in rows]
    pq.write_table(pa.table({n: pa.array([r[k] for r in full], t) for k, (n, t) in enumerate(columns)}), path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([k for k, _ in items], number), "text": pa.array([t for _, t in items], text)}), path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([k for k, _ in labels], number), "quality": pa.nulls(len(labels), pa.int32()), "toxic": pa.array([x for _, x in labels], pa.int32())}), path / "labels.parquet")
    return str(path)


def test_pipeline_run_awkward(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and doc_ids, clashing columns: every row is judged by its own text."""
    rng = random.Random(8)
    plain = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item = " ".join(f"quiz{k}" for k in range(24))
    train = [(100 + k, plain(40) + (" vile" if k % 3 == 0 else ""), "en", "s1") for k in range(240)]
    one, other, long = plain(60), plain(60), plain(30_000)
    rows = [
        (1, one, "en", "s1"), (1, one, "en", "s1"), (2, one + " more", "en", "s2"), (None, one, "en", None), (1, other, None, "s2"), (3, item + " " + plain(5), "en", "s1"), (1, plain(9) + " " + item, "en", "s1"),
        (None, "vile " + plain(20), "en", "s1"), (4, long, "en", "s1"), (5, long + " vile", "en", "s1"), (6, "", "de", "s3"), (7, None, None, None), (None, None, None, None), (8, "?!", "fr", "s3"), (9, "x", "es", "s3"),
    ]
    d = awkward_folder(tmp_path / "in", train + rows, [(1, item), (None, item), (2, None), (3, "")], [(k, int(" vile" in t)) for k, t, _, _ in train] + [(None, 1), (999_999, 1), (1, None)])
    got = corpus_pipeline.run(spark, d).collect()
    enc = bpe.encoding(bpe.VOCABULARY)
    shown = {(r["doc_id"], r["codes"]) for r in got}
    coded = lambda k, t: (k, token_output.encode(np.array(enc.encode_ordinary(t or ""), np.uint32)))
    stays = [(1, one), (1, other), (4, long), (6, ""), (7, None), (None, None), (8, "?!"), (9, "x")] + [(k, t) for k, t, _, _ in train if " vile" not in t]
    assert shown == {coded(k, t) for k, t in stays}
    assert [r["place"] for r in got] == list(range(len(got))) and sum((r["doc_id"], r["codes"]) == coded(1, one) for r in got) >= 2


def test_pipeline_run_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, awkward_folder(tmp_path / "none", [], [(1, "a b c")], [(1, 1)])).count() == 0
    assert corpus_pipeline.run(spark, awkward_folder(tmp_path / "bare", [(1, "a b c", "en", "s")], [], [])).count() == 1


def test_pipeline_keeps_the_order_over_many_files(spark, tmp_path):
    """A curriculum of many files of unlike sizes comes out in its order, with the order as a column."""
    texts = [f"{'w ' * (1 + 400 * (k // 100 % 3))}{k}" for k in range(3000)]
    docs = spark.createDataFrame([(7 * k % 3000, t, "ab"[k % 7 == 0]) for k, t in enumerate(texts)], "doc_id long, text string, source string")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        (order := mixing.mixed(docs)).write.parquet(f"{tmp_path}/mixed")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want = [r["doc_id"] for r in order.collect()]
    files = sorted(tmp_path.glob("mixed/*.parquet"))
    assert len(files) > 20 and [k for f in files for k in pq.read_table(f)["doc_id"].to_pylist()] == want
    read = spark.read.parquet(f"{tmp_path}/mixed")
    corpus_pipeline.token_codes(spark, read, DIR).write.parquet(f"{tmp_path}/codes")
    rows = [r for f in sorted(tmp_path.glob("codes/*.parquet")) for r in pq.read_table(f).to_pylist()]
    assert [r["doc_id"] for r in rows] == want and [r["place"] for r in rows] == list(range(len(want)))
    assert [r["doc_id"] for r in corpus_pipeline.token_codes(spark, order, DIR).collect()] == want
