import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import cleaner

FUZZ = st.lists(st.text(alphabet="ab .,!?;:-\n\t\xa0\u2003\x1c\x85é—GotitOkay'", max_size=30), min_size=1, max_size=60)
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def through(spark, texts, fn):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["x"] for r in df.select("k", fn(F.col("t")).alias("x")).orderBy("k").collect()]


@QUICK
@given(FUZZ)
def test_strip_squeeze_words(spark, texts):
    assert through(spark, texts, X.strip) == [t.strip() for t in texts]
    assert through(spark, texts, X.squeeze) == [re.sub(r"\s{2,}", " ", t).strip() for t in texts]
    assert through(spark, texts, X.word_count) == [len(re.findall(r"\w+", t)) for t in texts]
    want = [max(1, len([x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x])) for t in texts]
    assert [max(1, n) for n in through(spark, texts, X.sentence_count)] == want


def test_pinned_spaces(spark):
    """White space beyond ASCII ends sentences, as it does in Python."""
    texts = ["a.\u00a0b", "One.\u2003Two!\u00a0Three?\x1cFour.", "a. b", " a.b "]
    assert through(spark, texts, X.sentence_count) == [2, 4, 2, 1]
    assert through(spark, ["\x1fÉté!\u00a0là", "\u2003Ok, so"], X.first_word) == ["été", "ok"]
    assert through(spark, ["naïve rates", "5 %", "x"], lambda c: X.has(c, r"(?i)\bÏVE|\d\s%$")) == [False, True, False]


@QUICK
@given(FUZZ)
def test_openers_are_a_fixpoint(spark, texts):
    one = re.compile(r"(?i)\A" + cleaner._OPENER)

    def loop(t):
        while (new := one.sub("", t, count=1)) != t:
            t = new
        return t

    assert through(spark, texts, cleaner.drop_openers) == [loop(t) for t in texts]


def test_pick3_matches_arithmetic(spark):
    import hashlib

    def pick(seed):
        h, out = int(hashlib.md5(seed.encode()).hexdigest(), 16), []
        k = h % 8
        while len(out) < 3:
            if k % 8 not in out:
                out.append(k % 8)
            k += 1 + h % 3
        return [cleaner.COMFORT[x] for x in out]

    seeds = [f"seed {k} é" for k in range(300)]
    assert through(spark, seeds, lambda c: cleaner.pick3(c, cleaner.COMFORT)) == [pick(s) for s in seeds]


def test_names_are_literal(spark):
    cases = [("Hey Jo.n, come over", "Jo.n", "come over"), ("Joan, hi", "Jo.n", "Joan, hi"), ("Well then, D'Ann.", "D'Ann", "Well then."), ("Thanks \\E x", "\\E", "Thanks \\E x")]
    df = spark.createDataFrame([(k, m, n) for k, (m, n, _) in enumerate(cases)], "k int, m string, n string")
    got = df.select("k", cleaner.drop_name(F.col("m"), F.col("n"), F.lit(False)).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == [w for _, _, w in cases]
