"""Near copies that repeat their lines, and unrelated texts that repeat one shingle, by the similarity of their distinct shingles."""

import random

import numpy as np

from strandframe.llm import simhash

WORDS = [f"w{k}" for k in range(5000)]


def test_repeated_shingles_count_once():
    rng = random.Random(11)
    for _ in range(20):
        base = rng.choices(WORDS, k=200)
        line = base[50:60]
        one, two = ([], [])
        a = simhash.shingle_bits(" ".join(base).encode(), 5, True, one)
        b = simhash.shingle_bits(" ".join(base + line * 10).encode(), 5, True, two)
        assert len(np.intersect1d(one[0], two[0])) / len(np.union1d(one[0], two[0])) > 0.9
        assert np.bitwise_count(a ^ b).sum() <= 28
    # over parts as well as at once
    text, old = " ".join(base * 3).encode(), simhash.PART
    whole = simhash.shingle_bits(text, 5, True, one := [])
    try:
        simhash.PART = 37
        parts = simhash.shingle_bits(text, 5, True, two := [])
    finally:
        simhash.PART = old
    assert (whole == parts).all() and (one[0] == two[0]).all()


def test_groups_by_sets_and_not_by_fingerprints(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(20):  # pairs of a text and itself with one line repeated
        base = rng.choices(WORDS, k=1000)
        texts += [" ".join(base), " ".join(base + base[100:110] * 30)]
    texts += [" ".join(["same"] * 400 + rng.choices(WORDS, k=150)) for _ in range(6)]  # unrelated but for a run of one word
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(map(tuple, simhash.groups(df).collect()))
    assert got == {i: i - i % 2 if i < 40 else i for i in range(46)}


def test_equal_fingerprints_of_different_sets(spark, monkeypatch):
    plain = simhash.shingle_sets
    rng = random.Random(13)
    base = rng.choices(WORDS, k=300)
    texts = [" ".join(rng.choices(WORDS, k=100)) for _ in range(5)] + [" ".join(base), " ".join(base[:299] + ["x"]), " ".join(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    from pyspark.sql import functions as F

    zero = F.lit(0).cast("long")
    monkeypatch.setattr(simhash, "shingle_sets", lambda docs, words: plain(docs, words).withColumn("fp", zero).withColumn("fp2", zero))
    assert dict(map(tuple, simhash.groups(df).collect())) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5}
