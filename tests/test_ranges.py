"""Ranks, running sums and percentiles over many ranges, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import corpus, curriculum, inference, metrics, ranges


@pytest.fixture
def many_ranges(monkeypatch):
    """Small tables are cut into many ranges, too."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10)
    monkeypatch.setattr(ranges, "SAMPLE_ROWS", 3)


def rows():
    rng = random.Random(3)
    return [(["a", "b", None][i % 3 if i % 7 else 0], rng.choice([None, 1.5, -2.0, float(rng.randint(0, 40))]), i) for i in range(700)]


@pytest.mark.parametrize("parts", [1, 4, 70])
def test_running_sums_by_key(spark, many_ranges, parts):
    df = spark.createDataFrame(rows(), "k string, v double, i long").repartition(5)
    got = {r.i: r.s for r in ranges.running(df, ["k"], ["v", "i"], {"s": F.col("i")}, parts).collect()}
    order = sorted(rows(), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
    sums, want = {}, {}
    for k, _, i in order:
        sums[k] = want[i] = sums.get(k, 0) + i
    assert got == want


def test_equal_rows_share_a_sum_unless_apart(spark, many_ranges):
    df = spark.createDataFrame([(x,) for x in [1, 1, 2, 2, 2, 3] * 20], "v int")
    assert {(r.v, r.s) for r in ranges.running(df, [], ["v"], {"s": F.lit(1)}, 9).collect()} == {(1, 40), (2, 100), (3, 120)}
    assert sorted(r.n for r in ranges.numbered(df, ["v"], "n", 9).collect()) == list(range(120))


def test_a_range_depends_on_the_row_alone(spark, many_ranges):
    df = spark.createDataFrame(rows(), "k string, v double, i long")
    one, two = ({r.i: r.p for r in ranges.ranged(df.repartition(n, "i"), ["v", "i"], "p", 40).collect()} for n in (2, 9))
    assert one == two and len(set(one.values())) > 20
    placed = sorted((p, r[1] is not None, r[1] or 0.0, r[2]) for r, p in ((r, one[r[2]]) for r in rows()))
    assert [p[1:] for p in placed] == sorted(p[1:] for p in placed)


def test_percentiles_agree_with_numpy(spark, many_ranges):
    df = spark.createDataFrame([*rows(), ("a", float("nan"), 9999)], "k string, v double, i long").filter("k is not null")
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r.k: r for r in ranges.percentiles(df, ["k"], "v", shares).collect()}
    for k in "ab":
        values = [v for key, v, _ in rows() if key == k and v is not None]
        assert [got[k][n] for n in shares] == pytest.approx(np.quantile(values, list(shares.values())).tolist())
    assert ranges.percentiles(df.filter("false"), ["k"], "v", shares).count() == 0


def test_ranks_of_one_large_group(spark, many_ranges):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 30, 400).astype(float), rng.integers(0, 30, 400).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "i int, y double, p double")

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    assert metrics.spearman(df, [], "y", "p").first()[0] == pytest.approx(np.corrcoef(ranks(y), ranks(p))[0, 1])
    label = (y > 20).astype(int)
    wins = sum((a > b) + (a == b) / 2 for a in p[label == 1] for b in p[label == 0])
    assert metrics.roc_auc(df.withColumn("y", (F.col("y") > 20).cast("int")), [], "y", "p").first()[0] == pytest.approx(wins / (label.sum() * (1 - label).sum()))
    gains, k = (y - y.min()) / (y.max() - y.min()), 40
    best = lambda order: sum(gains[i] / np.log2(r + 2) for r, i in enumerate(order[:k]))
    want = best(sorted(range(400), key=lambda i: (-p[i], i))) / best(sorted(range(400), key=lambda i: (-gains[i], i)))
    assert metrics.ndcg(df, [], "y", "p", "i").first()[0] == pytest.approx(want)


def test_ndcg_of_ids_that_repeat_does_not_depend_on_the_order_of_rows(spark):
    # 20 rows, two in the top share: one place of rank 2 for two rows of one id and prediction
    data = [(1, 9.0, 100.0), (2, 5.0, 4.0), (2, 5.0, 8.0), *((i, 0.0, 0.0) for i in range(3, 20))]
    got = [metrics.ndcg(spark.createDataFrame(d, "i int, p double, y double").coalesce(1), [], "y", "p", "i").first()[0] for d in (data, data[::-1])]
    want = (1.0 + 0.04 / np.log2(3)) / (1.0 + 0.08 / np.log2(3))  # the smaller label comes first
    assert got == pytest.approx([want, want])


def test_folds_fractions_and_resamples_are_exact(spark, many_ranges):
    df = spark.range(103)
    folds = curriculum.folds(df, "id", 5, "k").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20, 20, 21, 21, 21]
    assert curriculum.keep_fraction(df, 0.1, "id", "s").count() == 10 and curriculum.keep_fraction(df, 0.0, "id", "s").count() == 0
    drawn = inference.resamples(df, "id", 7, "b").groupBy("resample").agg(F.sum("multiplicity").alias("n")).collect()
    assert len(drawn) == 7 and {r.n for r in drawn} == {103}


def test_quantiles_take_values_that_are_there(spark, many_ranges):
    df = spark.createDataFrame([(i % 50,) for i in range(500)] + [(None,)], "v int")
    values = sorted(i % 50 for i in range(500))
    got = {r["quantile"]: r["value"] for r in corpus.quantiles(df, "v", [0.05, 0.95]).collect()}
    assert got == {q: values[round(q * 499)] for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
