"""Batches, crops, corruption and model outputs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import alignment, batching


def test_balanced_shards():
    place = batching.balanced([1000, 10, 10, 10, 10], 2)
    loads = Counter()
    for n, b in zip([1000, 10, 10, 10, 10], place, strict=True):
        loads[b] += n
    assert sorted(loads.values()) == [40, 1000] and batching.balanced([5], 3) == [0] and batching.balanced([1, 1, 1], 3) == [0, 1, 2]


def test_packed_and_padded_round_trip(spark):
    rows = [(0, i, list(range(10 * i, 10 * i + n))) for i, n in enumerate([3, 1, 5])] + [(1, 0, [7]), (2, 0, [])]
    df = spark.createDataFrame(rows, "b int, o int, ids array<int>").withColumn("y", F.transform("ids", lambda x: x + 1))
    got = {r.b: r for r in batching.packed(df, "b", "o", "ids", 99, 8, "y").collect()}
    r = got[0]
    assert r.input_ids == [0, 1, 2, 10, 20, 21, 22, 23, 24, *[99] * 7] and r.position_ids == [0, 1, 2, 0, 0, 1, 2, 3, 4, *[0] * 7]
    assert (r.cu_seqlens, r.max_seqlen, r.num_sequences, r.num_tokens) == ([0, 3, 4, 9, 16], 7, 3, 9) and r.labels[:4] == [1, 2, 3, 11] and r.labels[9:] == [-100] * 7
    assert got[2].cu_seqlens == [0, 0, 0] and got[2].num_tokens == 0
    back = {(x.b, x.place): x.ids for x in batching.unpacked(batching.packed(df, "b", "o", "ids", 99, 8), "b").collect()}
    assert back == {(b, o): ids for b, o, ids in rows}
    p = {r.b: r for r in batching.padded(df, "b", "o", "ids", 99, 4, "y").collect()}[0]
    assert p.input_ids[1] == [10, *[99] * 7] and p.attention_mask[1] == [1, *[0] * 7] and p.position_ids[2] == [0, 1, 2, 3, 4, 0, 0, 0] and p.labels[0] == [1, 2, 3, *[-100] * 5]


@pytest.mark.parametrize("kind", ["fixed", "cosine", "beta"])
def test_corruption(spark, kind):
    rows = [(i, [1, *range(10, 10 + 60), 2]) for i in range(300)] + [(1000, [1, 2]), (1001, [1, 50, 2])]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    got = batching.corrupted(df, "i", "ids", 3, [1, 2], "s", kind=kind, rate=0.15).collect()
    shares = []
    for r in got:
        free = [k for k, x in enumerate(r.ids) if x not in (1, 2)]
        hit = [k for k, x in enumerate(r.input_ids) if x == 3]
        assert set(hit) <= set(free) and (hit or not free) and all(y == (r.ids[k] if k in hit else -100) for k, y in enumerate(r.labels)) and all(x == r.ids[k] for k, x in enumerate(r.input_ids) if k not in hit)
        if len(free) == 60:
            shares.append(len(hit) / 60)
    want = {"fixed": 0.15, "cosine": 0.15 * (1 - 2 / math.pi), "beta": 0.15}[kind]
    assert abs(np.mean(shares) - want) < 0.02 and (kind == "fixed" or np.std(shares) > 0.04)
    with pytest.raises(ValueError):
        batching.corrupted(df, "i", "ids", 3, [], "s", kind="other")


def test_beta_quantiles():
    q = batching.beta_quantiles(2.0, 2.0)
    assert q[256] == pytest.approx(0.5, abs=1e-3) and q[0] < 1e-3 and q[-1] == pytest.approx(1.0, abs=1e-3)
    assert q[128] == pytest.approx(0.3264, abs=1e-3)  # 3 x^2 - 2 x^3 = 1/4


def test_length_grouped(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(200)], "i int, n int")
    got = sorted((r.place, r.i, r.n) for r in batching.length_grouped(df, "i", "n", 4, "s").collect())
    assert [p for p, _, _ in got] == list(range(200)) and got[0][2] == 100
    run = 4 * min(200 // 16, 50)
    firsts = [got[k][2] for k in range(0, 200, run)]
    for k in range(0, 200, run):
        inner = [n for _, _, n in got[k + 1 : k + run]]
        assert inner == sorted(inner, reverse=True)
    assert max(firsts) == firsts[0]
    still = [(r.n, r.i) for r in batching.length_grouped(df, "i", "n", 4, None).orderBy("place").collect()]
    assert still == sorted(still, key=lambda x: (-x[0], x[1]))
    few = batching.length_grouped(df.limit(5), "i", "n", 4, "s").orderBy("place").collect()
    assert [r.n for r in few] == sorted((r.n for r in few), reverse=True)


def test_crops_and_scrambles(spark):
    df = spark.createDataFrame([(i, list(range(100, 100 + n))) for i, n in enumerate([5, 40, 200])], "i int, r array<int>").withColumn("y", F.transform("r", lambda x: x - 100))
    for r in batching.cropped(df, "i", "r", 40, "s", 1, 2, "y").collect():
        inner = r.input_ids[1:-1]
        assert r.input_ids[0] == 1 and r.input_ids[-1] == 2 and len(inner) == min(40, len(r.r)) and inner == [100 + p for p in r.original_positions[1:-1]] and r.labels[1:-1] == r.original_positions[1:-1] and r.original_positions[0] == -1
    mixed = spark.createDataFrame([(7, [1, 50, 51, 52, 1, 53, 54, 2])], "i int, ids array<int>").select("ids", batching.scrambled(F.col("ids"), [1, 2], F.col("i"), "s").alias("x")).first()
    assert [k for k, x in enumerate(mixed.x) if x in (1, 2)] == [0, 4, 7] and mixed.x[1] == 50 and sorted(mixed.x) == sorted(mixed.ids)


def test_outputs_and_tokens(spark):
    r = spark.range(1).select(
        batching.argmax(F.array(*map(F.lit, [1.0, 3.0, 3.0]))).alias("a"), batching.decided(F.array(*map(F.lit, [0.0, 0.1, -1.0]))).alias("d"), batching.target_log_prob(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1)).alias("l"),
        batching.residue_logits(F.array(*map(F.lit, [5.0, 6.0, 7.0])), [2, 0]).alias("r"), batching.valid_labels(F.array(*map(F.lit, [1, -100, 2]))).alias("v"), batching.padded_to(F.array(F.lit(1)), 3, -100).alias("p"),
        batching.scored_positions(F.array(*map(F.lit, [-1, 0, 1, -1])), F.array(*map(F.lit, [-100, 4, -100, -100]))).alias("s"), batching.position_ids(F.array(*map(F.lit, [9, 9]))).alias("i"),
    ).first()
    assert (r.a, r.d, r.r, r.v, r.p, r.s, r.i) == (1, [0, 1, 0], [7.0, 5.0], [1, 2], [1, -100, -100], [0], [0, 1]) and r.l == pytest.approx(-math.log(2))
    with pytest.raises(ValueError):
        batching.residue_ids({"A": 1}, 0, "AC")
    assert batching.residue_ids({"A": 1, "C": 2}, 0, "AC") == [1, 2]
    assert batching.checked_vocabulary({"<m>": 0, "A": 1}, 2, {"mask": "<m>"}) == {"mask": 0}
    for bad in (({"A": 1}, 1, {}), ({"A": 0}, 1, {"mask": "<m>"}), ({"A": 0}, 1, {"mask": "A", "pad": "A"})):
        with pytest.raises(ValueError):
            batching.checked_vocabulary(*bad)
    with pytest.raises(Exception, match="no such token"):
        spark.range(1).select(batching.decoded(F.array(F.lit(9)), {"A": 1}, [])).collect()


def test_alignment_errors(spark):
    a = spark.createDataFrame([(1, 0.5, 0), (2, 0.6, 1)], "id int, prediction double, o int")
    assert {(r.id, r.control) for r in alignment.control(a, a.withColumn("prediction", F.col("prediction") * 2)).collect()} == {(1, 1.0), (2, 1.2)}
    for other in (a.limit(1), a.unionAll(a), a.withColumn("id", F.col("id") + 1), a.withColumn("prediction", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            alignment.control(a, other)
    twice = a.withColumn("id", F.lit(1))
    assert alignment.control(twice, twice, order="o").count() == 2
    with pytest.raises(ValueError):
        alignment.control(twice, a, order="o")
    with pytest.raises(ValueError):
        alignment.attach_groups(a, spark.createDataFrame([(1, "g")], "id int, g string"), "id", "g")


def test_baselines_are_paired_without_multiplying(spark):
    model = spark.createDataFrame([("repeat", 0.1, 0), ("repeat", 0.1, 1), ("other", 0.3, 2)], "id string, label double, o int")
    shared = spark.createDataFrame([("other", 0.30000001, 9.0, 7), ("repeat", 0.1, 1.0, 8), ("repeat", 0.1, 2.0, 9)], "id string, label double, prediction double, o int")
    got = sorted((r.o, r.prediction) for r in alignment.baseline(model, shared, "o", regression=True).collect())
    assert got == [(0, 1.0), (1, 2.0), (2, 9.0)]
    for bad in (shared.limit(2), shared.withColumn("label", F.lit(0.2)), shared.unionAll(shared.limit(1))):
        with pytest.raises(ValueError):
            alignment.baseline(model, bad, "o", regression=True)
    with pytest.raises(ValueError):
        alignment.baseline(model, shared, "o", match_labels=False)


def test_token_priors(spark):
    asked = spark.createDataFrame([("p", [5, 7], [0, 2])], "id string, label array<int>, original_positions array<int>")
    priors = spark.createDataFrame([("p", [5, -100, 7], 0.5)], "id string, label array<int>, prediction double")
    assert sorted((r.original_position, r.label, r.prediction) for r in alignment.token_prior(asked, priors).collect()) == [(0, 5, 0.5), (2, 7, 0.5)]
    for rows in ([("p", [5, 7], [0, 1])], [("p", [5, 5], [0, 0])], [("p", [5], [3])], [("q", [5], [0])], [("p", [5], [0, 2])]):
        with pytest.raises(ValueError):
            alignment.token_prior(spark.createDataFrame(rows, asked.schema), priors)


def test_labels(spark):
    df = spark.createDataFrame([(0, [1, -100], [0, 1], 1.0)], "c int, t array<int>, m array<int>, n double")
    for column, kind, classes in (("c", "class", 2), ("t", "token", 2), ("m", "multilabel", 2), ("n", "number", None)):
        assert alignment.checked_labels(df, column, kind, classes).count() == 1
    for column, kind, classes, value in (("c", "class", 2, F.lit(2)), ("t", "token", 1, F.array(F.lit(1))), ("m", "multilabel", 3, F.array(F.lit(1))), ("n", "number", None, F.lit(float("nan")))):
        with pytest.raises(ValueError):
            alignment.checked_labels(df.withColumn(column, value), column, kind, classes)
    one, two = (alignment.identity(spark.createDataFrame(x, "a int, b double"), "a", "b").first() for x in ([(1, float("nan")), (2, None)], [(2, None), (1, float("nan"))]))
    assert one == two and one.n == 2
