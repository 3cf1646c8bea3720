"""Repeats, order, hot keys and small parts of the operators, and the query functions on tables in a folder."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from strandframe.llm import ann, components, langid, linededup, quality, queries, sharding
from strandframe.llm.common import Staging
from strandframe.staging import join_hot

pytest.importorskip("public_tokenizers")
VECTORS = "vec_id long, embedding array<float>"


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]


def brute(rows, k=20):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (v * v[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df, **more):
    out = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_repeated_rows_are_one_vector(spark):
    rows = vectors(400)
    df = spark.createDataFrame([*rows, rows[0], rows[0], rows[0], rows[20], rows[7], *[rows[33]] * 50], VECTORS).repartition(4)
    assert found(df, recall=1.0) == brute(rows)


def test_every_query_gets_its_twenty(spark, monkeypatch):
    # tiny leaves, of which the calibrated number holds fewer vectors than are asked for
    monkeypatch.setattr(ann, "LEAF_VECTORS", 2)
    rows = vectors(300)
    got = found(spark.createDataFrame(rows, VECTORS), recall=0.01)
    assert all(len(x) == 20 and len({i for i, _ in x}) == 20 for x in got.values()) and len(got) == 15
    few = found(spark.createDataFrame(rows[:12], VECTORS), recall=0.01)
    assert {q: len(x) for q, x in few.items()} == {0: 11}


def test_hot_leaf_and_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 7)
    rows = vectors(300)
    rows += [(1000 + 20 * i, rows[5][1]) for i in range(40)]
    assert found(spark.createDataFrame(rows, VECTORS), recall=1.0) == brute(rows)


def test_vectors_without_an_inner_product(spark):
    with pytest.raises(ValueError):
        ann.search(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], VECTORS), F.col("vec_id") == 0)


def labelled(spark):
    rng = random.Random(2)
    words = {"aa": [f"al{k}ko" for k in range(40)], "bb": [f"be{k}na" for k in range(40)]}
    return [(i, " ".join(rng.choices(words[x], k=rng.randint(3, 60))), x) for i in range(300) for x in [("aa", "bb")[i % 2]]]


def test_what_is_learned_depends_on_the_texts_alone(spark):
    rows, schema = labelled(spark), "doc_id long, text string, lang string"
    one = langid.learn(spark.createDataFrame(rows, schema).repartition(1))
    again = spark.createDataFrame([*rows, *[rows[0]] * 500, *[(9000 + i, rows[3][1], rows[3][2]) for i in range(500)]], schema).repartition(6)
    assert langid.learn(again) == one and set(one) == {"aa", "bb"}
    repeats = langid.learn(spark.createDataFrame([(1, "one text only", "cc")] * 3000, schema))
    assert repeats == {"cc": b"one text only"}
    long = langid.learn(spark.createDataFrame([(1, "z" * 200_000, "dd"), (2, "y" * 150_000, "dd"), (3, "12", "dd"), (4, None, "dd")], schema))
    assert long == {"dd": b"y" * 150_000}
    whole = {t.lower() for _, t, x in rows if x == "aa"}
    assert set(one["aa"].decode().split("\n")) == whole  # whole texts, none cut


def test_languages_by_plain_compression(spark):
    rows, schema = labelled(spark), "doc_id long, text string, lang string"
    df = spark.createDataFrame(rows, schema)
    known = langid.learn(df)
    coders = {x: zstandard.ZstdCompressor(level=7, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for x, d in known.items()}
    extra = spark.createDataFrame([(500, "al1ko " * 5000 + "be2na " * 100, None), (501, "AL3KO", None)], schema)
    for r in langid.identify(df.unionAll(extra).unionAll(extra), known).collect():
        text = r.text.lower().encode()
        size = lambda t: {x: sum(len(c.compress(t[k : k + 4096])) for k in range(0, len(t), 4096)) for x, c in coders.items()}
        sizes = size(text)
        low, high = sorted(sizes.values())
        if (high - low) / high < langid.NARROW and len(text) <= langid.SHORT_BYTES:
            words = text.split()
            many = [size(b" ".join([text, *words[i:], *words[:i]])) for i in range(len(words))]
            sizes = {x: sum(s[x] for s in many) for x in sizes}
            low, high = sorted(sizes.values())
        assert r.lang_pred == min(sorted(sizes), key=sizes.get) and r.lang_score == pytest.approx((high - low) / high) and r.lang_rejected == ((high - low) / high < langid.NARROW)


def loss(weights, thresholds, rows):
    """The penalised, weighted negative log-likelihood that fitting makes small."""
    grades = np.array([g for _, g in rows])
    share = (1 / np.bincount(grades, minlength=3).clip(1)) ** 0.5
    w = share[grades] / share[grades].sum()
    tail = lambda s, k: 1.0 if k == 0 else 0.0 if k == 3 else 1 / (1 + np.exp(thresholds[k - 1] - s))
    each = [-np.log(max(tail(weights[b].sum(), g) - tail(weights[b].sum(), g + 1), 1e-9)) for b, g in rows]
    return float((w * each).sum() + quality.DECAY * (weights**2).sum() / 2)


def test_ordinal_fit_is_a_minimum():
    rng = np.random.default_rng(4)
    signal = rng.normal(size=12) * 2
    rows = []
    for _ in range(400):
        b = np.sort(rng.choice(12, 4, replace=False)).astype(np.int32)
        rows.append((b, int(np.searchsorted([-1.0, 1.5], signal[b].sum() + rng.logistic()))))
    model = quality.fit(rows)
    used = np.flatnonzero(model.weights)
    own = loss(model.weights.astype(np.float64), model.thresholds, rows)
    for _ in range(40):  # no direction leads down by more than rounding
        w, t = model.weights.astype(np.float64).copy(), model.thresholds.copy()
        w[used] += rng.normal(size=len(used)) * 0.05
        t = np.sort(t + rng.normal(size=2) * 0.05)
        assert loss(w, t, rows) > own - 1e-4
    # plain gradient descent by finite differences, from elsewhere, comes to the same place
    x = np.concatenate([rng.normal(size=len(used)), [-0.5, 0.5]])
    at = lambda x: loss(np.bincount(used, x[:-2], quality.BUCKETS), x[-2:], rows)
    for _ in range(150):
        g = np.array([(at(x + h) - at(x - h)) / 2e-5 for h in np.eye(len(x)) * 1e-5])
        x -= 2.0 * g
    assert at(x) == pytest.approx(own, abs=5e-3)


def line_case():
    rng = random.Random(1)
    rows = [(h, 0, 1, doc, 7, pos) for h, docs in ((1, 30), (2, 3), (5, 1), (9, 400), (10, 12)) for doc in range(docs) for pos in range(rng.choice([1, 1, 3]))]
    rows += [(5, 0, 1, 0, 7, p) for p in range(50, 300)] + [(20 + k, 0, 1, k, 7, 0) for k in range(40)]
    return sorted({*rows}) + [(9, 0, 1, 0, 7, 0)] * 2  # a repeated row


@pytest.mark.parametrize("policy", ["shared", "shared_but_first", "first"])
@pytest.mark.parametrize("held", [1, 10**9])
@pytest.mark.parametrize("tasks", [1, 3, 17])
def test_streams_settle_the_same_whatever_they_hold(monkeypatch, policy, held, tasks):
    monkeypatch.setattr(linededup, "HELD", held)
    rows = sorted(line_case())
    names = [x.split()[0] for x in linededup.ROWS.split(", ")]
    gone, opened = set(), []
    for k in range(tasks):
        part = rows[len(rows) * k // tasks : len(rows) * (k + 1) // tasks]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part[i : i + 5], strict=True)], names=names) for i in range(0, len(part), 5)]
        for out in linededup._stream(iter(batches), 10, policy == "first", policy == "shared_but_first"):
            for *r, o in zip(*(c.to_pylist() for c in out.columns), strict=True):
                opened.append(tuple(r)) if o else gone.add(tuple(r))
    docs = defaultdict(set)
    for r in opened:
        docs[r[0]].add(r[2:5])
    for r in opened:
        is_first = r == min(x for x in opened if x[0] == r[0])
        if (policy == "first" and not is_first) or (policy != "first" and len(docs[r[0]]) >= 10 and not (policy == "shared_but_first" and is_first)):
            gone.add(r)
    every = defaultdict(set)
    for r in rows:
        every[r[0]].add(r)
    want = {r for h, own in every.items() for r in own if (policy == "first" or len({x[2:5] for x in own}) >= 10) and not (policy != "shared" and r == min(own))}
    assert gone == want


def test_hot_keys_stay_where_they_are(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 50)] + [(None, 0), (99, 1)], "k int, i int")
    right = spark.createDataFrame([(k, k * 10, 500 if k == 1 else 1) for k in range(1, 60)], "k int, v int, n long")
    got = sorted(map(tuple, join_hot(left, right, ["k"], 100).select("k", "i", "v").collect()))
    assert got == sorted([(1, i, 10) for i in range(500)] + [(k, k, 10 * k) for k in range(2, 50)])
    star = [(0, k) for k in range(1, 3000)] + [(k, k + 10_000) for k in range(1, 3000, 2)]
    roots = components.components(spark.createDataFrame(star, "a long, b long"), Staging(spark, "t")).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 3000 + 1500


def test_one_text_of_a_third_of_all_rows(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"{i} " + "x" * (i % 200)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3000 and len({r.shard for r in got if r.doc_id % 3 == 0}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_query_functions(spark, tmp_path):
    rows = [(i, t, x, "s", len(t)) for i, t, x in labelled(spark)] + [(1000, None, "aa", None, None), (1001, "123", None, "s", 3), (None, "al1ko al2ko al3ko al4ko", "aa", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    for r in (out := queries.op5_language(spark, d)).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (1000, 1001))
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == len(rows)
    shards = queries.op6_shards(spark, d)
    assert shards.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and {r.law for r in shards.collect()} == {"bytes"} and dict(shards.dtypes)["text_crc32"] == "bigint"
    licenses = queries.op10_licenses(spark, d)
    assert licenses.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and licenses.count() == len(rows)
    rated = queries.op8_quality(spark, d).collect()
    assert len(rated) == len(rows) and all(0 <= r.expected_grade <= 2 and r.kept == (r.p_top >= quality.SELECT) for r in rated)


def test_a_round_of_components_with_hubs_is_no_large_plan(spark):
    joins = []

    class Counted(Staging):
        def write(self, df, name):
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
            return super().write(df, name)

    star = [(0, i) for i in range(1, 400)] + [(i, 1000 + i) for i in range(1, 20)]
    roots = components.components(spark.createDataFrame(star, "a long, b long"), Counted(spark, "t")).collect()
    assert len(roots) == 419 and {r.root for r in roots} == {0} and 0 < max(joins) <= 4
