"""Literal fixtures with results worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandframe.functions import hashing, sequences
from strandframe.operators import baselines, corpus, curriculum, inference, metrics, tables
from strandframe.sources import sequences as files
from strandframe.streaming import ingest


def test_assembly(spark):
    base = spark.createDataFrame([("seq1", "ACDE"), ("seq2", "KLM"), ("seq3", "A")], "sequence_id string, sequence string")
    clusters = spark.createDataFrame([("seq1", "cluster1"), ("seq2", "cluster2")], "sequence_id string, cluster_id string")
    scores = spark.createDataFrame([("seq1", 0.9), ("seq2", 0.8)], "sequence_id string, score double")
    rows = corpus.assemble(base, clusters, "toy", scores).orderBy("sequence_id").collect()
    assert [tuple(r) for r in rows] == [("seq1", "ACDE", "cluster1", "toy", 4, 0.9), ("seq2", "KLM", "cluster2", "toy", 3, 0.8)]
    with pytest.raises(ValueError):
        corpus.assemble(base, clusters, "toy")
    assert corpus.assemble(base, clusters, "toy", on_missing_scores="skip").columns == ["sequence_id", "sequence", "cluster_id", "dataset_id", "sequence_length"]


def test_cascade(spark):
    schema = "sequence_id string, cluster_id string"
    first = spark.createDataFrame([("s1", "s1"), ("s2", "s1"), ("s3", "s3")], schema)
    second = spark.createDataFrame([("s1", "s1"), ("s3", "s1")], schema)
    out = corpus.compose([(90, first), (0.5, second)]).orderBy("sequence_id")
    assert [tuple(r) for r in out.collect()] == [("s1", "s1", "s1"), ("s2", "s1", "s1"), ("s3", "s3", "s1")]
    assert out.columns == ["sequence_id", "cluster_rep_at_90", "cluster_rep_at_50"]
    with pytest.raises(ValueError):
        corpus.compose([(0.904, first), (0.9, second)])
    with pytest.raises(Exception):  # noqa: B017
        corpus.compose([(0.9, first), (0.5, second.limit(1))]).collect()


def test_holdout_agrees_with_integers(spark):
    ids = [f"C{i}" for i in range(300)]
    got = {r.c: r.m for r in spark.createDataFrame([(i,) for i in ids], "c string").select("c", hashing.md5_mod(F.col("c"), 20).alias("m")).collect()}
    assert got == {i: int(hashlib.md5(i.encode()).hexdigest(), 16) % 20 for i in ids}
    assert not spark.range(1).select(curriculum.is_held_out(F.lit(None).cast("string")).alias("x")).first().x


def test_ramps(spark):
    at = lambda kind, start, end, over: [round(r[0], 6) for r in spark.range(0, 16, 5).select(curriculum.ramped(F.col("id"), kind, start, end, over)).collect()]
    assert at("linear", 0.1, 0.5, 10) == at("cosine", 0.1, 0.5, 10) == [0.1, 0.3, 0.5, 0.5]
    assert at("exponential", 0.1, 0.4, 10) == [0.1, 0.2, 0.4, 0.4]
    assert at("exponential", 0.0, 1.0, 10) == [0.0, round((2.718281828459045**0.5 - 1) / 1.718281828459045, 6), 1.0, 1.0] and at("linear", 0.0, 1.0, 0) == [1.0] * 4
    with pytest.raises(ValueError):
        curriculum.ramped(F.lit(1), "steps", 0, 1, 2)


def test_packing_is_greedy(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([3, 3, 20, 1, 2, 1])] + [(1, 0, 5)], "p int, i int, n int")
    got = sorted(tuple(r) for r in curriculum.pack_batches(rows, "p", "i", "n", 10).collect())
    assert got == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 2), (0, 5, 2), (1, 0, 0)]


def test_fmax(spark):
    def score(probabilities, labels):
        rows = [(k, p, y) for k, (ps, ys) in enumerate(zip(probabilities, labels, strict=True)) for p, y in zip(ps, ys, strict=True)]
        return metrics.f_max(spark.createDataFrame(rows, "k int, p double, y int"), "k", "y", "p").first()[0]

    assert score([[0.01, 0.0]], [[1, 0]]) == 1.0
    assert score([[0.009, 0.0]], [[1, 0]]) == 0.0
    assert score([[0.9, 0.8, 0.8], [0.001, 0.001, 0.001]], [[1, 0, 0], [1, 1, 1]]) == pytest.approx(2 / 3)
    assert score([[0.9, 0.9, 0.9], [0.9, 0.0, 0.0]], [[1, 0, 0], [1, 1, 0]]) == pytest.approx(12 / 17)


def test_hierarchy(spark):
    rows = [("Activity", "P1", 1.0), ("Activity", "P1", 0.0), ("Activity", "P2", 0.5), ("Binding", "P3", 0.2), ("Binding", "P4", float("nan"))]
    got = {r.f: r.score for r in metrics.hierarchy(spark.createDataFrame(rows, "f string, p string, score double"), "score", ["f", "p"]).collect()}
    assert got == {"Activity": 0.5, "Binding": 0.2}


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    got = {r.k: r.q for r in inference.benjamini_hochberg(rows, [], "p").collect()}
    assert got[4] is None and [round(got[k], 6) for k in (1, 2, 3)] == [0.03, 0.04, 0.04]


def test_multiset_alignment(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, i int")
    right = spark.createDataFrame([("a", 7), ("a", 8), ("c", 9)], "k string, j int")
    got = sorted(((r.k, r.i, r.j, r.matched) for r in tables.align_multiset(left, right, ["k"], "i", "j").collect()), key=str)
    assert got == [("a", 1, 7, True), ("a", 2, 8, True), ("b", 3, None, False), ("c", None, 9, False)]


def test_subset_types_and_groups(spark):
    df = spark.createDataFrame([(1, True, "x"), (1, False, "x"), (2, True, "y")], "g int, b boolean, s string")
    assert tables.subset(df, {"b": True}).count() == 2
    with pytest.raises(TypeError):
        tables.subset(df, {"b": 1})
    with pytest.raises(ValueError):
        tables.subset(df, {"b": True}, "g")


def test_sequence_functions(spark):
    row = spark.range(1).select(
        sequences.composition(F.lit("AAC-")).alias("c"), sequences.mutations(F.lit("A12C:D3E")).alias("m"), sequences.log_softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("l"),
        sequences.window_start(F.lit(1200), F.lit(1190), 512).alias("w"), sequences.mask_bit(F.lit(5), F.lit(2)).alias("b"), sequences.binary_label(F.lit("Benign")).alias("y"),
    ).first()
    assert row.c[:2] == pytest.approx([2 / 3, 1 / 3]) and [tuple(m) for m in row.m] == [("A", 12, "C"), ("D", 3, "E")]
    assert row.l[0] == pytest.approx(-0.693147, abs=1e-6) and (row.w, row.b, row.y) == (688, True, 0.0)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">id1 first > one\nACD\nE\n>id2\nKLM\n")
    rows = files.fasta(spark, str(tmp_path / "a.fa"), "T").orderBy("sequence_id").collect()
    assert [tuple(r) for r in rows] == [("T_000000000000", "id1", "first > one", "ACDE"), ("T_000000000001", "id2", "", "KLM")]


def test_temperature_of_calibrated_sites(spark):
    import math

    from strandframe.operators import calibration

    logits = [0.0, 1.0, 2.0]
    soft = [math.exp(x / 2) for x in logits]
    profile = [x / sum(soft) for x in soft]
    rows = [(f, b, t, True, profile, logits) for f in (0, 1) for b in (0, 1) for t in (True, False)]
    schema = "fold int, bin int, is_t boolean, in_balanced boolean, profile array<double>, logits array<double>"
    got = {r.fold: (round(r.temperature, 6), r.bound) for r in calibration.temperatures(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: (2.0, "none"), 1: (2.0, "none")}
    flat = [(f, 0, True, True, [1 / 3] * 3, logits) for f in (0, 1)] + [(2, 0, True, False, [1.0, 0.0, 0.0], logits)]
    assert {r.fold: (r.temperature, r.bound) for r in calibration.temperatures(spark.createDataFrame(flat, schema)).collect()} == {f: (8.0, "upper") for f in (0, 1, 2)}
    sharp = [(f, 0, True, True, [0.0, 0.0, 1.0], logits) for f in (0, 1)]
    assert {r.bound for r in calibration.temperatures(spark.createDataFrame(sharp, schema)).collect()} == {"lower"}
    one = calibration.temperatures(spark.createDataFrame(rows[:1], schema)).collect()
    assert [(r.temperature, r.bound) for r in one] == [(None, None)]


def test_multilabel_mcc(spark):
    cells = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 0, 1), (2, "a", 0, 0), (2, "b", 0, 0)], "row int, term string, y int, p int")
    r = metrics.multilabel_mcc(cells, "row", "term", "y", "p").first()
    # a: 1; b: labels constant, 0; all weight is on a; both rows have a constant side
    assert (r.mcc_macro, r.mcc_weighted, r.mcc_samples) == (0.5, 1.0, 0.0) and abs(r.mcc_micro - 2 / 12**0.5) < 1e-12
    none = metrics.multilabel_mcc(cells.filter("false"), "row", "term", "y", "p").first()
    assert tuple(none) == (None, None, None, None)


def test_multilabel_ranking(spark):
    cells = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 0, 0.5), ("b", 0, 0.4)], "term string, y int, s double")
    assert tuple(metrics.multilabel_ranking(cells, "term", "y", "s").first()) == (0.5, 1.0, 1.0)


def test_assay_mcc(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 1, 1.0), ("b", 1, 3.0)], "g string, y int, s double")
    got = {r.g: r.mcc for r in metrics.assay_mcc(rows, ["g"], "y", "s").collect()}
    assert got["a"] == 1.0 and got["b"] != got["b"]


def test_ingest_takes_a_shard_once(spark, tmp_path):
    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    shard = lambda a, b: spark.range(a, b).write.mode("append").parquet(source)
    shard(0, 10)
    take = lambda: ingest.ingest(spark, source, target, log, "id long", lambda s: s.filter("id <> 3"))
    assert (take(), take()) == (10, 0)
    shard(10, 15)
    assert take() == 5 and sorted(r.id for r in spark.read.parquet(target).collect()) == [i for i in range(15) if i != 3]
