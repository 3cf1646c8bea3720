"""Scores, comparisons, assays and calibration against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import assays, baselines, calibration, metrics, scoring

FLAT = "id string, unit int, label double, prediction double, condition string"


def flat(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        y = float(rng.normal())
        rows += [(f"x{i}", i % 12, y, y + float(rng.normal()) * s, c) for c, s in (("trained", 0.3), ("untrained", 1.5), ("random_head", 0.3))]
    return spark.createDataFrame(rows, FLAT)


def test_metrics_from_sums(spark):
    rows = flat(spark).filter("condition = 'trained'")
    y, p = (np.array([r[c] for r in rows.collect()]) for c in ("label", "prediction"))
    got = {r.metric: r.value for r in scoring.evaluate(rows, [], ["mse", "mae", "r2", "pearson", "mean_log_prob", "pseudo_perplexity", "accuracy"]).collect()}
    want = {"mse": ((y - p) ** 2).mean(), "mae": abs(y - p).mean(), "r2": 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), "pearson": np.corrcoef(y, p)[0, 1], "mean_log_prob": p.mean(), "pseudo_perplexity": math.exp(-p.mean()), "accuracy": 0.0}
    assert got == pytest.approx(want)
    binary = spark.createDataFrame([(1.0, 1.0)] * 3 + [(1.0, 0.0)] + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 4, "label double, prediction double")
    got = {r.metric: r.value for r in scoring.evaluate(binary, [], ["precision", "recall", "f1", "mcc", "accuracy"]).collect()}
    assert got == pytest.approx({"precision": 0.6, "recall": 0.75, "f1": 2 / 3, "mcc": (12 - 2) / math.sqrt(5 * 4 * 6 * 5), "accuracy": 0.7})
    with pytest.raises(KeyError):
        scoring.evaluate(binary, [], ["other"])
    with pytest.raises(KeyError):
        scoring.task_metrics("other")


def test_undefined_units_are_left_out(spark):
    rows = [(0, 0.0, 0.0), (0, 1.0, 1.0), (0, 2.0, 2.0), (0, 3.0, 3.0), (1, 10.0, 20.0), (1, 20.0, 10.0), (2, 5.0, 5.0), (2, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "unit int, label double, prediction double")
    got = {r.metric: (r.value, r.contributors) for r in scoring.mean_of_units(df, "unit", ["pearson", "mse", "mae", "r2"]).collect()}
    assert got["pearson"] == (pytest.approx(0.0), 2) and got["mse"] == (pytest.approx((0 + 100 + 0.5) / 3), 3) and got["mae"] == (pytest.approx(10.5 / 3), 3) and got["r2"] == (pytest.approx((1 - 3) / 2), 2)


def test_comparisons_find_the_worse_control(spark):
    got = {(r.metric, r.control): r for r in scoring.compared(flat(spark), "unit", ["mse", "pearson"], ["untrained", "random_head"], 60, 199, "s").collect()}
    worse, same = got["mse", "untrained"], got["mse", "random_head"]
    assert worse.diff_upper < 0 and worse.p_value == pytest.approx(1 / 200) and worse.p_value_adjusted == pytest.approx(2 / 200)
    assert same.diff_lower < 0 < same.diff_upper and same.p_value > 0.05 and same.p_value_adjusted >= same.p_value
    assert got["pearson", "untrained"].diff_lower > 0
    units = scoring.per_unit(flat(spark), ["condition", "unit"], ["mse"])
    two = scoring.randomised(units, "unit", ["mse"], "untrained", 199, "s", two_sided=True).first()
    assert two.p == pytest.approx(1 / 200) and two.observed < 0


def test_permutations_against_all_of_them(spark):
    """Of few units all swaps can be tried: the share of as extreme ones is what the test estimates."""
    t, c = [1.0, 2.0, 3.0, 2.5, 0.5], [1.5, 2.2, 2.9, 3.5, 0.9]
    rows = [("trained", u, x, 0.0) for u, x in enumerate(t)] + [("other", u, x, 0.0) for u, x in enumerate(c)]
    df = spark.createDataFrame(rows, "condition string, unit int, prediction double, label double")
    units = scoring.per_unit(df, ["condition", "unit"], ["mae"])
    p = scoring.randomised(units, "unit", ["mae"], "other", 2000, "s").first().p
    diffs = [sum((b - a) if k >> i & 1 else (a - b) for i, (a, b) in enumerate(zip(t, c, strict=True))) for k in range(32)]
    assert p == pytest.approx(np.mean(np.array(diffs) <= diffs[0] + 1e-12), abs=0.03)


def test_layers_and_reports(spark):
    base = flat(spark).filter("condition = 'trained'").drop("condition")
    deep = base.withColumn("layer", F.lit(2)).unionByName(base.withColumn("layer", F.lit(1)).withColumn("prediction", F.col("prediction") * 0))
    r = scoring.layers(deep, "unit", ["mse"], 30, 99, "s").first()
    assert r.layer == "1" and r.diff_mean < 0 and r.p_value == pytest.approx(0.01)
    with pytest.raises(ValueError):
        scoring.layers(deep.filter("layer = 2 or unit > 0"), "unit", ["mse"], 5, 5, "s")
    plain = scoring.report(flat(spark), "unit", ["mse", "spearman"], ["untrained"], "s", identity={"model": "m"})
    rows = {(x.metric, x.control): x for x in plain.collect()}
    assert plain.columns[0] == "model" and set(rows) == {(m, c) for m in ("mse", "spearman") for c in (None, "untrained")}
    assert rows["mse", "untrained"].diff_mean == pytest.approx(rows["mse", None].value - rows["mse", "untrained"].control_mean) and rows["mse", None].ci_mean is None
    full = {(x.metric, x.control): x for x in scoring.report(flat(spark), "unit", ["mse"], ["untrained"], "s", 30, 30).collect()}
    assert full["mse", None].ci_lower < full["mse", None].value < full["mse", None].ci_upper and full["mse", "untrained"].p_value is not None
    scrambled = scoring.scrambled_labels(flat(spark).filter("condition = 'trained'"), "id", "s")
    assert sorted(r.label for r in scrambled.filter("condition = 'scrambled_labels'").collect()) == sorted(r.label for r in scrambled.filter("condition = 'trained'").collect())
    moved = scoring.scrambled_groups(base, "unit", "id", "s")
    assert sorted(r["count"] for r in moved.groupBy("unit").count().collect()) == [20] * 12


def test_one_versus_one(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 3, 120) * 2, rng.random((120, 5)) + 0.01
    p[np.arange(120), y] += 0.3
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(y, p, strict=True)], "y int, p array<double>")
    q = p[:, [0, 2, 4]] / p[:, [0, 2, 4]].sum(1, keepdims=True)
    auc = lambda s, t: np.mean([(a > b) + (a == b) / 2 for a in s for b in t])
    pairs = [((auc(q[y == a, i], q[y == b, i]) + auc(q[y == b, j], q[y == a, j])) / 2, (y == a).sum() + (y == b).sum()) for i, a in enumerate((0, 2, 4)) for j, b in enumerate((0, 2, 4)) if i < j]
    r = scoring.one_versus_one(df, "y", "p", 5).first()
    assert r.auc_macro == pytest.approx(np.mean([v for v, _ in pairs])) and r.auc_weighted == pytest.approx(np.average([v for v, _ in pairs], weights=[n for _, n in pairs]))
    two = scoring.one_versus_one(df.filter("y < 4"), "y", "p", 5).first()
    assert two.auc_macro == pytest.approx(auc(p[y == 2, 2], p[y == 0, 2]))
    assert scoring.one_versus_one(df.filter("y = 0"), "y", "p", 5).first().auc_macro is None
    with pytest.raises(ValueError):
        scoring.one_versus_one(df, "y", "p", 3)


def test_weights_and_fixed_classes(spark):
    df = spark.createDataFrame([(1, 0.9, 2.0), (0, 0.5, 1.0), (1, 0.5, 3.0), (0, 0.95, 4.0)], "y int, s double, w double")
    assert metrics.roc_auc(df, [], "y", "s", "w").first()[0] == pytest.approx((2 * 1 + 3 * 0.5) / (5 * 5))
    counts = metrics.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string"), [], "y", "p")
    assert metrics.classification(counts, [], ["a", "b", "c"]).first().recall_macro == pytest.approx((0.5 + 1 + 0) / 3)
    r = {x.average: x for x in scoring.multilabel_classification(spark.createDataFrame([(0, "a", 1, 1), (0, "b", 1, 0), (1, "a", 0, 1), (1, "b", 0, 0)], "r int, t string, y int, p int"), "r", "t", "y", "p").collect()}
    assert (r["micro"].precision, r["macro"].recall, r["samples"].f1) == (0.5, 0.5, pytest.approx(1 / 3))
    steps = spark.createDataFrame([(2.0, 10, 5.0, 1.0, 0.1), (4.0, 30, 15.0, 1.0, 0.3)], "loss double, tokens long, correct double, seconds double, stall double")
    c = scoring.training_counters(steps, []).first()
    assert (c.loss, c.accuracy, c.tokens_per_second, c.stall_max, c.stall_p50) == pytest.approx((3.5, 0.5, 20.0, 0.3, 0.2)) and c.perplexity == pytest.approx(math.exp(3.5))


def test_assay_hierarchy_and_error(spark):
    rows = [("a1", "P1", "Activity", 1.0, 5), ("a2", "P1", "Activity", 0.0, 5), ("a3", "P2", "Activity", 0.5, 5), ("b1", "P3", "Binding", 0.2, 5), ("b2", "P4", "Binding", float("nan"), 5)]
    df = spark.createDataFrame(rows, "dms_id string, uniprot_id string, coarse_selection_type string, spearman double, num_variants long")
    got = {(r.scope, r.coarse_selection_type): r.value for r in assays.aggregate(df, ["spearman", "auc"]).collect()}
    assert got == pytest.approx({("function", "Activity"): 0.5, ("function", "Binding"): 0.2, ("overall", None): 0.35})
    table = assays.score_table(df, ["spearman"], "trained")
    assert {r.scope for r in table.collect()} == {"assay", "function", "overall"} and assays.publish(table, table.withColumn("value", F.lit(0.0))).filter("value <> 0").count() == 0
    assert 0 <= assays.standard_error(df, "spearman", 50, "s").first()[0] < 0.5
    with pytest.raises(ValueError):
        assays.aggregate(df, ["auc"])


def test_zero_shot_scores(spark):
    wild = spark.createDataFrame([("d", "ACD")], "dms_id string, target_seq string")
    logs = spark.createDataFrame([("d", p, r, -float(p * 10 + ord(r) % 7)) for p in (1, 2, 3) for r in "ACDE"], "dms_id string, position int, residue string, log_prob double")
    at = lambda p, r: -float(p * 10 + ord(r) % 7)
    variants = spark.createDataFrame([("d", "A1C"), ("d", "A1C:D3E"), ("d", "A9C"), ("d", "A1W"), ("d", "A1C")], "dms_id string, mutant string")
    got = sorted(((r.mutant, r.score) for r in assays.substitution_scores(variants, wild, logs).collect()), key=str)
    one = at(1, "C") - at(1, "A")
    assert got[:3] == [("A1C", one), ("A1C", one), ("A1C:D3E", one + at(3, "E") - at(3, "D"))] and all(math.isnan(s) for _, s in got[3:])
    with pytest.raises(Exception, match="not the wild residue"):
        assays.substitution_scores(spark.createDataFrame([("d", "C1A")], variants.schema), wild, logs).collect()
    pll = assays.pseudo_log_likelihood(logs.filter("residue = 'A'"), ["dms_id"])
    mutant = spark.createDataFrame([("d", "AC", -3.0)], "dms_id string, mutated_sequence string, pll double")
    scored = assays.indel_scores(spark.createDataFrame([("d", "AC"), ("d", "A")], "dms_id string, mutated_sequence string"), mutant, pll)
    assert sorted(str(r.score) for r in scored.collect()) == sorted([str(-3.0 - pll.first().pll), "nan"])
    matrix = assays.read_substitution("# scores\n   A  C\nA  4  0\nC  0  9\n")
    assert matrix == {"A": {"A": 4, "C": 0}, "C": {"A": 0, "C": 9}}
    pairs = assays.pair_scores(spark.createDataFrame([("A1C:C2C",), ("A1W",)], "mutant string"), matrix).collect()
    assert pairs[0].score == 9.0 and math.isnan(pairs[1].score)
    assert [r.dms_id for r in assays.unmatched(spark.createDataFrame([("d", "u", "f"), ("e", "u", "f")], "dms_id string, uniprot_id string, coarse_selection_type string"), variants).collect()] == ["e"]


def test_ridge_out_of_fold(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.01
    y[5] = np.nan
    rows = [("g", i, [float(v) for v in x[i]], float(y[i]), i % 4) for i in range(200)] + [("flat", i, [1.0, 2.0, 3.0], 7.0, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, i int, x array<double>, y double, f int").repartition(7)
    got = {(r.g, r.i): r.prediction for r in assays.ridge_out_of_fold(df, "g", "i", "x", "y", "f", 0.1).collect()}
    assert {k for k, _ in got} == {"g"} and len(got) == 200
    for f in range(4):
        train = [i for i in range(200) if i % 4 != f and i != 5]
        a = np.concatenate([np.ones((200, 1)), x], axis=1)
        w = np.linalg.solve(a[train].T @ a[train] + 0.1 * np.diag([1e-8, 1, 1, 1]), a[train].T @ y[train])
        assert all(abs(got["g", i] - a[i] @ w) < 1e-6 for i in range(200) if i % 4 == f)
    averaged = assays.scheme_average({n: spark.createDataFrame([("a", v)], "k string, m double") for n, v in (("r", 1.0), ("c", 0.0), ("m", float("nan")))}, ["k"], "m").first()
    assert (averaged.m, averaged.schemes) == (0.5, 2)


def test_calibration_cohorts(spark):
    logits = [0.0] * 19 + [math.log(19)]
    even = [1.0] * 20
    rows = [(0, 0, 0, True, True, False, 1 << 19, even, logits), (1, 1, 0, False, True, True, 1, even, [0.0] * 20), (2, 0, 0, True, False, False, 1, even, logits)]
    schema = "id int, fold int, bin int, is_t boolean, in_balanced boolean, in_high_nt boolean, consensus_mask int, profile array<double>, logits array<double>"
    fitted = spark.createDataFrame([(0, 2.0, "none"), (1, 1.0, "none")], "fold int, temperature double, bound string")
    got = {r.cohort: r for r in calibration.cohorts(calibration.scored(spark.createDataFrame(rows, schema), fitted)).collect()}
    kl = -sum(0.05 * math.log(p / 0.05) for p in [1 / 38] * 19 + [0.5])
    assert got["t"].kl == pytest.approx(kl) and got["t"].score == pytest.approx(100 * math.exp(-kl)) and got["t"].score_fit > got["t"].score and got["t"].accuracy == 1.0
    assert got["nt"].score == pytest.approx(100.0) and got["nt"].accuracy == 1.0 and got["high_nt"].n == 1 and got["t"].n == 1
    assert calibration.mean_temperature(fitted).first()[0] == 1.5 and calibration.cohort_bins(calibration.scored(spark.createDataFrame(rows, schema), fitted)).count() == 2
    r = spark.range(1).select(calibration.prior_logits(F.lit("C")).alias("h"), calibration.prior_logits(F.lit("A"), {a: {b: 2 * (a == b) for b in "ACDEFGHIKLMNPQRSTVWY"} for a in "ACDEFGHIKLMNPQRSTVWY"}).alias("b")).first()
    assert r.h[1] == pytest.approx(math.log(19)) and sum(r.h) == pytest.approx(math.log(19)) and r.b[0] == pytest.approx(math.log(2)) and sum(r.b) == pytest.approx(math.log(2))


def test_baselines(spark):
    train = spark.createDataFrame([("AAA", 0, 1.0), ("CCC", 1, 2.0), ("DDD", 1, 3.0), ("AAC", 0, 1.0)], "sequence string, label int, y double")
    assert baselines.constant(train, baselines.majority(train, "label").first()["class"]).filter("prediction <> 0").count() == 0
    assert baselines.train_mean(train, "y").first().mean == pytest.approx(1.75)
    fitted = {r.sequence: r.prediction for r in baselines.composition_ridge(train, train, "sequence", "y", 1e-9).collect()}
    assert fitted["CCC"] == pytest.approx(2.0, abs=0.3) and fitted["DDD"] == pytest.approx(3.0, abs=0.1)
    logistic = baselines.composition_logistic(train, train, "sequence", "label").collect()
    assert all(r.prediction == r.label and len(r.probability) == 2 for r in logistic)
    one = baselines.composition_logistic(train.filter("label = 0"), train, "sequence", "label").collect()
    assert {r.prediction for r in one} == {0}
    hits = spark.createDataFrame([("q", "t", 5.0, 0.0), ("q", "s", 9.0, 1.0)], "query string, target string, bits double, expectation double")
    near = baselines.nearest_label(spark.createDataFrame([("q",), ("z",)], "sequence_id string"), spark.createDataFrame([("t", 1.5), ("s", 2.5)], "sequence_id string, y double"), hits, "y", 0.25)
    assert {(r.sequence_id, r.prediction, r.fallback) for r in near.collect()} == {("q", 1.5, False), ("z", 0.25, True)}
