"""Contact units, their scores and means, with results worked out by hand (fixed values of the published protocol)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import contacts

SCORES = "split string, edition int, kind string, minsep int, record_id string, unit_id string, complex_id string, " + ", ".join(f"{m} double" for m in contacts.METRICS)


def row(record, unit, value, complex_id="C1", edition=14, kind="intra_eu", split="test", roc="same"):
    return (split, edition, kind, 6, record, unit, complex_id, value, value, value, value, value if roc == "same" else roc)


def test_units_records_and_complexes_weigh_the_same(spark):
    rows = [row("A", "D1", 1.0, roc=None), row("A", "D2", 0.0), row("A", "missing", None), row("B", "D1", 0.0), row("C", "D1", 1.0, "C2"), row("unknown", "D1", None, "C3"), row("A15", "D1", 0.0, edition=15)]
    got = {r.edition: r for r in contacts.aggregate(spark.createDataFrame(rows, SCORES)).collect()}
    assert len(got) == 2 and got[14].auc == 0.625 and got[14].roc_auc == 0.5 and got[15].auc == 0
    assert (got[14].n_units, got[14].n_sequences, got[14].n_complexes) == (6, 4, 3)
    assert (got[14].units_auc, got[14].units_roc_auc, got[14].sequences_auc, got[14].complexes_auc) == (4, 3, 3, 2)
    whole = [row("A", "chain", 1.0, kind="global"), row("B", "chain", 0.0, kind="global"), row("C", "chain", 1.0, "C2", kind="global")]
    assert contacts.aggregate(spark.createDataFrame(whole, SCORES)).first().auc == 0.75
    development = [row(r, "chain", v, None, None, "global", "validation") for r, v in (("A", 1.0), ("B", 0.0), ("C", 1.0))]
    first = contacts.aggregate(spark.createDataFrame(development, SCORES)).first()
    assert first.auc == pytest.approx(2 / 3) and first.n_complexes == 0 and first.complexes_auc == 0


@pytest.mark.parametrize("rows", [
    [row("A", "D1", 1.0)] * 2, [row("A", "D1", 1.0), row("A", "D2", 1.0, "C2")], [row("A", "D1", 1.0, None)], [row("A", "D1", 1.0, kind="global"), row("A", "D2", 1.0, kind="global")],
])
def test_what_cannot_be_averaged(spark, rows):
    with pytest.raises(ValueError):
        contacts.aggregate(spark.createDataFrame(rows, SCORES))


def test_a_nan_is_an_error(spark):
    with pytest.raises(Exception, match="not finite"):
        contacts.aggregate(spark.createDataFrame([row("A", "D1", float("nan"))], SCORES)).collect()


def test_scores_of_units(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for unit, length in (("u", 40), ("v", 12), ("w", 5)):
        pairs = [(i, j, float(rng.integers(0, 5)), int(rng.random() < 0.3)) for i in range(length) for j in range(i + 1, length)]
        rows += [(unit, *p, length) for p in pairs]
        for least in (6, 24):
            own = sorted(((-s, i, j, y) for i, j, s, y in pairs if j - i >= least))
            if own:
                y = [p[3] for p in own]
                cut = lambda d: sum(y[: max(1, min(len(y), length * d // 10))]) / max(1, min(len(y), length * d // 10))  # noqa: E731, B023
                want[unit, least] = (float(np.mean([cut(d) for d in range(1, 11)])), cut(10), cut(5), cut(2), "scored")
            else:
                want[unit, least] = (None, None, None, None, "no_eligible_pairs")
    got = contacts.score_units(spark.createDataFrame(rows, "unit string, i int, j int, score double, label int, length int"), ["unit"], "length").collect()
    assert len(got) == 6
    for r in got:
        assert (r.auc, r.p_at_l, r.p_at_l2, r.p_at_l5, r.status) == pytest.approx(want[r.unit, r.minsep])


def test_binned_precision(spark):
    pairs = [("s", 0, 8, 0.9, 1, 10), ("s", 0, 9, 0.8, 0, 10), ("s", 1, 8, 0.8, 1, 10), ("t", 0, 30, 0.5, 1, 31), ("t", 5, 4, 0.5, 1, 31)]
    df = spark.createDataFrame(pairs, "seq string, i int, j int, score double, label int, length int").withColumn("o", F.struct("i", "j"))
    value = lambda *a: contacts.binned_precision(df, "seq", "o", "length", *a).first()[0]
    assert value(6, 12, 1) == pytest.approx(2 / 3) and value(6, 12, 5) == 0.5 and value(24, None, 1) == 1.0 and np.isnan(value(12, 24, 1))
    assert {r.metric for r in contacts.binned_family(df, "seq", "o", "length").collect()} == {"p_at_l", "p_at_l2", "p_at_l5", "auc"}


UNITS = "id string, record_id string, unit_id string, kind string, split string, sequence string, valid_positions array<int>, positive_pairs array<array<int>>, labels_available boolean"


def unit(record="r", unit_id="u", kind="global", split="test", sequence="A" * 31, valid=None, pairs=((0, 6),), labels=True, id_=None):
    return (id_ or f"{record}/{kind}/{unit_id}", record, unit_id, kind, split, sequence, list(range(len(sequence))) if valid is None else valid, [list(p) for p in pairs], labels)


def test_violations(spark):
    bad = [unit(), unit("a", valid=[3, 2]), unit("b", valid=[40]), unit("c", pairs=[(6, 0)]), unit("d", pairs=[(0, 6), (0, 6)]), unit("e", id_="x"), unit("f", kind="intra_eu", split="train"), unit("g"), unit("g", split="train"), unit("g2", unit_id="p"), unit("g2", unit_id="q")]
    got = {(r.id.split("/")[0], r.problem) for r in contacts.violations(spark.createDataFrame(bad, UNITS)).collect()}
    assert got == {
        ("a", "positions do not rise"), ("b", "positions out of bounds"), ("c", "pairs out of bounds"), ("d", "repeated pairs"), ("x", "id is not record/kind/unit"), ("f", "development units have to be global"), ("f", "not one global unit"),
        ("g", "not one global unit"), ("g", "in more than one split"), ("g", "repeated id"), ("g2", "not one global unit"),
    }
    with pytest.raises(ValueError):
        contacts.checked(spark.createDataFrame(bad, UNITS))
    assert contacts.checked(spark.createDataFrame(bad[:1], UNITS)).count() == 1


def test_predictions_by_status(spark):
    rows = [unit("a", sequence="AXAAAAAAA", valid=[0, 1, 2, 7, 8], pairs=[(0, 7)]), unit("b", labels=False), unit("c", sequence="XXX", pairs=[]), unit("d", sequence="AAA", pairs=[])]
    scores = spark.createDataFrame([("a/global/u", i, j, i + j / 10) for i in range(9) for j in range(9)], "id string, i int, j int, score double")
    got = {r.id[0]: r for r in contacts.predictions(spark.createDataFrame(rows, UNITS), scores).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "scorable", "b": "missing_labels", "c": "no_retained_members", "d": "no_eligible_pairs"}
    assert (got["a"].original_i, got["a"].original_j, got["a"].labels, got["a"].scores, got["a"].length) == ([0, 0, 2], [7, 8, 8], [1, 0, 0], [0.7, 0.8, 2.8], 4) and got["b"].scores == []
    with pytest.raises(Exception, match="no finite score"):
        contacts.predictions(spark.createDataFrame(rows, UNITS), scores.filter("j < 8")).collect()


def test_places_and_identity(spark):
    r = spark.range(1).select(contacts.retained(F.lit("AXC")).alias("k"), contacts.inverse_places(F.lit("AXC")).alias("v"), contacts.token_places(F.lit("AXC")).alias("t")).first()
    assert (r.k, r.v, r.t) == ([0, 2], [0, -1, 1], [1, None, 2])
    rows = [unit("a", split="train"), unit("b", split="validation"), unit("c")]
    one = contacts.fingerprint(spark.createDataFrame(rows, UNITS)).first()[0]
    assert one == contacts.fingerprint(spark.createDataFrame([rows[1], rows[0], unit("z")], UNITS)).first()[0]
    assert one != contacts.fingerprint(spark.createDataFrame([rows[0], unit("b", split="validation", sequence="C" * 31)], UNITS)).first()[0]


def test_conditions_with_other_candidates(spark):
    df = spark.createDataFrame([("u", c, 0, j, 1) for c in "ab" for j in (6, 7)] + [("v", "a", 0, 6, 1), ("v", "b", 0, 7, 1)], "unit string, condition string, i int, j int, label int")
    assert [r.unit for r in contacts.same_candidates(df, ["unit"], "condition").collect()] == ["v"]


def test_jacobian(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 3, 5, 3))
    rows = [("u", i, a, j, b, float(x[i, a, j, b])) for i in range(5) for a in range(3) for j in range(5) for b in range(3)]
    centred = x
    for axis in range(4):
        centred = centred - centred.mean(axis=axis, keepdims=True)
    norm = np.sqrt((centred**2).sum(axis=(1, 3)))
    norm = (norm + norm.T) / 2
    np.fill_diagonal(norm, 0)
    want = norm - norm.sum(1, keepdims=True) * norm.sum(0, keepdims=True) / norm.sum()
    np.fill_diagonal(want, 0)
    got = np.zeros((5, 5))
    for r in contacts.jacobian_contacts(spark.createDataFrame(rows, "unit string, i int, a int, j int, b int, value double"), "unit").collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, want)
