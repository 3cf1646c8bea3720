"""Contact maps: units, candidate pairs with scores, precision at cuts of the length, and means of means.

Pairs are long tables (unit keys, i, j, score, label), so the work of one long chain is dealt like any other.
Undefined metrics are null; a NaN or an infinity is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import RESIDUES, let, letters
from .metrics import roc_auc
from .tables import duplicate_keys, inconsistent, require

#: Separations of the settings, metrics and the bins of separation.
SEPARATIONS = (6, 24)
METRICS = ("auc", "p_at_l", "p_at_l2", "p_at_l5", "roc_auc")
BINS = {"short": (6, 12), "medium": (12, 24), "long": (24, None)}
STATUSES = ("missing_labels", "no_retained_members", "no_eligible_pairs", "scorable")


def retained(sequence: Column, alphabet: str = RESIDUES) -> Column:
    """Places (from 0) of canonical residues."""
    return F.array_compact(F.transform(letters(sequence), lambda x, i: F.when(x.isin(*alphabet), i)))


def inverse_places(sequence: Column, alphabet: str = RESIDUES) -> Column:
    """Each residue's place among the canonical ones; -1 for those that are left out."""
    return let(retained(sequence, alphabet), lambda kept: F.transform(letters(sequence), lambda _, i: (F.array_position(kept, i) - 1).cast("int")))


def token_places(sequence: Column, prefix: int = 1, alphabet: str = RESIDUES) -> Column:
    """Place of each residue's token behind `prefix` special tokens, gaps of left-out residues kept as null."""
    inverse = inverse_places(sequence, alphabet)
    return F.transform(inverse, lambda i: F.when(i >= 0, i + prefix))


def violations(units: DataFrame) -> DataFrame:
    """(id, problem) of contact units: id, record_id, unit_id, kind, split, sequence, valid_positions, positive_pairs (arrays of int).

    Positions rise strictly within the sequence, pairs are distinct and rise within it, ids are record/kind/unit, a
    record has one `global` unit, units of development are global and no record is in two splits.
    """
    require(units, "id", "record_id", "unit_id", "kind", "split", "sequence", "valid_positions", "positive_pairs")
    p, pairs, n = F.col("valid_positions"), F.col("positive_pairs"), F.length("sequence")
    rising = F.forall(F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)
    inside = F.forall(p, lambda x: (x >= 0) & (x < n))
    good = F.forall(pairs, lambda x: (F.size(x) == 2) & (x[0] < x[1]) & (x[0] >= 0) & (x[1] < n))
    checks = {
        "positions do not rise": ~rising, "positions out of bounds": ~inside, "pairs out of bounds": ~good, "repeated pairs": F.size(pairs) != F.size(F.array_distinct(pairs)),
        "id is not record/kind/unit": F.col("id") != F.concat_ws("/", "record_id", "kind", "unit_id"), "development units have to be global": (F.col("split") != "test") & (F.col("kind") != "global"),
    }
    own = units.select("id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())))).alias("problem"))
    records = units.groupBy("record_id").agg(F.count_if(F.col("kind") == "global").alias("globals"), F.count_distinct("split").alias("splits"))
    whole = records.select(F.col("record_id").alias("id"), F.explode(F.array_compact(F.array(F.when(F.col("globals") != 1, "not one global unit"), F.when(F.col("splits") > 1, "in more than one split")))).alias("problem"))
    twice = duplicate_keys(units, ["id"]).select("id", F.lit("repeated id").alias("problem"))
    return own.unionAll(whole).unionAll(twice)


def checked(units: DataFrame) -> DataFrame:
    if bad := violations(units).limit(1).collect():
        raise ValueError(f"{bad[0].id}: {bad[0].problem}")
    return units


def fingerprint(units: DataFrame, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """One row with the identity of the development rows, whatever their order: a hash of their number and of sums of their rows' hashes."""
    rows = units.filter(F.col("split").isin(*splits)).select(F.sha2(F.to_json(F.struct(*sorted(units.columns))), 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*"), *(F.coalesce(part(at), F.lit(0)) for at in (1, 13, 25, 37))), 256).alias("fingerprint"))


def predictions(units: DataFrame, scores: DataFrame, unit: str = "id", least: int = 6) -> DataFrame:
    """(unit, length, status, original_i, original_j, labels, scores) of every unit.

    units: unit, sequence, valid_positions (null: all), positive_pairs, labels_available. scores: unit, i, j (original
    places), score; a scorable unit needs a finite one for each of its pairs.
    """
    kept = F.array_intersect(F.coalesce("valid_positions", retained(F.col("sequence"))), retained(F.col("sequence")))
    rows = units.select(unit, kept.alias("p"), "positive_pairs", "labels_available")
    made = let(F.col("p"), lambda p: F.flatten(F.transform(p, lambda i: F.transform(F.filter(p, lambda j: j - i >= least), lambda j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))))))
    rows = rows.withColumn("pairs", made)
    status = F.when(~F.col("labels_available"), STATUSES[0]).when(F.size("p") == 0, STATUSES[1]).when(F.size("pairs") == 0, STATUSES[2]).otherwise(STATUSES[3])
    rows = rows.withColumn("status", status).withColumn("length", F.size("p"))
    flat = rows.select(unit, "positive_pairs", "status", F.explode("pairs").alias("x")).select(unit, "positive_pairs", "status", "x.i", "x.j")
    flat = flat.withColumn("label", F.array_contains(F.col("positive_pairs"), F.array("i", "j")).cast("int")).join(scores.select(unit, "i", "j", "score"), [unit, "i", "j"], "left")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    flat = flat.withColumn("score", F.when((F.col("status") != STATUSES[3]) | finite, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no finite score: "), F.col(unit).cast("string"))).cast("double")))
    lists = flat.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("i", "j", "label", "score"))).alias("x"))  # the pairs of one chain
    every = rows.select(unit, "length", "status").join(lists, unit, "left")
    empty = F.coalesce("x", F.array().cast("array<struct<i:int,j:int,label:int,score:double>>"))
    scored = F.when(F.col("status") == STATUSES[3], F.transform(empty, lambda e: e["score"])).otherwise(F.array().cast("array<double>"))
    return every.select(unit, "length", "status", F.transform(empty, lambda e: e["i"]).alias("original_i"), F.transform(empty, lambda e: e["j"]).alias("original_j"), F.transform(empty, lambda e: e["label"]).alias("labels"), scored.alias("scores"))


def score_units(pairs: DataFrame, keys: list[str], length: str, separations: tuple[int, ...] = SEPARATIONS) -> DataFrame:
    """METRICS of every unit (keys) at every least separation, of (keys, i, j, score, label, length) rows.

    Pairs rank by falling score, then i, j; the cuts are at floor(length d / 10) of d from 1 to 10, at least 1 and at
    most all. The ROC-AUC is null where pairs are of one class. Status is `scored`, or `no_eligible_pairs`.
    """
    settings = pairs.select(*keys, "i", "j", "score", "label", F.col(length).alias("length"), F.explode(F.array(*map(F.lit, separations))).alias("minsep"))
    ok = settings.filter(F.col("j") - F.col("i") >= F.col("minsep"))
    unit = [*keys, "minsep"]
    w = Window.partitionBy(*unit).orderBy(F.desc("score"), "i", "j")
    ranked = ok.select(*unit, "length", F.row_number().over(w).alias("rank"), F.sum(F.col("label").cast("long")).over(w).alias("hits"), F.count("*").over(Window.partitionBy(*unit)).alias("n"))
    # the ten cuts as an array, so a row is compared with all of them where it is
    cut = lambda d: F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("length") * d / 10)))
    at = {d: F.max(F.when(F.col("rank") == cut(d), F.col("hits") / F.col("rank"))) for d in range(1, 11)}
    cuts = ranked.groupBy(*unit).agg(*(x.alias(f"_{d}") for d, x in at.items()))
    mean_ = reduce(lambda a, b: a + b, (F.col(f"_{d}") for d in at)) / 10
    cuts = cuts.select(*unit, mean_.alias("auc"), F.col("_10").alias("p_at_l"), F.col("_5").alias("p_at_l2"), F.col("_2").alias("p_at_l5"))
    every = settings.select(*unit).distinct()
    out = every.join(cuts, unit, "left").join(roc_auc(ok, unit, "label", "score").withColumnRenamed("auc", "roc_auc"), unit, "left")
    return out.withColumn("status", F.when(F.col("auc").isNull(), STATUSES[2]).otherwise("scored"))


def same_candidates(pairs: DataFrame, keys: list[str], control: str) -> DataFrame:
    """Units and controls whose candidate pairs are not those of the others: there should be none."""
    sets = pairs.groupBy(*keys, control).agg(F.count("*").alias("n"), F.sum(F.xxhash64("i", "j", "label").cast("decimal(38,0)")).alias("h"))
    return inconsistent(sets, keys, ["n", "h"])


def aggregate(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means of units by record, of records by complex, of complexes by setting (split, edition, kind, minsep); without an edition, of records.

    scores: split, edition, kind, minsep, record_id, unit_id, complex_id and metrics. Adds, by metric, how many units,
    records and complexes have one. Repeated units, a record of several editions or complexes, an edition without
    complexes and several units of a record whose kind is `global` are errors.
    """
    setting = ["split", "edition", "kind", "minsep"]
    if not duplicate_keys(scores, [*setting, "record_id", "unit_id"]).isEmpty():
        raise ValueError("repeated units")
    if not inconsistent(scores, ["record_id"], ["edition", "complex_id"]).isEmpty():
        raise ValueError("records of several editions or complexes")
    if not scores.filter(F.col("edition").isNotNull() & (F.coalesce("complex_id", F.lit("")) == "")).isEmpty():
        raise ValueError("an edition needs complexes")
    sound = lambda m: F.when(F.isnan(m) | (F.abs(m) == float("inf")), F.raise_error(F.lit(f"{m} is not finite")).cast("double")).otherwise(F.col(m))
    clean = scores.select(*setting, "record_id", "unit_id", "complex_id", *(sound(m).alias(m) for m in metrics))
    averages = [F.avg(m).alias(m) for m in metrics]
    counts = lambda level: [F.count(m).alias(f"{level}_{m}") for m in metrics]
    records = clean.groupBy(*setting, "record_id").agg(*averages, *counts("units"), F.count("*").alias("n_units"), F.max("complex_id").alias("complex_id"))
    if not records.filter((F.col("kind") == "global") & (F.col("n_units") > 1)).isEmpty():
        raise ValueError("a global record has one unit")
    carried = [F.sum(c).alias(c) for c in ("n_units", *(f"units_{m}" for m in metrics))]
    by_record = records.groupBy(*setting).agg(*averages, *counts("sequences"), F.count("*").alias("n_sequences"), *carried)
    complexes = records.filter("edition is not null").groupBy(*setting, "complex_id").agg(*averages)
    by_complex = complexes.groupBy(*setting).agg(*(F.avg(m).alias(f"_{m}") for m in metrics), *(F.count(m).alias(f"complexes_{m}") for m in metrics), F.count("*").alias("n_complexes"))
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in setting))
    joined = by_record.alias("r").join(by_complex.alias("c"), same, "left")
    above = [F.coalesce(F.col(f"c.{c}"), F.lit(0)).alias(c) for c in ("n_complexes", *(f"complexes_{m}" for m in metrics))]
    value = [F.when(F.col("r.edition").isNull(), F.col(f"r.{m}")).otherwise(F.col(f"c._{m}")).alias(m) for m in metrics]
    rest = [F.col(f"r.{c}") for c in by_record.columns if c.startswith(("n_", "units_", "sequences_"))]
    return joined.select(*(F.col(f"r.{k}") for k in setting), *value, *rest, *above)


def binned_precision(pairs: DataFrame, sequence: str, order: str, length: str, least: int, most: int | None, fraction: int | None) -> DataFrame:
    """Mean over sequences of the precision of the top length / fraction pairs (half to even, at least one) within a range of separation, by falling score, then order.

    Without a fraction, the mean over the ten deciles of the length. NaN where no sequence has a pair.
    """
    gap = F.abs(F.col("j") - F.col("i"))
    ok = pairs.filter((gap >= least) & ((gap < most) if most is not None else F.lit(True)) & (F.col(length) > 0))
    w = Window.partitionBy(sequence).orderBy(F.desc("score"), order)
    ranked = ok.select(sequence, F.col(length).alias("_l"), F.col("label").cast("long").alias("_y"), F.row_number().over(w).alias("_r"))
    shares = [1 / fraction] if fraction else [d / 10 for d in range(1, 11)]
    cut = lambda s: F.greatest(F.lit(1), F.bround(F.col("_l") / fraction if fraction else F.col("_l") * s).cast("long"))
    each = ranked.groupBy(sequence).agg(*(F.avg(F.when(F.col("_r") <= cut(s), F.col("_y"))).alias(f"_{i}") for i, s in enumerate(shares)))
    mean_ = reduce(lambda a, b: a + b, (F.col(f"_{i}") for i in range(len(shares)))) / len(shares)
    return each.agg(F.coalesce(F.avg(mean_), F.lit(float("nan"))).alias("precision"))


def binned_family(pairs: DataFrame, sequence: str, order: str, length: str) -> DataFrame:
    """(bin, metric, value): P@L, P@L/2, P@L/5 and the range's AUC of every bin of separation."""
    out = None
    for name, (least, most) in BINS.items():
        for metric, fraction in (("p_at_l", 1), ("p_at_l2", 2), ("p_at_l5", 5), ("auc", None)):
            one = binned_precision(pairs, sequence, order, length, least, most, fraction).select(F.lit(name).alias("bin"), F.lit(metric).alias("metric"), F.col("precision").alias("value"))
            out = one if out is None else out.unionAll(one)
    return out


def symmetrised(matrix: DataFrame, unit: str) -> DataFrame:
    """(unit, i, j, value) with the mean of each cell and its mirror; a missing one counts as 0."""
    both = matrix.select(unit, "i", "j", "value").unionAll(matrix.select(unit, F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy(unit, "i", "j").agg((F.sum("value") / 2).alias("value"))


def jacobian_contacts(jacobian: DataFrame, unit: str) -> DataFrame:
    """Contacts (unit, i, j, value) of a categorical Jacobian given as (unit, i, a, j, b, value): centred along each of its four axes, Frobenius norm over a and b, symmetrised, corrected by the product of sums, with a zero diagonal."""
    from .baselines import product_corrected

    out = jacobian
    for axis in ("i", "a", "j", "b"):
        others = [unit, *(x for x in ("i", "a", "j", "b") if x != axis)]
        out = out.join(out.groupBy(*others).agg(F.avg("value").alias("_m")), others).withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    norm = out.groupBy(unit, "i", "j").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
    norm = symmetrised(norm, unit).withColumn("value", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("value")))
    return product_corrected(norm, unit).withColumn("value", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("value")))
