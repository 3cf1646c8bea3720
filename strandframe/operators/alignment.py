"""Alignment of predictions, controls and baselines: joins that neither lose nor multiply an observation.

Mismatches are errors, found by one aggregate over the joined rows before these are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import align_multiset, duplicate_keys, require


def _none(bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise ValueError(message)


def same_ids(a: DataFrame, b: DataFrame, id_column: str = "id") -> None:
    """An error unless both tables have the same ids, each once."""
    for t in (a, b):
        _none(duplicate_keys(t, [id_column]), "repeated ids")
    _none(a.select(id_column).exceptAll(b.select(id_column)).unionAll(b.select(id_column).exceptAll(a.select(id_column))), "ids differ")


def control(trained: DataFrame, other: DataFrame, id_column: str = "id", prediction: str = "prediction", order: str | None = None) -> DataFrame:
    """trained with the control's prediction as `control`, one to one by id. With repeated ids, by order, where the ids have to agree."""
    require(trained, id_column, prediction)
    require(other, id_column, prediction)
    if order is None:
        same_ids(trained, other, id_column)
        joined = trained.join(other.select(id_column, F.col(prediction).alias("control")), id_column, "left")
    else:
        right = other.select(F.col(id_column).alias("_id"), F.col(order).alias("_order"), F.col(prediction).alias("control"))
        joined = trained.join(right, trained[order] == right["_order"], "full")
        _none(joined.filter(~F.col(id_column).eqNullSafe(F.col("_id")) | F.col(order).isNull() | F.col("_order").isNull()), "ids differ at some place")
        joined = joined.drop("_id", "_order")
    _none(joined.filter("control is null"), "a control without a prediction")
    return joined


def attach(predictions: DataFrame, values: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """predictions with columns (sequences, say) of their id, one row each; ids without any get null."""
    _none(duplicate_keys(values, [id_column]), "repeated ids")
    return predictions.join(values.select(id_column, *columns), id_column, "left")


def attach_groups(rows: DataFrame, groups: DataFrame, id_column: str, group: str) -> DataFrame:
    """rows with their metric group; ids of both sides have to be the same set, groups naming each once."""
    _none(duplicate_keys(groups, [id_column]), "repeated ids")
    known, asked = groups.select(id_column), rows.select(id_column).distinct()
    _none(known.exceptAll(asked).unionAll(asked.exceptAll(known)), "ids differ")
    return rows.join(groups.select(id_column, group), id_column)


def baseline(predictions: DataFrame, shared: DataFrame, order: str, regression: bool = False, match_labels: bool = True) -> DataFrame:
    """A shared baseline's rows (id, label, prediction and order) in the place of the model's (id, label and order).

    Equal observations, by id and label (as a 32-bit float in regression), are paired in order, and their counts have to
    agree both ways. Without labels to match, by ids that occur once.
    """
    if not match_labels:
        same_ids(predictions, shared)
        return predictions.select("id", F.col(order)).join(shared.drop(order, "label"), "id")
    label = F.col("label").cast("float") if regression else F.col("label")
    left = predictions.select("id", label.alias("label"), F.col(order).alias("_left"))
    right = shared.withColumn("label", label).withColumnRenamed(order, "_right")
    joined = align_multiset(left, right, ["id", "label"], "_left", "_right")
    _none(joined.filter(~F.col("matched")), "baseline and model have different observations")
    return joined.drop("matched", "_right", "label").withColumnRenamed("_left", order)


def token_prior(predictions: DataFrame, priors: DataFrame) -> DataFrame:
    """A prior of each id (id, prediction, label: array by original position) at every evaluated position (id, label, original_positions: arrays).

    Gives (id, original_position, label, prediction). Every position's label has to be the source's, no position occurs
    twice, and the ids of both sides are the same.
    """
    _none(duplicate_keys(priors, ["id"]), "repeated ids")
    _none(predictions.filter(F.size("label") != F.size("original_positions")), "labels and positions differ in number")
    z = F.explode(F.arrays_zip(F.col("original_positions").alias("p"), F.col("label").alias("y")))
    flat = predictions.select("id", z.alias("z")).select("id", F.col("z.p").alias("original_position"), F.col("z.y").alias("label"))
    _none(duplicate_keys(flat, ["id", "original_position"]), "a position occurs twice")
    joined = flat.join(priors.select("id", F.col("label").alias("_source"), "prediction", F.lit(True).alias("_there")), "id", "full")
    there = F.get("_source", F.col("original_position"))
    good = F.coalesce(F.col("_there") & (F.col("original_position") >= 0) & (there != -100) & (there == F.col("label")), F.lit(False))
    _none(joined.filter(~good), "labels differ from the source's at the recorded positions")
    return joined.drop("_source", "_there")


def first_seen(rows: DataFrame, id_column: str, order: str) -> DataFrame:
    """The first row of every id: what processes add to fill their last batch comes again and goes."""
    everything = F.struct(*rows.columns)
    return rows.groupBy(id_column).agg(F.min_by(everything, order).alias("_r")).select("_r.*")


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name]).alias(name)


def lists(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """Columns of each group as arrays in order."""
    collected = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *(F.col(c).alias(c) for c in columns))))
    return rows.groupBy(*keys).agg(collected.alias("_r")).select(*keys, *(_field("_r", c) for c in columns))


def hit_coverage(rows: DataFrame, fallback: str = "fallback") -> DataFrame:
    """matched, fallback, total and the share that was matched."""
    missed = F.count_if(F.col(fallback))
    return rows.agg((F.count("*") - missed).alias("matched"), missed.alias("fallback"), F.count("*").alias("total"), F.try_divide(F.count("*") - missed, F.count("*")).alias("fraction"))


def identified(rows: DataFrame, id_column: str, place: str) -> DataFrame:
    """rows whose id, where there is none, is their place."""
    return rows.withColumn(id_column, F.coalesce(F.col(id_column).cast("string"), F.col(place).cast("string")))


def label_problem(label: Column, kind: str, classes: int | None = None, ignored: int = -100) -> Column:
    """What is wrong with a label (null: nothing). kind: `class`, `token` (array of classes), `multilabel` (array of 0 and 1 of fixed width) or `number`."""
    if kind == "number":
        return F.when(label.isNull() | F.isnan(label.cast("double")) | (F.abs(label.cast("double")) == float("inf")), "not a finite number")
    if kind == "class":
        return F.when(label.isNull() | (label < 0) | (label >= classes), "not a class")
    if kind == "token":
        return F.when(label.isNull() | F.exists(label, lambda x: x.isNull() | ((x != ignored) & ((x < 0) | (x >= classes)))), "not classes")
    if kind == "multilabel":
        return F.when(label.isNull() | (F.size(label) != classes) | F.exists(label, lambda x: x.isNull() | ~x.isin(0, 1)), "not a vector of 0 and 1 of the width")
    raise ValueError(f"no such label: {kind}")


def checked_labels(rows: DataFrame, label: str, kind: str, classes: int | None = None) -> DataFrame:
    """rows, or an error that names the first problem found."""
    bad = rows.select(label_problem(F.col(label), kind, classes).alias("p")).filter("p is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{label}: {bad[0].p}")
    return rows


def identity(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a table's number of rows and a hash of its content that no order of rows changes; NaN is a value like others."""
    h = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)")), F.lit(0))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*"), *(part(at) for at in (1, 13, 25, 37))), 256).alias("identity"))
