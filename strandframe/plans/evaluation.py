"""The evaluation run: which scorer a task has, what it needs, and where its report goes.

Predictions are tables; models run outside. Every run replaces its own rows of the report (condition and split) only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assays, baselines, calibration, contacts, scoring
from ..operators.tables import upsert
from ..sources import stores
from . import config


def _flat(predictions: DataFrame, settings: dict) -> DataFrame:
    names = settings.get("metrics") or [m for m in scoring.task_metrics(settings["task"]["name"]) if m != "fmax"]
    return scoring.report(predictions, settings.get("unit", "id"), names, settings.get("controls", []), settings.get("seed", "0"), settings.get("resamples", 0), settings.get("permutations", 0), settings.get("identity"))


def _calibration(predictions: DataFrame, settings: dict) -> DataFrame:
    """Long rows of the cohorts' scores, each condition with temperatures of its own."""
    out = None
    for condition in ("trained", *settings.get("controls", [])):
        rows = calibration.cohorts(calibration.scored(predictions.filter(F.col("condition") == condition)))
        long = rows.unpivot(["cohort"], ["kl", "score", "score_fit", "accuracy"], "metric", "value").select(F.concat_ws("_", "metric", "cohort").alias("metric"), F.lit(None if condition == "trained" else condition).cast("string").alias("control"), "value")
        out = long if out is None else out.unionAll(long)
    return out


def _contacts(pairs: DataFrame, settings: dict) -> DataFrame:
    """Means of every setting and condition; conditions have to have the same candidate pairs."""
    unit = ["condition", "split", "edition", "kind", "record_id", "unit_id", "complex_id"]
    if not contacts.same_candidates(pairs, ["record_id", "kind", "unit_id"], "condition").isEmpty():
        raise ValueError("conditions differ in their candidate pairs")
    scored = contacts.score_units(pairs, unit, "length")
    out = None
    for condition in ("trained", *settings.get("controls", [])):
        one = contacts.aggregate(scored.filter(F.col("condition") == condition))
        long = one.unpivot(["split", "edition", "kind", "minsep"], list(contacts.METRICS), "metric", "value").withColumn("control", F.lit(None if condition == "trained" else condition).cast("string"))
        out = long if out is None else out.unionAll(long)
    return out


def _assays(scored: DataFrame, settings: dict) -> DataFrame:
    found = assays.all_metrics(scored, settings.get("unit", "mutant"), settings.get("continuous", "dms_score"), settings.get("binary"))
    named = found.join(scored.select("dms_id", "uniprot_id", "coarse_selection_type").distinct(), "dms_id")
    return assays.score_table(named, [*assays.CONTINUOUS, *assays.BINARY], settings.get("condition", "trained"))


#: Scorers by task; a task without one of its own is flat.
SCORERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"calibration": _calibration, "contact_prediction": _contacts, "assays": _assays}


def evaluate(predictions: DataFrame, settings: dict) -> DataFrame:
    """The long report of predictions under settings: task (name), metrics, controls, unit, resamples, permutations, seed, identity."""
    task = settings["task"]["name"]
    if task not in SCORERS:
        config.check_evaluation(settings)
    return SCORERS.get(task, _flat)(predictions, settings)


def baseline_predictions(train: DataFrame, test: DataFrame, kind: str, label: str = "label") -> DataFrame:
    """test with the prediction of a baseline fitted on train: `majority`, `mean` or `composition`."""
    if kind == "majority":
        return baselines.constant(test, baselines.majority(train, label).first()["class"])
    if kind == "mean":
        return baselines.constant(test, baselines.train_mean(train, label).first()["mean"])
    if kind == "composition":
        return baselines.composition_ridge(train, test, "sequence", label)
    raise KeyError(f"no such baseline: {kind}")


def publish(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Puts rows into the stored report, in the place of those with the same keys."""
    if stores.complete(spark, path):
        rows = upsert(spark.read.parquet(path), rows, keys)
    stores.replace(rows, path)
