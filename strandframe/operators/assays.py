"""Assays of mutants: suites, zero-shot scores from tables of log-probabilities, per-assay metrics and their hierarchy.

All assays are rows of one table with a dms_id, so a suite is one grouped pass and not a loop. Undefined metrics are NaN
or null and are left out of means.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60, key
from ..functions.sequences import RESIDUES, binary_label, let, mutations, total
from .curriculum import folds as dealt_folds
from .inference import resamples
from .metrics import assay_mcc, hierarchy, ndcg, roc_auc, spearman, top_recall
from .tables import finite, require, upsert

#: Metrics that continuous and binary labels have.
CONTINUOUS, BINARY = ("spearman", "ndcg", "top_recall"), ("auc", "mcc")


def suite(reference: DataFrame, variants: DataFrame, most: int | None = None) -> DataFrame:
    """variants of the suite's first `most` assays by dms_id, with the reference's columns; assays without variants give no rows."""
    require(reference, "dms_id", "uniprot_id", "coarse_selection_type")
    kept = reference if most is None else reference.orderBy("dms_id").limit(most)
    return variants.join(kept, "dms_id")


def unmatched(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """dms_id of assays without variants, which a run skips with a warning."""
    return reference.select("dms_id").join(variants.select("dms_id").distinct(), "dms_id", "left_anti")


def substitution_scores(variants: DataFrame, wild: DataFrame, log_probs: DataFrame) -> DataFrame:
    """score of every variant: over its mutations, the log-probability of the mutant less that of the wild residue, at the masked position.

    variants: dms_id, mutant (A12C:D30E). wild: dms_id, target_seq. log_probs: dms_id, position (from 1), residue,
    log_prob. A position outside the sequence makes NaN; a wild residue that the sequence does not have is an error.
    Equal variants are scored once and given out as often as they occur.
    """
    t = variants.select("dms_id", "mutant").distinct().join(wild.select("dms_id", "target_seq"), "dms_id")
    m = t.select("dms_id", "mutant", "target_seq", F.explode(mutations(F.col("mutant"))).alias("x"))
    at = F.substring("target_seq", F.col("x.position"), F.lit(1))
    inside = F.col("x.position") <= F.length("target_seq")
    checked = F.when(~inside | (at == F.col("x.wild")), inside).otherwise(F.raise_error(F.concat(F.lit("not the wild residue: "), F.col("mutant"))).cast("boolean"))
    m = m.select("dms_id", "mutant", F.col("x.position").alias("position"), F.col("x.wild").alias("wild"), F.col("x.mutant").alias("to"), checked.alias("inside"))
    p = lambda name, column: log_probs.select("dms_id", "position", F.col("residue").alias(name), F.col("log_prob").alias(column))
    m = m.join(p("wild", "_w"), ["dms_id", "position", "wild"], "left").join(p("to", "_m"), ["dms_id", "position", "to"], "left")
    one = F.when(F.col("inside"), F.col("_m") - F.col("_w"))
    each = m.groupBy("dms_id", "mutant").agg(F.when(F.count(one) == F.count("*"), F.sum(one)).otherwise(float("nan")).alias("score"))
    return variants.join(each, ["dms_id", "mutant"], "left")


def pseudo_log_likelihood(log_probs: DataFrame, keys: list[str]) -> DataFrame:
    """pll: the sum over positions of the log-probability of the residue that is there. log_probs: keys, position, log_prob."""
    return log_probs.groupBy(*keys).agg(F.sum("log_prob").alias("pll"))


def indel_scores(variants: DataFrame, mutant_pll: DataFrame, wild_pll: DataFrame) -> DataFrame:
    """score of every variant (dms_id, mutated_sequence): its pseudo-log-likelihood less that of the wild sequence; NaN where either is missing."""
    joined = variants.join(mutant_pll.select("dms_id", "mutated_sequence", F.col("pll").alias("_m")), ["dms_id", "mutated_sequence"], "left").join(wild_pll.select("dms_id", F.col("pll").alias("_w")), "dms_id", "left")
    return joined.withColumn("score", F.coalesce(F.col("_m") - F.col("_w"), F.lit(float("nan")))).drop("_m", "_w")


def pair_scores(variants: DataFrame, substitution: dict[str, dict[str, int]]) -> DataFrame:
    """score of every variant: the sum of its mutations' substitution scores; NaN where a residue has none."""
    table = F.create_map(*(F.lit(x) for a, row in substitution.items() for b, s in row.items() if a in RESIDUES and b in RESIDUES for x in (a + b, float(s))))
    one = F.transform(mutations(F.col("mutant")), lambda m: F.coalesce(F.element_at(table, F.concat(m["wild"], m["mutant"])), F.lit(float("nan"))))
    return variants.withColumn("score", F.aggregate(one, F.lit(0.0), lambda a, x: a + x))


def read_substitution(text: str) -> dict[str, dict[str, int]]:
    """A substitution matrix in the usual text form: comments, a line of letters, then a letter and its scores a line."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {row[0]: dict(zip(lines[0], map(int, row[1:]), strict=True)) for row in lines[1:]}


def random_scores(variants: DataFrame, identity: str, seed: str) -> DataFrame:
    """score of every variant: a uniform number by hash."""
    return variants.withColumn("score", h60(key(seed, F.col("dms_id"), F.col(identity))) / float(1 << 60))


def all_metrics(scored: DataFrame, identity: str, continuous: str | None = "dms_score", binary: str | None = None, flip: bool = False) -> DataFrame:
    """(dms_id, num_variants, metric columns): CONTINUOUS where there is a continuous label, BINARY where there is a binary one. Variants without a finite score are left out."""
    rows = scored.filter(finite(F.col("score")))
    parts = [rows.groupBy("dms_id").agg(F.count("*").alias("num_variants"))]
    if continuous:
        t = rows.filter(finite(F.col(continuous).cast("double"))).select("dms_id", F.col(continuous).cast("double").alias("label"), F.col("score").alias("prediction"), F.col(identity).alias("_id"))
        parts += [spearman(t, ["dms_id"], "label", "prediction"), ndcg(t, ["dms_id"], "label", "prediction", "_id"), top_recall(t, ["dms_id"], "label", "prediction")]
    if binary:
        t = rows.select("dms_id", binary_label(F.col(binary), flip).alias("label"), "score").filter("label is not null")
        parts += [roc_auc(t, ["dms_id"], "label", "score"), assay_mcc(t, ["dms_id"], "label", "score")]
    return reduce(lambda a, b: a.join(b, "dms_id", "left"), parts)


def pooled_auc(scored: DataFrame, binary: str, flip: bool = False) -> DataFrame:
    """One AUC over the variants of all assays."""
    t = scored.filter(finite(F.col("score"))).select(binary_label(F.col(binary), flip).alias("label"), "score").filter("label is not null")
    return roc_auc(t, [], "label", "score")


def aggregate(assays: DataFrame, metrics: list[str]) -> DataFrame:
    """(scope, coarse_selection_type, metric, value, contributors): means of proteins by function, and of functions overall.

    assays: dms_id, uniprot_id, coarse_selection_type and metric columns; a column that is missing or has no value is
    left out.
    """
    out = None
    for m in (m for m in metrics if m in assays.columns):
        clean = assays.filter(finite(F.col(m).cast("double"))).withColumn("value", F.col(m).cast("double"))
        by_function = hierarchy(clean, "value", ["coarse_selection_type", "uniprot_id"])
        overall = by_function.agg(F.avg("value").alias("value"), F.count("*").alias("contributors")).filter("contributors > 0")
        both = by_function.select(F.lit("function").alias("scope"), "coarse_selection_type", F.lit(m).alias("metric"), "value", "contributors")
        both = both.unionAll(overall.select(F.lit("overall").alias("scope"), F.lit(None).cast("string"), F.lit(m).alias("metric"), "value", "contributors"))
        out = both if out is None else out.unionAll(both)
    if out is None:
        raise ValueError("no metric to aggregate")
    return out


def score_table(assays: DataFrame, metrics: list[str], condition: str) -> DataFrame:
    """The long table of a condition: scopes `assay`, `function` and `overall`."""
    identity = ["dms_id", "uniprot_id", "coarse_selection_type", "num_variants"]
    there = [m for m in metrics if m in assays.columns]
    each = assays.select(*identity, *(F.col(m).cast("double").alias(m) for m in there)).unpivot(identity, there, "metric", "value").withColumn("scope", F.lit("assay"))
    above = aggregate(assays, metrics).drop("contributors")
    return each.unionByName(above, allowMissingColumns=True).withColumn("control", F.lit(condition))


def publish(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new's conditions replaced."""
    return upsert(stored, new, ["control"])


def standard_error(assays: DataFrame, metric: str, times: int, seed: str) -> DataFrame:
    """Bootstrap standard error of the overall mean: proteins are drawn within each function, a resample's value is the mean of its functions' means.

    Draw d of resample b takes the protein at place h60(seed|function|b|d) mod n of its function.
    """
    proteins = assays.filter(finite(F.col(metric).cast("double"))).groupBy("coarse_selection_type", "uniprot_id").agg(F.avg(metric).alias("value"))
    place = F.row_number().over(_by_function("uniprot_id")) - 1
    placed = proteins.withColumn("_p", place).withColumn("_n", F.count("*").over(_by_function()))
    draws = placed.select("coarse_selection_type", "_n", F.col("_p").alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("resample"))
    draws = draws.select("coarse_selection_type", "resample", (h60(key(seed, F.col("coarse_selection_type"), F.col("resample"), F.col("_d"))) % F.col("_n")).cast("int").alias("_p"))
    means = draws.join(placed.select("coarse_selection_type", "_p", "value"), ["coarse_selection_type", "_p"]).groupBy("resample", "coarse_selection_type").agg(F.avg("value").alias("value"))
    return means.groupBy("resample").agg(F.avg("value").alias("value")).agg(F.stddev_samp("value").alias("standard_error"))


def _by_function(*order: str):
    from pyspark.sql import Window

    w = Window.partitionBy("coarse_selection_type")
    return w.orderBy(*order) if order else w


def draw_units(assays: DataFrame, times: int, seed: str) -> DataFrame:
    """Resamples of whole assays."""
    return resamples(assays.select("dms_id").distinct(), "dms_id", times, seed)


def composition_features(sequence: Column) -> Column:
    """Shares of the 20 residues; zeros where there is none."""
    counts = F.array(*((F.length(sequence) - F.length(F.translate(sequence, r, ""))).cast("double") for r in RESIDUES))
    return let(counts, lambda c: let(F.greatest(F.lit(1.0), total(c)), lambda n: F.transform(c, lambda x: x / n)))


def ridge_out_of_fold(rows: DataFrame, group: str, identity: str, features: str, label: str, fold: str, penalty: float = 1.0) -> DataFrame:
    """(group, identity, fold, prediction): ridge regression fitted on the other folds of the same group.

    Every group and fold has its normal equations as sums over rows (the square of the features' number, however many
    rows there are); a fold's own sums are taken off the group's. Rows with a NaN or null label are predicted but not
    learned from; a fold whose training rows are fewer than two, or of one label only, has no predictions.
    """
    width = rows.select(F.max(F.size(features))).first()[0] or 0
    if not width:
        raise ValueError("no features")
    x = F.concat(F.array(F.lit(1.0)), F.transform(F.col(features), lambda v: v.cast("double")))
    size = width + 1
    kind = rows.schema[group].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for b in batches:
            groups, of, y = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_numpy(zero_copy_only=False)
            m = np.stack(b.column(2).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, size))
            rows_of: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(groups, of, strict=True)):
                rows_of.setdefault(k, []).append(i)
            for k, own in rows_of.items():
                a, t = m[own], y[own].astype(np.float64)
                packed = np.concatenate([(a.T @ a).ravel(), a.T @ t, [len(own), t.min(), t.max()]])
                if k in totals:
                    old = totals[k]
                    packed[:-2] += old[:-2]
                    packed[-2:] = min(packed[-2], old[-2]), max(packed[-1], old[-1])
                totals[k] = packed
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals]), pa.array([k[1] for k in totals], pa.int32()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], names=["g", "f", "s"])

    ready = rows.select(F.col(group).alias("g"), F.col(fold).cast("int").alias("f"), x.alias("x"), F.col(label).cast("double").alias("y"), F.col(identity).alias("i"))
    learned = ready.filter(finite(F.col("y"))).select("g", "f", "x", "y").mapInArrow(sums, f"g {kind}, f int, s array<double>")
    everyone = ready.select("g", "f").distinct()

    def solve(table: pa.Table) -> pa.Table:
        parts, wanted = {}, set()
        for g, f, s, own in zip(*(table.column(c).to_pylist() for c in ("g", "f", "s", "own")), strict=True):
            if own:
                wanted.add((g, f))
            else:
                v = np.array(s)
                if (g, f) in parts:
                    old = parts[g, f]
                    v[:-2] += old[:-2]
                    v[-2:] = min(v[-2], old[-2]), max(v[-1], old[-1])
                parts[g, f] = v
        out = []
        for g, f in sorted(wanted, key=lambda k: k[1]):
            others = [v for (_, of), v in parts.items() if of != f]
            if not others:
                continue
            total = np.sum([v[:-2] for v in others], axis=0)
            if total[-1] < 2 or min(v[-2] for v in others) == max(v[-1] for v in others):
                continue
            normal, right = total[: size * size].reshape(size, size), total[size * size : size * size + size]
            ridge = penalty * np.eye(size)
            ridge[0, 0] = 1e-9  # the intercept is free
            out.append((g, f, np.linalg.solve(normal + ridge, right).tolist()))
        return pa.table({"g": pa.array([o[0] for o in out], table.schema.field("g").type), "f": pa.array([o[1] for o in out], pa.int32()), "w": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    none = F.lit(None).cast("array<double>")
    both = learned.withColumn("own", F.lit(False)).unionByName(everyone.withColumn("s", none).withColumn("own", F.lit(True)))
    weights = both.groupBy("g").applyInArrow(solve, f"g {kind}, f int, w array<double>")
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return ready.join(weights, ["g", "f"]).select(F.col("g").alias(group), F.col("i").alias(identity), F.col("f").alias("fold"), dot.alias("prediction"))


def supervised(rows: DataFrame, identity: str, features: str, label: str, k: int, seed: str, official: str | None = None) -> DataFrame:
    """Out-of-fold predictions of every assay; folds are an official column or dealt by hash."""
    dealt = rows.withColumn("fold", F.col(official).cast("int")) if official else dealt_folds(rows, identity, k, seed)
    return ridge_out_of_fold(dealt, "dms_id", identity, features, label, "fold")


def scheme_average(schemes: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """The mean of a metric over split schemes, those where it is undefined left out."""
    parts = [t.select(*keys, F.lit(n).alias("scheme"), F.col(value).cast("double").alias("value")) for n, t in schemes.items()]
    rows = reduce(DataFrame.unionAll, parts).filter(finite(F.col("value")))
    return rows.groupBy(*keys).agg(F.avg("value").alias(value), F.count("*").alias("schemes"))
