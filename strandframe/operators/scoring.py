"""Scores of predictions and their controls: metrics from sums, paired resampling, paired randomisation, reports.

A metric here is a function of a few sums over rows, so units (rows, proteins, clusters) carry sums, a resample adds
them up with multiplicities and a permutation swaps them; rows themselves are read once. Tables have the columns
condition, label and prediction (double; for a multiclass label, equality is all that counts) and a unit column.
Undefined values are null and are left out, per metric.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60, key
from .inference import LOWER_IS_BETTER, benjamini_hochberg, resamples, shuffled
from .metrics import average_precision, f_max, multilabel_mcc, roc_auc, spearman

#: Permutations that one hash decides on.
CHUNK = 20


@dataclass(frozen=True)
class Metric:
    """Names of the sums that a metric needs, and its value as an expression of these."""

    sums: tuple[str, ...]
    value: Callable[..., Column]


def _sums(label: Column, prediction: Column) -> dict[str, Column]:
    y, p = label.cast("double"), prediction.cast("double")
    one, hit = F.lit(1.0), lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "n": one, "hit": hit(label == prediction), "y": y, "p": p, "yy": y * y, "pp": p * p, "yp": y * p, "ae": F.abs(y - p),
        "tp": hit((y == 1) & (p == 1)), "fp": hit((y != 1) & (p == 1)), "fn": hit((y == 1) & (p != 1)), "tn": hit((y != 1) & (p != 1)),
    }


def _or_zero(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def _spread(n: Column, x: Column, xx: Column) -> Column:
    """Sum of squares about the mean; null where it is nothing but rounding, or of fewer than two rows."""
    s = xx - x * x / n
    return F.when((n >= 2) & (s > 1e-12 * xx), s)


#: Metrics by name; those whose prediction is a probability come from whole tables, see ``evaluate``.
METRICS = {
    "accuracy": Metric(("hit", "n"), lambda hit, n: F.when(n > 0, hit / n)),
    "mse": Metric(("yy", "pp", "yp", "n"), lambda yy, pp, yp, n: F.when(n > 0, F.greatest(F.lit(0.0), (yy + pp - 2 * yp) / n))),
    "mae": Metric(("ae", "n"), lambda ae, n: F.when(n > 0, ae / n)),
    "r2": Metric(("yy", "pp", "yp", "y", "n"), lambda yy, pp, yp, y, n: 1 - (yy + pp - 2 * yp) / _spread(n, y, yy)),
    "pearson": Metric(("n", "y", "p", "yy", "pp", "yp"), lambda n, y, p, yy, pp, yp: (yp - y * p / n) / F.sqrt(_spread(n, y, yy) * _spread(n, p, pp))),
    "mean_log_prob": Metric(("p", "n"), lambda p, n: F.when(n > 0, p / n)),
    "pseudo_perplexity": Metric(("p", "n"), lambda p, n: F.when(n > 0, F.exp(-p / n))),
    "precision": Metric(("tp", "fp"), lambda tp, fp: _or_zero(tp, tp + fp)),
    "recall": Metric(("tp", "fn"), lambda tp, fn: _or_zero(tp, tp + fn)),
    "f1": Metric(("tp", "fp", "fn"), lambda tp, fp, fn: _or_zero(2 * tp, 2 * tp + fp + fn)),
    "mcc": Metric(("tp", "fp", "fn", "tn"), lambda tp, fp, fn, tn: _or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn)))),
}
#: Metrics of whole tables: (table, keys) to one row of keys and value. They need scores, not decisions.
WHOLE: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "spearman": lambda t, keys: spearman(t, keys, "label", "prediction").withColumnRenamed("spearman", "value"),
    "auc": lambda t, keys: roc_auc(t, keys, "label", "prediction").withColumnRenamed("auc", "value"),
    "average_precision": lambda t, keys: average_precision(t, keys, "label", "prediction").withColumnRenamed("average_precision", "value"),
}
#: Tasks with their metrics, conditions and baselines by name.
TASKS = {
    "sequence_classification": ("accuracy", "precision", "recall", "f1", "mcc"), "token_classification": ("accuracy", "precision", "recall", "f1", "mcc"), "sequence_regression": ("mse", "mae", "r2", "pearson", "spearman"),
    "pseudo_perplexity": ("mean_log_prob", "pseudo_perplexity"), "sequence_multilabel_classification": ("fmax", "mcc"), "contact_prediction": (), "calibration": (),
}
CONDITIONS = ("random_trunk", "random_head", "random_both", "untrained", "scrambled_labels", "scrambled_sequence")


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise KeyError(f"no such metric: {name}")
    return METRICS[name]


def task_metrics(task: str) -> tuple[str, ...]:
    if task not in TASKS:
        raise KeyError(f"no such task: {task}")
    return TASKS[task]


def per_unit(table: DataFrame, units: list[str], names: list[str]) -> DataFrame:
    """(units, sums): what the named metrics need of each unit."""
    needed = sorted({s for n in names for s in metric(n).sums})
    made = _sums(F.col("label"), F.col("prediction"))
    return table.groupBy(*units).agg(*(F.sum(made[s]).alias(s) for s in needed))


def _values(sums: DataFrame, keys: list[str], names: list[str], prefix: str = "") -> DataFrame:
    """Long (keys, metric, value) of summed columns."""
    made = F.array(*(F.struct(F.lit(n).alias("metric"), metric(n).value(*(F.col(prefix + s) for s in metric(n).sums)).cast("double").alias("value")) for n in names))
    return sums.select(*keys, F.explode(made).alias("_m")).select(*keys, "_m.metric", "_m.value")


def evaluate(table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value) of any of METRICS and WHOLE; an unknown name is a KeyError."""
    if unknown := [n for n in names if n not in METRICS and n not in WHOLE]:
        raise KeyError(f"no such metric: {', '.join(unknown)}")
    parts = [_values(per_unit(table, keys, own), keys, own)] if (own := [n for n in names if n in METRICS]) else []
    parts += [WHOLE[n](table, keys).select(*keys, F.lit(n).alias("metric"), F.col("value").cast("double").alias("value")) for n in names if n in WHOLE]
    return reduce(DataFrame.unionAll, parts)


def mean_of_units(table: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """(metric, value, contributors): every unit's own metrics, averaged over the units where they are defined."""
    each = evaluate(table, [unit], names)
    return each.groupBy("metric").agg(F.avg("value").alias("value"), F.count("value").alias("contributors"))


def scrambled_labels(trained: DataFrame, id_column: str, seed: str, within: list[str] | None = None) -> DataFrame:
    """trained with the condition of the same name added: the same predictions, labels permuted over all rows or within groups."""
    moved = shuffled(trained, within or [], id_column, "label", seed).withColumn("condition", F.lit("scrambled_labels"))
    return trained.unionByName(moved)


def scrambled_groups(trained: DataFrame, group: str, id_column: str, seed: str) -> DataFrame:
    """Labels permuted over all rows while every group keeps its size: a row takes the label at its place in hash order, in the order of groups."""
    from .ranges import numbered

    to = numbered(trained, [group, id_column], "_n")
    moved = numbered(trained.select(F.col("label").alias("_v"), F.col(id_column).alias("_i"), h60(key(seed, F.col(id_column))).alias("_h")), ["_h", "_i"], "_n").select("_n", "_v")
    return to.drop("label").join(moved, "_n").withColumnRenamed("_v", "label").drop("_n")


def resampled(units: DataFrame, unit: str, names: list[str], times: int, seed: str) -> DataFrame:
    """(condition, resample, metric, value): every resample draws the same units for all conditions. units: as of ``per_unit`` by condition and unit."""
    drawn = resamples(units.select(F.col(unit)).distinct(), unit, times, seed)
    sums = [c for c in units.columns if c not in ("condition", unit)]
    added = units.join(drawn, unit).groupBy("condition", "resample").agg(*(F.sum(F.col(s) * F.col("multiplicity")).alias(s) for s in sums))
    return _values(added, ["condition", "resample"], names).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def intervals(values: DataFrame, keys: list[str], alpha: float = 0.05, value: str = "value") -> DataFrame:
    """(keys, ci_mean, ci_lower, ci_upper) over resamples, of which there are few."""
    return values.groupBy(*keys).agg(F.avg(value).alias("ci_mean"), F.percentile(value, alpha / 2).alias("ci_lower"), F.percentile(value, 1 - alpha / 2).alias("ci_upper"))


def randomised(units: DataFrame, unit: str, names: list[str], against: str, times: int, seed: str, trained: str = "trained", two_sided: bool = False) -> DataFrame:
    """(metric, observed, p): paired randomisation of the trained condition and another one.

    A permutation swaps a unit's sums with probability 1/2; p = (k + 1) / (valid + 1) of the permutations whose
    difference is defined, null where none is. Without two sides, larger is better unless the metric says otherwise.
    The bits of one hash of a unit decide on CHUNK permutations, which are added up in one aggregate.
    """
    sums = [c for c in units.columns if c not in ("condition", unit)]
    own = lambda condition, letter: units.filter(F.col("condition") == condition).select(unit, *(F.col(s).alias(f"{letter}_{s}") for s in sums))
    pairs = own(trained, "t").join(own(against, "c"), unit)
    totals = pairs.agg(*(F.sum(f"{x}_{s}").alias(f"{x}_{s}") for x in "tc" for s in sums))
    seen = _values(totals, [], names, "t_").withColumnRenamed("value", "t").join(_values(totals, [], names, "c_").withColumnRenamed("value", "c"), "metric")
    observed = seen.select("metric", (F.col("t") - F.col("c")).alias("observed"))
    chunks = -(-times // CHUNK)
    dealt = pairs.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("_h", h60(key(seed, F.col("_chunk"), F.col(unit))))
    swap = lambda j: F.call_function("shiftright", F.col("_h"), F.lit(j)).bitwiseAND(F.lit(1)) == 1
    added = dealt.groupBy("_chunk").agg(*(F.sum(F.when(swap(j), F.col(f"c_{s}")).otherwise(F.col(f"t_{s}"))).alias(f"_{j}_{s}") for j in range(CHUNK) for s in sums))
    each = F.explode(F.array(*(F.struct((F.col("_chunk") * CHUNK + j).alias("permutation"), *(F.col(f"_{j}_{s}").alias(f"a_{s}") for s in sums)) for j in range(CHUNK))))
    drawn = added.select(each.alias("_x")).select("_x.*").filter(F.col("permutation") < times).join(F.broadcast(totals))  # one row
    drawn = drawn.select("permutation", *(F.col(f"a_{s}") for s in sums), *((F.col(f"t_{s}") + F.col(f"c_{s}") - F.col(f"a_{s}")).alias(f"b_{s}") for s in sums))
    a, b = (_values(drawn, ["permutation"], names, f"{x}_").withColumnRenamed("value", x) for x in "ab")
    diffs = a.join(b, ["permutation", "metric"]).withColumn("d", F.col("a") - F.col("b")).filter(F.col("d").isNotNull() & ~F.isnan("d")).join(F.broadcast(observed), "metric")
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    size = F.abs("d") >= F.abs("observed") - 1e-12 if two_sided else F.col("d") * sign >= F.col("observed") * sign - 1e-12
    found = diffs.groupBy("metric").agg(F.count_if(size).alias("_k"), F.count("*").alias("_n"))
    return observed.join(found, "metric", "left").select("metric", "observed", F.when(F.col("observed").isNotNull(), (F.col("_k") + 1) / (F.col("_n") + 1)).alias("p"))


def compared(table: DataFrame, unit: str, names: list[str], others: list[str], times: int, permutations: int, seed: str, trained: str = "trained", two_sided: bool = False, alpha: float = 0.05) -> DataFrame:
    """(metric, control, trained_mean, control_mean, diff_mean, diff_lower, diff_upper, p_value, p_value_adjusted) of every other condition.

    Means and intervals are over resamples where both sides are defined, p-values are adjusted within each metric. With
    two sides this compares layers with the deepest one.
    """
    units = per_unit(table.filter(F.col("condition").isin(trained, *others)), ["condition", unit], names)
    values = resampled(units, unit, names, times, seed)
    t = values.filter(F.col("condition") == trained).select("resample", "metric", F.col("value").alias("t"))
    c = values.filter(F.col("condition") != trained).select("resample", "metric", F.col("condition").alias("control"), F.col("value").alias("c"))
    paired = c.join(t, ["resample", "metric"]).withColumn("d", F.col("t") - F.col("c"))
    means = paired.groupBy("metric", "control").agg(F.avg("t").alias("trained_mean"), F.avg("c").alias("control_mean"), F.avg("d").alias("diff_mean"), F.percentile("d", alpha / 2).alias("diff_lower"), F.percentile("d", 1 - alpha / 2).alias("diff_upper"))
    tests = [randomised(units, unit, names, o, permutations, f"{seed}|{o}", trained, two_sided).select("metric", F.lit(o).alias("control"), F.col("p").alias("p_value")) for o in others]
    joined = means.join(reduce(DataFrame.unionAll, tests), ["metric", "control"]).filter("p_value is not null")
    return benjamini_hochberg(joined, ["metric"], "p_value").withColumnRenamed("q", "p_value_adjusted")


def layers(table: DataFrame, unit: str, names: list[str], times: int, permutations: int, seed: str) -> DataFrame:
    """Every layer against the deepest, by two-sided tests. table: layer, label, prediction and unit; layers have to be aligned by unit."""
    found = sorted(r[0] for r in table.select("layer").distinct().collect())  # a model's layers
    sizes = table.groupBy(unit).agg(F.count_distinct("layer").alias("n")).filter(F.col("n") != len(found))
    if not sizes.isEmpty():
        raise ValueError("layers are not aligned by unit")
    named = table.withColumn("condition", F.col("layer").cast("string"))
    return compared(named, unit, names, [str(x) for x in found[:-1]], times, permutations, seed, str(found[-1]), True).withColumnRenamed("control", "layer")


def report(table: DataFrame, unit: str, names: list[str], others: list[str], seed: str, times: int = 0, permutations: int = 0, identity: dict[str, str] | None = None, trained: str = "trained") -> DataFrame:
    """The long report of a run: a row for each metric (with its interval, given resamples), and for each control and metric.

    Columns: identity's, metric, control (null: the trained model), value, ci_mean, ci_lower, ci_upper, control_mean,
    diff_mean, diff_lower, diff_upper, p_value, p_value_adjusted.
    """
    d = ("ci_mean", "ci_lower", "ci_upper", "control_mean", "diff_mean", "diff_lower", "diff_upper", "p_value", "p_value_adjusted")
    none = F.lit(None).cast("double")
    own = evaluate(table.filter(F.col("condition") == trained), [], names)
    if times:
        decomposable = [n for n in names if n in METRICS]
        units = per_unit(table.filter(F.col("condition") == trained), ["condition", unit], decomposable)
        own = own.join(intervals(resampled(units, unit, decomposable, times, seed), ["metric"]), "metric", "left")
        out = own.select("metric", F.lit(None).cast("string").alias("control"), "value", *(F.col(c) if c in own.columns else none.alias(c) for c in d))
        if others and permutations:
            c = compared(table, unit, decomposable, others, times, permutations, seed, trained)
            out = out.unionByName(c.select("metric", "control", F.col("trained_mean").alias("value"), *(F.col(x) if x in c.columns else none.alias(x) for x in d)))
    else:
        out = own.select("metric", F.lit(None).cast("string").alias("control"), "value", *(none.alias(c) for c in d))
        for o in others:
            point = evaluate(table.filter(F.col("condition") == o), [], names).select("metric", F.col("value").alias("_c"))
            joined = own.join(point, "metric")
            out = out.unionByName(joined.select("metric", F.lit(o).alias("control"), "value", *((F.col("_c") if x == "control_mean" else F.col("value") - F.col("_c") if x == "diff_mean" else none).alias(x) for x in d)))
    return out.select(*(F.lit(v).alias(k) for k, v in (identity or {}).items()), *out.columns)


def one_versus_one(table: DataFrame, label: str, probabilities: str, classes: int) -> DataFrame:
    """auc_macro and auc_weighted (by the pair's rows) of a multiclass ROC-AUC over all pairs of observed classes.

    Probabilities are scaled to sum to one over the observed classes. With two of these, the binary AUC of the larger
    one; with fewer, null. A row takes part in the pairs of its own class only, once as that class and once as the other.
    """
    counts = dict(table.groupBy(F.col(label).cast("int")).count().collect())  # a row for each class
    if any(c is None or not 0 <= c < classes for c in counts):
        raise ValueError("labels have to be classes")
    seen = sorted(counts)
    if len(seen) < 2:
        return table.sparkSession.range(1).select(F.lit(None).cast("double").alias("auc_macro"), F.lit(None).cast("double").alias("auc_weighted"))
    y, p = F.col(label).cast("int"), F.col(probabilities)
    if len(seen) == 2:
        one = roc_auc(table.select((y == seen[1]).cast("int").alias("y"), F.get(p, F.lit(seen[1])).cast("double").alias("s")), [], "y", "s")
        return one.select(F.col("auc").alias("auc_macro"), F.col("auc").alias("auc_weighted"))
    total = reduce(lambda a, b: a + b, (F.get(p, F.lit(c)).cast("double") for c in seen))
    others = F.filter(F.array(*map(F.lit, seen)), lambda c: c != y)
    both = F.flatten(F.transform(others, lambda c: F.array(F.struct(y.alias("a"), c.alias("b"), F.lit(1).alias("y"), (F.get(p, y) / total).alias("s")), F.struct(c.alias("a"), y.alias("b"), F.lit(0).alias("y"), (F.get(p, c) / total).alias("s")))))
    dealt = table.select(F.explode(both).alias("_x")).select("_x.a", "_x.b", "_x.y", F.col("_x.s").cast("double").alias("s"))
    each = roc_auc(dealt, ["a", "b"], "y", "s")
    sizes = F.create_map(*(F.lit(x) for item in counts.items() for x in item))
    weight = sizes[F.col("a")] + sizes[F.col("b")]
    return each.agg(F.avg("auc").alias("auc_macro"), (F.sum(F.col("auc") * weight) / F.sum(weight)).alias("auc_weighted"))


def multilabel_classification(cells: DataFrame, row: str, term: str, label: str, prediction: str) -> DataFrame:
    """(average, precision, recall, f1): micro, macro and weighted over terms, samples over rows; a division by zero is 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = [F.count_if(y & p).cast("double").alias("tp"), F.count_if(~y & p).cast("double").alias("fp"), F.count_if(y & ~p).cast("double").alias("fn")]
    names = ("precision", "recall", "f1")
    made = lambda t: t.select("*", *(METRICS[n].value(*(F.col(s) for s in METRICS[n].sums)).alias(n) for n in names))
    terms, rows = made(cells.groupBy(term).agg(*counts)), made(cells.groupBy(row).agg(*counts))
    support = F.col("tp") + F.col("fn")
    mean = lambda t, name: t.agg(*(F.avg(n).alias(n) for n in names)).select(F.lit(name).alias("average"), *names)
    micro = made(cells.agg(*counts)).select(F.lit("micro").alias("average"), *names)
    weighted = terms.agg(*(_or_zero(F.sum(F.col(n) * support), F.sum(support)).alias(n) for n in names)).select(F.lit("weighted").alias("average"), *names)
    return micro.unionAll(mean(terms, "macro")).unionAll(weighted).unionAll(mean(rows, "samples"))


def training_counters(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Counters over steps (loss, tokens predicted, correct, seconds, stall): loss and accuracy by predicted tokens, perplexity exp(min(loss, 100)), tokens a second and quantiles of the stall."""
    from .ranges import percentiles

    n = F.sum("tokens").cast("double")
    loss = F.try_divide(F.sum(F.col("loss") * F.col("tokens")), n)
    sums = steps.groupBy(*keys).agg(loss.alias("loss"), F.exp(F.least(loss, F.lit(100.0))).alias("perplexity"), F.try_divide(F.sum("correct"), n).alias("accuracy"), F.try_divide(n, F.sum("seconds")).alias("tokens_per_second"), F.max("stall").alias("stall_max"))
    quantiles = percentiles(steps, keys, "stall", {"stall_p50": 0.5, "stall_p90": 0.9, "stall_p99": 0.99})
    return sums.join(quantiles, keys, "left") if keys else sums.join(F.broadcast(quantiles), how="left")


def whole_multilabel(cells: DataFrame, row: str, term: str, label: str, probability: str) -> DataFrame:
    """Fmax and MCC (decisions above one half) of multilabel cells, one row."""
    decided = cells.withColumn("_d", (F.col(probability) > 0.5).cast("int"))
    return f_max(cells, row, label, probability).join(F.broadcast(multilabel_mcc(decided, row, term, label, "_d")))  # one row each
