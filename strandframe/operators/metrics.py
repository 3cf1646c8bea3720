"""Metrics by group. keys may be empty: then the whole table is one group. Undefined values are null unless a metric says NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import percentiles, running
from .tables import mean


def confusion(table: DataFrame, keys: list[str], label: str, prediction: str) -> DataFrame:
    return table.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification(counts: DataFrame, keys: list[str], classes: list | None = None) -> DataFrame:
    """accuracy (which micro averages equal), macro and weighted precision, recall and F1, and MCC (0 where a side is constant) of confusion counts; a division by zero is 0.

    Macro averages go over the classes that occur, or over the given ones.
    """
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = counts.select(*keys, F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"), "n", "label", "prediction")
    hit = F.when((F.col("label") == F.col("prediction")) & (F.col("x.t") > 0), F.col("n")).otherwise(0)
    one = each.groupBy(*keys, F.col("x.c").alias("c")).agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum(hit).alias("hit"))
    one = one.withColumn("precision", ratio(F.col("hit"), F.col("p"))).withColumn("recall", ratio(F.col("hit"), F.col("t")))
    one = one.withColumn("f1", ratio(2 * F.col("hit"), F.col("t") + F.col("p")))
    macro = (lambda x: F.avg(x)) if classes is None else (lambda x: F.sum(F.when(F.col("c").isin(*classes), F.col(x)).otherwise(0.0)) / len(classes))
    parts = [f(x) for x in ("precision", "recall", "f1") for f in (lambda x: macro(x).alias(f"{x}_macro"), lambda x: ratio(F.sum(F.col(x) * F.col("t")), F.sum("t")).alias(f"{x}_weighted"))]
    d = lambda x: F.sum(x).cast("double")
    out = one.groupBy(*keys).agg(*parts, d("t").alias("s"), d("hit").alias("c"), F.sum(F.col("t") * F.col("p")).cast("double").alias("tp"), F.sum(F.col("t") * F.col("t")).cast("double").alias("tt"), F.sum(F.col("p") * F.col("p")).cast("double").alias("pp"))
    s2 = F.col("s") * F.col("s")
    mcc = ratio(F.col("c") * F.col("s") - F.col("tp"), F.sqrt(s2 - F.col("pp")) * F.sqrt(s2 - F.col("tt")))
    return out.select(*keys, ratio(F.col("c"), F.col("s")).alias("accuracy"), *(f"{x}_{y}" for x in ("precision", "recall", "f1") for y in ("macro", "weighted")), mcc.alias("mcc"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def regression(table: DataFrame, keys: list[str], label: str, prediction: str) -> DataFrame:
    """mse, mae, r2 and Pearson correlation; the latter two need two rows and sides that vary."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    many = (F.count("*") >= 2) & (F.var_pop(y) > 0)
    r2 = F.when(many, 1 - F.sum(e * e) / F.when(F.var_pop(y) > 0, F.var_pop(y) * F.count("*")))
    return table.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2"), F.when(many, correlation(y, p)).alias("pearson"))


def average_ranks(table: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, equal values sharing their mean; null values have none. Ranks come from the counts of values, so a group may be as large as it likes."""
    counts = table.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running(counts, keys, [value], {"_upto": F.col("_c")}).select(*(F.col(k).alias(f"_{k}_of") for k in keys), F.col(value).alias("_value"), (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    same = F.col(value) == F.col("_value")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}_of"))
    return table.join(ranked, same, "left").select(*table.columns, name)


def spearman(table: DataFrame, keys: list[str], label: str, prediction: str) -> DataFrame:
    ranked = average_ranks(average_ranks(table, keys, label, "_y"), keys, prediction, "_p")
    return ranked.groupBy(*keys).agg(correlation(F.col("_y"), F.col("_p")).alias("spearman"))


def _by_score(table: DataFrame, keys: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """Positives and negatives, by weight, of each distinct score, and both up to it; the running sums go over these, not over rows."""
    y = F.col(label).cast("long")
    w = F.lit(1) if weight is None else F.col(weight).cast("double")
    g = table.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(y * w).alias("pos"), F.sum((1 - y) * w).alias("neg"))
    return running(g, keys, ["s"], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})


def roc_auc(table: DataFrame, keys: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """Binary ROC-AUC, ties counting half; null with one class only."""
    g = _by_score(table, keys, label, score, weight).withColumn("won", F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return g.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def average_precision(table: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Precision after each group of equal scores, weighted by its positives; 0 without positives."""
    low = table.withColumn("_s", -F.col(score).cast("double"))
    g = _by_score(low, keys, label, "_s").withColumn("precision", F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto")))
    return g.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")), F.lit(0.0)).alias("average_precision"))


def ndcg(table: DataFrame, keys: list[str], label: str, prediction: str, id_column: str, share: float = 0.1) -> DataFrame:
    """NDCG of the top share by prediction; gains are labels scaled to 0..1, ties go by id, those of one id by rising label."""
    y = F.col(label).cast("double")
    ends = table.groupBy(*keys).agg(F.min(y).alias("_low"), F.max(y).alias("_high"), F.floor(F.count("*") * share).alias("_k"))
    t = table.select(*keys, y.alias("_y"), (-F.col(prediction).cast("double")).alias("_p"), (-y).alias("_ny"), F.col(id_column).alias("_id"))
    t = running(running(t, keys, ["_p", "_id", "_y"], {"_r": F.lit(1)}, apart=True), keys, ["_ny", "_id"], {"_i": F.lit(1)}, apart=True)
    t = t.join(ends, keys) if keys else t.join(F.broadcast(ends))  # one row
    t = t.filter((F.col("_r") <= F.col("_k")) | (F.col("_i") <= F.col("_k"))).withColumn("_g", F.coalesce(F.try_divide(F.col("_y") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)))
    gain = lambda r: F.sum(F.when(F.col(r) <= F.col("_k"), F.col("_g") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    found = t.groupBy(*keys).agg(F.try_divide(gain("_r"), gain("_i")).alias("ndcg"))
    return ends.select(*keys).join(found, keys, "left") if keys else found


def top_recall(table: DataFrame, keys: list[str], label: str, prediction: str, share: float = 0.9) -> DataFrame:
    """Share of the rows at or above the labels' percentile that are also at or above the predictions'."""
    joined = table
    for column, cut in ((label, "_y"), (prediction, "_p")):
        cuts = percentiles(table, keys, column, {cut: share})
        joined = joined.join(cuts, keys) if keys else joined.join(F.broadcast(cuts))  # one row
    top = F.col(label) >= F.col("_y")
    return joined.groupBy(*keys).agg(F.try_divide(F.count_if(top & (F.col(prediction) >= F.col("_p"))), F.count_if(top)).alias("top_recall"))


def f_max(pairs: DataFrame, protein: str, label: str, probability: str) -> DataFrame:
    """CAFA's Fmax of (protein, term, label, probability) rows over thresholds .01 to 1.00, by one histogram.

    Precision is over proteins with a prediction, recall over annotated ones; proteins without a label are left out.
    """
    step = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(F.col(probability) * 100, 9)))).cast("int")
    h = pairs.groupBy(protein, step.alias("step")).agg(F.sum(F.col(label).cast("long")).alias("hit"), F.count("*").alias("all"))
    w = Window.partitionBy(protein).orderBy(F.desc("step"))
    h = h.withColumn("hit", F.sum("hit").over(w)).withColumn("all", F.sum("all").over(w)).withColumn("next", F.coalesce(F.lag("step").over(w), F.lit(101)))
    labels = pairs.groupBy(protein).agg(F.sum(F.col(label).cast("long")).alias("labels")).filter("labels > 0")
    # each row holds for the thresholds above the next lower step up to its own
    w2 = Window.partitionBy(protein).orderBy("step")
    h = h.withColumn("from", F.greatest(F.lit(1), F.coalesce(F.lag("step").over(w2), F.lit(0)) + 1)).filter("step >= 1").join(labels, protein)
    each = h.select(F.explode(F.sequence(F.col("from"), F.col("step"))).alias("t"), F.col("hit") / F.col("all"), F.col("hit") / F.col("labels")).toDF("t", "p", "r")
    total = labels.agg(F.count("*").alias("proteins"))
    curve = each.groupBy("t").agg(F.avg("p").alias("p"), F.sum("r").alias("r")).join(F.broadcast(total)).select("t", "p", (F.col("r") / F.col("proteins")).alias("r"))
    best = curve.agg(F.max(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))).alias("best"))
    return best.join(F.broadcast(total)).select(F.when(F.col("proteins") > 0, F.coalesce("best", F.lit(0.0))).alias("fmax"))


def hierarchy(table: DataFrame, value: str, levels: list[str]) -> DataFrame:
    """Mean of means: levels are keys from the coarsest to the finest; nulls and NaNs are left out at each. Returns the coarsest level's rows with their contributors."""
    out = table
    for depth in range(len(levels), 0, -1):
        out = out.groupBy(*levels[:depth]).agg(mean(F.col(value)).alias(value), F.count_if(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("contributors"))
    return out


def contact_precision(pairs: DataFrame, unit: str, length: str, least: int = 6) -> DataFrame:
    """Precision of the ceil-free top L d / 10 pairs, d from 1 to 10, of (unit, i, j, score, label, length) rows by falling score, then i, j.

    AUC is the mean over the ten cuts, P@L the last one, P@L/2 and P@L/5 the fifth and the second.
    """
    ok = pairs.filter((F.col("j") - F.col("i")) >= least)
    w = Window.partitionBy(unit).orderBy(F.desc("score"), "i", "j")
    r = ok.select(unit, F.col(length).alias("l"), F.row_number().over(w).alias("rank"), F.sum(F.col("label").cast("long")).over(w).alias("hits"), F.count("*").over(Window.partitionBy(unit)).alias("n"))
    cut = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("l") * F.col("d") / 10)))
    each = r.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(10)))).filter(F.col("rank") == cut).withColumn("p", F.col("hits") / F.col("rank"))
    at = lambda d: F.max(F.when(F.col("d") == d, F.col("p")))
    return each.groupBy(unit).agg(F.avg("p").alias("auc"), at(10).alias("p_at_l"), at(5).alias("p_at_l2"), at(2).alias("p_at_l5"))


def _mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Binary MCC of counts; 0 where labels or predictions are constant."""
    d = lambda x: x.cast("double")
    spread = F.sqrt(d(tp + fp) * d(tp + fn)) * F.sqrt(d(tn + fp) * d(tn + fn))
    return F.coalesce(F.try_divide(d(tp) * d(tn) - d(fp) * d(fn), spread), F.lit(0.0))


def multilabel_mcc(cells: DataFrame, row: str, term: str, label: str, prediction: str) -> DataFrame:
    """mcc_micro, mcc_macro, mcc_weighted (by positives; unweighted if there are none) and mcc_samples of (row, term) cells of 0 and 1.

    An empty table gives nulls.
    """
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]
    names = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
    terms = cells.groupBy(term).agg(*counts).withColumn("mcc", _mcc(*names))
    support = F.sum(F.col("tp") + F.col("fn"))
    weighted = F.coalesce(F.try_divide(F.sum(F.col("mcc") * (F.col("tp") + F.col("fn"))), support), F.avg("mcc"))
    micro = F.when(F.count("*") > 0, _mcc(*map(F.sum, names)))
    by_term = terms.agg(micro.alias("mcc_micro"), F.avg("mcc").alias("mcc_macro"), weighted.alias("mcc_weighted"))
    by_row = cells.groupBy(row).agg(*counts).agg(F.avg(_mcc(*names)).alias("mcc_samples"))
    return by_term.join(F.broadcast(by_row))  # one row each


def multilabel_ranking(cells: DataFrame, term: str, label: str, score: str) -> DataFrame:
    """Average precision (macro; weighted by positives, 0 if there are none) and macro ROC-AUC over terms, leaving out those of one class."""
    support = cells.groupBy(term).agg(F.sum(F.col(label).cast("long")).alias("positives"))
    each = average_precision(cells, [term], label, score).join(roc_auc(cells, [term], label, score), term).join(support, term)
    weighted = F.coalesce(F.try_divide(F.sum(F.col("average_precision") * F.col("positives")), F.sum("positives")), F.lit(0.0))
    return each.agg(F.avg("average_precision").alias("ap_macro"), weighted.alias("ap_weighted"), F.avg("auc").alias("auc_macro"))


def pseudo_perplexity(table: DataFrame, keys: list[str], log_prob: str) -> DataFrame:
    """mean_log_prob and pseudo_perplexity, the exponential of its negative."""
    average = F.avg(F.col(log_prob).cast("double"))
    return table.groupBy(*keys).agg(average.alias("mean_log_prob"), F.exp(-average).alias("pseudo_perplexity"))


def assay_mcc(table: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """MCC of a binary label and scores at or above their own median; NaN where either side is constant."""
    cuts = percentiles(table, keys, score, {"_cut": 0.5})
    joined = table.join(cuts, keys) if keys else table.join(F.broadcast(cuts))  # one row
    y, p = F.col(label) == 1, F.col(score) >= F.col("_cut")
    counts = joined.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    constant = (tp + fp == 0) | (fn + tn == 0) | (tp + fn == 0) | (fp + tn == 0)
    return counts.select(*keys, F.when(constant, F.lit(float("nan"))).otherwise(_mcc(tp, fp, fn, tn)).alias("mcc"))
