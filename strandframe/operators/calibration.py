"""Calibration of residue predictions against profiles: sites, cross-fitted temperatures, cohorts.

A site is (id, fold, bin, is_t, in_balanced, in_high_nt, consensus_mask, profile and logits as arrays of 20).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import RESIDUES, divergence, let, letters, log_softmax, mask_bit, total, window_start
from .batching import argmax

#: Bounds of the temperature, strata and bins of sites, residues of a window.
BOUNDS, STRATA, BINS, WINDOW = (0.25, 8.0), 18, 9, 512
COHORTS = ("t", "nt", "high_nt")
#: Inverse temperatures tried in one pass.
GRID = 16


def site_rows(table: DataFrame, id_column: str, sequence: str, sites: str, window: int = WINDOW, mask: str = "?") -> DataFrame:
    """A row for each site (struct with `position`, from 0): its window with the site masked, id as id:position and the masked place."""
    c = letters(F.col(sequence))
    t = table.select(F.col(id_column), c.alias("_c"), F.explode(sites).alias("site"))
    t = t.withColumn("_s", window_start(F.size("_c"), F.col("site.position"), window))
    place = F.col("site.position") - F.col("_s")
    masked = F.array_join(F.transform(F.slice("_c", F.col("_s") + 1, F.lit(window)), lambda x, i: F.when(i == place, F.lit(mask)).otherwise(x)), "")
    return t.select(F.concat_ws(":", F.col(id_column).cast("string"), F.col("site.position").cast("string")).alias("id"), place.cast("int").alias("place"), masked.alias("masked"), "site")


def normalised(profile: Column) -> Column:
    return let(total(profile), lambda n: F.transform(profile, lambda x: x.cast("double") / n))


def _slope(beta: Column, profile: Column, logits: Column) -> Column:
    """Derivative, by the inverse temperature, of the divergence of a site."""
    logs = let(F.transform(logits, lambda x: x * beta), log_softmax)
    return total(F.zip_with(logs, logits, lambda q, x: F.exp(q) * x)) - total(F.zip_with(profile, logits, lambda p, x: p * x))


def temperatures(sites: DataFrame, bounds: tuple[float, float] = BOUNDS, rounds: int = 8) -> DataFrame:
    """(fold, temperature, bound): for each fold the temperature that makes the mean divergence of the balanced sites of all other folds least, every stratum (2 bin + 1 - is_t) weighing the same.

    The mean is convex in the inverse temperature, so its derivative has one root within the bounds, or the bound that
    it would pass (`lower`, `upper`; else `none`) is the answer. A pass takes the derivative at GRID points for every
    fold, one aggregate by stratum and fold, and narrows the bracket by that factor. Folds without such sites have null.
    """
    spark = sites.sparkSession
    ready = sites.filter("in_balanced").select("fold", (2 * F.col("bin") + 1 - F.col("is_t").cast("int")).alias("stratum"), normalised(F.col("profile")).alias("profile"), "logits")
    folds = sorted(r[0] for r in sites.select("fold").distinct().collect())  # a few folds
    brackets: dict = {f: (1 / bounds[1], 1 / bounds[0]) for f in folds}
    found: dict = {}
    for step in range(rounds):
        if not brackets:
            break
        points = {f: [low + (high - low) * i / (GRID - 1) for i in range(GRID)] for f, (low, high) in brackets.items()}
        others = F.filter(F.array(*map(F.lit, points)), lambda f: f != F.col("fold"))
        grid = F.create_map(*(F.lit(x) if i % 2 == 0 else F.array(*map(F.lit, x)) for f, betas in points.items() for i, x in enumerate((f, betas))))
        dealt = ready.select("stratum", "profile", "logits", F.explode(others).alias("of"))
        dealt = dealt.select("of", "stratum", F.posexplode(F.transform(grid[F.col("of")], lambda b: _slope(b, F.col("profile"), F.col("logits")))).alias("k", "s"))
        by_stratum = dealt.groupBy("of", "k", "stratum").agg(F.avg("s").alias("s"))
        slopes: dict = {}
        for of, k, s in by_stratum.groupBy("of", "k").agg(F.avg("s")).collect():
            slopes.setdefault(of, {})[k] = s
        for f in list(brackets):
            own, betas = slopes.get(f), points[f]
            if own is None:
                found[f], _ = (None, None), brackets.pop(f)
            elif step == 0 and own[0] >= 0:
                found[f], _ = (bounds[1], "upper"), brackets.pop(f)
            elif step == 0 and own[GRID - 1] <= 0:
                found[f], _ = (bounds[0], "lower"), brackets.pop(f)
            else:
                k = max(i for i in range(GRID - 1) if own[i] < 0) if own[0] < 0 else 0
                brackets[f] = betas[k], betas[k + 1]
    found |= {f: (2 / (a + b), "none") for f, (a, b) in brackets.items()}
    schema = sites.select("fold").schema.add("temperature", "double").add("bound", "string")
    return spark.createDataFrame([(f, *found[f]) for f in folds], schema)


def scored(sites: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """sites with kl, kl_fit (at the temperature of their fold), temperature and predicted (place of the largest logit)."""
    fitted = temperatures(sites) if fitted is None else fitted
    joined = sites.withColumn("profile", normalised(F.col("profile"))).join(F.broadcast(fitted.select("fold", "temperature")), "fold", "left")  # a row for each fold
    return joined.withColumn("kl", divergence(F.col("profile"), F.col("logits"))).withColumn("kl_fit", F.when(F.col("temperature").isNotNull(), divergence(F.col("profile"), F.col("logits"), F.col("temperature")))).withColumn("predicted", argmax(F.col("logits")))


def cohort(name: str) -> Column:
    return {"t": F.col("in_balanced") & F.col("is_t"), "nt": F.col("in_balanced") & ~F.col("is_t"), "high_nt": F.col("in_high_nt")}[name]


def cohorts(rows: DataFrame) -> DataFrame:
    """(cohort, n, kl, score, score_fit, accuracy): scores are 100 exp(-mean KL), accuracy the share whose prediction is a consensus residue. rows: as of ``scored``."""
    each = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(cohort(c), F.lit(False)), F.lit(c)) for c in COHORTS))))
    right = mask_bit(F.col("consensus_mask"), F.col("predicted")).cast("int")
    return rows.withColumn("cohort", each).groupBy("cohort").agg(F.count("*").alias("n"), F.avg("kl").alias("kl"), (100 * F.exp(-F.avg("kl"))).alias("score"), (100 * F.exp(-F.avg("kl_fit"))).alias("score_fit"), F.avg(right).alias("accuracy"))


def cohort_bins(rows: DataFrame) -> DataFrame:
    """(cohort, bin, score, score_fit) of the two balanced cohorts."""
    each = F.explode(F.array_compact(F.array(*(F.when(cohort(c), F.lit(c)) for c in COHORTS[:2]))))
    return rows.withColumn("cohort", each).groupBy("cohort", "bin").agg((100 * F.exp(-F.avg("kl"))).alias("score"), (100 * F.exp(-F.avg("kl_fit"))).alias("score_fit"))


def mean_temperature(fitted: DataFrame) -> DataFrame:
    return fitted.agg(F.avg("temperature").alias("temperature"))


def prior_logits(residue: Column, substitution: dict[str, dict[str, int]] | None = None) -> Column:
    """Logits over the residues that depend on the masked residue alone: ln 19 at it and 0 elsewhere, or half-bit substitution scores times ln 2 / 2."""
    if substitution is None:
        return F.array(*(F.when(residue == r, math.log(19)).otherwise(0.0) for r in RESIDUES))
    rows = F.create_map(*(x for a in RESIDUES for x in (F.lit(a), F.array(*(F.lit(substitution[a][b] * math.log(2) / 2) for b in RESIDUES)))))
    return rows[residue]


def baseline(sites: DataFrame, residue: str, substitution: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """sites with the logits of the residue alone."""
    return sites.withColumn("logits", prior_logits(F.col(residue), substitution))
