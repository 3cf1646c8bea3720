"""Resampling statistics over units. Units carry sufficient statistics, so a resample draws units and not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60, key
from .ranges import numbered

#: Permutations that the bits of one hash decide on.
BITS = 30

#: Metrics of which less is better.
LOWER_IS_BETTER = {"mse", "mae", "pseudo_perplexity", "kl_t", "kl_nt", "kl_high_nt"}


def resamples(units: DataFrame, order: str, times: int, seed: str) -> DataFrame:
    """Every unit as often as each resample draws it: resample, multiplicity and the unit's columns.

    Draw d of resample b takes the unit at place h60(seed|b|d) mod n, so draws are multinomial and the same everywhere.
    """
    placed = numbered(units, [order], "_place")
    draws = placed.select("_place", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("resample")).withColumnRenamed("_place", "_draw")
    n = units.agg(F.count("*").alias("_n"))
    drawn = draws.join(F.broadcast(n)).select("resample", (h60(key(seed, F.col("resample"), F.col("_draw"))) % F.col("_n")).alias("_place"))
    return drawn.groupBy("resample", "_place").agg(F.count("*").alias("multiplicity")).join(placed, "_place").drop("_place")


def interval(values: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Mean and linear quantiles at alpha / 2 on both sides; NaNs and nulls are left out."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.percentile(v, alpha / 2).alias("low"), F.percentile(v, 1 - alpha / 2).alias("high"))


def permutation_p(units: DataFrame, unit: str, a: str, b: str, times: int, seed: str, two_sided: bool = False, lower_is_better: bool = False) -> DataFrame:
    """Paired test of mean(a) against mean(b): each permutation swaps a unit's pair with probability 1/2; p = (k + 1) / (valid + 1).

    Permutation t takes bit t mod BITS of the hash of seed, t / BITS and unit, so a unit is read times / BITS times and
    its differences are added up where they are.
    """
    d = (F.col(a) - F.col(b)).cast("double") * (-1 if lower_is_better else 1)
    each = units.select(unit, d.alias("d")).filter(F.col("d").isNotNull() & ~F.isnan("d"))
    observed = each.agg(F.avg("d").alias("observed"))
    dealt = each.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(-(-times // BITS) - 1)))).withColumn("h", h60(key(seed, F.col("c"), F.col(unit))))
    kept = lambda j: F.call_function("shiftright", F.col("h"), F.lit(j)).bitwiseAND(F.lit(1)) == 0
    added = dealt.groupBy("c").agg(*(F.avg(F.when(kept(j), F.col("d")).otherwise(-F.col("d"))).alias(f"m{j}") for j in range(BITS)))
    means = added.select(F.posexplode(F.array(*(f"m{j}" for j in range(BITS)))).alias("j", "m"), "c").filter(F.col("c") * BITS + F.col("j") < times)
    size: Column = F.abs("m") >= F.abs("observed") - 1e-12 if two_sided else F.col("m") >= F.col("observed") - 1e-12
    return means.join(F.broadcast(observed)).groupBy("observed").agg(((F.count_if(size) + 1) / (F.count("*") + 1)).alias("p"))


def benjamini_hochberg(table: DataFrame, keys: list[str], p: str) -> DataFrame:
    """q: the smallest p n / rank at this rank or later, at most 1; null p stays null and does not count."""
    part = keys or [F.lit(0)]
    valid = table.filter(F.col(p).isNotNull())
    ranked = valid.withColumn("_r", F.rank().over(Window.partitionBy(*part).orderBy(p)) + F.count("*").over(Window.partitionBy(*part, p)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*part)))
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(Window.partitionBy(*part).orderBy(F.desc(p))))
    return ranked.withColumn("q", q).drop("_r", "_n").unionByName(table.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def long_report(wide: DataFrame, identity: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(identity, metrics, "metric", "value")


def shuffled(table: DataFrame, keys: list[str], id_column: str, value: str, seed: str) -> DataFrame:
    """value permuted within keys (all rows for none), by hash order; every value is used once."""
    part = keys or [F.lit(0)]
    to = table.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(id_column)))
    moved = table.select(*keys, F.col(value).alias("_v"), F.row_number().over(Window.partitionBy(*part).orderBy(h60(key(seed, F.col(id_column))), id_column)).alias("_r"))
    return to.drop(value).join(moved, [*keys, "_r"]).withColumnRenamed("_v", value).drop("_r")
