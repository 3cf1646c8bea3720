"""Corpus tables: cluster cascades, assembly and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import ambiguous
from .ranges import counted, percentiles
from .tables import deduped, remap, require


def threshold_label(value: float) -> int:
    """Percent of a threshold that is given as percent or as a fraction."""
    share = value / 100 if value > 1 else value
    if not 0 < share <= 1:
        raise ValueError(f"not a threshold: {value}")
    return round(100 * share)


def compose(rounds: list[tuple[float, DataFrame]]) -> DataFrame:
    """Wide cluster table of rounds (sequence_id, cluster_id), the later ones clustering the representatives of the round before.

    Every sequence of the first round gets cluster_rep_at_<percent> of each; one that a later round lacks is an error.
    """
    labels = [threshold_label(t) for t, _ in rounds]
    if len(set(labels)) != len(labels):
        raise ValueError("thresholds with the same percent")
    columns = [f"cluster_rep_at_{x}" for x in labels]
    out = deduped(rounds[0][1].select("sequence_id", F.col("cluster_id").alias(columns[0])), ["sequence_id"], columns[0])
    for last, name, (_, table) in zip(columns, columns[1:], rounds[1:], strict=False):
        mapping = table.select(F.col("sequence_id").alias(last), F.col("cluster_id").alias(name))
        out = remap(out, mapping, last, name)
        out = out.withColumn(name, F.coalesce(name, F.raise_error(F.concat(F.lit(f"no {name} of "), F.col(last))).cast("string")))
    return out.select("sequence_id", *columns)


def wide_clusters(rounds: dict[str, DataFrame]) -> DataFrame:
    """Cluster tables (sequence_id, column) side by side, one row for each sequence of the first."""
    out = None
    for name, table in rounds.items():
        one = deduped(table.select("sequence_id", name), ["sequence_id"], name)
        out = one if out is None else out.join(one, "sequence_id", "left")
    return out


def assemble(base: DataFrame, clusters: DataFrame, dataset_id: str, scores: DataFrame | None = None, on_missing_scores: str = "error") -> DataFrame:
    """base joined with clusters, and with scores if there are any, both inner; dataset_id and sequence_length (characters) are added.

    on_missing_scores says what happens without scores: `skip` leaves the column out, `error` raises.
    """
    require(base, "sequence_id", "sequence")
    require(clusters, "sequence_id")
    if scores is None and on_missing_scores == "error":
        raise ValueError("there are no scores")
    # ids first: texts are shuffled once, and only against the rows that stay
    kept = clusters if scores is None else clusters.join(scores, "sequence_id")
    added = [c for c in clusters.columns if c != "sequence_id"], [c for c in (scores.columns if scores is not None else []) if c != "sequence_id"]
    own = [F.lit(dataset_id).alias("dataset_id"), F.length("sequence").cast("int").alias("sequence_length")]
    return base.join(kept, "sequence_id").select(*base.columns, *added[0], *own, *added[1])


def statistics(table: DataFrame, score: str | None = "score") -> DataFrame:
    """One row: counts, lengths, ambiguous residues and scores."""
    n = F.col("sequence_length")
    marks = ambiguous(F.col("sequence"))
    found = [
        F.count("*").alias("num_rows"), F.min(n).alias("length_min"), F.max(n).alias("length_max"), F.avg(n).alias("length_mean"),
        F.stddev_samp(n).alias("length_std"), F.sum(n).cast("long").alias("length_sum"), F.sum(marks).cast("long").alias("ambiguous_total"),
        F.count_if(marks > 0).alias("ambiguous_rows"), F.try_divide(F.sum(marks), F.sum(n)).alias("ambiguous_fraction"),
    ]
    if score:
        s = F.col(score).cast("double")
        found += [f(s).alias(f"score_{name}") for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("var", F.var_samp), ("min", F.min), ("max", F.max))]
    out = table.agg(*found).join(F.broadcast(percentiles(table, [], "sequence_length", {"length_median": 0.5})), how="left")  # one row each
    return out.join(F.broadcast(percentiles(table, [], score, {"score_median": 0.5})), how="left") if score else out


def quantiles(table: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Values at place round(q (n - 1)), half to even, of the sorted values that are not null; the quartiles are always among them.

    Values are counted first, so the running sum goes over distinct ones.
    """
    shares = sorted({*shares, 0.25, 0.5, 0.75})
    c = counted(table, [], value)
    place = lambda q: F.bround(F.col("n") * q - q).cast("long")
    here = F.filter(F.array(*(F.struct(F.lit(q).alias("quantile"), place(q).alias("place")) for q in shares)), lambda x: (x["place"] < F.col("upto")) & (x["place"] >= F.col("upto") - F.col("c")))
    return c.select("v", F.explode(here).alias("x")).select("x.quantile", F.col("v").alias("value"))


def mode(table: DataFrame, value: str) -> DataFrame:
    """The most frequent value, of equals the smallest, and its count."""
    return table.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1)


def histogram(table: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin (from 1), its bounds and count, empty bins included. Bins are closed on the right, the first on both sides; equal values get a width of 1 / bins."""
    bounds = table.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high")).withColumn("high", F.when(F.col("high") == F.col("low"), F.col("high") + 1).otherwise(F.col("high")))
    width = (F.col("high") - F.col("low")) / bins
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(value) - F.col("low")) / width))).cast("int")
    counts = table.filter(F.col(value).isNotNull()).join(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.filter("low is not null").select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "low", width.alias("w"))
    return every.join(counts, "bin", "left").select("bin", (F.col("low") + (F.col("bin") - 1) * F.col("w")).alias("lower"), (F.col("low") + F.col("bin") * F.col("w")).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box(table: DataFrame, value: str) -> DataFrame:
    """Tukey's box: quartiles (linear), whiskers at 1.5 interquartile ranges but within the values."""
    v = F.col(value).cast("double")
    ends = table.agg(F.min(v).alias("least"), F.max(v).alias("most"))
    q = percentiles(table, [], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).join(F.broadcast(ends))  # one row each
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return q.select("q1", "q2", "q3", F.greatest("least", F.col("q1") - reach).alias("whisker_low"), F.least("most", F.col("q3") + reach).alias("whisker_high"))


def clusters_found(table: DataFrame, columns: list[str], exact: bool = True, error: float = 0.02) -> DataFrame:
    """Distinct clusters of every column, and their share of the rows."""
    count = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, error))
    wide = table.agg(F.count("*").alias("rows"), *(count(F.col(c)).alias(c) for c in columns))
    return wide.unpivot("rows", columns, "level", "clusters").select("level", "clusters", F.try_divide("clusters", "rows").alias("reduction"))


def redundancy(tokens: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """RED of each key's token vectors: 1 - mean cosine of its pairs, by the squared norm of the sum of unit vectors. One token: 0."""
    from ..functions.sequences import unit

    parts = tokens.select(*keys, F.posexplode(unit(F.col(vector))).alias("d", "x")).groupBy(*keys, "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("norm"), F.max("n").alias("n"))
    return whole.select(*keys, "n", F.when(F.col("n") <= 1, 0.0).otherwise(1 - (F.col("norm") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("red"))


def mean_pool(tokens: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector of each key, long: d and value."""
    return tokens.select(*keys, F.posexplode(vector).alias("d", "x")).groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("value"))


def standardisation(vectors: DataFrame, vector: str, floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation (at least floor) of every dimension."""
    x = F.col("x").cast("double")
    return vectors.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg(x).alias("mean"), F.greatest(F.stddev_pop(x), F.lit(floor)).alias("std"))
