"""Curriculum sampling: splits by cluster, score-sorted clusters, epoch plans, token-budgeted batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60, key, md5_mod
from .ranges import numbered


def is_held_out(cluster: Column, modulus: int = 20) -> Column:
    """Whether a cluster belongs to validation; null clusters never do."""
    return F.coalesce(md5_mod(cluster.cast("string"), modulus) == 0, F.lit(False))


def split(table: DataFrame, cluster: str, modulus: int = 20) -> DataFrame:
    return table.withColumn("split", F.when(is_held_out(F.col(cluster), modulus), "validation").otherwise("train"))


def cluster_index(table: DataFrame, cluster: str, score: str, row_id: str) -> DataFrame:
    """rn: place of a row in its cluster by falling score, then row_id. Rows at or above a threshold are a prefix."""
    return table.withColumn("rn", F.row_number().over(Window.partitionBy(cluster).orderBy(F.col(score).desc_nulls_last(), row_id)))


def valid_counts(table: DataFrame, cluster: str, score: str, threshold: float) -> DataFrame:
    return table.groupBy(cluster).agg(F.count_if(F.col(score) >= threshold).alias("valid"))


#: Share of the way from the start to the end of a ramp, by the share x of its epochs, for ramps that blend linearly.
BLENDS: dict[str, Callable[[Column], Column]] = {"linear": lambda x: x, "cosine": lambda x: F.pow(F.sin(x * (math.pi / 2)), F.lit(2.0))}


def ramped(epoch: Column, kind: str, start: float, end: float, over: int) -> Column:
    """The score threshold of an epoch on its way from start to end over some epochs, then flat; a column, so a plan of all epochs is one table.

    `exponential` is the geometric blend; from a start of 0, which that cannot leave, it is the blend of exp(x) - 1.
    """
    x = F.least(F.lit(1.0), epoch / float(over)) if over > 0 else F.lit(1.0)
    if kind == "exponential" and start > 0:
        return F.exp((1 - x) * math.log(start) + x * math.log(end))
    shares = BLENDS | {"exponential": lambda t: F.expm1(t) / math.expm1(1.0)}
    if kind not in shares:
        raise ValueError(f"no such ramp: {kind}")
    return F.lit(float(start)) + shares[kind](x) * (end - start)


def pick(index: DataFrame, counts: DataFrame, cluster: str, seed: str) -> DataFrame:
    """One row of each cluster with valid rows, evenly among them, by the hash of seed and cluster."""
    wanted = counts.filter("valid > 0").select(F.col(cluster).alias("_c"), (1 + h60(key(seed, F.coalesce(F.col(cluster).cast("string"), F.lit("")))) % F.col("valid")).alias("_rn"))
    return index.join(wanted, F.col(cluster).eqNullSafe(F.col("_c")) & (F.col("rn") == F.col("_rn"))).drop("_c", "_rn")


def keep_fraction(table: DataFrame, fraction: float, id_column: str, seed: str) -> DataFrame:
    """max(1, round half even (n fraction)) rows by hash order; none for a fraction of 0."""
    if fraction <= 0:
        return table.limit(0)
    most = max(1, round(table.count() * fraction))
    dealt = numbered(table.withColumn("_h", h60(key(seed, F.col(id_column)))), ["_h", id_column], "_n")
    return dealt.filter(F.col("_n") < most).select(*table.columns)


def epoch_plan(picked: dict[str, DataFrame], row_id: str, length: str, seed: str) -> DataFrame:
    """(source, row_id, length) of all sources with the shuffle key whose order is the epoch's."""
    out = None
    for name, df in picked.items():
        one = df.select(F.lit(name).alias("source"), F.col(row_id).alias("row_id"), F.col(length).alias("sequence_length"))
        out = one if out is None else out.unionAll(one)
    return out.withColumn("shuffle", h60(key(seed, F.col("source"), F.col("row_id"))))


def pack_batches(rows: DataFrame, partition: str, order: str, length: str, budget: int, extra: int = 2, most: int | None = None) -> DataFrame:
    """batch of every row: rows in order join a batch while its cost stays within the budget; one row always fits.

    Cost is length + extra, at most `most`. Each partition is folded by itself, holding one number.
    """
    kind = rows.schema[partition].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, used = object(), 0, 0
        for b in batches:
            out = []
            for p, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                cost = n + extra if most is None else min(n + extra, most)
                if p != now:
                    now, batch, used = p, 0, cost
                elif used + cost > budget:
                    batch, used = batch + 1, cost
                else:
                    used += cost
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=[partition, order, "batch"])

    few = rows.select(partition, order, F.col(length).cast("long"))
    return few.repartition(partition).sortWithinPartitions(partition, order).mapInArrow(run, f"`{partition}` {kind}, `{order}` {rows.schema[order].dataType.simpleString()}, batch long")


def folds(table: DataFrame, id_column: str, k: int, seed: str) -> DataFrame:
    """fold of every row: rows in hash order are dealt out in turn."""
    dealt = numbered(table.withColumn("_h", h60(key(seed, F.col(id_column)))), ["_h", id_column], "_n")
    return dealt.select(*table.columns, (F.col("_n") % k).cast("int").alias("fold"))
