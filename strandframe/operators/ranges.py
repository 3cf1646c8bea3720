"""Ranks and running sums over a whole table's order, with no task that holds more than a range of it.

Ranges are cut at bounds from a sample that is drawn by hash, so a row's range depends on the rows alone: it is the same
in every branch of a plan and for a task that is run again. A range's rows are numbered or summed by themselves; what
lies before it comes from the ranges' totals, a row for each range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import let

#: Sampled rows for each range, bounds that are compared at a time, and rows that are worth a range.
SAMPLE_ROWS, STRIDE, RANGE_ROWS = 64, 32, 50_000


def _bounds(df: DataFrame, order: list[str], parts: int) -> list[tuple]:
    n = df.count()
    parts = min(parts, -(-n // RANGE_ROWS))
    if parts < 2:
        return []
    keep = max(1, n // (parts * SAMPLE_ROWS))
    drawn = df.select(*order).filter(F.pmod(F.xxhash64(*order), F.lit(keep)) == 0).distinct() if keep > 1 else df.select(*order).distinct()
    # about SAMPLE_ROWS x parts values; a cap far beyond that guards against a hash that does not spread
    rows = sorted((tuple((x is not None, x) for x in r) for r in drawn.orderBy(F.xxhash64(*order)).limit(8 * parts * SAMPLE_ROWS).collect()), key=lambda r: [(there, 0 if not there else x) for there, x in r])
    return [tuple(x for _, x in rows[len(rows) * i // parts]) for i in range(1, parts)] if len(rows) >= parts else [tuple(x for _, x in r) for r in rows[1:]]


def ranged(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds a row's range (from 0) in the ascending order of the columns, nulls first."""
    return _ranged(df, order, name, _bounds(df, order, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _ranged(df: DataFrame, order: list[str], name: str, bounds: list[tuple]) -> DataFrame:
    kinds = [df.schema[c].dataType for c in order]
    if not bounds:
        return df.withColumn(name, F.lit(0))
    literal = lambda b: F.struct(*(F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(b, kinds, strict=True))))
    every, coarse = F.array(*map(literal, bounds)), F.array(*map(literal, bounds[STRIDE - 1 :: STRIDE])) if len(bounds) >= STRIDE else F.array()
    below = lambda own, b: F.aggregate(b, F.lit(0), lambda n, x: n + F.when(x <= own, 1).otherwise(0))
    own = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    if len(bounds) < STRIDE:
        return df.withColumn(name, let(own, lambda k: below(k, every)))
    return df.withColumn(name, let(own, lambda k: let(below(k, coarse), lambda c: c * STRIDE + below(k, F.slice(every, c * STRIDE + 1, STRIDE)))))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None, apart: bool = False) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the same keys that come no later in the order. Rows that are equal in it get one sum, or, apart, follow each other in any order."""
    bounds = _bounds(df, [*keys, *order], parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not bounds:  # one range
        whole = Window.partitionBy(*keys or [F.lit(0)]).orderBy(*order)
        whole = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow) if apart else whole
        return df.select("*", *(F.sum(value).over(whole).alias(name) for name, value in sums.items()))
    dealt = _ranged(df, [*keys, *order], "_range", bounds)
    for name, value in sums.items():
        dealt = dealt.withColumn(f"_{name}", value)
    totals = dealt.groupBy("_range", *keys).agg(*(F.sum(f"_{n}").alias(f"_{n}_sum") for n in sums))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_range").alias("_its"), *(F.col(k).alias(f"_{k}_key") for k in keys), *(F.coalesce(F.sum(f"_{n}_sum").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums))
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow) if apart else within
    for name in sums:
        dealt = dealt.withColumn(f"_{name}", F.sum(f"_{name}").over(within))
    same = F.col("_range") == F.col("_its")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}_key"))
    joined = dealt.join(totals, same)
    return joined.select(*df.columns, *((F.col(f"_{n}") + F.col(f"_{n}_before")).alias(n) for n in sums))


def numbered(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds a gapless number from 0 in the given order; rows that are equal in it follow each other in any order."""
    out = running(df, [], order, {"_upto": F.lit(1)}, parts, apart=True)
    return out.withColumn("_upto", (F.col("_upto") - 1).cast("long")).withColumnRenamed("_upto", name)


def counted(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c, upto, n): distinct values that are not null with their count, the rows up to them and the rows of the keys."""
    counts = table.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    upto = running(counts, keys, ["v"], {"upto": F.col("c")})
    return upto.join(totals, keys) if keys else upto.join(F.broadcast(totals))  # one row


def percentiles(table: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear percentiles by name of the values that are neither null nor NaN, exact, from counts by value."""
    clean = table.withColumn("_v", F.col(value).cast("double")).filter(~F.isnan("_v"))
    c = counted(clean, keys, "_v")
    found = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        at = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("c") <= i), F.col("v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        found += [low.alias(f"_{name}_low"), high.alias(f"_{name}_high"), F.max(place - F.floor(place)).alias(f"_{name}_part")]
    out = c.groupBy(*keys).agg(*found)
    return out.select(*keys, *((F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n) for n in shares))
