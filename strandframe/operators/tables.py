"""Guards, joins and set operations that keep a table's rows accountable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def mean(value: Column) -> Column:
    """Mean that leaves out nulls and NaNs."""
    return F.avg(F.nanvl(value.cast("double"), F.lit(None).cast("double")))


def deduped(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key, with its smallest value; a null value is smaller than all."""
    least = F.when(F.count("*") > F.count(value), F.lit(None)).otherwise(F.min(value))
    return df.groupBy(*keys).agg(least.alias(value))


def remap(left: DataFrame, mapping: DataFrame, on: str, target: str) -> DataFrame:
    """left with the target of its key; of several targets the smallest. Keys without one get null."""
    return left.join(deduped(mapping.select(on, target), [on], target), on, "left")


def unmapped(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Number of rows whose key right lacks."""
    return left.join(right.select(on).distinct(), on, "left_anti").agg(F.count("*").alias("unmapped"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def inconsistent(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one combination of values, nulls being a value."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("combinations")).filter("combinations > 1")


def align_multiset(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Pairs equal keys first come, first served, so that repeated keys neither multiply rows nor share one.

    Returns all columns of left and those of right that are no keys; a row without a partner has `matched` false.
    """
    def place(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))

    r = place(right, right_order).withColumn("_there", F.lit(True))
    return place(left, left_order).join(r, [*keys, "_place"], "full").withColumn("matched", F.coalesce("_there", F.lit(False)) & F.col(left_order).isNotNull()).drop("_place", "_there")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same multiset of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], default_split: str = "test") -> DataFrame:
    """new, with those rows of stored whose keys it lacks (null equals null). Stored rows without a split count as default_split's; missing columns are null."""
    if "split" in keys and "split" not in stored.columns:
        stored = stored.withColumn("split", F.lit(default_split))
    replaced = new.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return stored.join(replaced, same, "left_anti").unionByName(new, allowMissingColumns=True)


def subset(df: DataFrame, equal: dict[str, object], group: str | None = None) -> DataFrame:
    """Rows that equal all values; none at all is an error. With a group, so is a group that is not left whole."""
    require(df, *equal)
    kinds = {"boolean": bool, "string": str}
    for name, value in equal.items():
        kind = df.schema[name].dataType.simpleString()
        if (kind == "boolean") != isinstance(value, bool) or isinstance(value, str) != (kinds.get(kind) is str):
            raise TypeError(f"{name} is {kind}, and {value!r} is not")
    hit = reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in equal.items()), F.lit(True))
    out = df.filter(F.coalesce(hit, F.lit(False)))
    if out.isEmpty():
        raise ValueError(f"no row equals {equal}")
    if group is None:
        return out
    partial = df.groupBy(group).agg(F.count_if(hit).alias("hit"), F.count("*").alias("n")).filter("hit > 0 and hit < n")
    if not partial.isEmpty():
        raise ValueError(f"the subset cuts through groups of {group}")
    return out


def narrowed(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles as floats and longs as ints in the named columns, also within arrays."""
    out = df
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        out = out.withColumn(c, F.col(c).cast(kind.replace("double", "float").replace("bigint", "int")))
    return out
