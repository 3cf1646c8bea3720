"""K-d tree partitioning into shards of nearly equal bytes.

Points are groups of equal texts, with their bytes as weight and metadata as coordinates. A node of the tree is split
along its widest dimension, relative to the whole table, at the weighted median; ties on that dimension go by the
group's hash, so the order is total and a cut can be as fine as one group. The median is found by rounds of histograms:
each round adds up the bytes of every node in CELLS cells of the interval that still holds the median, and keeps the
cell where half of the bytes is passed. All nodes of a level are split in the same rounds, and a round returns at most
nodes x CELLS numbers, whatever the table's size. Equal texts stay together.

Slots number a shard's documents without gaps: rows are counted by shard and hash bucket, buckets get their first
slot, and numbers within a bucket follow, so no task holds a shard.

Nulls: a null text has no bytes (size 1) and is a group with empty texts; null doc_ids get slots like others; other
columns only need to be there if they are named as dimensions, and their nulls count as 0. Repeated rows get a slot
each. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, hot_above, join_hot, need

CELLS = 512
#: A median's cell is fine enough when it holds this share of a shard's bytes.
FINE = 1e-4


def _cell(value: Column, low: Column, high: Column) -> Column:
    """Cell (0 to CELLS - 1) of a value within bounds that it lies in."""
    width = high - low
    return F.when(width <= 0, 0).otherwise(F.least(F.lit(CELLS - 1), F.floor((value - low) / width * CELLS))).cast("int")


def _literal(node: Column, values: dict[int, float]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v))))[node]


def _halve(here: DataFrame, point: Column, inside: Column, bounds: dict[int, tuple[float, float]], target: dict[int, float], fine: float) -> dict[int, tuple[float, float, bool | None]]:
    """Where the bytes of every node, in the order of point, pass target.

    A node's answer is (point, what is left of target, None) where a single value of point is left, and (largest or smallest
    point of a fine cell, 0, whether the cell goes to the left) where a cell holds no more than fine bytes.
    """
    n, open_, target, out = F.col("node"), dict(bounds), dict(target), {}
    while open_:
        low, high = (_literal(n, {k: v[j] for k, v in open_.items()}) for j in (0, 1))
        held = here.filter(n.isin(*open_)).filter(inside & (point >= low) & (point <= high))
        found: dict[int, list[tuple]] = {}
        for node, *cell in held.groupBy("node", _cell(point, low, high).alias("cell")).agg(F.sum("bytes"), F.min(point), F.max(point)).collect():
            found.setdefault(node, []).append(tuple(cell))
        for k in list(open_):
            cells = sorted(found[k])
            for i, (_, size, least, most) in enumerate(cells):
                if target[k] < size or i + 1 == len(cells):
                    break
                target[k] -= size
            if least == most:
                out[k] = (float(least), target[k], None)
            elif size <= fine:
                out[k] = (float(most), 0.0, True) if 2 * target[k] >= size else (float(least), 0.0, False)
            else:
                open_[k] = (float(least), float(most))
                continue
            del open_[k]
    return out


def split(points: DataFrame, dimensions: list[str], leaves: int, staging: Staging) -> DataFrame:
    """points: dimensions, tie (double, nearly unique), bytes and three more columns. Adds shard, 0 to leaves - 1 (a power of two)."""
    depth = int(math.log2(leaves))
    if 1 << depth != leaves:
        raise ValueError("the number of shards has to be a power of two")
    total = points.agg(F.sum("bytes"), *(x for d in dimensions for x in (F.min(d), F.max(d)))).first()
    if not total[0]:
        return points.withColumn("shard", F.lit(0))
    spans = {d: max(1e-12, float(total[2 + 2 * i] - total[1 + 2 * i])) for i, d in enumerate(dimensions)}
    fine = FINE * total[0] / leaves
    node = F.lit(0)
    for _ in range(depth):
        here = points.withColumn("node", node)
        rows = here.groupBy("node").agg(F.sum("bytes").alias("b"), F.min("tie"), F.max("tie"), *(x for d in dimensions for x in (F.min(d), F.max(d)))).collect()
        axis, bounds, target, ties = {}, {}, {}, {}
        for r in rows:
            spreads = [(float(r[5 + 2 * i] - r[4 + 2 * i]) / spans[d], -i) for i, d in enumerate(dimensions)]
            i = -max(spreads)[1]
            axis[r[0]], bounds[r[0]], target[r[0]], ties[r[0]] = i, (float(r[4 + 2 * i]), float(r[5 + 2 * i])), r[1] / 2, (float(r[2]), float(r[3]))
        n = F.col("node")
        value = F.array(*(F.col(d).cast("double") for d in dimensions))[_literal(n, axis).cast("int")]
        # first along the dimension; where one value of it holds the median, along the tie
        on_value = _halve(here, value, F.lit(True), bounds, target, fine)
        single = {k: v for k, (v, _, whole) in on_value.items() if whole is None}
        cuts = {k: (v if whole else math.nextafter(v, -math.inf), math.inf) for k, (v, _, whole) in on_value.items() if whole is not None}
        if single:
            on_tie = _halve(here, F.col("tie"), value == _literal(n, single), {k: ties[k] for k in single}, {k: on_value[k][1] for k in single}, fine)
            for k, (v, rest, whole) in on_tie.items():
                if whole is None:  # one group, which goes to the left if half of it fits there
                    whole = rest >= fine
                cuts[k] = (single[k], v if whole else math.nextafter(v, -math.inf))
        at, tie = _literal(n, {k: v[0] for k, v in cuts.items()}), _literal(n, {k: v[1] for k, v in cuts.items()})
        left = (value < at) | ((value == at) & (F.col("tie") <= tie))
        previous, points = points, staging.write(here.withColumn("kd_node", n * 2 + F.when(left, 0).otherwise(1)).select(*points.columns[: len(dimensions) + 5], "kd_node"), "nodes")
        staging.drop(previous)
        node = F.col("kd_node")
    return points.withColumn("shard", node.cast("int"))


def shard(docs: DataFrame, dimensions: dict[str, Column] | None = None, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document. dimensions: metadata by name; a group of equal texts has the smallest of its rows."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    staging = Staging(spark, "shards")
    text = F.coalesce("text", F.lit(""))
    if dimensions is None:
        dimensions = {"position": F.col("doc_id").cast("double"), "length": F.log1p(F.octet_length(text))}
        for name in ("lang", "source"):
            if name in docs.columns:
                dimensions[name] = F.pmod(F.xxhash64(F.coalesce(F.col(name), F.lit(""))), F.lit(1009)).cast("double")
    named = {f"d{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(dimensions.values())}
    rows = staging.write(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), *(c.alias(k) for k, c in named.items())),
        "rows",
    )
    # 53 bits of the hash are exact in a double
    tie = F.shiftrightunsigned("h1", 11).cast("double")
    points = staging.write(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *(F.min(k).alias(k) for k in named)).select(*named, tie.alias("tie"), "bytes", "h1", "h2", "n"), "groups")
    hot = hot_above(spark, points.agg(F.sum("n")).first()[0] or 0)
    placed = split(points, list(named), shards, staging).select("h1", "h2", "n", "shard")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("doc_id", "h1"), F.lit(buckets)).cast("int")
    dealt = staging.write(join_hot(rows.select("doc_id", "size", "text_crc32", "h1", "h2"), placed, ["h1", "h2"], hot).select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "placed")
    # at most shards x buckets rows
    counts = sorted(dealt.groupBy("shard", "bucket").count().collect())
    first, seen = [], {}
    for s, b, n in counts:
        first.append((s, b, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    offsets = spark.createDataFrame(first, "shard int, bucket int, first long")
    number = F.expr("row_number() over (partition by shard, bucket order by doc_id, text_crc32, size)")
    return dealt.join(F.broadcast(offsets), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + number - 1).alias("slot"))
