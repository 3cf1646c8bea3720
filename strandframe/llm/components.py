"""Connected components of a table of links, by large stars and small stars in turn.

Both steps keep every component connected and hang its nodes on smaller ones, until each hangs on the smallest. A node
with very many links is only ever aggregated to its smallest neighbour, which is then sent to its links where they are;
no list of neighbours is made. Every step is a written table, so neither lineage nor a lost executor costs more than a
step, and no plan holds another step's plan over and over: the driver plans a step's few joins only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, hot_above, join_hot


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _joined(left: DataFrame, least: DataFrame, hot: int | None) -> DataFrame:
    """left with the smallest neighbour of its a; hot: whether there are hubs, and from how many links on."""
    return left.join(least.drop("n"), "a") if hot is None else join_hot(left, least, ["a"], hot)


def _large(links: DataFrame, hot: int | None, staging: Staging) -> DataFrame:
    """Larger neighbours of every node hang on its smallest neighbour (or itself)."""
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    least = least if hot is None else staging.write(least, "least")  # read for hubs and for the rest
    return _joined(both.filter("b > a"), least, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame, hot: int | None, staging: Staging) -> DataFrame:
    """Smaller neighbours of every node, and it, hang on the smallest of them. links: a > b."""
    least = staging.write(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    moved = _joined(links, least, hot).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, staging: Staging, rounds: int = 60) -> DataFrame:
    """(a, b) links of one type to (node, root): every node that has a link, with its component's smallest node."""
    now = staging.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        # how many links there are, what they are, and how many one node has: of all, and of those to smaller ones
        each = _both(now).groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("up"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        total, most, most_up, mark = each.agg(F.sum("n"), F.max("n"), F.max("up"), F.sum("h")).first()
        if not total or (total, mark) == seen:
            break
        seen, hot = (total, mark), hot_above(links.sparkSession, total)
        # hanging links on smaller nodes gives no node more links to smaller ones than it had
        large = staging.write(_large(now, hot if most > hot else None, staging), "links")
        nxt = staging.write(_small(large, hot if most_up > hot else None, staging), "links")
        staging.drop(now)
        staging.drop(large)
        now = nxt
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
