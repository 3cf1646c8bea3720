"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and has a bounded number of leaves (MOST_LEAVES, about LEAF_VECTORS vectors each
until there are that many), so it is small enough to send to every worker whatever the table's size. Every vector is
assigned to its leaf. A query walks the tree through a priority queue of branches, nearest first, and takes the leaves
in the order in which they come up. How many it visits is calibrated: the true neighbours of CALIBRATED queries are
found by brute force over all vectors, and visits widen until the share of them that lies in visited leaves reaches the
target recall. All queries then visit that many leaves, and more where these hold fewer vectors than were asked for.

Neighbouring leaves form buckets of about PART_ROWS vectors. A query goes to the buckets of its leaves only. A bucket
with more vectors (one hot leaf) or more queries is searched in blocks of PART_ROWS vectors by PART_ROWS queries, so no
task grows with the table.

Scores are inner products in double precision of the original vectors. Candidates are chosen by blocked matrix
products; all that could be among the k best by their rounding are scored again one by one, in a way that gives equal
vectors equal scores, so ties go to the smaller id.

Null or zero vectors, and those with null or non-finite components, take no part; nor do rows with a null id. Rows that
share an id are one vector, so a repeated row changes nothing (of different vectors under one id, the one with the
smallest hash stands). Vectors of different lengths have no inner product, so they are an error. Fewer vectors than
asked for: all of them. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, need

CALIBRATED, SEED = 192, 11
#: Vectors for each leaf, children of a node, and the most leaves.
LEAF_VECTORS, BRANCHES, MOST_LEAVES = 640, 8, 16_384
#: Vectors that the tree is fitted on: so many, or more for a tree with many leaves.
SAMPLE, SAMPLE_LEAF = 40_000, 16
#: Vectors and queries of a block, and the least number of buckets, which gives small tables some tasks.
PART_ROWS, BUCKETS = 20_000, 12
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes by number; children of a node, its centre, and the number of its leaf (-1: none)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector: down the nearest branches."""
        out = np.zeros(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = nearest(vectors[rows], self.centres[kids])
            stack += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def visit(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: the queue holds branches by the inner product of query and centre. Given their sizes, there are more than most where these hold fewer than least vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                held += least if sizes is None else int(sizes[out[-1]])
                continue
            kids = self.children[node]
            for score, kid in zip((self.centres[kids] @ query).tolist(), kids, strict=True):
                heapq.heappush(queue, (-score, kid))
        return out


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for at in range(0, len(vectors), 8192):
        out[at : at + 8192] = (vectors[at : at + 8192] @ centres.T - half).argmax(axis=1)
    return out


def k_means(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(vectors, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres, nearest(vectors, centres)


def grow(sample: np.ndarray, most_leaves: int) -> Tree:
    """The tree of a sample: the largest nodes are split until there are most_leaves."""
    least = max(2, len(sample) // most_leaves)
    rng = np.random.default_rng(SEED)
    centres, children, members = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [[]], [np.arange(len(sample))]
    leaves, queue = 1, [(-len(sample), 0)]
    while queue:
        size, node = heapq.heappop(queue)
        if -size < 2 * least or leaves >= most_leaves:
            continue
        k = min(BRANCHES, -size // least, most_leaves - leaves + 1)
        own, near = k_means(sample[members[node]], k, rng)
        kids = [i for i in range(k) if (near == i).any()]
        if len(kids) < 2:  # equal vectors
            continue
        for i in kids:
            children[node].append(len(centres))
            heapq.heappush(queue, (-int((near == i).sum()), len(centres)))
            centres.append(own[i])
            children.append([])
            members.append(members[node][near == i])
        members[node] = members[node][:0]
        leaves += len(kids) - 1
    leaf, n = np.full(len(centres), -1), 0
    for i, kids in enumerate(children):
        if not kids:
            leaf[i], n = n, n + 1
    return Tree(np.stack(centres), children, leaf)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's k best among vectors, itself left out."""
    for at in range(0, len(queries), 256):
        scores = queries[at : at + 256] @ vectors.T
        for i, row in enumerate(scores):
            q = at + i
            row = np.where(ids == query_ids[q], -np.inf, row)
            count = min(k, len(row))
            floor = np.partition(row, len(row) - count)[len(row) - count]
            chosen = np.flatnonzero((row >= floor - SLACK * max(1.0, abs(floor) if np.isfinite(floor) else 1.0)) & np.isfinite(row))
            exact = (vectors[chosen] * queries[q]).sum(axis=1)
            order = np.lexsort((ids[chosen], -exact))[:k]
            yield int(query_ids[q]), ids[chosen][order], exact[order]


FOUND = "query_id long, vec_id long, score double"


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all parts. Its rows are at most k a part."""
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64)
    ids, scores = (np.concatenate([r[j] for r in rows]) if rows else np.zeros(0) for j in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.float64))], names=["query_id", "vec_id", "score"])


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a list column, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    need(vectors, id_column, vector_column)
    v = F.col(vector_column)
    good = v.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(good).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))


def _one_an_id(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v) with one vector an id. Only where ids repeat are vectors shuffled for it."""
    if rows.select("vec_id").groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("x")).select("vec_id", F.col("x.v").alias("v"))


def buckets_of(sizes: np.ndarray, most: int) -> np.ndarray:
    """The bucket of every leaf: neighbouring leaves, until they hold most vectors."""
    out, bucket, held = np.zeros(len(sizes), np.int32), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            bucket, held = bucket + 1, 0
        out[leaf], held = bucket, held + n
    return out


def search(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for every row that queries (over vec_id and v) selects."""
    spark = vectors.sparkSession
    staging = Staging(spark, "ann")
    rows = _one_an_id(staging.write(clean(vectors, id_column, vector_column), "clean"))
    total, shortest, longest = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} to {longest} components have no inner product")
    leaves = int(np.clip(total // LEAF_VECTORS, 8, MOST_LEAVES))
    share = int(min(1.0, max(SAMPLE, SAMPLE_LEAF * leaves) / total) * (1 << 30))
    sampled = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).toArrow()
    order = np.argsort(sampled.column("vec_id").to_numpy(), kind="stable")
    if not len(order):
        sampled, order = rows.orderBy("vec_id").limit(1).toArrow(), np.zeros(1, np.int64)
    tree = grow(matrix(sampled.column("v"))[order], leaves)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

    kind = rows.schema["v"].dataType.simpleString()
    indexed = staging.write(rows.mapInArrow(assign, f"vec_id long, v {kind}, leaf int"), "index")
    asked = indexed.filter(queries)
    visits = _calibrate(indexed, asked, tree, k, recall)

    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, n in indexed.groupBy("leaf").count().collect():  # a row a leaf, at most MOST_LEAVES
        sizes[leaf] = n
    bucket_of = buckets_of(sizes, min(PART_ROWS, max(1, total // BUCKETS)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_, buckets, leaves = [], [], []
            for i, q in enumerate(matrix(b.column(1))):
                wanted: dict[int, list[int]] = {}
                for leaf in tree.visit(q, visits, sizes, k + 1):
                    wanted.setdefault(int(bucket_of[leaf]), []).append(leaf)
                rows_ += [i] * len(wanted)
                buckets += wanted
                leaves += wanted.values()
            take = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(buckets, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "v", "bucket", "leaves"])

    routed = staging.write(asked.select("vec_id", "v").mapInArrow(route, f"vec_id long, v {kind}, bucket int, leaves array<int>"), "routed")
    # the blocks of every bucket: at most MOST_LEAVES rows
    askers = dict(routed.groupBy("bucket").count().collect())
    held = np.bincount(bucket_of, sizes).astype(np.int64)
    blocks = spark.createDataFrame([(b, -(-int(held[b]) // PART_ROWS), -(-n // PART_ROWS)) for b, n in askers.items()], "bucket int, parts int, query_parts int")
    names = spark.createDataFrame(list(enumerate(bucket_of.tolist())), "leaf int, bucket int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(n)).cast("int")
    left = routed.join(F.broadcast(blocks), "bucket").select("vec_id", "v", "bucket", "leaves", every("parts").alias("part"), own("query_parts", 1).alias("query_part"))
    right = indexed.join(F.broadcast(names), "leaf").join(F.broadcast(blocks), "bucket").select("vec_id", "v", "leaf", "bucket", own("parts", 2).alias("part"), every("query_parts").alias("query_part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of each query over the leaves that it visits here."""
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch([])])
        ids, points, owners, leaf = right.column("vec_id").to_numpy(), matrix(right.column("v")), left.column("vec_id").to_numpy(), right.column("leaf").to_numpy()
        asks, visited = matrix(left.column("v")), left.column("leaves").to_pylist()
        by_leaf: dict[int, list[int]] = {}
        for i, found in enumerate(visited):
            for x in found:
                by_leaf.setdefault(x, []).append(i)
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for x, asking in by_leaf.items():
            here = np.flatnonzero(leaf == x)
            if len(here):
                for q, near, scores in best(asks[asking], owners[asking], points[here], ids[here], k):
                    kept.setdefault(q, []).append((near, scores))
        out = []
        for q, found in kept.items():
            near, scores = (np.concatenate([f[j] for f in found]) for j in (0, 1))
            order = np.lexsort((near, -scores))[:k]
            out.append((q, near[order], scores[order]))
        return pa.Table.from_batches([_batch(out)])

    key = ["bucket", "part", "query_part"]
    return _merge(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, FOUND), k)


def _calibrate(indexed: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that a sample of the queries finds the share recall of its true neighbours."""
    count = asked.count()
    share = int(min(1.0, CALIBRATED / max(count, 1)) * (1 << 30))
    some = asked.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < share).select("vec_id", "v").toArrow()
    if not some.num_rows:
        some = asked.orderBy("vec_id").limit(1).select("vec_id", "v").toArrow()
    if not some.num_rows:
        return tree.leaves
    ids, points = some.column("vec_id").to_numpy(), matrix(some.column("v"))

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            yield _batch(list(best(points, ids, matrix(b.column(1)), own, k)))

    true = _merge(indexed.select("vec_id", "v").mapInArrow(truth, FOUND), k)
    leaf_of = true.select("query_id", "vec_id").join(indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # CALIBRATED x k rows
    rank = {int(q): {leaf: i for i, leaf in enumerate(tree.visit(p, tree.leaves))} for q, p in zip(ids, points, strict=True)}
    needed = sorted(rank[q][leaf] + 1 for q, leaf in leaf_of)
    visits = 1
    while visits < tree.leaves and np.searchsorted(needed, visits, side="right") < recall * len(needed):
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return visits
