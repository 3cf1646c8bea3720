"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of a covering code: blocks of 23 of a fingerprint's bits, each with the perfect binary Golay
code, whose covering radius is 3 and whose words are named by 12 bits. Take fingerprints x and y that differ in t bits.
Some point m between them differs from x in at most floor(t/2) bits and from y in at most ceil(t/2), and one anchor
lies within the covering radius of m in every block. So when each fingerprint goes to every anchor whose distances
exceed the radius by no more than ceil(t/2), summed over blocks, x and y meet at an anchor, where one of them exceeds
it by floor(t/2) at most. That is replication within covering radius plus threshold, with the threshold split between
the two sides. Nothing is lost, and all fingerprints at an anchor are compared.

Only distinct fingerprints are dealt to anchors. A task compares the fingerprints of its anchors, sorted, by shifted
arrays, and returns a spanning forest of the links of each anchor, never all pairs; anchors with very many
fingerprints are compared by quarters of 16 bits, of which two that differ in 3 bits share one.

``groups`` serves larger distances too (a similarity of word shingles of 0.8 is about 20 of 128 bits): there the
anchors are points of random coordinate subspaces, each a covering code of radius 0 on its own coordinates, enough of
them that most pairs of that distance meet. Fingerprints only propose pairs there; each link is counted on the two
sets of shingles. A first round counts two pairs of every fingerprint, the nearest and one picked by a hash, which
ties a family of copies together without all its pairs; a second one compares all close fingerprints whose ends are
still apart, in blocks of documents with their sets, and returns only what ties two components. A pair that never meets at an anchor is missed, a pair below the similarity is never linked.

Nulls and empty texts: no shingle, fingerprint zero, linked like any other. A null doc_id takes part and is never the
smallest; a component of null ids only has a null component_id. Repeated rows count once each. Empty tables give empty
results. Extra columns are ignored. Very long texts are hashed in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, hot_above, join_hot, need, slices, small_batches, text_key
from .components import components

SEED = 42
#: The Golay code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GOLAY = 0b101011100011
BLOCK, INFO, RADIUS = 23, 12, 3
#: Shingles hashed at a time, and rows at one anchor that are compared by shifts.
PART, SHIFTED = 1 << 16, 3000
#: Random projections for larger distances: their number and bits.
PROJECTIONS, PROJECTED_BITS = 64, 16
#: Rows of a part of a cluster; two parts are compared at a time.
BLOCK_ROWS = 512
#: Sets are pairs of these: distinct shingles by 32 bits of their hash.
SET = np.dtype("<u4")


def shingle_bits(text: bytes, words: int, wide: bool = False, kept: list[np.ndarray] | None = None) -> np.ndarray:
    """The fingerprint of a text as 1 (64 bits) or 2 (128 bits) unsigned numbers. With kept, which gains the distinct shingles, a repeated shingle counts once."""
    lanes = 2 if wide else 1
    tokens = text.lower().split()
    found: list[np.ndarray] = []
    if not tokens:
        if kept is not None:
            kept.append(np.zeros(0, SET))
        return np.zeros(lanes, np.uint64)
    n = max(1, len(tokens) - words + 1)
    total = np.zeros(64 * lanes, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PART):
        part = tokens[at : min(at + PART, n) + words - 1]
        if len(part) <= words:
            shingles = [b" ".join(part)]
        else:
            # one joined text, cut at word borders
            joined = b" ".join(part)
            ends, pos = [], -1
            for t in part:
                pos += len(t) + 1
                ends.append(pos)
            starts = [0, *(e + 1 for e in ends[: len(part) - words])]
            shingles = [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=True)]
        hashes = [np.array([digest(s, seed) for s in shingles], np.uint64) for seed in (SEED, SEED + 1)[:lanes]]
        rows = np.stack(hashes, axis=1)
        if kept is not None:
            found.append(rows[np.unique(rows[:, 0], return_index=True)[1]])
            continue
        total += _sums(rows)
    if kept is not None:
        rows = np.concatenate(found)
        if len(found) > 1:
            rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
        kept.append(np.unique(rows[:, 0].astype(SET)))
        n = len(rows)
        for at in range(0, n, PART):
            total += _sums(rows[at : at + PART])
    return np.packbits(2 * total > n, bitorder="little").view("<u8")


def _sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (n, lanes) have each bit."""
    return np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (long, the 64 bits)."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = np.concatenate([shingle_bits(t, words) for t in texts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp and fp2 (the 128 bits of the distinct shingles), shingles (binary: the distinct ones, ascending), node, a hash of these, and text_h1 and text_h2, hashes of the text."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            kept: list[np.ndarray] = []
            found = np.stack([shingle_bits(t, words, True, kept) for t in texts]).view(np.int64)
            columns = [batch.column(0).cast(pa.int64()), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array([k.tobytes() for k in kept], pa.binary())]
            columns.append(pa.array(np.array([xxhash.xxh64_intdigest(k.tobytes(), SEED) for k in kept], np.uint64).view(np.int64)))
            columns += [batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "fp2", "shingles", "node", "text_h1", "text_h2"])

    return docs.select("doc_id", "text", *text_key()).mapInArrow(run, "doc_id long, fp long, fp2 long, shingles binary, node long, text_h1 long, text_h2 long")


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns by which a point differs from the code's words near it: (starts by syndrome and excess, patterns, excesses).

    The patterns of syndrome s with an excess of at most e are patterns[starts[s, 0] : starts[s, e + 1]].
    """
    def syndrome(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(BLOCK - 1, 10, -1):
            v ^= np.where(v >> bit & 1, GOLAY << bit - 11, 0)
        return v

    single = 1 << np.arange(BLOCK)
    layers = [np.zeros(1, np.int64)]
    for _ in range(RADIUS + 2):
        grown = layers[-1][:, None] | single[None, :]
        highest = single[None, :] > layers[-1][:, None]  # each pattern once
        layers.append(grown[highest])
    patterns = np.concatenate(layers)
    excess = np.concatenate([np.full(len(x), max(0, w - RADIUS)) for w, x in enumerate(layers)])
    s = syndrome(patterns)
    order = np.lexsort((patterns, excess, s))
    patterns, excess, s = patterns[order], excess[order], s[order]
    starts = np.searchsorted(s * 4 + excess, np.arange(2048)[:, None] * 4 + np.arange(4)[None, :])
    table = syndrome(np.arange(1 << BLOCK, dtype=np.int64)).astype(np.int16)
    return starts, patterns, excess.astype(np.int64), table


def _spread(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, repeated by counts, and places from starts on."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[rows]


def anchors(fp: np.ndarray, blocks: int, most: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor within radius plus excess, summed over blocks, of at most most: row of fp, anchor, excess."""
    starts, patterns, excess, table = golay()
    rows, name, over = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    for k in range(blocks):
        point = (fp[rows] >> np.uint64(BLOCK * k) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
        s = table[point].astype(np.int64)
        again, place = _spread(starts[s, most - over + 1] - starts[s, 0], starts[s, 0])
        name = name[again] << INFO | (point[again] ^ patterns[place]) >> 11
        over = over[again] + excess[place]
        rows = rows[again]
    return rows, name, over


class Forest:
    """Union-find over rows by arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.parent[i], self.parent[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up


def compare(groups: np.ndarray, values: np.ndarray, over: np.ndarray | None, distance: int) -> Forest:
    """Links rows of one group (sorted) whose values (n, lanes) differ in at most distance bits; over: excesses, of which a pair's may not pass distance."""
    n = len(groups)
    forest = Forest(n)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    ends = np.repeat(first + sizes, sizes)

    def near(i: np.ndarray, j: np.ndarray) -> None:
        close = np.bitwise_count(values[i] ^ values[j]).sum(axis=1) <= distance
        if over is not None:
            close &= over[i] + over[j] <= distance
        forest.join(i[close], j[close])

    rows = np.flatnonzero(np.repeat(sizes <= SHIFTED, sizes))
    shift = 1
    while True:
        rows = rows[rows + shift < ends[rows]]
        if not len(rows):
            break
        near(rows, rows + shift)
        shift += 1
    for k in np.flatnonzero(sizes > SHIFTED):
        own = np.arange(first[k], first[k] + sizes[k])
        parts = distance + 1
        width = 64 * values.shape[1] // parts
        for p in range(parts):  # two rows agree on one part at least
            bits = np.unpackbits(values[own].view(np.uint8), axis=1, bitorder="little")[:, p * width : (p + 1) * width if p + 1 < parts else None]
            key = np.packbits(bits, axis=1)
            key = np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel()
            order = np.argsort(key, kind="stable")
            own_sorted, key = own[order], key[order]
            begins = np.concatenate([[True], key[1:] != key[:-1]])
            runs = np.append(np.flatnonzero(begins), len(own))
            stop = np.repeat(runs[1:], np.diff(runs))
            left, shift = np.arange(len(own)), 1
            while len(left := left[left + shift < stop[left]]):
                near(own_sorted[left], own_sorted[left + shift])
                shift += 1
    return forest


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, at_once: int = 1 << 19) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < at_once:
            continue
        table = pa.Table.from_batches(held)
        k = table.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield table.slice(0, cut)
            held, count = table.slice(cut).to_batches(), len(k) - cut
        else:
            at_once = 2 * count
    if held and count:
        yield pa.Table.from_batches(held)


def _links(dealt: DataFrame, distance: int) -> DataFrame:
    """dealt: anchor, node, fp, over. Links (a, b) of nodes: a spanning forest for each anchor."""
    spark = dealt.sparkSession
    spread = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "anchor"):
            values = table.column("fp").to_numpy().view(np.uint64)[:, None]
            forest = compare(table.column("anchor").to_numpy(), values, table.column("over").to_numpy().astype(np.int64), distance)
            hung = np.flatnonzero(forest.parent != np.arange(len(values)))
            node = table.column("node").to_numpy()
            pairs = np.unique(np.stack([node[hung], node[forest.parent[hung]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return spread.mapInArrow(run, "a long, b long")


def _deal(nodes: DataFrame) -> DataFrame:
    """Replicates rows (node, fp) to their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows, name, over = anchors(part.column(1).to_numpy().view(np.uint64), 2)
                take = pa.array(rows)
                columns = [pa.array(name), part.column(0).take(take), part.column(1).take(take), pa.array(over.astype(np.int8))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "node", "fp", "over"])

    return nodes.select("node", "fp").mapInArrow(run, "anchor long, node long, fp long, over byte")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id; fingerprints link at 3 or fewer differing bits."""
    staging = Staging(docs.sparkSession, "simhash")
    marked = staging.write(fingerprints(docs, words), "fingerprints")
    # a fingerprint's own name: the 64 bits themselves
    distinct = staging.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).select("fp", "least", "n", F.col("fp").alias("node")), "distinct")
    named = _named(distinct, _links(_deal(distinct), 3), staging)
    hot = hot_above(docs.sparkSession, distinct.agg(F.sum("n")).first()[0] or 0)
    out = join_hot(marked, named.select("fp", "component_id", "n"), ["fp"], hot)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(distinct: DataFrame, links: DataFrame, staging: Staging) -> DataFrame:
    """distinct (node, least, others) with component_id, the smallest doc_id linked through any chain."""
    roots = components(links, staging)
    # of what has links, the smallest doc_id of every root
    named = roots.join(distinct.select("node", "least"), "node")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(smallest, "root").select("node", "component_id")
    return distinct.join(linked, "node", "left").withColumn("component_id", F.coalesce("component_id", "least"))


@lru_cache
def coordinates() -> np.ndarray:
    """The sampled coordinates of each projection."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(128, PROJECTED_BITS, replace=False) for _ in range(PROJECTIONS)])


def by_projection(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every row (n, 2) in every projection: row, anchor."""
    bits = np.unpackbits(values.view(np.uint8), axis=1, bitorder="little").astype(np.int32)
    weight = (1 << np.arange(PROJECTED_BITS)).astype(np.int32)
    names = np.stack([bits[:, c] @ weight + (k << PROJECTED_BITS) for k, c in enumerate(coordinates())], axis=1)
    return np.repeat(np.arange(len(values)), PROJECTIONS), names.ravel().astype(np.int32)


def _pick(values: np.ndarray) -> np.ndarray:
    """A hash of each row (n, lanes) of unsigned numbers."""
    x = values[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ values[:, 1]
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def close_pairs(groups: np.ndarray, values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, differing bits) of one group (sorted) that differ in at most distance bits, one shift of the rows at a time."""
    n = len(groups)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    rows, shift = np.arange(n), 1
    while len(rows := rows[rows + shift < ends[rows]]):
        differ = np.bitwise_count(values[rows] ^ values[rows + shift]).sum(axis=1)
        close = differ <= distance
        if close.any():
            yield rows[close], rows[close] + shift, differ[close].astype(np.int64)
        shift += 1


def _met(nodes: DataFrame, *names: str) -> DataFrame:
    """nodes, replicated to their anchors of all projections, sorted by anchor."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows, name = by_projection(np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(name), *(part.column(k).take(pa.array(rows)) for k in range(len(names)))], names=["anchor", *names])

    dealt = nodes.select(*names).mapInArrow(deal, "anchor int, " + ", ".join(f"{x} long" for x in names))
    return dealt.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor").sortWithinPartitions("anchor")


def _bits(table: pa.Table) -> np.ndarray:
    return np.stack([table.column("fp").to_numpy(), table.column("fp2").to_numpy()], axis=1).view(np.uint64)


def _proposed(nodes: DataFrame, distance: int) -> DataFrame:
    """nodes: fp, fp2, node. Pairs (a, b, differ, pick) of close nodes: for each node at each anchor the nearest and one by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "anchor"):
            bits = _bits(table)
            node, none = table.column("node").to_numpy(), np.uint64(2**64 - 1)
            pick_of = lambda i, j: _pick(np.stack([(node[i] ^ node[j]).view(np.uint64), bits[i, 0] ^ bits[j, 0]], axis=1))  # noqa: E731, B023
            nearest, picked = np.full(len(bits), none), np.full(len(bits), none)
            for i, j, differ in close_pairs(table.column("anchor").to_numpy(), bits, distance):
                # both ends of a pair see the same hash, whichever comes first
                chance = pick_of(i, j) >> np.uint64(32) << np.uint64(32)
                # of equally near ones the pick, too, so that no node is everyone's nearest
                near = differ.astype(np.uint64) << np.uint64(56) | chance >> np.uint64(8) & ~np.uint64(2**32 - 1)
                for x, y in ((i, j), (j, i)):
                    nearest[x] = np.minimum(nearest[x], near | y.astype(np.uint64))
                    picked[x] = np.minimum(picked[x], chance | y.astype(np.uint64))
            for best in (nearest, picked):
                i = np.flatnonzero(best != none)
                j = (best[i] & np.uint64(2**32 - 1)).astype(np.int64)
                differ, pick = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1).astype(np.int64), pick_of(i, j).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(differ), pa.array(pick)], names=["a", "b", "differ", "pick"])

    return _met(nodes, "fp", "fp2", "node").mapInArrow(run, "a long, b long, differ long, pick long")


def first_meeting(projection: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Whether pairs, whose differing bits (n, 2) are given, meet in no projection before this one."""
    masks = np.zeros((PROJECTIONS, 2), np.uint64)
    for k, chosen in enumerate(coordinates()):
        for c in chosen:
            masks[k, c // 64] |= np.uint64(1) << np.uint64(c % 64)
    out = np.ones(len(projection), bool)
    for k, mask in enumerate(masks):
        out &= (projection <= k) | (differing & mask).any(axis=1)
    return out


def blocks_of(cluster: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, low and high: clusters (sorted) in parts of at most most rows, each row with every two parts of which one is its own."""
    first = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])) if len(cluster) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(cluster)))
    part = (np.arange(len(cluster)) - np.repeat(first, sizes)) // most
    parts = np.repeat(-(-sizes // most), sizes)
    rows, other = _spread(np.maximum(parts - 1, 1), np.zeros(len(cluster), np.int64))
    own = part[rows]
    other = np.where(parts[rows] > 1, other + (other >= own), own)
    return rows, np.minimum(own, other), np.maximum(own, other)


def _apart(nodes: DataFrame, sets: DataFrame, distance: int, similarity: float) -> DataFrame:
    """nodes: fp, fp2, node, root. Links (a, b) that tie roots together, of all pairs of close nodes with different roots.

    A task of anchors does not return pairs but the nodes that have any, by clusters of close ones in blocks; the tasks
    of blocks get the nodes with their sets, count the pairs and return only links that tie two roots for the first time.
    """
    spark = nodes.sparkSession

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "anchor"):
            bits, node, root, anchor = _bits(table), *(table.column(x).to_numpy() for x in ("node", "root", "anchor"))
            forest, has = Forest(len(root)), np.zeros(len(root), bool)
            for i, j, _ in close_pairs(anchor, bits, distance):
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                apart = first_meeting(anchor[i] >> PROJECTED_BITS, bits[i] ^ bits[j])
                i, j = i[apart], j[apart]
                has[i] = has[j] = True
                forest.join(i, j)
            own = np.flatnonzero(has)
            own = own[np.argsort(forest.parent[own], kind="stable")]
            rows, low, high = blocks_of(forest.parent[own], BLOCK_ROWS)
            own = own[rows]
            top = np.stack([node[forest.parent[own]].view(np.uint64) ^ anchor[own].astype(np.uint64), low.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64)], axis=1)
            values = bits[own].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_pick(top).view(np.int64)), pa.array(values[:, 0].copy()), pa.array(values[:, 1].copy()), pa.array(node[own]), pa.array(root[own])], names=["block", "fp", "fp2", "node", "root"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "block", BLOCK_ROWS):
            bits, root, node = _bits(table), table.column("root").to_numpy(), table.column("node").to_numpy()
            shingles = [np.frombuffer(x, SET) for x in table.column("shingles").to_pylist()]
            _, tied = np.unique(root, return_inverse=True)  # roots, and below which of them are tied by now
            forest, found = Forest(int(tied.max(initial=-1)) + 1), []
            for i, j, _ in close_pairs(table.column("block").to_numpy(), bits, distance):
                apart = forest.parent[tied[i]] != forest.parent[tied[j]]
                linked = [(x, y) for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True) if similar(shingles[x], shingles[y], similarity)]
                if linked:
                    ends = np.array(linked)
                    forest.join(tied[ends[:, 0]], tied[ends[:, 1]])
                    found.append(node[ends])
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    blocks = _met(nodes, "fp", "fp2", "node", "root").mapInArrow(cluster, "block long, fp long, fp2 long, node long, root long")
    wide = blocks.join(sets, "node")
    wide = wide.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")
    return wide.mapInArrow(count, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets of distinct shingles are at least so similar (Jaccard)."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _counted(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with their sets' similarity (Jaccard) of at least similarity; sets: node, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(similar(*(np.frombuffer(v.as_buffer(), SET) for v in (x, y)), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, staging: Staging, words: int, similarity: float, slack: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of documents with their node, the nodes (node, least, first), and links (a, b) of nodes with a similarity (Jaccard) of distinct word shingles as asked.

    128-bit fingerprints propose pairs within the expected distance of that similarity plus slack deviations: sets of
    Jaccard similarity s have a cosine of 2s / (1 + s), and each bit differs with the probability of its angle over pi.
    """
    chance = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    distance = int(128 * chance + slack * np.sqrt(128 * chance * (1 - chance)))
    marked = staging.write(shingle_sets(docs, words), "fingerprints")
    # texts with the same set are one node; equal fingerprints of different sets are two, compared like any others
    prints = F.min(F.struct("fp", "fp2"))
    distinct = staging.write(marked.groupBy("node").agg(prints["fp"].alias("fp"), prints["fp2"].alias("fp2"), F.min("doc_id").alias("least"), F.min(_row()).alias("first")), "distinct")
    both = staging.write(_proposed(distinct, distance), "proposed")
    ends = both.select(F.col("a").alias("node"), "differ", "pick", F.col("b").alias("other"))
    best = ends.groupBy("node").agg(F.min_by("other", F.struct("differ", "pick", "other")).alias("near"), F.min_by("other", F.struct("pick", "other")).alias("some"))
    first = best.select(F.col("node").alias("a"), F.explode(F.array("near", "some")).alias("b"))
    first = staging.write(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # only what has a partner is compared any further
    active = best.select("node")
    sets = staging.write(marked.groupBy("node").agg(F.first("shingles").alias("shingles")).join(active, "node"), "sets")
    links = staging.write(_counted(first, sets, similarity), "links")
    roots = components(links, staging)
    apart = distinct.join(active, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = staging.write(links.union(_apart(apart, sets, distance, similarity)), "links")
    return marked, distinct, links


def _row() -> Column:
    """A document, by id and text: in order of ids, null last, then of hashes of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_h1", "text_h2")


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, slack: float = 2.2) -> DataFrame:
    """doc_id and component_id of documents linked by a similarity (Jaccard) of their distinct word shingles as asked."""
    staging = Staging(docs.sparkSession, "simhash")
    marked, distinct, links = _linked(docs, staging, words, similarity, slack)
    named = _named(distinct, links, staging)
    return marked.select("doc_id", "node").join(named.select("node", "component_id"), "node").select("doc_id", "component_id")


def survivors(docs: DataFrame, words: int = 5, similarity: float = 0.8, slack: float = 2.2) -> DataFrame:
    """One row of docs, all columns kept, of each group as in ``groups``: that with the smallest doc_id, then hash of the text.

    A document is a pair of doc_id (null is an id like others, the last) and text; of its repeated rows any one stays.
    """
    staging = Staging(docs.sparkSession, "simhash")
    _, distinct, links = _linked(docs, staging, words, similarity, slack)
    roots = distinct.join(components(links, staging), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.*").alias("k")
    keyed = docs.withColumns(dict(zip(key := _unused(docs, "text_h1", "text_h2"), text_key(), strict=True))).dropDuplicates(["doc_id", *key]).alias("d")
    same = F.col("k.doc_id").eqNullSafe(F.col("d.doc_id"))
    for name, own in zip(("text_h1", "text_h2"), key, strict=True):
        same &= F.col(f"k.{name}") == F.col(f"d.{own}")
    return keyed.join(kept, same, "left_semi").select(*docs.columns)


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer where docs has them."""
    out = []
    for name in names:
        while name in docs.columns:
            name += "_"
        out.append(name)
    return out
