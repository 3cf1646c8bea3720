"""Token batches: corruption for masked modelling, packed and padded batches, orders by length, and what models give back.

Ids are arrays of int; a batch is one row, as large as its token budget. All choices are keyed hashes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60, key, uniform
from ..functions.sequences import let, log_softmax
from .curriculum import pack_batches
from .ranges import numbered

#: Fixed value: the label of what is not to be predicted.
IGNORED = -100
#: Length-grouped order: so many batches are sorted together, at most.
MEGA, MOST_MEGA = 4, 50


def beta_quantiles(a: float, b: float, steps: int = 512) -> list[float]:
    """Quantiles of the Beta distribution at 0, 1 / steps, ..., 1, from its density on a fine grid."""
    x = (np.arange(1 << 16) + 0.5) / (1 << 16)
    log_density = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    total = np.cumsum(np.exp(log_density - log_density.max()))
    return np.interp(np.arange(steps + 1) / steps, np.concatenate([[0], total / total[-1]]), np.arange((1 << 16) + 1) / (1 << 16)).tolist()


def corruption_rate(identity: Column, seed: str, kind: str = "fixed", rate: float = 0.15, concentration: float = 10.0) -> Column:
    """A sequence's masking rate: `fixed`; `cosine`, rate (1 - cos(t pi / 2)) of a uniform t; `beta` with mean rate and a = rate x concentration."""
    t = uniform(key(seed, "rate", identity))
    if kind == "fixed":
        return F.lit(float(rate))
    if kind == "cosine":
        return F.lit(float(rate)) * (1 - F.cos(t * math.pi / 2))
    if kind == "beta":
        q = beta_quantiles(rate * concentration, (1 - rate) * concentration)
        between = lambda place, low: F.get(F.array(*map(F.lit, q)), low) * (1 - place + low) + F.get(F.array(*map(F.lit, q)), low + 1) * (place - low)
        return let(t * (len(q) - 1), lambda place: between(place, F.floor(place).cast("int")))
    raise ValueError(f"no such masking: {kind}")


def corrupted(table: DataFrame, identity: str, ids: str, mask_id: int, special: list[int], seed: str, **rate) -> DataFrame:
    """table with input_ids (masked) and labels (IGNORED where not masked). Special ids are never masked; of a sequence that has others, at least one is."""
    who = F.col(identity).cast("string")
    marked = lambda r: F.transform(ids, lambda x, i: F.struct(i.alias("i"), (~x.isin(*special) if special else F.lit(True)).alias("free"), (uniform(F.concat_ws("|", F.lit(seed), who, i.cast("string"))) < r).alias("hit")))
    out = table.withColumn("_p", let(corruption_rate(F.col(identity), seed, **rate), marked)).withColumn("_free", F.transform(F.filter("_p", lambda p: p["free"]), lambda p: p["i"]))
    hits = F.transform(F.filter("_p", lambda p: p["free"] & p["hit"]), lambda p: p["i"])
    one = F.when(F.size("_free") > 0, F.array(F.get("_free", (h60(key(seed, "one", F.col(identity))) % F.size("_free")).cast("int")))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_hits", hits).withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(one))
    masked = lambda then, other: F.transform(ids, lambda x, i: F.when(F.array_contains("_hits", i), then(x)).otherwise(other(x)))
    out = out.withColumn("input_ids", masked(lambda x: F.lit(mask_id), lambda x: x)).withColumn("labels", masked(lambda x: x, lambda x: F.lit(IGNORED)))
    return out.drop("_p", "_free", "_hits")


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name]).alias(name)


def gathered(table: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """One row a batch with the columns of its rows as arrays in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order))))  # one batch
    return table.groupBy(batch).agg(rows.alias("_r")).select(batch, *(_field("_r", c) for c in columns))


def packed(table: DataFrame, batch: str, order: str, ids: str, pad_id: int = 0, multiple: int = 1, labels: str | None = None) -> DataFrame:
    """One row a batch: input_ids of all its sequences in a row, position_ids, cu_seqlens (borders; the padding is a last segment of its own), max_seqlen, num_sequences, num_tokens, and labels if there are any."""
    g = gathered(table, batch, order, ids, *([labels] if labels else []))
    lengths = F.transform(ids, lambda x: F.size(x))
    g = g.withColumn("_n", lengths).withColumn("num_tokens", F.aggregate("_n", F.lit(0), lambda a, x: a + x)).withColumn("_pad", F.pmod(-F.col("num_tokens"), F.lit(multiple)))
    borders = F.aggregate("_n", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    places = F.flatten(F.transform("_n", lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    fill = lambda c, value: F.concat(c, F.array_repeat(F.lit(value), F.col("_pad")))
    extra = [fill(F.flatten(labels), IGNORED).alias("labels")] if labels else []
    return g.select(
        batch, fill(F.flatten(ids), pad_id).alias("input_ids"), fill(places, 0).alias("position_ids"), F.concat(borders, F.array(F.col("num_tokens") + F.col("_pad"))).alias("cu_seqlens"),
        F.greatest(F.array_max("_n"), F.col("_pad")).alias("max_seqlen"), F.size("_n").alias("num_sequences"), "num_tokens", *extra,
    )


def padded(table: DataFrame, batch: str, order: str, ids: str, pad_id: int = 0, multiple: int = 1, labels: str | None = None) -> DataFrame:
    """One row a batch: input_ids, attention_mask and position_ids (and labels) as arrays of equal length, a multiple of `multiple`."""
    g = gathered(table, batch, order, ids, *([labels] if labels else []))
    most = F.array_max(F.transform(ids, lambda x: F.size(x)))
    g = g.withColumn("_m", most + F.pmod(-most, F.lit(multiple)))
    fill = lambda x, value: F.concat(x, F.array_repeat(F.lit(value), F.col("_m") - F.size(x)))
    mask = F.transform(ids, lambda x: fill(F.transform(x, lambda _: F.lit(1)), 0))
    places = F.transform(ids, lambda x: fill(F.transform(x, lambda _, i: i), 0))
    extra = [F.transform(labels, lambda x: fill(x, IGNORED)).alias("labels")] if labels else []
    return g.select(batch, F.transform(ids, lambda x: fill(x, pad_id)).alias("input_ids"), mask.alias("attention_mask"), places.alias("position_ids"), *extra)


def unpacked(batches: DataFrame, batch: str, ids: str = "input_ids", borders: str = "cu_seqlens", count: str = "num_sequences") -> DataFrame:
    """(batch, place, ids): the sequences of packed rows, without the padding."""
    cut = F.transform(F.sequence(F.lit(1), F.col(count)), lambda i: F.slice(ids, F.get(borders, i - 1) + 1, F.get(borders, i) - F.get(borders, i - 1)))
    return batches.filter(F.col(count) > 0).select(batch, F.posexplode(cut).alias("place", "ids"))


def evaluation_batches(rows: DataFrame, partition: str, order: str, length: str, budget: int, seed: str | None = None) -> DataFrame:
    """batch of every row as in ``pack_batches``, cost being the length itself; with a seed, `turn` says when a batch's turn comes in the shuffled order."""
    out = pack_batches(rows, partition, order, length, budget, extra=0)
    return out if seed is None else out.withColumn("turn", h60(key(seed, F.col(partition), F.col("batch"))))


def even_batches(batches: DataFrame, batch: str, processes: int) -> DataFrame:
    """Batches numbered from 0 without the last ones, so that every process gets as many."""
    total = batches.agg((F.floor((F.coalesce(F.max(batch), F.lit(-1)) + 1) / processes) * processes).alias("_most"))  # one row
    return batches.join(F.broadcast(total)).filter(F.col(batch) < F.col("_most")).drop("_most")


def remaining(batches: DataFrame, batch: str, consumed: int) -> DataFrame:
    """What is left of an epoch of which `consumed` batches have been used."""
    return batches.filter(F.col(batch) >= consumed)


def length_grouped(rows: DataFrame, id_column: str, length: str, batch_size: int, seed: str | None) -> DataFrame:
    """place (from 0) of every row such that neighbours have like lengths.

    With a seed: rows in hash order form runs of min(n // (4 batch_size), 50) batches (all rows where that is none),
    each run by falling length, and the longest row of all changes places with the first one. Without: by falling length.
    """
    if seed is None:
        return numbered(rows.withColumn("_l", -F.col(length)), ["_l", id_column], "place").drop("_l")
    n = rows.count()
    run = batch_size * (min(n // (batch_size * MEGA), MOST_MEGA) or max(1, -(-n // batch_size)))
    dealt = numbered(rows.withColumn("_h", h60(key(seed, F.col(id_column)))), ["_h", id_column], "_n").withColumn("_run", F.floor(F.col("_n") / run))
    within = Window.partitionBy("_run").orderBy(F.desc(length), "_n")
    placed = dealt.withColumn("place", F.col("_run") * run + F.row_number().over(within) - 1)
    top = placed.agg(F.min(F.struct((-F.col(length)).alias("l"), "place"))["place"].alias("_top"))  # one row
    swapped = F.when(F.col("place") == F.col("_top"), F.lit(0)).when(F.col("place") == 0, F.col("_top")).otherwise(F.col("place"))
    return placed.join(F.broadcast(top)).withColumn("place", swapped.cast("long")).drop("_h", "_n", "_run", "_top")


def balanced(sizes: list[int], buckets: int) -> list[int]:
    """The bucket of every shard: largest first into the least loaded bucket, of equals the first. Shards are few; rows are never dealt by this."""
    out, queue = [0] * len(sizes), [(0, b) for b in range(buckets)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, b = heapq.heappop(queue)
        out[i] = b
        heapq.heappush(queue, (load + sizes[i], b))
    return out


def crop_start(length: Column, size: int, identity: Column, seed: str) -> Column:
    """Start of an example's window of a size, the same whenever it is asked for; 0 where the example fits."""
    return F.when(length <= size, F.lit(0)).otherwise(h60(key(seed, identity)) % (length - size + 1)).cast("int")


def cropped(table: DataFrame, identity: str, residues: str, size: int, seed: str, bos: int, eos: int, labels: str | None = None) -> DataFrame:
    """input_ids of the window between begin and end marks, original_positions (-1 at the marks) and the labels of the window."""
    start = crop_start(F.size(residues), size, F.col(identity), seed)
    t = table.withColumn("_s", start).withColumn("_w", F.slice(residues, F.col("_s") + 1, F.lit(size)))
    ids = F.concat(F.array(F.lit(bos)), F.col("_w"), F.array(F.lit(eos)))
    places = F.concat(F.array(F.lit(-1)), F.transform("_w", lambda _, i: i + F.col("_s")), F.array(F.lit(-1)))
    t = t.withColumn("input_ids", ids).withColumn("original_positions", places)
    if labels:
        t = t.withColumn("labels", F.concat(F.array(F.lit(IGNORED)), F.slice(labels, F.col("_s") + 1, F.lit(size)), F.array(F.lit(IGNORED))))
    return t.drop("_s", "_w")


def without(ids: Column, unwanted: list[int]) -> Column:
    return F.filter(ids, lambda x: ~x.isin(*unwanted)) if unwanted else ids


def position_ids(ids: Column) -> Column:
    return F.transform(ids, lambda _, i: i)


def scrambled(ids: Column, special: list[int], identity: Column, seed: str) -> Column:
    """Ids with all but the special ones and the first other one in hash order; those stay where they are."""
    def moved(marked: Column) -> Column:
        free = F.filter(marked, lambda m: m["free"])
        rest = F.slice(free, 2, 1 << 30)
        keyed = F.transform(rest, lambda m: F.struct(h60(F.concat_ws("|", F.lit(seed), identity.cast("string"), m["i"].cast("string"))).alias("h"), m["x"].alias("x")))
        dealt = F.zip_with(rest, F.array_sort(keyed), lambda m, o: F.struct(m["i"].alias("i"), o["x"].alias("x")))
        fixed = F.transform(F.concat(F.filter(marked, lambda m: ~m["free"]), F.slice(free, 1, 1)), lambda m: F.struct(m["i"].alias("i"), m["x"].alias("x")))
        return F.transform(F.array_sort(F.concat(fixed, dealt)), lambda m: m["x"])

    return let(F.transform(ids, lambda x, i: F.struct(i.alias("i"), x.alias("x"), (~x.isin(*special) if special else F.lit(True)).alias("free"))), moved)


def decoded(ids: Column, vocabulary: dict[str, int], special: list[int]) -> Column:
    """The sequence of token ids, special ones left out; an id that no token has is an error."""
    table = F.create_map(*(F.lit(x) for token, i in vocabulary.items() for x in (i, token)))
    token = lambda x: F.coalesce(F.element_at(table, x), F.raise_error(F.concat(F.lit("no such token: "), x.cast("string"))).cast("string"))
    return F.array_join(F.transform(without(ids, special), token), "")


def valid_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != IGNORED)


def scored_positions(original: Column, labels: Column) -> Column:
    """Original positions that have a label: neither a mark's nor ignored."""
    return F.transform(F.filter(F.arrays_zip(original.alias("p"), labels.alias("y")), lambda z: (z["p"] >= 0) & (z["y"] != IGNORED)), lambda z: z["p"])


def padded_to(values: Column, size: int, fill: object) -> Column:
    """Values filled up to a size, as rows have to be before they are gathered from several processes."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def token_rows(table: DataFrame, id_column: str, predictions: str, labels: str) -> DataFrame:
    """(id, place, prediction, label) of every token that has a label."""
    zipped = F.arrays_zip(F.col(predictions).alias("p"), F.col(labels).alias("y"))
    return table.select(id_column, F.posexplode(zipped).alias("place", "z")).filter(F.col("z.y") != IGNORED).select(id_column, "place", F.col("z.p").alias("prediction"), F.col("z.y").alias("label"))


def argmax(logits: Column) -> Column:
    """Place of the largest logit, of equals the first."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def decided(logits: Column) -> Column:
    """0 or 1 for every logit: whether its sigmoid is above one half."""
    return F.transform(logits, lambda x: (1 / (1 + F.exp(-x)) > 0.5).cast("int"))


def target_log_prob(logits: Column, target: Column) -> Column:
    """Log-probability of the target's place."""
    return F.get(log_softmax(logits), target)


def residue_logits(logits: Column, residue_ids: list[int]) -> Column:
    """The logits of the residues, in their order."""
    return F.array(*(F.get(logits, F.lit(i)) for i in residue_ids))


def residue_ids(vocabulary: dict[str, int], unknown: int, residues: str) -> list[int]:
    """Token ids of the residues, all of them known and different."""
    ids = [vocabulary.get(r, unknown) for r in residues]
    if unknown in ids or len(set(ids)) != len(residues):
        raise ValueError("residues without a token of their own")
    return ids


def checked_vocabulary(vocabulary: dict[str, int], size: int, named: dict[str, str]) -> dict[str, int]:
    """Ids of named tokens (role to token); an error where one is missing, ids are not 0 to size - 1, or two roles share one."""
    if sorted(vocabulary.values()) != list(range(size)):
        raise ValueError(f"ids are not 0 to {size - 1}")
    if missing := sorted(t for t in named.values() if t not in vocabulary):
        raise ValueError(f"tokens are missing: {', '.join(missing)}")
    if len(set(named.values())) != len(named):
        raise ValueError("named tokens have to differ")
    return {role: vocabulary[t] for role, t in named.items()}
