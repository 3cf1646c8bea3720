"""Line dedup by range-partitioned hashes.

Every line's key (stripped of ASCII white space, A-Z lower-cased) becomes a 128-bit hash. Rows of hash, document and
position are range-partitioned and sorted by all of these, so a very frequent line is spread over neighbouring tasks by
document. Each task streams its rows once, with a few batches of state, and tells which positions go. Only the first and
the last key of a task can go on in another one; their rows are counted together afterwards, and what comes of these
keys, at most two a task, is broadcast to them. Per document, the lines that go become one compressed bitmap; texts are
not shuffled but for the join with it.

Policies: ``first`` keeps a key's first occurrence (smallest document, then position), ``shared`` drops all lines whose
key is found in at least min_docs documents, ``shared_but_first`` drops these but for the key's first occurrence.

A document is a distinct pair of doc_id and text; its copies in repeated rows share one bitmap. Null or empty texts are
one empty line. Empty keys stay. A null doc_id is an id like others, the smallest. Very long texts are read whole, a
text at a time. Empty tables give empty results. Extra columns are kept by ``apply``, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, need, slices, small_batches

#: Batches of one key that a task holds before it settles what it can of them.
HELD = 16
ROWS = "h1 long, h2 long, has_id byte, id long, text_h long, pos int"


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row for each line whose key has at least min_chars code points; see ROWS."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            ids = batch.column(0).to_pylist()
            digests, owner, pos, hashes = [], [], [], []
            for k, text in enumerate(texts):
                hashes.append(xxhash.xxh64_intdigest(text, 42))
                for p, line in enumerate(text.split(b"\n")):
                    key = line.strip().lower()
                    if len(key) >= min_chars and (min_chars == 1 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(k)
                        pos.append(p)
            if not owner:
                continue
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner = np.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.array([x is not None for x in ids], np.int8)[owner]), pa.array(np.array([x or 0 for x in ids], np.int64)[owner]),
                    pa.array(np.array(hashes, np.uint64).view(np.int64)[owner]), pa.array(np.array(pos, np.int32)),
                ],
                names=[x.split()[0] for x in ROWS.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, first: bool, spare: bool = False) -> Iterator[pa.RecordBatch]:
    """Reads sorted rows. Yields rows that go for sure, and with open set those of the task's first and last key, which may
    go on in other tasks and so are decided on together."""
    columns = ["h1", "h2", "has_id", "id", "text_h", "pos"]
    kept: list[list[np.ndarray]] = []  # of the key that is still open
    seen_first = False

    def emit(rows: list[np.ndarray], open_: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(np.full(len(rows[0]), open_))], names=[*columns, "open"])

    def documents(rows: list[np.ndarray]) -> np.ndarray:
        """Whether a row begins another document of its key."""
        out = np.ones(len(rows[0]), bool)
        out[1:] = np.any([r[1:] != r[:-1] for r in rows[:5]], axis=0)
        return out

    def settle(rows: list[np.ndarray], begins: np.ndarray) -> pa.RecordBatch | None:
        """Whole groups that lie inside the task."""
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(begins)))
        if first:
            gone = ~begins
        else:
            counts = np.add.reduceat(documents(rows).astype(np.int64), starts)
            gone = np.repeat(counts >= min_docs, sizes)
        if first or spare:  # the first occurrence, which repeated rows of its document have too, stays
            gone &= np.any([r != np.repeat(r[starts], sizes) for r in rows[2:]], axis=0)
        return emit([r[gone] for r in rows], False) if gone.any() else None

    def open_group() -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
        if first:  # later rows of the key in this task go in any case; its first one depends on the task before
            later = np.any([r != r[0] for r in rows[2:]], axis=0)
            if later.any():
                yield emit([r[later] for r in rows], False)
            rows = [r[:1] for r in rows]
        yield emit(rows, True)

    def lighten() -> Iterator[pa.RecordBatch]:
        """Settles rows of a key that fills many batches; of these, kept holds on to what later rows depend on."""
        nonlocal kept
        rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
        stay = np.zeros(len(rows[0]), bool)
        if first:
            stay = np.all([r == r[0] for r in rows[2:]], axis=0)
        elif not seen_first:  # open whatever comes
            stay[-1] = True
        else:
            begin = np.flatnonzero(documents(rows))[:min_docs]
            if len(begin) < min_docs:
                return
            stay[begin] = True
            if spare:  # rows like the first one stay with it
                stay |= np.all([r == r[0] for r in rows[2:]], axis=0)
        yield emit([r[~stay] for r in rows], not first and not seen_first)
        kept = [[r[stay] for r in rows]]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
        begins = np.ones(len(rows[0]), bool)
        begins[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        if kept and kept[-1][0][-1] == rows[0][0] and kept[-1][1][-1] == rows[1][0]:
            begins[0] = False
        starts = np.flatnonzero(begins)
        if not len(starts):
            kept.append(rows)
            if len(kept) > HELD:
                yield from lighten()
            continue
        if kept:
            kept.append([r[: starts[0]] for r in rows])
            if not seen_first:
                yield from open_group()
                seen_first = True
            else:
                whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
                marks = np.zeros(len(whole[0]), bool)
                marks[0] = True
                if (out := settle(whole, marks)) is not None:
                    yield out
        kept = []
        from_ = starts[0]
        if not seen_first and len(starts) > 1:  # the task's first key ended within its first batch
            kept = [[r[starts[0] : starts[1]] for r in rows]]
            yield from open_group()
            seen_first, from_ = True, starts[1]
        inner = [r[from_ : starts[-1]] for r in rows]
        if len(inner[0]) and (out := settle(inner, begins[from_ : starts[-1]])) is not None:
            yield out
        kept = [[r[starts[-1] :] for r in rows]]
    if kept:
        yield from open_group()


def bitmaps(docs: DataFrame, policy: str = "shared", min_docs: int = 10, min_chars: int = 1, staging: Staging | None = None) -> DataFrame:
    """(has_id, id, text_h, dropped binary): for each document that loses lines, a zlib-compressed bitmap of them up to the last one."""
    if policy not in ("shared", "first", "shared_but_first"):
        raise ValueError(f"no such policy: {policy}")
    first, spare = policy == "first", policy == "shared_but_first"
    spark = docs.sparkSession
    staging = staging or Staging(spark, "lines")
    # the range bounds are sampled from the staged rows, so texts are read once for this
    rows = staging.write(line_rows(docs, min_chars), "rows")
    order = ["h1", "h2", "has_id", "id", "text_h", "pos"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # repeated rows of a document say the same thing
    found = staging.write(dealt.mapInArrow(lambda b: _stream(b, min_docs, first, spare), f"{ROWS}, open boolean"), "found")
    key = ["h1", "h2"]
    # the open keys are the first and the last one of each task, so what is told of them may be broadcast
    opened = found.filter("open")
    settled = found.filter("not open").select("has_id", "id", "text_h", "pos")
    if first:
        kept = opened.groupBy(*key).agg(F.min(F.struct("has_id", "id", "text_h", "pos")).alias("kept"))  # the first over all tasks
        late = opened.join(F.broadcast(kept), key).filter("struct(has_id, id, text_h, pos) <> kept")
    else:
        frequent = opened.select(*key, "has_id", "id", "text_h").distinct().groupBy(*key).count().filter(F.col("count") >= min_docs)
        late = opened.join(F.broadcast(frequent.select(*key)), key)
        if spare:
            kept = opened.groupBy(*key).agg(F.min(F.struct("has_id", "id", "text_h", "pos")).alias("kept"))
            late = late.join(F.broadcast(kept), key).filter("struct(has_id, id, text_h, pos) <> kept")
    gone = settled.union(late.select("has_id", "id", "text_h", "pos"))

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for positions in batch.column(3):
                places = positions.values.to_numpy()
                marks = np.zeros(int(places.max()) + 1, np.uint8)
                marks[places] = 1
                out.append(zlib.compress(np.packbits(marks).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out, pa.binary())], names=["has_id", "id", "text_h", "dropped"])

    lists = gone.groupBy("has_id", "id", "text_h").agg(F.collect_list("pos").alias("positions"))  # one document's lines at most, times its repeats
    return lists.mapInArrow(bitmap, "has_id byte, id long, text_h long, dropped binary")


def marks_of(dropped: bytes | None, lines: int) -> np.ndarray:
    """Which of a text's lines go."""
    out = np.zeros(lines, bool)
    if dropped:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))[:lines].astype(bool)
        out[: len(bits)] = bits
    return out


def with_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """docs with their bitmap (null: nothing goes) in a column of a name they do not use."""
    name = "dropped"
    while name in docs.columns:
        name += "_"
    t = F.coalesce(docs["text"], F.lit(""))
    condition = (F.col("m.has_id") == docs["doc_id"].isNotNull().cast("byte")) & (F.col("m.id") == F.coalesce(docs["doc_id"], F.lit(0)).cast("long")) & (F.col("m.text_h") == F.xxhash64(t))
    return docs.join(maps.alias("m"), condition, "left").select(*(docs[c] for c in docs.columns), F.col("m.dropped").alias(name))


def apply(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """docs without the lines that their bitmaps drop, all columns kept; n_chars, where there is one, follows the text. A null text stays null."""
    joined = with_bitmaps(docs, maps)
    name = joined.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for k, dropped in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if dropped:
                    lines = texts[k].split("\n")
                    texts[k] = "\n".join(x for x, m in zip(lines, marks_of(dropped, len(lines)).tolist(), strict=True) if not m)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, columns[at].type)
            for k in range(len(columns)):
                if batch.schema.names[k] == "n_chars":
                    columns[k] = pa.array([None if t is None else len(t) for t in texts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the hash of the lines that stay, joined by line feeds."""
    maps = bitmaps(docs, "shared", min_docs, min_chars)
    joined = with_bitmaps(docs.select("doc_id", "text"), maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows = []
            for text, dropped in zip(texts, batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                if dropped:
                    gone = marks_of(dropped, len(lines))
                    kept = b"\n".join(x for x, m in zip(lines, gone.tolist(), strict=True) if not m)
                    rows.append((len(lines), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                else:
                    rows.append((len(lines), 0, hashlib.sha256(text).hexdigest()))
            n_lines, n_dropped, hashes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(hashes)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            )

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
