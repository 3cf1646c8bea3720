"""Harmonic packing of token sequences.

What a document's ids leave after full sequences belongs to the class k of the reciprocal of its length: more than
capacity / (k + 1) and at most capacity / k ids. A bin of class k takes k such rests, the fixed count of its class, and
what it then still lacks is cut from the front of rests that come later, before these go to their own classes. So there
is at most one cut a bin, no piece shorter than MIN_PIECE but a document's own tail, and a bin is left short by less
than MIN_PIECE only. Rests that are smaller than all gaps go into a gap whole where many bins wait.

Every task fills the bins of its own documents, so nothing is shuffled and a task holds only rests that wait, at most k
for each class and MOST_WAITING gaps. At its end it lets the remaining rests run through the gaps and on into
full sequences; the last one is cut into sequences of a power of two each, the other length that needs no padding.

Bins are named by task and number, so a task that is run again after a loss gives the same names as long as it reads
the same rows in the same order, which scans of files do. Numbers may have holes.

Nulls: a null text is an empty one, a null doc_id stays null. An empty text is its end id alone. Very long texts are
full sequences and one rest. Repeated rows are packed once each. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import need, slices, small_batches
from .tokens import text_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences that one task can name.
TASK_SEQUENCES = 1 << 40


#: Ids that a cut leaves on both sides, and a gap that is not worth one.
MIN_PIECE = 8
#: Bins of a task that wait for cuts before rests go into them whole.
MOST_WAITING = 64


@dataclass
class Piece:
    """Ids of a document (little-endian, 32 bits) from start on; total: how many it has in all."""

    doc_id: int | None
    start: int
    ids: memoryview
    total: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.total), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.total)


class Packer:
    """Bins of one task. ``add`` and ``finish`` put settled rows (see SCHEMA) into ``rows``."""

    def __init__(self, capacity: int, first: int):
        if capacity & (capacity - 1):
            raise ValueError("the capacity has to be a power of two")
        self.capacity, self.next = capacity, first
        self.classes: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, int, list[Piece]]] = []  # (ids that a bin lacks, the bin, its pieces), sorted
        self.rows: list[tuple] = []

    def settle(self, pieces: list[Piece], into: int | None = None) -> None:
        """Rows of a bin, a new one if it has no number yet."""
        if into is None:
            into, self.next = self.next, self.next + 1
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p), crc32(p.ids), p.total, into, offset))
            offset += len(p)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian 32-bit, the end id included."""
        n = len(ids) // 4
        whole = Piece(doc_id, 0, memoryview(ids), n)
        for _ in range(n // self.capacity):
            full, whole = whole.cut(self.capacity)
            self.settle([full])
        rest = Piece(doc_id, whole.start, memoryview(bytes(whole.ids)), n)  # what waits does not hold on to a long document
        while len(rest) and (at := self.gap_for(len(rest))) is not None:
            lacks, into, pieces = self.gaps.pop(at)
            part, rest = rest.cut(min(lacks, len(rest)))
            self.wait([*pieces, part], into)
        if len(rest):
            k = self.capacity // len(rest)
            own = self.classes.setdefault(k, [])
            own.append(rest)
            if len(own) == k:
                self.next += 1
                self.wait(self.classes.pop(k), self.next - 1)

    def wait(self, pieces: list[Piece], into: int) -> None:
        lacks = self.capacity - sum(map(len, pieces))
        if lacks < MIN_PIECE:
            self.settle(pieces, into)
        else:
            insort(self.gaps, (lacks, into, pieces), key=lambda g: g[:2])

    def gap_for(self, n: int) -> int | None:
        """Place of the largest gap that n ids fill, both sides of the cut being long enough; else, where many wait, of the largest gap if it has room for all n."""
        if not self.gaps:
            return None
        at = bisect_right(self.gaps, n - MIN_PIECE, key=lambda g: g[0]) - 1
        if at >= 0:
            return at
        exact = bisect_left(self.gaps, n, key=lambda g: g[0])
        if exact < len(self.gaps) and self.gaps[exact][0] == n:
            return exact
        return len(self.gaps) - 1 if len(self.gaps) > MOST_WAITING and self.gaps[-1][0] >= n + MIN_PIECE else None

    def finish(self) -> None:
        """Deals out the rests that wait, longest first: through the gaps as far as they go, the smallest first, then with the pieces of bins that are still short into new bins, the last one in powers of two."""
        left = deque(p for k in sorted(self.classes) for p in self.classes[k])
        self.classes, gaps, self.gaps = {}, self.gaps, []
        remaining = sum(map(len, left))

        def draw(n: int) -> Iterator[Piece]:
            while n:
                part, rest = left.popleft().cut(n)
                if len(rest):
                    left.appendleft(rest)
                n -= len(part)
                yield part

        for lacks, into, pieces in gaps:
            if lacks <= remaining:
                remaining -= lacks
                self.settle([*pieces, *draw(lacks)], into)
            else:
                left.extend(pieces)
                remaining += self.capacity - lacks
        while remaining:
            size = min(self.capacity, 1 << remaining.bit_length() - 1)
            remaining -= size
            self.settle(list(draw(size)))

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their bins; see SCHEMA. vocabulary: a file of the ``tokenizers`` library."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(vocabulary).encode
        packer = Packer(capacity, TaskContext.get().partitionId() * TASK_SEQUENCES)
        for batch, texts in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                packer.add(doc_id, encode(text.decode()).tobytes() + end)
            if rows := packer.take():
                yield _batch(rows)
        packer.finish()
        if rows := packer.take():
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
