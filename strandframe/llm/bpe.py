"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A token sequence is the encoding of a piece exactly if no merge crosses any of its borders, which two neighbouring
tokens decide between themselves. So a nondeterministic transducer reads a piece byte by byte: a state is the last
whole token and a node of the trie of tokens, and it may close the token there if the pair holds. Its subsets are the
states of the deterministic transducer, made when a text first reaches them and forgotten together when there are too
many. At each byte it tells the token that the encoding of the bytes so far ends with. What the live readings have in
common is certain and is emitted; a reading dies at the latest after the longest token, so the lookahead is bounded.

Results are those of the ``tiktoken`` library for the same ranks and pattern; tests hold them against it.

Nulls: a null text is an empty one (no ids), a null doc_id stays null. Repeated rows give repeated results. An empty
table gives an empty one. Very long pieces are read in one pass. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import need, slices, small_batches

#: States and pairs that are kept before all are forgotten; words that a worker remembers.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 200_000, 400_000, 150_000
#: Longer words are not remembered.
WORD_BYTES = 40
#: Bytes after which a long piece's certain tokens are emitted.
LOOK = 4096
NONE = 1 << 60
#: A reading is one number: the last token, counted from 1, above the trie node's bits.
NODE_BITS = 24
NODE = (1 << NODE_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on every line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """``encode(piece)`` gives the ids of one piece; ``start``, ``step`` and ``finish`` read it byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.closed = [-1]
        self.depth = [0]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.closed.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.closed[node] = i
        self.edges: dict[int, tuple[list[tuple[int, bytes]], list[tuple[int, bytes]], bool]] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def history(self, token: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]], bool]:
        """How a token's first and last part grow as its own bytes are merged, each with the rank of that merge, and whether they merge to it."""
        if (known := self.edges.get(token)) is not None:
            return known
        ranks, text = self.ranks, self.token[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        first, last = [(-1, parts[0])], [(-1, parts[-1])]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                first.append((rank, parts[0]))
            if i == len(parts) - 1:
                last.append((rank, parts[-1]))
        known = self.edges[token] = (first, last, len(parts) == 1)
        return known

    def holds(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens. left: -1 where a piece begins."""
        if (known := self.pairs.get(left << NODE_BITS | right)) is not None:
            return known
        first, _, whole = self.history(right)
        if left < 0 or not whole:
            out = whole
        else:
            last, get = self.history(left)[1], self.ranks.get
            i = j = 0
            while True:
                grown_left = last[i + 1][0] if i + 1 < len(last) else NONE
                grown_right = first[j + 1][0] if j + 1 < len(first) else NONE
                across = get(last[i][1] + first[j][1], NONE)
                # of equal merges the one further left comes first
                if across < grown_left and across <= grown_right and across < NONE:
                    out = False
                    break
                if grown_left == grown_right == NONE:
                    out = True
                    break
                if grown_left <= grown_right:
                    i += 1
                else:
                    j += 1
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left << NODE_BITS | right] = out
        return out

    start = 0

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the token that the encoding of what has been read so far ends with."""
        move = self.moves.get(state << 8 | byte)
        return move if move is not None else self._make(state, byte)

    def _make(self, state: int, byte: int) -> tuple[int, int]:
        live, children, ends = [], self.children, -1
        for reading in self.states[state]:
            child = children[reading & NODE].get(byte)
            if child is None:
                continue
            if children[child]:
                live.append(reading & ~NODE | child)
            if ends < 0 and (token := self.closed[child]) >= 0 and self.holds((reading >> NODE_BITS) - 1, token):
                ends = token  # one encoding, so one reading ends here
        if ends >= 0:
            live.append((ends + 1) << NODE_BITS)
        nxt = tuple(live)
        number = self.numbers.get(nxt)
        if number is None:
            number = self.numbers[nxt] = len(self.states)
            self.states.append(nxt)
        out = self.moves[state << 8 | byte] = (number, ends)
        return out

    def certain(self, state: int, ends: list[int]) -> int:
        """How many of the bytes read, whose last tokens are ends, belong to tokens that all live readings share."""
        starts = {len(ends) - self.depth[x & NODE] for x in self.states[state]}
        while len(starts) > 1:
            furthest = max(starts)
            starts.remove(furthest)
            starts.add(furthest - len(self.token[ends[furthest - 1]]))
        return starts.pop()

    def back(self, ends: list[int], at: int) -> list[int]:
        """Tokens of the first at bytes, from the last one back."""
        out = []
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= len(self.token[token])
        out.reverse()
        return out

    def stream(self, piece: bytes) -> Iterator[int]:
        """Tokens as they become certain, looked for every LOOK bytes."""
        state, ends = 0, []
        for n, byte in enumerate(piece, 1):
            state, end = self.step(state, byte)
            ends.append(end)
            if not n % LOOK:
                cut = self.certain(state, ends)
                yield from self.back(ends, cut)
                del ends[:cut]
                if len(self.states) > MAX_STATES:  # all but this one may go
                    here = self.states[state]
                    self._forget()
                    state = self.numbers.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
        yield from self.back(ends, len(ends))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._forget()
        if len(piece) > LOOK:
            return list(self.stream(piece))
        state, ends, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self._make(state, byte)
            state = move[0]
            ends.append(move[1])
        return self.back(ends, len(ends))


def single_spaced(text: str) -> bool:
    """Whether words are parted by one blank or line feed each and nothing else is white space."""
    words = text.split()
    gaps = len(words) - 1
    return gaps == text.count(" ") + text.count("\n") and gaps + sum(map(len, words)) == len(text)


class Codec:
    """Texts to ids and back. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.split = regex.compile(pattern).findall
        #: Two generations each: the older one goes when the younger is full.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.bytes_of = self.transducer.token

    def _pieces(self, text: str) -> bytes:
        out, known, older = [], self.pieces, self.old_pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None and (ids := older.get(piece)) is None:
                ids = b"".join(i.to_bytes(4, "little") for i in self.transducer.encode(piece.encode()))
                if len(piece) <= WORD_BYTES:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Blanks and line feeds between characters that are no white space always begin a piece or are one, so words are remembered with the blank before them."""
        if not single_spaced(text):
            return self._pieces(text)
        if len(self.words) > MAX_WORDS:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > MAX_WORDS:
            self.pieces, self.old_pieces = {}, self.pieces
        out, known, older, feed = [], self.words, self.old_words, None
        for line in text.split("\n"):
            if feed is not None:
                out.append(feed)
            else:
                feed = self._pieces("\n")
            words = line.split(" ")
            out.append(self._pieces(words[0]))
            for word in words[1:]:
                ids = known.get(word)
                if ids is None:
                    ids = older.get(word)
                    if ids is None:
                        ids = self._pieces(" " + word)
                    if len(word) <= WORD_BYTES:
                        known[word] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the text that is complete so far, ``close`` what an unfinished end stands for.

    States: 0 between characters; otherwise how many bytes a character still lacks and the range of the next one.
    """

    def __init__(self) -> None:
        self.kept = b""

    @staticmethod
    def after(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
        """The state after a byte; None where no character holds it there."""
        lacks, low, high = state
        if lacks:
            return (lacks - 1, 0x80, 0xBF) if low <= byte <= high else None
        if byte < 0x80:
            return state
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None

    def feed(self, chunk: bytes) -> str:
        """Only the last three bytes can belong to an unfinished character, so the machine runs over them alone."""
        data = self.kept + chunk
        cut = len(data)
        for at in range(len(data) - 1, max(len(data) - 4, -1), -1):
            if data[at] < 0x80:
                break
            if data[at] >= 0xC0:
                state: tuple[int, int, int] | None = (0, 0x80, 0xBF)
                for byte in data[at:]:
                    state = self.after(state, byte)
                    if state is None:
                        break
                if state is not None and state[0]:
                    cut = at
                break
        self.kept = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.kept = self.kept.decode("utf-8", "replace"), b""
        return out


def decode_stream(tokens: Iterable[int], token_bytes: dict[int, bytes], at_once: int = 64) -> Iterator[str]:
    """Texts that become complete as tokens arrive, at_once of them together."""
    machine, held = Utf8Machine(), []
    for token in tokens:
        held.append(token_bytes[token])
        if len(held) == at_once:
            yield machine.feed(b"".join(held))
            held = []
    yield machine.feed(b"".join(held))
    yield machine.close()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column and the ids of every text, as little-endian 32-bit integers in a binary column ``ids``."""
    need(docs, id_column, text_column)
    small_batches(docs.sparkSession)
    picked = docs.select(id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch, texts in slices(batches, text_column):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t.decode()) for t in texts], pa.binary())], names=[id_column, "ids"])

    kind = picked.schema[id_column].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_column}` {kind}, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """The text of every row of ``encode``'s result, through the streaming decoder."""
    need(encoded, id_column, "ids")
    picked = encoded.select(id_column, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            texts = ["".join(decode_stream(memoryview(x or b"").cast("I"), own.bytes_of, 4096)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = picked.schema[id_column].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, the latter of what the streaming decoder returns for the ids."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch, texts in slices(batches):
            counts, hashes, decoded = [], [], []
            for text in texts:
                ids = own.encode(text.decode())
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                back = hashlib.sha256()
                for part in decode_stream(memoryview(ids).cast("I"), own.bytes_of, 4096):
                    back.update(part.encode())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
