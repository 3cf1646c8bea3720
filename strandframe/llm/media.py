"""AVI motion-JPEG columns: writing and parsing the container, decoding intra frames, finding shots.

Frames are baseline JPEG of eight bits, of one component or of several interleaved in one scan, of which the first (luma)
is kept; a frame without Huffman tables has the standard ones of Annex K, as AVI1 has it. ``store`` writes one component. The unit that JPEG keeps without loss is the quantised
coefficient, so ``store`` writes a payload as coefficients (byte - 128, quantisers of one, in zigzag order) and
``Movie.coefficients`` gives it back bit for bit. A restart interval holds one row of three blocks, 192 bytes; a
comment segment of each frame says how many rows are payload. Decoding runs in lock step over all restart intervals
of a slice of media, so its cost is that of NumPy and not of Python.

Shots begin where the histogram of luma differs from the last frame's by more than an adaptive threshold: mean plus
SPREAD deviations of the differences in a window before it, and at least FLOOR. Every shot is a clip with its times.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, slices, small_batches

UNIT, COLUMNS, ROWS, RATE = 192, 3, 16, 25
WINDOW, SPREAD, FLOOR, BINS = 12, 3.0, 0.25, 32
#: Rows that are coded or decoded together.
AT_ONCE = 8192
#: Blocks of frames that are decoded together.
DECODED = 1 << 16
#: Largest magnitude of a coefficient.
REACH = 2047


@lru_cache
def zigzag() -> np.ndarray:
    """Natural position of each place in zigzag order, by the rule: diagonals, every other one reversed."""
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else -(p // 8)))
    return np.array(order)


@lru_cache
def own_tables() -> tuple[tuple[bytes, bytes], tuple[bytes, bytes]]:
    """(code counts by length, symbols) for DC and AC: short codes for the sizes that bytes of text have."""
    dc = bytes([0, 2, 2, 2, 0, 6] + [0] * 10), bytes([6, 5, 4, 7, 3, 2, 1, 0, 8, 9, 10, 11])
    first = [0x06, 0x05, 0x07, 0x04, 0x03, 0x02, 0x01]
    rest = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in first)]
    ac = bytes([0, 3, 0, 0, 4, 0, 0, 0, 0, 0, len(rest), 0, 0, 0, 0, 0]), bytes(first + rest)
    return dc, ac


@lru_cache
def standard_tables() -> dict[int, tuple[bytes, bytes]]:
    """Tables of Annex K by class and number, as in a DHT segment: luma 0, chroma 1."""
    pairs = lambda *rows: bytes(r << 4 | x for r, first in rows for x in range(first, 11))
    luma = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a")
    chroma = bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a")
    return {
        0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
        0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
        0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]), luma + pairs((3, 4), *((r, 3) for r in range(4, 9)), *((r, 2) for r in range(9, 14)), (14, 1), (15, 1))),
        0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 0x77]), chroma + pairs((3, 5), *((r, 3) for r in range(4, 8)), *((r, 2) for r in range(8, 16)))),
    }


def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Code and length of every symbol of a Huffman table."""
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=16)
def lookup(counts: bytes, symbols: bytes, is_dc: bool) -> np.ndarray:
    """For the next 16 bits: bits of code (5) | size (5) | run (5), -1 where no code fits."""
    out = np.full(1 << 16, -1, np.int32)
    for symbol, (code, length) in codes(counts, symbols).items():
        run, size = (0, symbol) if is_dc else (symbol >> 4, symbol & 15)
        low = code << 16 - length
        out[low : low + (1 << 16 - length)] = length | size << 5 | run << 10
    return out


@lru_cache
def code_arrays() -> tuple[np.ndarray, ...]:
    (dc, ac) = own_tables()
    out = []
    for counts, symbols in (dc, ac):
        value, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        for symbol, (code, n) in codes(counts, symbols).items():
            value[symbol], length[symbol] = code, n
        out += [value, length]
    return tuple(out)


def sizes(v: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return np.ceil(np.log2(np.abs(v).astype(np.float64) + 1)).astype(np.int64)


@lru_cache
def whole_codes() -> tuple[np.ndarray, ...]:
    """Code with its magnitude bits, and length of both, of every coefficient from -REACH on: DC, then AC with no zeros before it."""
    dc_value, dc_length, ac_value, ac_length = code_arrays()
    v = np.arange(-REACH, REACH + 1)
    size = sizes(v)
    bits = np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
    out = []
    for value, length in ((dc_value, dc_length), (ac_value, ac_length)):
        out += [value[size] << size.astype(np.uint64) | bits, (length[size] + size).astype(np.int32)]
    return tuple(out)


def with_runs(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of the 63 AC places of blocks that hold zeros: none at a zero, but the end of a block at its last place."""
    _, _, ac_value, ac_length = code_arrays()
    coefficients = blocks.astype(np.int64)
    size = sizes(coefficients)
    bits = np.where(coefficients < 0, coefficients + (1 << size) - 1, coefficients).astype(np.uint64)
    filled = coefficients != 0
    filled[:, 0] = True
    before = np.maximum.accumulate(np.where(filled, np.arange(64), 0), axis=1)
    run = np.arange(64) - np.concatenate([before[:, :1], before[:, :-1]], axis=1) - 1
    run[:, 0] = 0
    symbol = np.where(filled, (run & 15) << 4 | size, 0)
    value, length = ac_value[symbol] << size.astype(np.uint64) | bits, ac_length[symbol] + size
    long_runs = np.where(filled, run >> 4, 0)
    for k in range(1, 4):
        at = long_runs >= k  # a run of sixteen zeros before it
        if at.any():
            value[at] |= ac_value[0xF0] << length[at].astype(np.uint64)
            length[at] += ac_length[0xF0]
    value[~filled], length[~filled] = 0, 0
    ends = ~filled[:, 63]
    value[ends, 63], length[ends, 63] = ac_value[0], ac_length[0]
    return value[:, 1:], length[:, 1:]


def entropy_code(rows: np.ndarray) -> list[bytes]:
    """rows: (n, 3, 64) coefficients. The coded bytes of each restart interval, stuffed and padded."""
    n = len(rows)
    blocks = rows.reshape(-1, 64)
    first = np.diff(rows[:, :, 0].astype(np.int32), axis=1, prepend=0).ravel()
    dc_value, dc_length, ac_value, ac_length = whole_codes()
    value, length = ac_value[blocks.astype(np.int32) + REACH], ac_length[blocks.astype(np.int32) + REACH]
    value[:, 0], length[:, 0] = dc_value[first + REACH], dc_length[first + REACH]
    sparse = (blocks[:, 1:] == 0).any(axis=1)
    if sparse.any():
        value[sparse, 1:], length[sparse, 1:] = with_runs(blocks[sparse])
    value, length = value.reshape(n, -1), length.reshape(n, -1)
    total = length.sum(axis=1)
    pad = -total % 8
    value = np.concatenate([value, ((1 << pad) - 1).astype(np.uint64)[:, None]], axis=1).ravel()
    length = np.concatenate([length, pad[:, None]], axis=1).ravel()
    used = length > 0
    value, length = value[used], length[used]
    end = np.cumsum(length)
    start = end - length
    words = np.zeros(int(end[-1]) // 64 + 2, np.uint64)
    word, over = start >> 6, (end - 1 >> 6) > (start >> 6)
    shift = 64 - (start & 63) - length
    high = np.where(shift >= 0, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
    words[word[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)
    stream = words.astype(">u8").view(np.uint8)
    cuts = np.cumsum((total + pad) >> 3)
    stream = stream[: cuts[-1]]
    marks = np.flatnonzero(stream == 0xFF)
    if len(marks):
        stream = np.insert(stream, marks + 1, 0)
        cuts = cuts + np.searchsorted(marks, cuts)
    data, cuts = stream.tobytes(), [0, *cuts.tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=64)
def frame_head(rows: int, payload_rows: int) -> bytes:
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    (dc, ac) = own_tables()
    return b"".join((
        b"\xff\xd8", segment(0xE0, b"AVI1\0\0\0\0\0\0\0\0\0\0"), segment(0xFE, b"payload rows %d" % payload_rows), segment(0xDB, b"\0" + b"\1" * 64),
        segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, COLUMNS * 8, 1, 1, 0x11, 0)), segment(0xC4, b"\x00" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1]),
        segment(0xDD, struct.pack(">H", COLUMNS)), segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    """A RIFF file with a header list, the frames and an idx1 index."""
    most = max(map(len, frames), default=0)
    head = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    headers = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return chunk(b"RIFF", b"AVI " + headers + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 192 bytes, as an AVI file."""
    counts = [len(p) // UNIT for p in payloads]
    data = np.frombuffer(b"".join(payloads), np.uint8)
    coded: list[bytes] = []
    for at in range(0, sum(counts), AT_ONCE):
        part = data[at * UNIT : (at + AT_ONCE) * UNIT]
        coded += entropy_code(part.astype(np.int16).reshape(-1, COLUMNS, 64) - 128)
    blank = entropy_code(np.zeros((1, COLUMNS, 64), np.int16))[0]
    out, at = [], 0
    for n in counts:
        rows = min(n, ROWS)
        frames = []
        for k in range(0, n, rows):
            own = coded[at + k : at + min(k + rows, n)]
            body = [*own, *[blank] * (rows - len(own))]
            parts = [frame_head(rows, len(own)), body[0]]
            for i, x in enumerate(body[1:]):
                parts += (bytes((0xFF, 0xD0 + i % 8)), x)
            frames.append(b"".join([*parts, b"\xff\xd9"]))
        out.append(write_avi(frames, COLUMNS * 8, rows * 8))
        at += n
    return out


def riff_chunks(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, body's start, body's length) of the chunks between two places."""
    while start + 8 <= end:
        name, size = bytes(data[start : start + 4]), struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise ValueError("a RIFF chunk ends behind its list")
        yield name, start + 8, size
        start += 8 + size + (size & 1)


def frame_places(media: bytes) -> tuple[list[tuple[int, int]], float]:
    """(start, length) of every video frame and the frame rate: by idx1 or OpenDML indexes, else by walking the frames."""
    data = memoryview(media)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movie, index, standard = float(RATE), None, None, []

    def walk(start: int, end: int) -> None:
        nonlocal rate, movie, index
        for name, at, size in riff_chunks(data, start, end):
            kind = bytes(data[at : at + 4])
            if name == b"LIST" and kind == b"movi":
                movie = movie or (at, at + size)
            elif name == b"LIST":
                walk(at + 4, at + size)
            elif name == b"strh" and kind == b"vids":
                scale, per = struct.unpack_from("<II", data, at + 20)
                rate = per / scale if scale and per else rate
            elif name == b"idx1":
                index = (at, size)
            elif name == b"indx" and data[at + 3] == 0:  # a super index: where the standard ones are
                for k in range(struct.unpack_from("<I", data, at + 4)[0]):
                    standard.append(struct.unpack_from("<Q", data, at + 24 + 16 * k)[0] + 8)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movie is None:
        raise ValueError("an AVI file without frames' list")
    out = []
    if standard:
        for at in standard:
            count, base = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<Q", data, at + 12)[0]
            for k in range(count):
                offset, size = struct.unpack_from("<II", data, at + 24 + 8 * k)
                out.append((base + offset, size & 0x7FFFFFFF))
    elif index:
        entries = [struct.unpack_from("<4sIII", data, index[0] + 16 * k) for k in range(index[1] // 16)]
        base = 0 if entries and entries[0][2] >= movie[0] else movie[0]  # offsets count from the file or from the list
        out = [(base + at + 8, size) for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
    else:
        out = [(at, size) for name, at, size in riff_chunks(data, movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")]
    return out, rate


@dataclass
class Frame:
    """What a frame's segments say, and where its coded data lie."""

    width: int = 0
    height: int = 0
    interval: int = 0
    quantisers: tuple[int, ...] = ()
    #: Of each component in the order of the scan: blocks across and down in a unit, DC and AC table.
    scan: tuple[tuple[int, int, tuple[bytes, bytes], tuple[bytes, bytes]], ...] = ()
    luma: int = 0
    payload_rows: int = -1
    data: bytes = b""


@lru_cache(maxsize=256)
def parse_head(head: bytes) -> Frame:
    f, at, tables, quantisers, parts, chosen = Frame(), 2, dict(standard_tables()), {}, [], []
    while at + 4 <= len(head):
        mark, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, at = head[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("quantisers of 16 bits aren't read")
                quantisers[body[0]] = tuple(body[1:65])
                body = body[65:]
        elif mark == 0xC0:
            bits, f.height, f.width, components = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only frames of eight bits are read")
            parts = [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(components)]  # name, sampling, quantiser
        elif 0xC1 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            f.interval = struct.unpack(">H", body)[0]
        elif mark == 0xFE and body.startswith(b"payload rows "):
            f.payload_rows = int(body[13:])
        elif mark == 0xDA:
            chosen = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])]
    names = [name for name, _, _ in chosen]
    if not parts or sorted(names) != sorted(x[0] for x in parts):
        raise ValueError("only frames of one scan with all components are read")
    sampling = {name: (x >> 4, x & 15) if len(parts) > 1 else (1, 1) for name, x, _ in parts}
    if any(d not in tables or a not in tables for _, d, a in chosen) or parts[0][2] not in quantisers or any(0 in x for x in sampling.values()):
        raise ValueError("a table or sampling factor that the frame hasn't")
    f.scan, f.luma = tuple((*sampling[name], tables[d], tables[a]) for name, d, a in chosen), names.index(parts[0][0])
    if any(f.scan[f.luma][k] != max(x[k] for x in f.scan) for k in (0, 1)):
        raise ValueError("only frames with luma in full resolution are read")
    f.quantisers = quantisers[parts[0][2]]
    return f


def parse_frame(frame: bytes) -> Frame:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    end = frame.rfind(b"\xff\xd9")
    known = parse_head(frame[:at])
    return replace(known, data=frame[at : end if end > 0 else len(frame)])


def decode_coefficients(frames: list[Frame]) -> np.ndarray:
    """Luma's coefficients (blocks, 64) in zigzag order of frames that share their scan, all restart intervals in lock step."""
    scan, luma = frames[0].scan, frames[0].luma
    tables = np.concatenate([t for _, _, dc, ac in scan for t in (lookup(*dc, True), lookup(*ac, False))])
    across, down = scan[luma][:2]
    # of each block of a unit, its component
    unit = np.repeat(np.arange(len(scan)), [h * v for h, v, _, _ in scan])
    joined, blocks = [], []
    for f in frames:
        count = -(-f.width // (8 * across)) * -(-f.height // (8 * down))
        step = f.interval or count
        blocks += [min(step, count - k) * len(unit) for k in range(0, count, step)]
        joined.append(f.data)
        joined.append(b"\xff\xd0")
    data = np.frombuffer(b"".join(joined), np.uint8)
    marks = np.flatnonzero(data[:-1] == 0xFF)
    after = data[marks + 1]
    ends = marks[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[marks[after == 0] + 1] = False
    keep[ends] = keep[ends + 1] = False
    if len(ends) != len(blocks):
        raise ValueError("restart marks don't fit the frame's size")
    place = np.concatenate([[0], np.cumsum(keep)])
    starts = np.concatenate([[0], place[ends[:-1]]]) * 8
    limit = place[ends] * 8
    clean = np.concatenate([data[keep], np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    words = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    blocks_of = np.array(blocks)
    first = np.concatenate([[0], np.cumsum(blocks_of)[:-1]])
    out = np.zeros(int(blocks_of.sum()) * 64, np.int16)
    at, k, base, left = starts.copy(), np.zeros(len(starts), np.int64), first * 64, blocks_of.copy()
    lane = np.arange(len(starts))
    while len(lane):
        peek = words[at >> 3] >> (16 - (at & 7)).astype(np.uint32) & 0xFFFF
        table = (k > 0) * (1 << 16)
        if len(scan) > 1:
            table = table + (unit[(base >> 6) % len(unit)] << 17)  # lanes hold whole units
        entry = tables[peek + table]
        if (entry < 0).any():
            raise ValueError("a code that the table hasn't")
        length, size, run = entry & 31, entry >> 5 & 31, entry >> 10
        at = at + length
        value = (words[at >> 3] << (at & 7).astype(np.uint32)) >> 16 >> (16 - size).astype(np.uint32)
        value = value.astype(np.int64)
        value = np.where(value < 1 << np.maximum(size - 1, 0), value - (1 << size) + 1, value)
        at = at + size
        is_dc = k == 0
        place = k + run
        ended = ~is_dc & (size == 0) & (run < 15)
        some = size > 0
        if (place > 63)[some].any() or (at > limit[lane]).any():
            raise ValueError("coded data end too early")
        out[base[some] + place[some]] = value[some]
        k = np.where(ended, 64, place + 1)
        over = k > 63
        if over.any():
            k = np.where(over, 0, k)
            base = base + 64 * over
            left = left - over
            if not left.all():
                live = left > 0
                at, k, base, left, lane = at[live], k[live], base[live], left[live], lane[live]
    out = out.reshape(-1, 64)
    if len(scan) > 1:
        out = out[np.tile(unit == luma, len(out) // len(unit))]
        blocks_of = blocks_of // len(unit) * (across * down)
        first = np.concatenate([[0], np.cumsum(blocks_of)[:-1]])
    # DC values are differences within a restart interval
    total = np.cumsum(out[:, 0].astype(np.int64))
    out[:, 0] = total - np.repeat(np.where(first > 0, total[first - 1], 0), blocks_of)
    return out if len(scan) == 1 else np.concatenate([out[x] for x in _rows(frames, across, down)])


def _rows(frames: list[Frame], across: int, down: int) -> Iterator[np.ndarray]:
    """Of each frame, the places of its luma blocks row by row, without those of units that lie outside the frame."""
    start = 0
    for f in frames:
        wide, high = -(-f.width // (8 * across)), -(-f.height // (8 * down))
        places = start + np.arange(wide * high * across * down).reshape(high, wide, down, across).transpose(0, 2, 1, 3).reshape(high * down, wide * across)
        yield places[: -(-f.height // 8), : -(-f.width // 8)].ravel()
        start += wide * high * across * down


@lru_cache
def inverse_dct() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 pixels), scaled by 2^26 and rounded, so that sums in doubles are exact."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.round(np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) * 2**13)
    return np.kron(basis, basis)[zigzag()]


def pixels(coefficients: np.ndarray, quantisers: tuple[int, ...]) -> np.ndarray:
    """Luma (blocks, 64)."""
    scaled = (coefficients * np.array(quantisers, np.float64)) @ inverse_dct()
    return np.clip(np.floor((scaled + 2**25) / 2**26) + 128, 0, 255).astype(np.uint8)


def histograms(coefficients: np.ndarray, quantisers: tuple[int, ...], blocks: list[int]) -> np.ndarray:
    """(frames, BINS) counts of luma."""
    out = np.zeros((len(blocks), BINS), np.int64)
    frame = np.repeat(np.arange(len(blocks)), blocks)
    for at in range(0, len(frame), AT_ONCE):
        luma = pixels(coefficients[at : at + AT_ONCE], quantisers)
        cell = frame[at : at + AT_ONCE, None] * BINS + (luma >> 3)
        out += np.bincount(cell.ravel(), minlength=out.size).reshape(out.shape)
    return out


def shots(counts: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, difference at its start) of every shot."""
    if not len(counts):
        return []
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    difference = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    starts, peaks, since = [0], [0.0], 0
    for i, d in enumerate(difference.tolist()):
        past = difference[max(since, i - WINDOW) : i]
        limit = max(FLOOR, past.mean() + SPREAD * past.std()) if len(past) else FLOOR
        if d > limit:
            starts.append(i + 1)
            peaks.append(d)
            since = i + 1
    return list(zip(starts, [*starts[1:], len(counts)], peaks, strict=True))


@dataclass
class Movie:
    """A parsed and decoded file."""

    rate: float
    frames: list[Frame]
    coefficients: np.ndarray
    counts: np.ndarray

    def payload(self) -> bytes:
        """The bytes that ``store`` put into the coefficients."""
        parts, at = [], 0
        for f in self.frames:
            blocks = (f.width // 8) * (f.height // 8)
            rows = f.payload_rows if f.payload_rows >= 0 else f.height // 8
            parts.append(self.coefficients[at : at + rows * (f.width // 8)])
            at += blocks
        return (np.concatenate(parts) + 128).astype(np.uint8).tobytes() if parts else b""

    def clips(self) -> list[tuple[int, int, float]]:
        return shots(self.counts)


def parts(members: list[tuple[int, Frame]]) -> Iterator[list[tuple[int, Frame]]]:
    """Frames in runs of about DECODED blocks, so that decoding one very long file takes no more than that at a time."""
    run, blocks = [], 0
    for member in members:
        own = -(-member[1].width // 8) * -(-member[1].height // 8)
        if run and blocks + own > DECODED:
            yield run
            run, blocks = [], 0
        run.append(member)
        blocks += own
    yield run


def read(media: list[bytes]) -> list[Movie]:
    """Movies of several files; frames with the same tables are decoded together."""
    parsed = []
    for m in media:
        places, rate = frame_places(m)
        parsed.append((rate, [parse_frame(m[a : a + n]) for a, n in places]))
    groups: dict[tuple, list[tuple[int, Frame]]] = {}
    for i, (_, frames) in enumerate(parsed):
        for f in frames:
            groups.setdefault((f.quantisers, f.scan, f.luma), []).append((i, f))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for (quantisers, *_), members in ((key, part) for key, whole in groups.items() for part in parts(whole)):
        decoded = decode_coefficients([f for _, f in members])
        blocks = [-(-f.width // 8) * -(-f.height // 8) for _, f in members]
        counts = histograms(decoded, quantisers, blocks)
        ends = np.concatenate([[0], np.cumsum(blocks)])
        for k, (_, f) in enumerate(members):
            found[id(f)] = decoded[ends[k] : ends[k + 1]], counts[k : k + 1]
    out = []
    for rate, frames in parsed:
        own = [found[id(f)] for f in frames]
        empty = np.zeros((0, 64), np.int16), np.zeros((0, BINS), np.int64)
        out.append(Movie(rate, frames, np.concatenate([x[0] for x in own] or [empty[0]]), np.concatenate([x[1] for x in own] or [empty[1]])))
    return out


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def feature(movie: Movie) -> str:
    """Frames, then start and end of every clip in frames."""
    return f"frames={len(movie.frames)};clips=" + ",".join(f"{a}-{b}" for a, b, _ in movie.clips())


def add_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column and the AVI file (binary ``media``) that holds the text."""
    need(docs, id_column, text_column)
    small_batches(docs.sparkSession)
    picked = docs.select(id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_column):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(store([padded(t) for t in texts]), pa.binary())], names=[id_column, "media"])

    return picked.mapInArrow(run, f"`{id_column}` {picked.schema[id_column].dataType.simpleString()}, media binary")


def clips(media: DataFrame, id_column: str, media_column: str = "media") -> DataFrame:
    """A row for each clip of every file: its frames, its times in seconds and the difference at its start. A null file has none; one that can't be read gives one row with only ``error`` set."""
    need(media, id_column, media_column)
    small_batches(media.sparkSession)
    picked = media.select(id_column, media_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    movie = read([data])[0]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((key, None, None, None, None, None, None, str(e)))
                    continue
                rows += [(key, k, a, b, a / movie.rate, b / movie.rate, d, None) for k, (a, b, d) in enumerate(movie.clips())]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[id_column, "clip", "first_frame", "end_frame", "start_s", "end_s", "difference", "error"])

    kind = picked.schema[id_column].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_column}` {kind}, clip int, first_frame int, end_frame int, start_s double, end_s double, difference double, error string")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: its text goes into an AVI file, the file is parsed and decoded, and the digests of both are returned.

    A null text is an empty one and gives one block row of blanks; a null doc_id stays null; repeated rows give repeated
    results; very long texts become files of many frames; an empty table gives an empty one; extra columns are ignored.
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            media = store([padded(t) for t in texts])
            rows = []
            for text, m, movie in zip(texts, media, read(media), strict=True):
                payload = movie.payload()
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(movie)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return picked.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
