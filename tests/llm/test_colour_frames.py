"""Frames of several components, and frames without Huffman tables, as ordinary motion-JPEG AVIs have them."""

import struct

import numpy as np

from strandframe.llm import media


def coded(blocks, pattern, dht):
    """One scan of blocks (n, 64) with standard tables, component by pattern; 1 and 2 share chroma's."""
    bits, last = [], {}
    for k, b in enumerate(blocks.tolist()):
        c = pattern[k % len(pattern)]
        dc, ac = (media.codes(*dht[x | min(c, 1)]) for x in (0x00, 0x10))
        run = 0
        for p, v in enumerate([b[0] - last.get(c, 0), *b[1:]]):
            if p and not v:
                run += 1
                continue
            while run > 15:
                bits.append("{:0{}b}".format(*ac[0xF0]))
                run -= 16
            size = abs(v).bit_length()
            bits.append("{:0{}b}".format(*(ac[run << 4 | size] if p else dc[size])) + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""))
            run = 0
        if run:
            bits.append("{:0{}b}".format(*ac[0]))
        last[c] = b[0]
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")


def frame(width, height, blocks, sampling, pattern):
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    n = len(sampling)
    parts = b"".join(bytes((k + 1, x, min(k, 1))) for k, x in enumerate(sampling))
    scan = b"".join(bytes((k + 1, 0x11 * min(k, 1))) for k in range(n))
    return b"".join((b"\xff\xd8", segment(0xDB, b"\0" + b"\2" * 64 + b"\1" + b"\3" * 64), segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + parts), segment(0xDA, bytes((n,)) + scan + b"\0\x3f\0"), coded(blocks, pattern, media.standard_tables()), b"\xff\xd9"))


def test_colour_and_standard_tables(spark):
    assert all(len(symbols) == sum(counts) == len(set(symbols)) for counts, symbols in media.standard_tables().values())
    rng = np.random.default_rng(3)
    for sampling, pattern, across, down in (([0x22, 0x11, 0x11], [0, 0, 0, 0, 1, 2], 2, 2), ([0x21, 0x11, 0x11], [0, 0, 1, 2], 2, 1), ([0x11] * 3, [0, 1, 2], 1, 1), ([0x11], [0], 1, 1)):
        width, height = 40, 24  # no whole number of units of 16
        wide, high = -(-width // (8 * across)), -(-height // (8 * down))
        frames, want = [], []
        for level in [-300] * 6 + [300] * 5:
            blocks = np.where(rng.random((wide * high * len(pattern), 64)) < 0.1, rng.integers(-40, 41, (wide * high * len(pattern), 64)), 0)
            own = np.tile(np.array(pattern) == 0, wide * high)
            blocks[:, 0] = np.where(own, level, rng.integers(-200, 200, len(blocks)))
            frames.append(frame(width, height, blocks, sampling, pattern))
            luma = blocks[own].reshape(high, wide, down, across, 64).transpose(0, 2, 1, 3, 4).reshape(high * down, wide * across, 64)
            want.append(luma[:3, :5].reshape(-1, 64))
        movie = media.write_avi(frames, width, height)
        assert (media.read([movie])[0].coefficients == np.concatenate(want)).all()
        rows = media.clips(spark.createDataFrame([(1, bytearray(movie))], "k int, media binary"), "k").orderBy("clip").collect()
        assert [(r.first_frame, r.end_frame, r.error) for r in rows] == [(0, 6, None), (6, 11, None)]
