"""The llm operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandframe.llm import ann, bpe, components, langid, licenses, linededup, media, packing, quality, sharding, simhash
from strandframe.llm.common import Staging

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, node long, anchor long, shard int, h1 long, labels string"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", " ", "\n", "a\n\nb", "é\x00 ü\x1c  x\t\ty", "x" * 5000, "MIT License\nmit, license!\nApache  LICENSE", "Licensed under the Apache License, Version 2.0.", "ABC abc", "日本語 テキスト"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]
    base = " ".join(rng.choices(words, k=200))
    texts += [base] * 15 + [base + " tail", base.upper(), base.replace("w1 ", "w2 ")]
    texts += ["Shared Line \n" + f"own {i}" for i in range(12)] + [" shared line\nrare\nrare"] * 2 + [" ".join(rng.choices(words, k=20000))]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}", None if t is None else len(t), "x", 1, 2, 3, 4, "y") for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "no id\nshared line", "en", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_id():
    return {r[0]: (r[1] or "") for r in corpus()}


def test_media_round_trip(docs, empty):
    want, rows = texts_by_id(), media.digests(docs).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        raw = want[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({(r.media_sha256, r.feature) for r in rows if want[r.doc_id] == ""}) == 1
    assert media.digests(empty).count() == 0


def test_media_any_bytes_and_shots(spark):
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * n, np.uint8).tobytes() for n in (1, 3, 16, 17, 40)] + [b"\x80" * 384, (b"\x80" * 50 + b"a" * 14) * 9, b"\xff" * 192, b"\0" * 192]
    stored = media.store(payloads)
    assert [m.payload() for m in media.read(stored)] == payloads
    # two scenes: dark frames, then bright ones
    frames = []
    for level in [-100] * 10 + [100] * 8:
        blocks = np.zeros((16, 3, 64), np.int16)
        blocks[:, :, 0] = level * 8
        coded = media.entropy_code(blocks)
        body = b"".join(x + (bytes((0xFF, 0xD0 + i % 8)) if i < 15 else b"") for i, x in enumerate(coded))
        frames.append(media.frame_head(16, 16) + body + b"\xff\xd9")
    movie = media.write_avi(frames, 24, 128)
    df = spark.createDataFrame([(1, bytearray(movie)), (2, None), (3, bytearray(b"no avi"))], "k int, media binary")
    rows = media.clips(df, "k").orderBy("k", "clip").collect()
    assert [(r.first_frame, r.end_frame, r.start_s, r.end_s) for r in rows if r.k == 1] == [(0, 10, 0.0, 0.4), (10, 18, 0.4, 0.72)]
    assert [r.error is not None for r in rows if r.k == 3] == [True] and not [r for r in rows if r.k == 2]
    pixels = media.pixels(media.read([movie])[0].coefficients, (1,) * 64)
    assert set(np.unique(pixels)) == {28, 228}


def brute_fingerprint(text, words):
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, values, distance):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)].append(x)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_simhash(docs, empty):
    rows = [(r[0], r[1] or "") for r in corpus()]
    prints = [brute_fingerprint(t, 3) for _, t in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints, 3), strict=True), key=str)
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.groups(empty).count() == 0
    grouped = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    assert len({grouped[i] for i, t in texts_by_id().items() if i is not None and t.startswith("w") and len(t) > 500 and t.count(" ") in (199, 200)}) == 1


def jaccard_classes(texts: list[str], words: int, similarity: float) -> list[int]:
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if texts[i] == texts[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_groups_count_their_links(spark):
    rng = random.Random(5)
    words, texts = [f"w{i}" for i in range(500)], ["", " "]
    for family in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for _ in range(60 if family == 0 else rng.randint(1, 4)):
            own = list(base)
            for _ in range(max(1, int(len(own) * (0.01 if family == 0 else rng.choice([0.005, 0.01, 0.03, 0.06]))))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += texts[2:20]
    want = jaccard_classes(texts, 5, 0.8)
    got = [c for _, c in sorted(map(tuple, simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()))]
    # nothing below the similarity is linked; what the anchors miss is little
    assert len(set(zip(got, want, strict=True))) == len(set(got))
    assert len(set(want)) <= len(set(got)) <= 1.05 * len(set(want)) and got[2:62] == [2] * 60
    # many rows at one anchor propose few pairs a row
    assert len(set(want)) > 40


def test_every_pair_within_three_bits_meets_at_an_anchor():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300, np.uint64)
    for bits in (1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1 << int(b))
        met = []
        for values in (x, y):
            rows, name, over = simhash.anchors(values, 2)
            found = defaultdict(dict)
            for r, a, o in zip(rows.tolist(), name.tolist(), over.tolist(), strict=True):
                found[r][a] = o
            met.append(found)
        for i in range(len(x)):
            assert any(met[0][i][a] + met[1][i][a] <= 3 for a in met[0][i].keys() & met[1][i].keys())


def test_compare_of_many_rows_at_one_anchor():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 62, (400, 1), np.uint64)
    values[200:] = values[:200] ^ np.uint64(0b111)
    old, simhash.SHIFTED = simhash.SHIFTED, 50
    try:
        many = simhash.compare(np.zeros(400, np.int64), values, None, 3)
    finally:
        simhash.SHIFTED = old
    few = simhash.compare(np.zeros(400, np.int64), values, None, 3)
    assert (many.parent == few.parent).all() and (few.parent[200:] == np.arange(200)).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 60)] + [(900, 901), (901, 900), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), Staging(spark, "t")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in range(5, 60)} | {900: 900, 901: 900}


def test_nearest(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[100:140] = 5 * v[0]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(3000)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0, None] + [0.0] * 14, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact = v.astype(np.float64)
    hit = total = 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        scores = (exact * exact[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        assert len(found) == 20 and all(abs(scores[i] - s) < 1e-12 for i, s in found)
        assert [x for x, _ in found] == [x for x, _ in sorted(found, key=lambda x: (-x[1], x[0]))]
        hit += len({x for x, _ in found} & set(order))
        total += 20
    assert hit / total >= 0.9
    assert [x for x, _ in got[0]] == list(range(100, 120))  # ties go to the smaller id
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0, 20)
    assert [r.vec_id for r in few.orderBy("rank").collect()] in ([1, 2], [2, 1])
    assert ann.search(df.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def brute_lines(min_docs):
    strip, low = " \t\n\v\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    found = defaultdict(set)
    for r in corpus():
        for line in (r[1] or "").split("\n"):
            found[key(line)].add((r[0], r[1]))
    out = []
    for r in corpus():
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines(docs, empty, min_docs):
    assert sorted([tuple(r) for r in linededup.digests(docs, min_docs).collect()], key=str) == brute_lines(min_docs)
    assert linededup.digests(empty).count() == 0


def test_lines_of_one_frequent_key_over_many_tasks(spark):
    rows = [(i, f"same\nown {i}\nsame" if i % 3 else f"other {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.n_dropped for r in linededup.digests(df).collect()}
    assert got == {i: 2 if i % 3 else 0 for i, _ in rows}
    kept = linededup.apply(df, linededup.bitmaps(df, "first")).collect()
    assert sum(r.text.split("\n").count("same") for r in kept) == 1 and {r.doc_id for r in kept if "same" in r.text} == {1}


def test_language(spark):
    rng = random.Random(1)
    words = {"aa": ["der", "und", "nicht", "haus", "gehen"], "bb": ["the", "and", "house", "going", "with"]}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x, 1.0) for i in range(200) for x in [("aa", "bb")[i % 2]]] + [(900, None, "aa", 1.0), (901, "12 34 !", "bb", 1.0), (902, "und der haus nicht gehen", None, 1.0), (903, "", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score double")
    known = langid.learn(df)
    out = langid.identify(df, known).collect()
    assert all(r.lang_pred == r.lang for r in out if r.doc_id < 200) and all(0 <= r.lang_score_ <= 1 and r.lang_score == 1.0 for r in out)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id >= 900} == {900: "und", 901: "und", 902: "aa", 903: "und"}
    assert langid.learn(df.limit(0)) == {} and langid.identify(df.limit(0), known).count() == 0
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}


def test_shards(docs, empty, spark):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(corpus())
    want, shard_of = texts_by_id(), {}
    for r in rows:
        raw = want[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert shard_of.setdefault(raw, r.shard) == r.shard
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(empty).count() == 0
    rng = random.Random(5)
    many = spark.createDataFrame([(i, f"{i} " + "x" * rng.randint(0, 300), "hot" if i % 3 else f"l{i % 5}", None) for i in range(4000)], "doc_id long, text string, lang string, source string")
    sizes = defaultdict(int)
    for r in sharding.shard(many).collect():
        sizes[r.shard] += r["size"]
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) < 1500


def test_bpe(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = texts_by_id()
    for r in bpe.round_trip(docs, path, P.PATTERN).collect():
        ids = np.array(known.encode_ordinary(want[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()}
    assert back == want
    rng = random.Random(8)
    own = bpe.codec(path, P.PATTERN)
    for _ in range(300):
        text = "".join(rng.choices("abetinor ABéß'\n12,日", k=rng.randint(1, 60)))
        assert own.encode(text) == np.array(known.encode_ordinary(text), "<u4").tobytes(), text
    long = "".join(rng.choices("abetinorst", k=20000))
    assert own.encode(long) == np.array(known.encode_ordinary(long), "<u4").tobytes()


def test_utf8_machine():
    text = "aé日😀b" * 20
    for cut in range(1, 8):
        machine, raw = bpe.Utf8Machine(), text.encode()
        assert "".join(machine.feed(raw[i : i + cut]) for i in range(0, len(raw), cut)) + machine.close() == text
    machine = bpe.Utf8Machine()
    assert machine.feed(b"a\xe6\x97") == "a" and machine.close() == "�"
    assert machine.feed(b"\xed\xa0") == b"\xed\xa0".decode("utf-8", "replace")


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = rng.choices([f"w{k}" for k in range(50)], k=40)
        kind = i % 3
        words = [*words, "insult"] if kind == 0 else [w + "###" for w in words] if kind == 1 else words
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(kind != 1), int(kind == 0)))
    labels += [(5, None, None), (7777, 1, 0), (None, 1, 0), (8, 1, 0)]
    df, rated = spark.createDataFrame([*rows, (901, None, 1.0), (902, "", 1.0)], "doc_id long, text string, p_top double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grades = quality.graded(rated)
    assert {r.doc_id: r.grade for r in grades.collect()}[8] == 2
    model = quality.fit(quality.sample(df, grades))
    out = quality.predict(df, model).collect()
    right = sum(round(r.expected_grade) == r.doc_id % 3 for r in out if r.doc_id < 900)
    assert right >= 890 and (np.diff(model.thresholds) > 0).all() and all(0 <= r.p_top_ <= 1 for r in out)
    assert {r.p_top for r in quality.predict(df, quality.fit([])).collect()} == {1.0}
    assert quality.predict(df.limit(0), model).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = texts_by_id()
    rows = packing.pack(docs, path).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048 and ((at & (at - 1)) == 0 or 2048 - at < packing.MIN_PIECE)
    for doc_id, found in pieces.items():
        ids = np.array([*library.encode(want[doc_id], add_special_tokens=False).ids, 1], "<u4")
        copies = 3 if doc_id == 20 else 1
        assert sum(r.length for r in found) == copies * len(ids)
        for r in found:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(pieces) == set(want) and packing.pack(empty, path).count() == 0


def test_packing_of_special_strings(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    text = "a <|endoftext|> b\nplain words"
    ids = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1], "<u4")
    rows = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1), path).orderBy("start").collect()
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows] and sum(r.length for r in rows) == len(ids)


@pytest.mark.parametrize("lengths", ["mixed", "halves", "small", "long"])
def test_packer_cuts_little_and_pads_little(lengths):
    rng = random.Random(4)
    draw = {"mixed": lambda: int(rng.expovariate(1 / 900)) + 1, "halves": lambda: rng.choice([1100, 100]), "small": lambda: rng.randint(1, 30), "long": lambda: rng.randint(2000, 30000)}[lengths]
    sizes = [draw() for _ in range(3000)]
    packer = packing.Packer(2048, 7)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
    packer.finish()
    bins, docs = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, total, into, offset in packer.take():
        bins[into].append((offset, length))
        docs[doc_id].append((start, length, crc, total))
    padding = 0
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    short = 0
    for i, n in enumerate(sizes):
        at = 0
        for start, length, crc, total in sorted(docs[i]):
            assert (start, total) == (at, n) and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
            at += length
            short += length < packing.MIN_PIECE and at < n
        assert at == n
    assert padding < 0.002 * sum(sizes) and short <= 12  # pieces of a task's last sequences only
    assert len(docs) + len(bins) + sum(n // 2048 for n in sizes) >= sum(map(len, docs.values()))  # at most one cut a bin


def test_licenses(docs, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
    want = []
    for r in corpus():
        words = split(r[1] or "")
        hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        own = {
            (b, label, len(set(t.split()) & set(split(line))) / len(set(t.split())))
            for b, line in enumerate((r[1] or "").split("\n")) for label, notices in licenses.TEMPLATES.items() for t in notices
            if len(set(t.split()) & set(split(line))) >= 0.8 * len(set(t.split())) - 1e-9
        }
        base = {x for _, x in hits}
        score = max([1.0 if hits else 0.0, *(c for _, _, c in own)])
        want.append((r[0], len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for _, x, _ in own})), score, sorted(own)))
    got = [(*r[:8], [tuple(b) for b in r.blocks]) for r in licenses.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(empty).count() == 0


def test_blocks_hold_every_pair_of_a_cluster():
    cluster = np.repeat([3, 5, 9, 12], [1, 7, 2, 20])
    rows, low, high = simhash.blocks_of(cluster, 3)
    together: dict[tuple, list] = {}
    for r, a, b in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True):
        together.setdefault((cluster[r], a, b), []).append(r)
    met = {(x, y) for v in together.values() for x in v for y in v if x < y}
    assert met == {(x, y) for x in range(30) for y in range(x + 1, 30) if cluster[x] == cluster[y]}
    assert max(map(len, together.values())) <= 6
    assert [len(x) for x in simhash.blocks_of(np.zeros(0, np.int64), 3)] == [0, 0, 0]


def test_first_meeting_owns_each_pair_once():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, (40, 2)).astype(np.uint64))
    names = [simhash.by_projection(v)[1].reshape(40, -1) for v in (a, b)]
    for k in range(40):
        shared = np.flatnonzero(names[0][k] == names[1][k])
        owns = simhash.first_meeting(shared, np.repeat((a[k] ^ b[k])[None], len(shared), axis=0))
        assert owns.tolist() == [True] + [False] * (len(shared) - 1)


def test_second_round_ties_what_the_first_leaves_apart(spark):
    words = [f"w{k}" for k in range(400)]
    # two tight families around texts that are near each other, whose members' nearest are all of their own family
    rows = [(fam * 100 + k, " ".join(words[: 395 - 5 * fam] + [f"x{fam}"] * 2 + [f"y{fam}_{k}"])) for fam in range(2) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.groups(frame).collect()} == {0}
    marked = simhash.shingle_sets(frame, 5).withColumn("node", F.xxhash64("fp", "fp2")).cache()
    nodes = marked.withColumn("root", F.when(F.col("doc_id") < 100, 0).otherwise(1).cast("long"))
    links = simhash._apart(nodes, marked.select("node", "shingles"), 28, 0.8).collect()
    family = {r.node: r.root for r in nodes.collect()}
    assert links and all(family[x.a] != family[x.b] for x in links)
    assert len(links) <= 8 * simhash.PROJECTIONS
    marked.unpersist()
