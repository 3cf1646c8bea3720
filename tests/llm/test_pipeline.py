"""The stages of the pipeline and run() against brute force on small tables with nulls, repeats and groups of copies."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)], SCHEMA).repartition(3)


def order(key):
    i, text = key[0], key[1] or ""
    return i is not None, i or 0, text


def brute_lines(texts):
    """Lines that ten or more documents hold, all but their first occurrence. For ids that one text has each."""
    docs = sorted({(i, t or "") for i, t in texts}, key=order)
    holders, first = defaultdict(set), {}
    for d in docs:
        for p, line in enumerate(d[1].split("\n")):
            key = line.strip(" \t\n\r\x0b\x0c").lower()
            holders[key].add(d)
            first.setdefault(key, (d, p))

    def cut(i, t):
        if t is None:
            return None
        keys = [line.strip(" \t\n\r\x0b\x0c").lower() for line in t.split("\n")]
        return "\n".join(x for p, (x, k) in enumerate(zip(t.split("\n"), keys, strict=True)) if not k or len(holders[k]) < 10 or first[k] == ((i, t), p))

    return sorted([(i, cut(i, t)) for i, t in texts], key=str)


def copies():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    line = lambda: " ".join(rng.choices(words, k=12))
    groups = ["\n".join(line() for _ in range(8)) for _ in range(3)]
    texts = [(100 + 20 * g + k, t) for g, t in enumerate(groups) for k in range(9 + g)]  # 9, 10 and 11 copies
    texts += [(300 + k, f"{line()}\n Footer Line \n{line()}\n\nfooter line") for k in range(12)]
    texts += [(1, None), (2, ""), (3, "\n"), (None, "footer line\nfirst of all"), (None, "footer line\nfirst of all")]
    return [*texts, (120, groups[1]), (120, groups[1])], groups


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_lines_keep_one_of_each_group(spark, parts):
    texts, groups = copies()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = corpus_pipeline.lines(spark, table(spark, texts), "").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted([(r.doc_id, r.text) for r in rows], key=str) == brute_lines(texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    left = [r.text for r in rows]
    assert [left.count(g) for g in groups] == [9, 3, 1]  # ten rows' first document stands in three rows


def test_lines_of_one_frequent_key_over_many_tasks(spark):
    rows = [(i, f"same\nown {i}\nsame" if i % 3 else f"other {i}") for i in range(900)]
    got = corpus_pipeline.lines(spark, table(spark, rows), "").collect()
    assert {r.doc_id: r.text for r in got if "same" in r.text} == {1: "same\nown 1"} and len(got) == 900
    assert corpus_pipeline.lines(spark, table(spark, rows).limit(0), "").count() == 0


def near_texts():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choices(words, k=120) for _ in range(6)]
    text = [" ".join(b) for b in base]
    near = [" ".join([*b[:118], "x", "y"]) for b in base]
    return [
        (None, text[0]), (None, text[0]), (None, text[1]), (7, near[1]), (None, text[2]), (None, near[2]),
        (5, text[3]), (5, text[4]), (5, near[3]), (4, near[4]), (9, text[5]), (9, text[5]), (8, text[5].upper()), (20, ""), (21, None), (3, " "),
    ]


def test_near_duplicates_by_row(spark):
    texts = near_texts()
    rows = corpus_pipeline.near_duplicates(spark, table(spark, texts), "").collect()
    got = sorted([(r.doc_id, r.text) for r in rows], key=str)
    by_text = [t for _, t in got]
    assert len(got) == len(set(got)) == 7
    assert (None, texts[0][1]) in got and (7, texts[3][1]) in got and (4, texts[9][1]) in got and (8, texts[12][1]) in got and (3, " ") in got
    assert [i for i, t in got if t in (texts[4][1], texts[5][1])] == [None] and [i for i, t in got if t in (texts[6][1], texts[8][1])] == [5]
    assert texts[7][1] not in by_text and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert corpus_pipeline.near_duplicates(spark, table(spark, texts).limit(0), "").count() == 0
