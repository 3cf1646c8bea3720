"""License notices that lines cut, against brute force over every stretch of words."""

import re

from strandframe.llm import licenses


def wrapped(words, width, mark="", gap="\n"):
    return gap.join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))


def brute(text):
    """Blocks by their definition: a line and the words after it, one less than the notice has."""
    lines = [re.findall(r"[a-z0-9]+", x.lower()) for x in text.split("\n")]
    out = set()
    for b, line in enumerate(lines):
        for label, notices in licenses.TEMPLATES.items():
            for notice in notices:
                words = notice.split()
                after = [w for x in lines[b + 1 :] for w in x][: len(words) - 1]
                own, rest = set(words) & set(line), set(words) & set(after)
                need = licenses.THRESHOLD * len(set(words)) - 1e-9
                if len(own | rest) >= need and (len(own) >= need or own - rest):
                    out.add((b, label, len(own | rest) / len(set(words))))
    return sorted(out)


def test_wrapped_notices(spark):
    notices = [(label, t) for label, found in licenses.TEMPLATES.items() for t in found]
    cases = []
    for label, t in notices:
        words = t.split()
        cases += [(label, "intro words here\n" + wrapped(words, width, mark, gap) + "\nown tail " * 40) for width in (1, 3, 5, 8, (len(words) + 1) // 2) for mark, gap in (("# ", "\n"), (" * ", "\r\n"), ("", "\n\n"))]
        cases.append((label, "a b c " + " ".join(words[:2]) + "\n" + " ".join(words[2:]) + " d e f"))
        cases.append((None, " ".join(words[: len(words) // 2]) + "\n" + "own " * 60 + "\n" + " ".join(words[len(words) // 2 :])))  # too far apart to be a notice
    cases += [(None, ""), (None, None), (None, "\n\n"), (None, "the\n" * 300)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(cases)
    for i, (label, text) in enumerate(cases):
        assert [tuple(b) for b in got[i].blocks] == brute(text or ""), text
        if label:
            assert label in got[i].labels.split(",") and got[i].score == 1.0, text
    # these have no base phrase: without their blocks they have neither label nor score
    assert {label for label, _ in cases if label and label not in licenses.PHRASES.values()} == {"cc-by-nc", "bsd", "mpl", "isc"}


def test_repeated_rows_each_give_a_row(spark):
    rows = [(1, "MIT License\nreleased under the MIT license")] * 3 + [(None, "released under the mit license")] * 2 + [(1, "other"), (2, None), (2, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted([(r.doc_id, r.labels, r.n_base) for r in got], key=str) == sorted([(1, "mit", 2)] * 3 + [(None, "mit", 1)] * 2 + [(1, "", 0)] + [(2, "", 0)] * 2, key=str)
