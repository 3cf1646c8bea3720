"""Stores, readers, clusters and configured runs on small folders."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import clustering, corpus
from strandframe.plans import config, evaluation
from strandframe.plans import corpus as corpus_plan
from strandframe.sources import sequences, stores


def test_a_table_appears_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.replace(spark.range(3), path)
    stores.replace(spark.read.parquet(path).unionAll(spark.range(10, 12)), path)
    assert spark.read.parquet(path).count() == 5 and stores.complete(spark, path) and os.listdir(tmp_path) == ["t"]
    os.makedirs(tmp_path / "half.staged-1")
    with pytest.raises(ValueError):
        stores.promote(spark, str(tmp_path / "half.staged-1"), path)
    assert stores.sweep(spark, str(tmp_path)) == []
    assert stores.sweep(spark, str(tmp_path), 24, now=4e9) == ["half.staged-1"] and sorted(os.listdir(tmp_path)) == ["t"]


def test_manifests_runs_and_publications(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    stores.add_to_manifest(spark, path, a={"x": 1, "y": {"z": 1}})
    assert stores.add_to_manifest(spark, path, a={"y": {"w": 2}}, b=3) == {"a": {"x": 1, "y": {"z": 1, "w": 2}}, "b": 3} == stores.read_json(spark, path)
    run = stores.reserve(spark, str(tmp_path), {"b": 1, "a": 2})
    assert run.endswith(stores.identity({"a": 2, "b": 1})[:12])
    with pytest.raises(FileExistsError):
        stores.reserve(spark, str(tmp_path), {"a": 2, "b": 1})
    assert stores.reserve(spark, str(tmp_path), {"a": 2, "b": 1}, overwrite=True) == run
    rows = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, p double")
    where = stores.publish(spark, rows, str(tmp_path / "shared"), {"train": "x"}, {"test": "y"})
    assert stores.publish(spark, rows.limit(0), str(tmp_path / "shared"), {"train": "x"}, {"test": "y"}) == where and stores.published(spark, where).count() == 2
    stores.replace(rows.limit(1), f"{where}/rows")
    with pytest.raises(ValueError):
        stores.published(spark, where)


def test_prepared_sources(spark, tmp_path):
    table = spark.createDataFrame([("MKT" * 5, f"C{i % 20:06d}" if i else None, (i % 10) / 10) for i in range(200)], "sequence string, cluster string, score double")
    ready = stores.prepared_columns(table, "sequence", "score", ["cluster"])
    assert ready.columns == ["sequence", "score", "cluster", "sequence_length"] and ready.first().sequence_length == 15
    path = str(tmp_path / "source")
    stores.export(ready, path, "cluster", 20)
    back = stores.load(spark, path, cluster="cluster", modulus=20)
    held = {r.cluster for r in back.filter("split = 'validation'").collect()}
    assert back.count() == 200 and None not in held and not held & {r.cluster for r in back.filter("split = 'train'").collect()}
    for asked in ({"cluster": "other"}, {"modulus": 10}):
        with pytest.raises(ValueError):
            stores.load(spark, path, **asked)
    with pytest.raises(NotImplementedError):
        stores.load(spark, path, "hub")
    assert stores.load(spark, f"{path}/train", "parquet").count() == back.filter("split = 'train'").count()


def test_splits(spark, tmp_path):
    for name, n in (("train-0-of-2", 6), ("train-1-of-2", 4), ("test-0-of-1", 3)):
        spark.range(n).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    found = sequences.splits(spark, str(tmp_path))
    assert {r.split: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 10, "test": 3}
    assert stores.test_split(found, "train").filter("split = 'test'").count() == 10
    for bad in (lambda: stores.test_split(found, "other"), lambda: stores.fixed_splits(found), lambda: stores.fixed_splits(found, ("train",), "main"), lambda: stores.roles(found, {"train": "train", "refit": "both"}), lambda: stores.roles(found, {"validation": "validation"}, ("validation",))):
        with pytest.raises(ValueError):
            bad()
    assert stores.fixed_splits(found, ("train",), "a" * 40).count() == 10
    assert {r.split for r in stores.roles(found, {"train": "test", "validation": "validation"}).collect()} == {"train"}
    carved = stores.carve_validation(found, "id", 0.25, "s")
    assert {r.split: r["count"] for r in carved.groupBy("split").count().collect()} == {"train": 8, "validation": 2, "test": 3} and stores.carve_validation(carved, "id", 0.5, "s").filter("split = 'validation'").count() == 2
    (tmp_path / "odd").mkdir()
    spark.range(1).toPandas().to_parquet(tmp_path / "odd" / "x.parquet")
    with pytest.raises(Exception, match="not a split"):
        sequences.splits(spark, str(tmp_path / "odd")).collect()
    units = spark.createDataFrame([("test", 14), ("test", 15), ("train", None)], "split string, edition int")
    assert stores.edition(units, 14).count() == 2
    for bad in (lambda: stores.edition(units, 13), lambda: stores.edition(units.withColumn("edition", F.lit(9)), 14)):
        with pytest.raises(ValueError):
            bad()


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">X1 some words\nAC\nDE\n>X2\nKL\n")
    assert [(r.original_id, r.description, r.sequence) for r in stores.reader("mgnify")(spark, str(tmp_path / "a.fa"), "M").orderBy("sequence_id").collect()] == [("X1", "", "ACDE"), ("X2", "", "KL")]
    (tmp_path / "x.a3m").write_text("#comment\n>one first\nAc-D\n>sp|curated\nAAAA\n>all_consensus\nCCCC\n>two\nK\x01L\n")
    assert [(r.sequence_id, r.original_id, r.sequence) for r in stores.reader("bfd")(spark, str(tmp_path / "x.a3m"), "B").orderBy("sequence_id").collect()] == [("B_000000000000", "one", "ACD"), ("B_000000000001", "two", "KL")]
    head = "sequence_id_heavy,sequence_alignment_aa_heavy,ANARCI_status_heavy,note,sequence_id_light,sequence_alignment_aa_light,ANARCI_status_light"
    (tmp_path / "oas").mkdir()
    with gzip.open(tmp_path / "oas" / "run1.csv.gz", "wt") as f:
        f.write('{"about": "the file"}\n' + head + '\nh1,EVQ,ok,"a, b",l1,DIQ,ok\nh2,EVL,Shorter than IMGT,x,l2,DIV,ok\nh3,QVQ,,y,l3,EIV,\n')
    (tmp_path / "oas" / "run2.csv").write_text("about\n" + head + "\nh4,AAA,ok,z,l4,CCC,ok\n")
    got = [(r.sequence_id, r.original_id, r.sequence) for r in stores.reader("oas")(spark, str(tmp_path / "oas"), "O").orderBy("sequence_id").collect()]
    assert got == [("O_000000000000", "run1:h1|l1", "EVQ|DIQ"), ("O_000000000001", "run1:h3|l3", "QVQ|EIV"), ("O_000000000002", "run2:h4|l4", "AAA|CCC")]
    assert sequences.paired_files(spark, str(tmp_path / "oas"), "O", "XXXXX").filter("sequence = 'AAAXXXXXCCC'").count() == 1
    (tmp_path / "c.tsv").write_text('r1\ts1\nr1\t"s2\n')
    (tmp_path / "none.tsv").write_text("")
    assert sorted(map(tuple, sequences.cluster_pairs(spark, str(tmp_path / "c.tsv")).collect())) == [('"s2', "r1"), ("s1", "r1")] and sequences.cluster_pairs(spark, str(tmp_path / "none.tsv")).count() == 0
    with pytest.raises(NotImplementedError):
        stores.reader("other")
    stores.write_fasta(spark.createDataFrame([(f"s{i}", "AC") for i in range(5)], "sequence_id string, sequence string").coalesce(1), str(tmp_path / "out"), 2)
    assert len([n for n in os.listdir(tmp_path / "out") if n.startswith("part")]) == 3 and sequences.fasta(spark, str(tmp_path / "out"), "F").count() == 5


def greedy(rows, identity, coverage):
    """Every sequence by falling length: the first representative that covers it, else one of its own."""
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    order, reps, out = sorted(rows, key=lambda r: (-len(r[1]), r[0])), [], {}
    for i, s in order:
        for c, t in reps:
            if len(s) >= coverage * len(t) and distance(s, t) <= int((1 - identity) * max(len(s), len(t)) + 1e-9):
                out[i] = c
                break
        else:
            reps.append((i, s))
            out[i] = i
    return out


def test_clusters_of_copies_and_near_copies(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for family in range(12):
        base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(60, 120))]
        rows.append((f"f{family:02d}_0", "".join(base)))
        for k in range(1, 5):
            own = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
            rows.append((f"f{family:02d}_{k}", "".join(own)[: len(own) - rng.choice([0, 0, 2])]))
    rows += [("short", "ACD"), ("short2", "ACD"), ("null", None), ("empty", "")]
    df = spark.createDataFrame(rows, "sequence_id string, sequence string").repartition(5)
    got = {r.sequence_id: r.cluster_id for r in clustering.cluster(df, 0.9).collect()}
    want = greedy([(i, s or "") for i, s in rows], 0.9, 0.8)
    assert got == want
    wide = clustering.cascade(df, [0.97, 0.9], str(tmp_path / "rounds"))
    first = {r.sequence_id: r for r in wide.collect()}
    assert set(first) == {i for i, _ in rows} and all(first[r.cluster_rep_at_97].cluster_rep_at_90 == r.cluster_rep_at_90 for r in first.values())
    again = clustering.cascade(df.limit(0), [0.97, 0.9], str(tmp_path / "rounds"), resume=True)
    assert again.count() == len(rows)
    for bad in (lambda: clustering.cascade(df, []), lambda: clustering.cascade(df, [0.9], resume=True), lambda: clustering.cascade(df, [0.5, 0.9])):
        with pytest.raises(ValueError):
            bad()
    hits = clustering.search(df.filter("sequence_id like 'f%_1'"), df.filter("sequence_id like 'f%_0'"))
    best = hits.groupBy("query").agg(F.max_by("target", "bits").alias("t")).collect()
    assert len(best) == 12 and all(r.query[:3] == r.t[:3] for r in best)
    r = spark.range(1).select(clustering.cleaned(F.lit("AB*C")).alias("c"), clustering.scattered(F.array(F.lit(0.3), F.lit(0.7)), [2, 0], 4).alias("p")).first()
    assert (r.c, r.p) == ("AXXC", [0.7, 0.0, 0.3, 0.0])


def test_one_frequent_kmer_is_no_quadratic_work(spark):
    df = spark.createDataFrame([(f"s{i:04d}", "ACDEFGHIKL" * 4) for i in range(1500)], "sequence_id string, sequence string")
    assert clustering.cluster(df, 0.9).select("cluster_id").distinct().collect()[0][0] == "s0000"
    assert clustering.links(df, 0.9).count() == 1499


def test_distances_are_counted_once_for_all_identities(spark):
    rng = random.Random(8)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    texts = ["", "é", *("".join(rng.choice("abé\u4e2d\U0001f600") for _ in range(rng.choice([1, 31, 64, 200]))) for _ in range(20))]
    assert all(clustering.edit_distance(a, b) == plain(a, b) for a in texts for b in texts)
    base = "".join(rng.choice("ACDEFGHIKL") for _ in range(90))
    rows = [(f"s{i:02d}", base[: 90 - i % 5] + "M" * (i % 9)) for i in range(30)]
    df, text = spark.createDataFrame(rows, "sequence_id string, sequence string"), dict(rows)
    pairs = clustering.Pairs(df)
    whole = pairs.of().collect()
    assert whole and all(r.distance == plain(text[r.centre], text[r.member]) for r in whole)
    part = df.filter("sequence_id >= 's10'")
    ends = lambda t: sorted((r.centre, r.member) for r in t.collect())
    assert ends(clustering.alike(pairs.of(part), 0.95)) == ends(clustering.links(part, 0.95))
    assert pairs.known.count() == pairs.known.select("centre", "member").distinct().count()


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\nread: {source: uniref, path: p}\noutput: o\n")
    (tmp_path / "b.yaml").write_text("read: {path: q}\ncluster: {thresholds: [0.9]}\n")
    got = config.parse(config.from_arguments([str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), "cluster.coverage=1", "assemble.enabled=false"]), corpus_plan.Settings)
    assert (got.read.path, got.cluster.thresholds, got.cluster.coverage, got.assemble.enabled, got.describe.enabled) == ("q", [0.9], 1.0, False, True)
    base = {"name": "x", "output": "o", "read": {"source": "uniref", "path": "p"}}
    for bad, error in (({**base, "more": 1}, ValueError), ({"name": "x"}, ValueError), ({**base, "read": {"source": 1, "path": "p"}}, TypeError), ({**base, "cluster": {"enabled": 1}}, TypeError), ({**base, "cluster": {"thresholds": 0.9}}, TypeError)):
        with pytest.raises(error):
            config.parse(bad, corpus_plan.Settings)
    with pytest.raises(ValueError):
        config.load([])
    assert config.composed({"a": 1}, {"n": 1}, {"tasks": ["t"]}, {"name": "t"}) == {"a": 1, "model": {"n": 1}, "dataset": {"tasks": ["t"]}, "task": {"name": "t"}}
    for bad in (lambda: config.composed({}, {}, {"tasks": ["u"]}, {"name": "t"}), lambda: config.composed({"old": {"x": 1}}, {}, {}, {}, ["old.x"]), lambda: config.check_evaluation({"task": {"name": "calibration"}, "controls": ["untrained", "untrained"]}), lambda: config.check_evaluation({"task": {"name": "none"}}), lambda: config.single([], "file")):
        with pytest.raises(ValueError):
            bad()
    assert [config.human_bytes(n) for n in (0, 1023, 1024, 1536, 1 << 30, 1 << 70)] == ["0 B", "1023 B", "1.00 KiB", "1.50 KiB", "1.00 GiB", "1024.00 EiB"]
    with pytest.raises(TypeError):
        config.human_bytes(1.5)
    with pytest.raises(FileNotFoundError):
        config.path(None, "/no/such/file", required=True)
    assert config.path("a", "b") == "a" and config.path(None, "b") == "b"


def test_corpus_run(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=50)) for _ in range(6)]
    (tmp_path / "in.fa").write_text("".join(f">id{i} words\n{t}\n" for i, t in enumerate(texts + texts[:2])))
    spark.createDataFrame([(f"X_{i:012d}", i / 10) for i in range(7)], "sequence_id string, score double").write.parquet(str(tmp_path / "scores"))
    settings = config.parse({"name": "x", "output": str(tmp_path / "out"), "read": {"source": "uniref", "path": str(tmp_path / "in.fa")}, "assemble": {"scores": str(tmp_path / "scores")}}, corpus_plan.Settings)
    assert corpus_plan.run(spark, settings) == ["read", "cluster", "assemble", "describe"]
    rows = corpus_plan.assembled(spark, settings).collect()
    assert len(rows) == 7 and {r.dataset_id for r in rows} == {"x"} and len({r.cluster_rep_at_90 for r in rows}) == 6
    said = stores.read_json(spark, str(tmp_path / "out" / "statistics.json"))
    assert said["num_rows"] == 7 and said["length_median"] == 50 and said["length_quantiles"]["0.5"] == 50 and set(stores.read_json(spark, str(tmp_path / "out" / "manifest.json"))["steps"]) == {"read", "cluster", "assemble", "describe"}
    data = stores.plot_data(spark.read.parquet(str(tmp_path / "out" / "assembled")), "sequence_length", ["cluster_rep_at_90"])
    assert {k: v.count() for k, v in data.items()} == {"histogram": 50, "histogram_log": 50, "box": 1, "bars": 1}
    settings.cluster.enabled = settings.assemble.enabled = settings.describe.enabled = False
    assert corpus_plan.run(spark, settings) == ["read"]
    settings.assemble.on_missing_scores = "other"
    with pytest.raises(ValueError):
        corpus_plan.run(spark, settings)


def test_evaluation_run(spark, tmp_path):
    rows = [("a", 1.0, 1.1), ("b", 2.0, 1.9), ("c", 3.0, 3.2), ("d", 4.0, 3.9)]
    df = spark.createDataFrame([(i, y, p, "trained") for i, y, p in rows] + [(i, y, 2.5, "untrained") for i, y, _ in rows], "id string, label double, prediction double, condition string")
    settings = {"task": {"name": "sequence_regression"}, "metrics": ["mse", "spearman"], "controls": ["untrained"]}
    out = evaluation.evaluate(df, settings)
    assert {(r.metric, r.control) for r in out.collect()} == {(m, c) for m in ("mse", "spearman") for c in (None, "untrained")} - ({("spearman", "untrained")} if out.filter("metric = 'spearman' and control is not null").isEmpty() else set())
    path = str(tmp_path / "report")
    evaluation.publish(spark, path, out.withColumn("split", F.lit("test")), ["metric", "control", "split"])
    evaluation.publish(spark, path, out.withColumn("split", F.lit("test")).withColumn("value", F.lit(0.0)), ["metric", "control", "split"])
    assert spark.read.parquet(path).count() == out.count() and spark.read.parquet(path).filter("value <> 0").count() == 0
    train = spark.createDataFrame([("AAC", 1), ("CCD", 1), ("AAA", 0)], "sequence string, label int")
    for kind in ("majority", "mean", "composition"):
        assert evaluation.baseline_predictions(train, train, kind).count() == 3
    with pytest.raises(KeyError):
        evaluation.baseline_predictions(train, train, "other")
    assert corpus.threshold_label(0.9) == 90
