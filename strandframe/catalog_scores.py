"""Queries of metrics, comparisons, contacts, assays, calibration and clusters.

lineitem and orders stand for predictions with their units, customer, supplier and nation for assays, proteins and
functions, conversations for chains, benchmark for sequences to be clustered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CELLS, L, MCC, cells, h, query, read, rounded
from .catalog_batches import joined
from .operators import assays, baselines, calibration, clustering, contacts, scoring

J = "j AS (SELECT l_returnflag AS g, l_suppkey AS unit, l_discount::double AS label, l_tax::double AS prediction, l_orderkey * 10 + l_linenumber AS i, l_quantity::double AS w FROM lineitem)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("unit"), x("l_discount").alias("label"), x("l_tax").alias("prediction"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), x("l_quantity").alias("w"))


@query(f"""WITH {J}, k AS (SELECT g, prediction AS s, sum(w) FILTER (label >= 0.05) AS p, sum(w) FILTER (label < 0.05) AS n FROM j GROUP BY 1, 2), b AS (SELECT *, sum(coalesce(n, 0)) OVER (PARTITION BY g ORDER BY s) - coalesce(n, 0) / 2 AS below FROM k)
  SELECT g, round(sum(p * below) / (sum(p) * sum(n)), 6) AS auc FROM b GROUP BY 1""")
def weighted_auc(spark: SparkSession, d: str) -> DataFrame:
    from .operators.metrics import roc_auc

    rows = judged(spark, d).withColumn("y", (F.col("label") >= 0.05).cast("int"))
    return rounded(roc_auc(rows, ["g"], "y", "prediction", "w"))


@query("""WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END AS y, [1.0 + o_orderkey % 7, 1.0 + o_custkey % 5, 2.0, 1.0 + o_orderkey % 3]::double[] AS p FROM orders),
  r AS (SELECT y, [0, 1, 3] AS cs, p, p[1] + p[2] + p[4] AS t FROM o), e AS (SELECT y AS a, c AS b, 1 AS v, p[y + 1] / t AS s FROM (SELECT *, unnest(cs) AS c FROM r) WHERE c <> y UNION ALL SELECT c, y, 0, p[c + 1] / t FROM (SELECT *, unnest(cs) AS c FROM r) WHERE c <> y),
  k AS (SELECT a, b, round(s, 12) AS s, sum(v) AS pos, sum(1 - v) AS neg FROM e GROUP BY 1, 2, 3), w AS (SELECT *, sum(neg) OVER (PARTITION BY a, b ORDER BY s) - neg / 2 AS below FROM k), u AS (SELECT a, b, sum(pos * below) / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY 1, 2),
  n AS (SELECT y, count(*) AS n FROM o GROUP BY 1) SELECT round(avg(auc), 6) AS auc_macro, round(sum(auc * (x.n + z.n)) / sum(x.n + z.n), 6) AS auc_weighted FROM u JOIN n AS x ON x.y = a JOIN n AS z ON z.y = b""")
def one_versus_one_auc(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(3)
    p = F.array(1.0 + F.col("o_orderkey") % 7, 1.0 + F.col("o_custkey") % 5, F.lit(2.0), 1.0 + F.col("o_orderkey") % 3)
    return rounded(scoring.one_versus_one(read(spark, d, "orders").select(y.alias("y"), p.alias("p")), "y", "p", 4))


AVERAGES = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
HITS = "sum(y * p)::double AS tp, sum((1 - y) * p)::double AS fp, sum(y * (1 - p))::double AS fn"


@query(f"""WITH {CELLS}, t AS (SELECT *, {AVERAGES} FROM (SELECT l_suppkey, {HITS} FROM c GROUP BY 1)), r AS (SELECT *, {AVERAGES} FROM (SELECT l_orderkey, {HITS} FROM c GROUP BY 1)), a AS (
  SELECT 'micro' AS average, {AVERAGES} FROM (SELECT {HITS} FROM c) UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1) FROM t
  UNION ALL SELECT 'weighted', sum(precision * (tp + fn)) / sum(tp + fn), sum(recall * (tp + fn)) / sum(tp + fn), sum(f1 * (tp + fn)) / sum(tp + fn) FROM t UNION ALL SELECT 'samples', avg(precision), avg(recall), avg(f1) FROM r)
  SELECT average, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM a""")
def multilabel_classification(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.multilabel_classification(cells(spark, d), "l_orderkey", "l_suppkey", "y", "p"))


@query(f"""WITH {J}, v AS (SELECT g, round(avg((label = prediction)::int), 6) AS accuracy, round(avg((label - prediction) ^ 2), 6) AS mse, round(avg(abs(label - prediction)), 6) AS mae, round(1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*)), 6) AS r2, round(corr(label, prediction), 6) AS pearson,
  round(exp(-avg(prediction)), 6) AS pseudo_perplexity FROM j GROUP BY 1) SELECT * FROM v UNPIVOT (value FOR metric IN (accuracy, mse, mae, r2, pearson, pseudo_perplexity))""")
def evaluated_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.evaluate(judged(spark, d), ["g"], ["accuracy", "mse", "mae", "r2", "pearson", "pseudo_perplexity"]))


@query(f"""WITH {J}, v AS (SELECT unit, avg((label - prediction) ^ 2) AS mse, CASE WHEN count(*) > 1 AND var_pop(label) > 1e-12 AND var_pop(prediction) > 1e-12 THEN corr(label, prediction) END AS pearson FROM j GROUP BY 1)
  SELECT metric, round(avg(value), 6) AS value, count(value) AS contributors FROM (SELECT * FROM v UNPIVOT INCLUDE NULLS (value FOR metric IN (mse, pearson))) GROUP BY 1""")
def mean_of_units(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.mean_of_units(judged(spark, d), "unit", ["mse", "pearson"]))


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """The trained condition and two controls with the same labels."""
    rows = judged(spark, d)
    other = lambda name, p: rows.withColumn("prediction", p).withColumn("condition", F.lit(name))
    return rows.withColumn("condition", F.lit("trained")).unionByName(other("untrained", F.lit(0.04))).unionByName(other("random_head", F.col("w") / 500))


B = "b AS (SELECT unit, sum(label * label) AS yy, sum(prediction * prediction) AS tpp, sum(label * prediction) AS typ, sum(0.04 * 0.04) AS cpp, sum(label * 0.04) AS cyp, count(*) AS n FROM j GROUP BY 1)"


@query(f"""WITH {J}, {B}, o AS (SELECT (sum(tpp) - 2 * sum(typ) - sum(cpp) + 2 * sum(cyp)) / sum(n) AS o FROM b), t AS (SELECT unnest(range(0, 60)) AS t),
  p AS (SELECT t, sum(CASE WHEN ({h("'r|' || t // 20 || '|' || unit")} >> (t % 20)::int) % 2 = 1 THEN cpp - 2 * cyp - tpp + 2 * typ ELSE tpp - 2 * typ - cpp + 2 * cyp END) / sum(n) AS d FROM b, t GROUP BY 1)
  SELECT 'mse' AS metric, round(o, 6) AS observed, round((count(*) FILTER (-d >= -o - 1e-12) + 1) / 61, 6) AS p FROM p, o GROUP BY o""")
def paired_randomisation(spark: SparkSession, d: str) -> DataFrame:
    units = scoring.per_unit(conditions(spark, d), ["condition", "unit"], ["mse"])
    return rounded(scoring.randomised(units, "unit", ["mse"], "untrained", 60, "r"))


@query()
def control_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.compared(conditions(spark, d), "unit", ["mse", "mae", "pearson"], ["untrained", "random_head"], 50, 60, "c"))


@query()
def layer_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d)
    deep = lambda n: rows.withColumn("layer", F.lit(n)).withColumn("prediction", F.col("prediction") * n / 3 + 0.01)
    return rounded(scoring.layers(deep(1).unionByName(deep(2)).unionByName(deep(3)), "unit", ["mse", "mae"], 40, 40, "l"))


@query()
def score_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.report(conditions(spark, d), "unit", ["mse", "mae"], ["untrained"], "s", 40, 40, {"model_name": "m", "split": "test"}))


@query(f"""WITH a AS (SELECT o_orderkey AS i, o_custkey % 50 AS g, o_totalprice AS v, row_number() OVER (ORDER BY o_custkey % 50, o_orderkey) AS r, row_number() OVER (ORDER BY {h("'x|' || o_orderkey")}, o_orderkey) AS q FROM orders)
  SELECT x.i, x.g, y.v AS label FROM a AS x JOIN a AS y ON x.r = y.q""")
def scrambled_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 50).alias("g"), F.col("o_totalprice").alias("label"))
    return scoring.scrambled_groups(rows, "g", "i", "x")


@query("""WITH s AS (SELECT l_returnflag AS g, l_quantity AS tokens, l_discount * 10 AS loss, l_linenumber::double AS stall FROM lineitem)
  SELECT g, round(sum(loss * tokens) / sum(tokens), 6) AS loss, round(exp(least(sum(loss * tokens) / sum(tokens), 100)), 6) AS perplexity, round(sum(floor(tokens / 2)) / sum(tokens), 6) AS accuracy, round(sum(tokens) / sum(2.0::double), 6) AS tokens_per_second, max(stall) AS stall_max,
  quantile_cont(stall, 0.5) AS stall_p50, quantile_cont(stall, 0.9) AS stall_p90, round(quantile_cont(stall, 0.99), 6) AS stall_p99 FROM s GROUP BY 1""")
def training_counters(spark: SparkSession, d: str) -> DataFrame:
    steps = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("tokens"), (F.col("l_discount") * 10).alias("loss"), F.floor(F.col("l_quantity") / 2).cast("double").alias("correct"), F.lit(2.0).alias("seconds"), F.col("l_linenumber").cast("double").alias("stall"))
    return rounded(scoring.training_counters(steps, ["g"]))


# contacts: suppliers stand for units, five of them for a record, orders' lines for pairs
P = L.replace("60 AS length", "60 AS length, (l_suppkey % 17)::varchar AS record_id, l_suppkey % 5 AS complex")
RANKED = """e AS (SELECT *, unnest([6, 24]) AS minsep FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY unit, minsep ORDER BY score DESC, i, j) AS r, count(*) OVER (PARTITION BY unit, minsep) AS n FROM e WHERE j - i >= minsep),
  y AS (SELECT *, sum(label) OVER (PARTITION BY unit, minsep ORDER BY r ROWS UNBOUNDED PRECEDING) AS hits FROM k), c AS (SELECT unit, minsep, d, hits / r AS p FROM y, (SELECT unnest(range(1, 11)) AS d) WHERE r = greatest(1, least(n, (length * d) // 10))),
  m AS (SELECT unit, minsep, avg(p) AS auc, max(p) FILTER (d = 10) AS p_at_l, max(p) FILTER (d = 5) AS p_at_l2, max(p) FILTER (d = 2) AS p_at_l5 FROM c GROUP BY 1, 2),
  v AS (SELECT unit, minsep, score, sum(label) AS pos, sum(1 - label) AS neg FROM k GROUP BY 1, 2, 3), w AS (SELECT *, sum(neg) OVER (PARTITION BY unit, minsep ORDER BY score) - neg / 2 AS below FROM v),
  z AS (SELECT unit, minsep, sum(pos * below) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM w GROUP BY 1, 2)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    j = F.col("l_orderkey") + F.col("l_linenumber") * 6
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("i"), j.alias("j"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") >= 0.05).cast("int").alias("label"), F.lit(60).alias("length"))


PAIRS = P.replace("l_linenumber * 3", "l_linenumber * 6")


@query(f"""WITH {PAIRS}, {RANKED}, a AS (SELECT DISTINCT unit, minsep FROM e) SELECT unit, minsep, round(auc, 6) AS auc, round(p_at_l, 6) AS p_at_l, round(p_at_l2, 6) AS p_at_l2, round(p_at_l5, 6) AS p_at_l5, round(roc_auc, 6) AS roc_auc,
  CASE WHEN auc IS NULL THEN 'no_eligible_pairs' ELSE 'scored' END AS status FROM a LEFT JOIN m USING (unit, minsep) LEFT JOIN z USING (unit, minsep)""")
def contact_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contacts.score_units(pairs(spark, d), ["unit"], "length"))


@query(f"""WITH {PAIRS}, {RANKED}, a AS (SELECT DISTINCT unit, minsep FROM e), u AS (SELECT minsep, (unit % 17)::varchar AS record_id, unit % 17 % 5 AS complex, auc, p_at_l FROM a LEFT JOIN m USING (unit, minsep)),
  r AS (SELECT minsep, record_id, complex, avg(auc) AS auc, avg(p_at_l) AS p_at_l, count(auc) AS units, count(*) AS n FROM u GROUP BY 1, 2, 3), q AS (SELECT minsep, complex, avg(auc) AS auc, avg(p_at_l) AS p_at_l FROM r GROUP BY 1, 2),
  s AS (SELECT minsep, sum(n)::bigint AS n_units, count(*) AS n_sequences, sum(units)::bigint AS units_auc, count(auc) AS sequences_auc FROM r GROUP BY 1)
  SELECT minsep, round(avg(auc), 6) AS auc, round(avg(p_at_l), 6) AS p_at_l, n_units, n_sequences, count(*) AS n_complexes, units_auc, sequences_auc, count(auc) AS complexes_auc FROM q JOIN s USING (minsep) GROUP BY minsep, n_units, n_sequences, units_auc, sequences_auc""")
def three_level_mean(spark: SparkSession, d: str) -> DataFrame:
    scored = contacts.score_units(pairs(spark, d), ["unit"], "length")
    record = F.col("unit") % 17
    named = scored.select(F.lit("test").alias("split"), F.lit(14).alias("edition"), F.lit("intra_eu").alias("kind"), "minsep", record.cast("string").alias("record_id"), F.col("unit").cast("string").alias("unit_id"), (record % 5).cast("string").alias("complex_id"), *contacts.METRICS)
    out = contacts.aggregate(named)
    return rounded(out.select("minsep", "auc", "p_at_l", "n_units", "n_sequences", "n_complexes", "units_auc", "sequences_auc", "complexes_auc"))


@query(f"""WITH {PAIRS}, b AS (SELECT *, CASE WHEN j - i >= 24 THEN 'long' WHEN j - i >= 12 THEN 'medium' ELSE 'short' END AS bin FROM x WHERE j - i >= 6), r AS (SELECT *, row_number() OVER (PARTITION BY unit, bin ORDER BY score DESC, i, j) AS r FROM b),
  s AS (SELECT bin, unit, avg(label) FILTER (r <= 60) AS p_at_l, avg(label) FILTER (r <= 30) AS p_at_l2, avg(label) FILTER (r <= 12) AS p_at_l5, (SELECT avg(q) FROM (SELECT avg(y.label) AS q FROM (SELECT unnest(range(1, 11)) AS d), r AS y WHERE y.unit = r.unit AND y.bin = r.bin AND y.r <= 6 * d GROUP BY d)) AS auc FROM r GROUP BY 1, 2, r.unit, r.bin)
  SELECT bin, metric, round(avg(value), 6) AS value FROM (SELECT bin, unit, p_at_l, p_at_l2, p_at_l5, auc FROM s) UNPIVOT (value FOR metric IN (p_at_l, p_at_l2, p_at_l5, auc)) GROUP BY 1, 2""")
def binned_precision(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).withColumn("o", F.struct("i", "j"))
    return rounded(contacts.binned_family(rows, "unit", "o", "length"))


def units(spark: SparkSession, d: str) -> DataFrame:
    """Texts of benchmark as chains of which a to m are canonical; contacts are five letters apart."""
    n = F.length("text")
    whole = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i)
    pairs_ = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 9)), lambda i: F.array(i, i + 8))
    return read(spark, d, "benchmark").select(
        F.concat_ws("/", F.col("item_id").cast("string"), F.lit("global"), F.lit("all")).alias("id"), F.col("item_id").cast("string").alias("record_id"), F.lit("all").alias("unit_id"), F.lit("global").alias("kind"), F.lit("test").alias("split"),
        F.col("text").alias("sequence"), whole.alias("valid_positions"), pairs_.alias("positive_pairs"), (F.col("item_id") % 9 != 0).alias("labels_available"),
    )


@query("SELECT item_id || '/global/all' AS id, 'pairs out of bounds' AS problem FROM benchmark WHERE length(text) < 9 UNION ALL SELECT item_id || '/global/all', 'id is not record/kind/unit' FROM benchmark WHERE item_id % 10 = 0")
def contact_violations(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("record_id").cast("long") % 10 == 0
    return contacts.violations(units(spark, d).withColumn("unit_id", F.when(odd, "other").otherwise(F.col("unit_id"))))


CANON = "ACDEFGHIKLMNPQRSTVWY"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""WITH t AS (SELECT item_id, translate(substr(text, 1, 60), '{LOWER}', '{UPPER}') AS s FROM benchmark), c AS (SELECT item_id, k - 1 AS i, substr(s, k, 1) AS x FROM (SELECT *, unnest(range(1, length(s) + 1)) AS k FROM t)), k AS (SELECT item_id, i FROM c WHERE contains('{CANON}', x)),
  p AS (SELECT a.item_id, a.i, b.i AS j FROM k AS a JOIN k AS b ON a.item_id = b.item_id AND b.i - a.i >= 6), n AS (SELECT t.item_id, count(k.i) AS length FROM t LEFT JOIN k USING (item_id) GROUP BY 1), m AS (SELECT item_id, count(*) AS pairs, sum((j - i = 8)::int) AS hits, sum(i * 31 + j) AS s FROM p GROUP BY 1)
  SELECT item_id || '/global/all' AS id, length::int AS length, CASE WHEN item_id % 9 = 0 THEN 'missing_labels' WHEN length = 0 THEN 'no_retained_members' WHEN pairs IS NULL THEN 'no_eligible_pairs' ELSE 'scorable' END AS status, coalesce(pairs, 0)::int AS pairs, coalesce(hits, 0)::int AS hits,
  CASE WHEN item_id % 9 = 0 THEN 0.0 ELSE coalesce(s, 0)::double END AS total FROM n LEFT JOIN m USING (item_id)""")
def contact_predictions(spark: SparkSession, d: str) -> DataFrame:
    chains = units(spark, d).withColumn("sequence", F.translate(F.substring("sequence", 1, 60), LOWER, UPPER))
    at = F.explode(F.sequence(F.lit(0), F.lit(59)))
    scores = chains.select("id", at.alias("i")).select("id", "i", at.alias("j")).withColumn("score", (F.col("i") * 31 + F.col("j")).cast("double"))
    out = contacts.predictions(chains, scores)
    return out.select("id", "length", "status", F.size("labels").alias("pairs"), F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("hits"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"))


# assays: customers of a nation stand for an assay's variants, regions for functions
VARIANTS = "v AS (SELECT n_name AS dms_id, n_nationkey % 8 AS uniprot_id, n_regionkey AS f, c_custkey AS i, c_acctbal::double AS y, (c_custkey * 37 % 1000 + c_acctbal / 10)::double AS s, (c_acctbal > 5000)::int AS bin FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def variants(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations at any scale
    return rows.select(
        F.col("n_name").alias("dms_id"), (F.col("n_nationkey") % 8).cast("string").alias("uniprot_id"), F.col("n_regionkey").cast("string").alias("coarse_selection_type"), F.col("c_custkey").alias("i"), F.col("c_acctbal").cast("double").alias("dms_score"),
        (F.col("c_custkey") * 37 % 1000 + F.col("c_acctbal") / 10).cast("double").alias("score"), (F.col("c_acctbal") > 5000).cast("int").alias("bin"), "c_custkey",
    )


ASSAYS = f"""a AS (SELECT dms_id, any_value(uniprot_id) AS uniprot_id, any_value(f) AS f, count(*) AS n FROM v GROUP BY 1), r AS (SELECT dms_id, rank() OVER (PARTITION BY dms_id ORDER BY y) + (count(*) OVER (PARTITION BY dms_id, y) - 1) / 2 AS a, rank() OVER (PARTITION BY dms_id ORDER BY s) + (count(*) OVER (PARTITION BY dms_id, s) - 1) / 2 AS b FROM v),
  sp AS (SELECT dms_id, corr(a, b) AS spearman FROM r GROUP BY 1), ct AS (SELECT dms_id, quantile_cont(y, 0.9) AS cy, quantile_cont(s, 0.9) AS cs, quantile_cont(s, 0.5) AS ms FROM v GROUP BY 1),
  tr AS (SELECT dms_id, count(*) FILTER (y >= cy AND s >= cs) / count(*) FILTER (y >= cy) AS top_recall FROM v JOIN ct USING (dms_id) GROUP BY 1),
  k AS (SELECT dms_id, s, sum(bin) AS pos, sum(1 - bin) AS neg FROM v GROUP BY 1, 2), w AS (SELECT *, sum(neg) OVER (PARTITION BY dms_id ORDER BY s) - neg / 2 AS below FROM k), au AS (SELECT dms_id, sum(pos * below) / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY 1),
  q AS (SELECT dms_id, bin AS y, (s >= ms)::int AS p FROM v JOIN ct USING (dms_id)), cn AS (SELECT dms_id, sum(y * p)::double AS tp, sum((1 - y) * p)::double AS fp, sum(y * (1 - p))::double AS fn, sum((1 - y) * (1 - p))::double AS tn FROM q GROUP BY 1), mc AS (SELECT dms_id, {MCC} AS mcc FROM cn),
  m AS (SELECT * FROM a JOIN sp USING (dms_id) JOIN tr USING (dms_id) JOIN au USING (dms_id) JOIN mc USING (dms_id))"""


@query(f"WITH {VARIANTS}, {ASSAYS} SELECT dms_id, n AS num_variants, round(spearman, 6) AS spearman, round(top_recall, 6) AS top_recall, round(auc, 6) AS auc, round(mcc, 6) AS mcc FROM m")
def assay_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assays.all_metrics(variants(spark, d), "i", "dms_score", "bin").drop("ndcg"))


@query(f"""WITH {VARIANTS}, {ASSAYS}, l AS (SELECT * FROM (SELECT dms_id, uniprot_id::varchar AS uniprot_id, f::varchar AS f, n, spearman, auc FROM m) UNPIVOT (value FOR metric IN (spearman, auc))),
  p AS (SELECT metric, f, avg(value) AS value FROM (SELECT metric, f, uniprot_id, avg(value) AS value FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT 'assay' AS scope, dms_id, uniprot_id, f AS coarse_selection_type, n AS num_variants, metric, round(value, 6) AS value, 'trained' AS control FROM l UNION ALL SELECT 'function', NULL, NULL, f, NULL, metric, round(value, 6), 'trained' FROM p
  UNION ALL SELECT 'overall', NULL, NULL, NULL, NULL, metric, round(avg(value), 6), 'trained' FROM p GROUP BY metric""")
def assay_score_table(spark: SparkSession, d: str) -> DataFrame:
    rows = variants(spark, d)
    found = assays.all_metrics(rows, "i", "dms_score", "bin").join(rows.select("dms_id", "uniprot_id", "coarse_selection_type").distinct(), "dms_id")
    return rounded(assays.score_table(found, ["spearman", "auc", "absent"], "trained").select("scope", "dms_id", "uniprot_id", "coarse_selection_type", "num_variants", "metric", "value", "control"))


@query(f"WITH {VARIANTS}, k AS (SELECT s, sum(bin) AS pos, sum(1 - bin) AS neg FROM v GROUP BY 1), w AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg / 2 AS below FROM k) SELECT round(sum(pos * below) / (sum(pos)::double * sum(neg)), 6) AS auc FROM w")
def pooled_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assays.pooled_auc(variants(spark, d), "bin"))


@query(f"""WITH {VARIANTS}, {ASSAYS}, p AS (SELECT f::varchar AS f, uniprot_id::varchar AS u, avg(auc) AS v FROM m GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM p),
  d AS (SELECT f, b, {h("'e|' || f || '|' || b || '|' || i")} % n AS j FROM o, (SELECT unnest(range(0, 100)) AS b)), s AS (SELECT b, f, avg(v) AS v FROM d JOIN o USING (f) WHERE j = i GROUP BY 1, 2) SELECT round(stddev_samp(v), 6) AS standard_error FROM (SELECT b, avg(v) AS v FROM s GROUP BY 1)""")
def standard_error(spark: SparkSession, d: str) -> DataFrame:
    rows = variants(spark, d)
    found = assays.all_metrics(rows, "i", None, "bin").join(rows.select("dms_id", "uniprot_id", "coarse_selection_type").distinct(), "dms_id")
    return rounded(assays.standard_error(found, "auc", 100, "e"))


WILD = f"w AS (SELECT item_id AS dms_id, regexp_replace(translate(substr(text, 1, 50), '{LOWER}', '{UPPER}'), '[^A-Z]', 'A', 'g') AS s FROM benchmark)"


def wild(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("dms_id"), F.regexp_replace(F.translate(F.substring("text", 1, 50), LOWER, UPPER), "[^A-Z]", "A").alias("target_seq"))


@query(f"""WITH {WILD}, v AS (SELECT dms_id, p, substr(s, p, 1) AS a, substr(s, 60 - p, 1) AS b, s FROM (SELECT *, unnest([11, 14, 17, 70]) AS p FROM w))
  SELECT dms_id, p::int AS position, CASE WHEN p <= length(s) THEN round(((ascii(a) * 7 + p) % 13 - (ascii('C') * 7 + p) % 13) / 8.0::double + 0.0, 6) END AS score FROM v""")
def substitution_scores(spark: SparkSession, d: str) -> DataFrame:
    w = wild(spark, d)
    places = w.select("dms_id", "target_seq", F.explode(F.array(*map(F.lit, (11, 14, 17, 70)))).alias("position"))
    own = F.when(F.col("position") <= F.length("target_seq"), F.substring("target_seq", F.col("position"), F.lit(1))).otherwise("A")
    muts = places.select("dms_id", "position", F.concat(own, F.col("position").cast("string"), F.lit("C")).alias("mutant"))
    residues = F.explode(F.array(*(F.lit(chr(c)) for c in range(65, 91))))
    logs = places.select("dms_id", "position", residues.alias("residue")).withColumn("log_prob", ((F.ascii("residue") * 7 + F.col("position")) % 13) / -8.0)
    score = F.nanvl(F.col("score"), F.lit(None).cast("double")) + 0.0
    return rounded(assays.substitution_scores(muts, w, logs).select("dms_id", "position", score.alias("score")))


@query(f"""WITH {WILD}, l AS (SELECT dms_id, sum(-((k * 5 + ascii(substr(s, k, 1))) % 11) / 7.0::double) AS pll, any_value(s) AS s FROM (SELECT *, unnest(range(1, length(s) + 1)) AS k FROM w) GROUP BY 1),
  m AS (SELECT dms_id, substr(s, 4) AS t FROM w), n AS (SELECT dms_id, sum(-((k * 5 + ascii(substr(t, k, 1))) % 11) / 7.0::double) AS pll FROM (SELECT *, unnest(range(1, length(t) + 1)) AS k FROM m) GROUP BY 1)
  SELECT dms_id, round(n.pll - l.pll, 6) AS score FROM l JOIN n USING (dms_id)""")
def indel_scores(spark: SparkSession, d: str) -> DataFrame:
    w = wild(spark, d)
    cut = w.select("dms_id", F.expr("substring(target_seq, 4)").alias("mutated_sequence"))
    logs = lambda t, c, keys: t.select(*keys, F.posexplode(F.split(F.col(c), "")).alias("p", "x")).filter("x <> ''").withColumn("log_prob", -(((F.col("p") + 1) * 5 + F.ascii("x")) % 11) / 7.0)
    mutant = assays.pseudo_log_likelihood(logs(cut, "mutated_sequence", ["dms_id", "mutated_sequence"]), ["dms_id", "mutated_sequence"])
    return rounded(assays.indel_scores(cut, mutant, assays.pseudo_log_likelihood(logs(w, "target_seq", ["dms_id"]), ["dms_id"])).select("dms_id", "score"))


@query()
def ridge_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    x = F.array(F.col("score") / 1000, F.col("i") % 7 / 7)
    return rounded(assays.supervised(variants(spark, d).withColumn("x", x), "i", "x", "dms_score", 5, "cv"), 3)


# calibration: vectors stand for sites with logits of 20 residues, neighbours in the vector for profiles
SITES = """s AS (SELECT vec_id AS id, (vec_id % 3)::int AS fold, (vec_id % 9)::int AS bin, vec_id % 2 = 0 AS is_t, vec_id % 5 <> 0 AS in_balanced, vec_id % 7 = 0 AS in_high_nt, 1048575 >> (vec_id % 11)::int AS mask, embedding[1:20] AS l, list_transform(embedding[21:40], lambda x: x * x + 0.01) AS f FROM embeddings),
  u AS (SELECT id, generate_subscripts(l, 1) - 1 AS i, unnest(l)::double AS x, unnest(f)::double AS p FROM s), t AS (SELECT id, i, x, p / sum(p) OVER (PARTITION BY id) AS p, max(x) OVER (PARTITION BY id) AS m FROM u),
  k AS (SELECT id, sum(p * ln(p)) - sum(p * x) + ln(sum(exp(x - m))) + any_value(m) AS kl, min(i) FILTER (x = m)::int AS predicted FROM t GROUP BY 1)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id")
    return read(spark, d, "embeddings").select(
        i.alias("id"), (i % 3).cast("int").alias("fold"), (i % 9).cast("int").alias("bin"), (i % 2 == 0).alias("is_t"), (i % 5 != 0).alias("in_balanced"), (i % 7 == 0).alias("in_high_nt"), F.call_function("shiftright", F.lit(1048575), (i % 11).cast("int")).alias("consensus_mask"),
        F.slice(v, 1, 20).alias("logits"), F.transform(F.slice("embedding", 21, 20), lambda x: (x * x + F.lit(0.01).cast("float")).cast("double")).alias("profile"),
    )


@query(f"""WITH {SITES}, c AS (SELECT s.*, kl, predicted, unnest(list_filter(['t', 'nt', 'high_nt'], lambda n: CASE n WHEN 't' THEN in_balanced AND is_t WHEN 'nt' THEN in_balanced AND NOT is_t ELSE in_high_nt END)) AS cohort FROM s JOIN k USING (id))
  SELECT cohort, count(*) AS n, round(avg(kl), 4) AS kl, round(100 * exp(-avg(kl)), 3) AS score, round(avg((mask >> predicted) & 1), 6) AS accuracy FROM c GROUP BY 1""")
def calibration_cohorts(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.cohorts(calibration.scored(sites(spark, d), spark.createDataFrame([(f, 1.0) for f in range(3)], "fold int, temperature double")))
    return out.select("cohort", "n", F.round("kl", 4).alias("kl"), F.round("score", 3).alias("score"), F.round("accuracy", 6).alias("accuracy"))


@query()
def calibration_temperatures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.temperatures(sites(spark, d)), 5)


@query("SELECT item_id, round(ln(19), 6) AS own, array_to_string(list_transform(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda x: CASE WHEN x = upper(substr(text, 1, 1)) THEN 1 ELSE 0 END), ',') AS hot FROM benchmark")
def residue_prior_logits(spark: SparkSession, d: str) -> DataFrame:
    logits = calibration.prior_logits(F.upper(F.substring("text", 1, 1)))
    hot = joined(F.transform(logits, lambda x: (x > 0).cast("int")))
    return rounded(read(spark, d, "benchmark").select("item_id", F.log(F.lit(19.0)).alias("own"), hot.alias("hot")))


@query("SELECT round(avg(quality), 6) AS mean, count(quality) AS n FROM labels")
def train_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baselines.train_mean(read(spark, d, "labels"), "quality"))


@query("SELECT doc_id, (SELECT quality FROM labels WHERE quality IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction FROM labels")
def constant_baseline(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels")
    return baselines.constant(labels.select("doc_id"), baselines.majority(labels, "quality").first()["class"])


@query()
def composition_ridge(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").withColumn("text", F.upper("text")).filter(F.length("text") > 30)
    return rounded(baselines.composition_ridge(rows, rows, "text", "quality").select("doc_id", "prediction"), 4)


@query()
def native_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of clusters of the conversations' turns."""
    turns = read(spark, d, "conversations").select(F.format_string("%08d_%04d", F.col("conv_id").cast("long"), F.col("turn").cast("long")).alias("sequence_id"), F.col("text").alias("sequence"))
    return clustering.cascade(turns, [0.9, 0.7, 0.5])


@query()
def nearest_by_kmers(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t, i: read(spark, d, t).select(F.col(i).cast("string").alias("sequence_id"), F.col("text").alias("sequence"))
    hits = clustering.search(side("conversations", "conv_id").dropDuplicates(["sequence_id"]), side("documents", "doc_id"))
    return baselines.best_hit(hits, "query", "bits", "expectation", "target").select("query", "bits")


@query()
def jacobian_contacts(spark: SparkSession, d: str) -> DataFrame:
    cells_ = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("unit"), (F.col("l_orderkey") % 6).alias("i"), (F.col("l_linenumber") % 4).alias("a"), (F.col("l_partkey") % 6).alias("j"), (F.col("l_quantity").cast("long") % 4).alias("b")).agg(F.sum("l_tax").alias("value"))
    return rounded(contacts.jacobian_contacts(cells_, "unit"))
