"""Queries of the engine's own operators over the driver's tables, and their SQL twins.

documents stand for sequences (text is the sequence, source its dataset), labels for scores, embeddings for residue
vectors, lineitem and orders for grouped predictions. Doubles are rounded, as engines add them up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, sequences
from .operators import baselines, corpus, curriculum, inference, metrics, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def base(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("sequence_id"), F.col("text").alias("sequence"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Two nested levels: equal texts, and texts with equal beginnings."""
    docs = read(spark, d, "documents")
    whole, start = F.md5(F.col("text").cast("binary")), F.md5(F.substring("text", 1, 64).cast("binary"))
    keyed = docs.select(F.col("doc_id").alias("sequence_id"), whole.alias("whole"), start.alias("start"))
    a = keyed.groupBy("whole").agg(F.min("sequence_id").alias("cluster_rep_at_90"))
    b = keyed.groupBy("start").agg(F.min("sequence_id").alias("cluster_rep_at_50"))
    return keyed.join(a, "whole").join(b, "start").select("sequence_id", "cluster_rep_at_90", "cluster_rep_at_50")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select(F.col("doc_id").alias("sequence_id"), F.col("quality").alias("score"))


C = """c AS (SELECT doc_id AS sequence_id, text AS sequence, min(doc_id) OVER (PARTITION BY md5(text)) AS cluster_rep_at_90,
  min(doc_id) OVER (PARTITION BY md5(substr(text, 1, 64))) AS cluster_rep_at_50 FROM documents)"""
H = "('0x' || substr(md5({0}), 1, 15))::bigint"


def h(text: str) -> str:
    return H.format(text)


@query(f"WITH {C} SELECT sequence_id, md5(sequence) AS sequence_md5, cluster_rep_at_90, cluster_rep_at_50, 'docs' AS dataset_id, length(sequence)::int AS sequence_length, quality AS score FROM c JOIN labels ON doc_id = sequence_id")
def assemble_inner(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.assemble(base(spark, d), clusters(spark, d), "docs", scores(spark, d))
    return out.withColumn("sequence_md5", F.md5(F.col("sequence").cast("binary"))).drop("sequence")


@query("SELECT count(*) AS unmapped FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmapped_anti(spark: SparkSession, d: str) -> DataFrame:
    return tables.unmapped(base(spark, d), scores(spark, d), "sequence_id")


@query("SELECT c_custkey, m.least FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS least FROM orders GROUP BY 1) m ON o_custkey = c_custkey")
def remap_dedupe_min(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("least"))
    return tables.remap(read(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "least")


@query(f"WITH {C} SELECT sequence_id, cluster_rep_at_90, cluster_rep_at_50 FROM c")
def wide_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = clusters(spark, d)
    return corpus.wide_clusters({n: c.select("sequence_id", n) for n in ("cluster_rep_at_90", "cluster_rep_at_50")})


@query(f"WITH {C} SELECT sequence_id::varchar AS sequence_id, cluster_rep_at_90::varchar AS cluster_rep_at_90, cluster_rep_at_50::varchar AS cluster_rep_at_50 FROM c")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    c = clusters(spark, d)
    text = lambda n: F.col(n).cast("string")
    first = c.select(text("sequence_id").alias("sequence_id"), text("cluster_rep_at_90").alias("cluster_id"))
    second = c.select(text("cluster_rep_at_90").alias("sequence_id"), text("cluster_rep_at_50").alias("cluster_id")).distinct()
    return corpus.compose([(0.9, first), (0.5, second)])


@query("""SELECT count(*) AS num_rows, min(n) AS length_min, max(n) AS length_max, round(avg(n), 6) AS length_mean, round(median(n), 6) AS length_median, round(stddev_samp(n), 6) AS length_std,
  sum(n)::bigint AS length_sum, sum(a)::bigint AS ambiguous_total, count(*) FILTER (a > 0) AS ambiguous_rows, round(sum(a) / sum(n), 6) AS ambiguous_fraction, round(avg(s), 6) AS score_mean, round(median(s), 6) AS score_median,
  round(stddev_samp(s), 6) AS score_std, round(var_samp(s), 6) AS score_var, min(s)::double AS score_min, max(s)::double AS score_max
  FROM (SELECT length(text)::int AS n, length(text) - length(translate(text, 'XBZJ', '')) AS a, quality::double AS s FROM documents JOIN labels USING (doc_id))""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.statistics(corpus.assemble(base(spark, d), clusters(spark, d), "docs", scores(spark, d))))


@query("""WITH s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL)
  SELECT quantile::double AS quantile, v AS value FROM s, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) AS quantile) WHERE i = round_even(quantile * (n - 1), 0)::bigint""")
def quantiles_nearest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.quantiles(read(spark, d, "documents"), "n_chars", [0.05, 0.95])


@query(f"WITH {C} SELECT level, clusters, round(clusters / rows, 6) AS reduction FROM (SELECT count(*) AS rows, count(DISTINCT cluster_rep_at_90) AS cluster_rep_at_90, count(DISTINCT cluster_rep_at_50) AS cluster_rep_at_50 FROM c) UNPIVOT (clusters FOR level IN (cluster_rep_at_90, cluster_rep_at_50))")
def distinct_clusters_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.clusters_found(clusters(spark, d), ["cluster_rep_at_90", "cluster_rep_at_50"]))


@query()
def distinct_clusters_hll(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clusters_found(clusters(spark, d), ["cluster_rep_at_90", "cluster_rep_at_50"], exact=False)


@query("SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def score_mode(spark: SparkSession, d: str) -> DataFrame:
    return corpus.mode(read(spark, d, "lineitem"), "l_quantity")


@query("""WITH b AS (SELECT min(n_chars)::double AS low, max(n_chars)::double AS high FROM documents), w AS (SELECT low, (high - low) / 50 AS w FROM b),
  k AS (SELECT greatest(1, least(50, ceil((n_chars - low) / w)))::int AS bin, count(*) AS n FROM documents, w GROUP BY 1)
  SELECT bin::int AS bin, round(low + (bin - 1) * w, 6) AS lower, round(low + bin * w, 6) AS upper, coalesce(n, 0)::bigint AS n FROM (SELECT unnest(range(1, 51))::int AS bin) LEFT JOIN k USING (bin), w""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.histogram(read(spark, d, "documents"), "n_chars"))


@query("""SELECT round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(greatest(a, q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(least(b, q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM
  (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, min(v) AS a, max(v) AS b FROM (SELECT n_chars::double AS v FROM documents))""")
def tukey_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.box(read(spark, d, "documents"), "n_chars"))


MOD = "((('0x' || substr(md5({0}), 1, 16))::ubigint::hugeint % 20 * 16 + ('0x' || substr(md5({0}), 17, 16))::ubigint::hugeint % 20) % 20)"


@query(f"WITH {C} SELECT CASE WHEN {MOD.format('cluster_rep_at_50::varchar')} = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM c GROUP BY 1")
def holdout_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.split(clusters(spark, d), "cluster_rep_at_50").groupBy("split").agg(F.count("*").alias("n"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select(key.alias("row_id"), (F.col("o_custkey") % 100).alias("cluster"), (F.floor("o_totalprice") % 11 / 100.0).alias("score"), (key % 97).cast("int").alias("sequence_length"))


S = "s AS (SELECT o_orderkey AS row_id, o_custkey % 100 AS cluster, (floor(o_totalprice)::bigint % 11 / 100.0)::double AS score, (o_orderkey % 97)::int AS sequence_length FROM orders)"
S += ", x AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC NULLS LAST, row_id)::int AS rn FROM s)"


@query(f"WITH {S} SELECT * FROM x")
def cluster_index(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.cluster_index(scored(spark, d), "cluster", "score", "row_id")


@query(f"WITH {S} SELECT cluster, count(*) FILTER (score >= 0.05) AS valid FROM s GROUP BY 1")
def valid_counts(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.valid_counts(scored(spark, d), "cluster", "score", 0.05)


@query(f"""WITH {S}, v AS (SELECT cluster, count(*) FILTER (score >= 0.05) AS valid FROM s GROUP BY 1 HAVING valid > 0)
  SELECT 'lines' AS source, row_id, sequence_length, {h("'e1|lines|' || row_id")} AS shuffle FROM x JOIN v USING (cluster) WHERE rn = 1 + {h("'s1|' || cluster")} % valid""")
def epoch_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    chosen = curriculum.pick(curriculum.cluster_index(rows, "cluster", "score", "row_id"), curriculum.valid_counts(rows, "cluster", "score", 0.05), "cluster", "s1")
    return curriculum.epoch_plan({"lines": chosen}, "row_id", "sequence_length", "e1")


@query(f"SELECT o_orderkey FROM orders ORDER BY {h('''('f|' || o_orderkey)''')}, o_orderkey LIMIT (SELECT greatest(1, round_even(count(*) * 0.1, 0))::bigint FROM orders)")
def source_fraction(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.keep_fraction(read(spark, d, "orders").select("o_orderkey"), 0.1, "o_orderkey", "f")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) + 2 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
  p AS (SELECT conv_id, turn, r, cost AS used, 0::bigint AS batch FROM t WHERE r = 1 UNION ALL
  SELECT t.conv_id, t.turn, t.r, CASE WHEN p.used + t.cost > 400 THEN t.cost ELSE p.used + t.cost END, CASE WHEN p.used + t.cost > 400 THEN p.batch + 1 ELSE p.batch END FROM p JOIN t ON t.conv_id = p.conv_id AND t.r = p.r + 1)
  SELECT conv_id, turn, batch FROM p""")
def token_packing(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    return curriculum.pack_batches(turns, "conv_id", "turn", "n", 400)


@query("""WITH u AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::double AS x FROM embeddings), n AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-8) AS norm FROM u GROUP BY 1),
  p AS (SELECT label, d, sum(x / norm) AS x, count(*) AS n FROM u JOIN n USING (vec_id) GROUP BY 1, 2) SELECT label, max(n) AS n, round(CASE WHEN max(n) <= 1 THEN 0 ELSE 1 - (sum(x * x) - max(n)) / (max(n) * (max(n) - 1.0)) END, 6) AS red FROM p GROUP BY 1""")
def red_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.redundancy(read(spark, d, "embeddings"), ["label"], "embedding"))


@query("SELECT label, (d - 1)::int AS d, round(avg(x), 6) AS value FROM (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1, 2")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.mean_pool(read(spark, d, "embeddings"), ["label"], "embedding"))


@query("SELECT (d - 1)::int AS d, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS std FROM (SELECT generate_subscripts(embedding, 1) AS d, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1")
def feature_standardise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.standardisation(read(spark, d, "embeddings"), "embedding"))


@query("SELECT o_orderpriority, o_orderstatus AS label, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS prediction, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").withColumn("p", F.when(F.col("o_totalprice") > 150000, "F").otherwise("O"))
    return metrics.confusion(rows, ["o_orderpriority"], "o_orderstatus", "p")


@query("""WITH c AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS p FROM orders), k AS (SELECT DISTINCT y AS c FROM c UNION SELECT DISTINCT p FROM c),
  o AS (SELECT c, (SELECT count(*) FROM c x WHERE x.y = k.c) AS t, (SELECT count(*) FROM c x WHERE x.p = k.c) AS p, (SELECT count(*) FROM c x WHERE x.p = k.c AND x.y = k.c) AS h FROM k),
  m AS (SELECT t, p, h, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, CASE WHEN t > 0 THEN h / t ELSE 0 END AS rc, 2 * h / (t + p) AS f1 FROM o)
  SELECT round(sum(h) / sum(t), 6) AS accuracy, round(avg(pr), 6) AS precision_macro, round(sum(pr * t) / sum(t), 6) AS precision_weighted, round(avg(rc), 6) AS recall_macro, round(sum(rc * t) / sum(t), 6) AS recall_weighted,
  round(avg(f1), 6) AS f1_macro, round(sum(f1 * t) / sum(t), 6) AS f1_weighted,
  round((sum(h) * sum(t) - sum(t * p)) / (sqrt(sum(t)::double ^ 2 - sum(p * p)) * sqrt(sum(t)::double ^ 2 - sum(t * t))), 6) AS mcc FROM m""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").withColumn("p", F.when(F.col("o_totalprice") > 150000, "F").otherwise("O"))
    return rounded(metrics.classification(metrics.confusion(rows, [], "o_orderstatus", "p"), []))


Y = "y AS (SELECT l_returnflag AS g, (l_discount >= 0.05)::int AS y, l_quantity AS s, l_extendedprice AS e, l_orderkey * 10 + l_linenumber AS i FROM lineitem)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") >= 0.05).cast("int").alias("y"), F.col("l_quantity").alias("s"), F.col("l_extendedprice").alias("e"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))


@query(f"WITH {Y}, k AS (SELECT g, s, sum(y) AS p, sum(1 - y) AS n FROM y GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY s) - n AS b FROM k) SELECT g, round(sum(p * (b + n / 2)) / (sum(p)::double * sum(n)), 6) AS auc FROM w GROUP BY 1")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_auc(judged(spark, d), ["g"], "y", "s"))


@query(f"WITH {Y}, k AS (SELECT g, s, sum(y) AS p, count(*) AS n FROM y GROUP BY 1, 2), w AS (SELECT *, sum(p) OVER q / sum(n) OVER q AS r FROM k WINDOW q AS (PARTITION BY g ORDER BY s DESC)) SELECT g, round(sum(p * r) / sum(p), 6) AS average_precision FROM w GROUP BY 1")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(judged(spark, d), ["g"], "y", "s"))


@query(f"WITH {Y} SELECT g, count(*) AS n, round(avg((e - s) ^ 2), 3) AS mse, round(avg(abs(e - s)), 3) AS mae, round(1 - sum((e - s) ^ 2) / (var_pop(e) * count(*)), 3) AS r2, round(corr(e, s), 3) AS pearson FROM y GROUP BY 1")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.regression(judged(spark, d), ["g"], "e", "s"), 3)


@query(f"WITH {Y}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY e) + (count(*) OVER (PARTITION BY g, e) - 1) / 2 AS a, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2 AS b FROM y) SELECT g, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def spearman_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.spearman(judged(spark, d), ["g"], "e", "s"))


@query(f"""WITH {Y}, t AS (SELECT *, min(e) OVER w AS a, max(e) OVER w AS b, floor(count(*) OVER w * 0.1) AS k FROM y WINDOW w AS (PARTITION BY g)), u AS (SELECT *, (e - a) / (b - a) AS x FROM t),
  r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, i) AS r, row_number() OVER (PARTITION BY g ORDER BY x DESC, i) AS q FROM u)
  SELECT g, round(sum(x / log2(r + 1)) FILTER (r <= k) / sum(x / log2(q + 1)) FILTER (q <= k), 6) AS ndcg FROM r GROUP BY 1""")
def ndcg_decile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ndcg(judged(spark, d), ["g"], "e", "s", "i"))


@query(f"WITH {Y}, c AS (SELECT g, quantile_cont(e, 0.9) AS ce, quantile_cont(s, 0.9) AS cs FROM y GROUP BY 1) SELECT g, round(count(*) FILTER (e >= ce AND s >= cs) / count(*) FILTER (e >= ce), 6) AS top_recall FROM y JOIN c USING (g) GROUP BY 1")
def top_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.top_recall(judged(spark, d), ["g"], "e", "s"))


@query("""WITH x AS (SELECT l_orderkey AS k, (l_discount >= 0.05)::int AS y, l_tax * 12 AS p FROM lineitem), n AS (SELECT k, sum(y) AS y FROM x GROUP BY 1 HAVING sum(y) > 0),
  t AS (SELECT unnest(range(1, 101)) AS t), e AS (SELECT t, k, sum(x.y) AS h, count(*) AS a, any_value(n.y) AS l FROM x JOIN n USING (k) JOIN t ON round(p * 100, 9) >= t GROUP BY 1, 2),
  c AS (SELECT t, avg(h / a) AS p, sum(h / l) / (SELECT count(*) FROM n) AS r FROM e GROUP BY 1) SELECT round(max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS fmax FROM c""")
def fmax(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") >= 0.05).cast("int").alias("y"), (F.col("l_tax") * 12).alias("p"))
    return rounded(metrics.f_max(rows, "l_orderkey", "y", "p"))


MCC = "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn)) * sqrt((tn + fp) * (tn + fn)), 0), 0)"
#: Orders stand for rows and suppliers for terms; a label and a prediction by line.
CELLS = "c AS (SELECT l_orderkey, l_suppkey, CAST(l_discount >= 0.05 AS INT) AS y, l_tax AS s, CAST(l_tax >= 0.04 AS INT) AS p FROM lineitem)"
COUNTS = "CAST(count(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND p = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS tn"


def cells(spark: SparkSession, d: str) -> DataFrame:
    y, p = (F.col("l_discount") >= 0.05).cast("int").alias("y"), (F.col("l_tax") >= 0.04).cast("int").alias("p")
    return read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", y, F.col("l_tax").alias("s"), p)


@query(f"""WITH {CELLS}, t AS (SELECT l_suppkey, {COUNTS} FROM c GROUP BY 1), r AS (SELECT l_orderkey, {COUNTS} FROM c GROUP BY 1), m AS (SELECT *, {MCC} AS mcc FROM t),
  a AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM t)
  SELECT (SELECT round({MCC}, 6) FROM a) AS mcc_micro, round(avg(mcc), 6) AS mcc_macro, round(sum(mcc * (tp + fn)) / sum(tp + fn), 6) AS mcc_weighted, (SELECT round(avg({MCC}), 6) FROM r) AS mcc_samples FROM m""")
def multilabel_mcc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.multilabel_mcc(cells(spark, d), "l_orderkey", "l_suppkey", "y", "p"))


@query(f"""WITH {CELLS}, k AS (SELECT l_suppkey, s, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY 1, 2),
  w AS (SELECT *, sum(pos) OVER q / sum(pos + neg) OVER q AS r, coalesce(sum(neg) OVER (PARTITION BY l_suppkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2 AS below FROM k WINDOW q AS (PARTITION BY l_suppkey ORDER BY s DESC)),
  e AS (SELECT l_suppkey, sum(pos) AS n, coalesce(sum(pos * r) / nullif(sum(pos), 0), 0) AS ap, sum(pos * below) / nullif(sum(pos) * sum(neg), 0) AS auc FROM w GROUP BY 1)
  SELECT round(avg(ap), 6) AS ap_macro, round(sum(ap * n) / sum(n), 6) AS ap_weighted, round(avg(auc), 6) AS auc_macro FROM e""")
def multilabel_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.multilabel_ranking(cells(spark, d), "l_suppkey", "y", "s"))


@query("SELECT l_returnflag, round(avg(-l_tax * 10), 6) AS mean_log_prob, round(exp(-avg(-l_tax * 10)), 6) AS pseudo_perplexity FROM lineitem GROUP BY 1")
def pseudo_perplexity(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_returnflag", (-F.col("l_tax") * 10).alias("lp"))
    return rounded(metrics.pseudo_perplexity(rows, ["l_returnflag"], "lp"))


@query(f"""WITH b AS (SELECT l_returnflag AS g, CAST(l_discount >= 0.05 AS INT) AS y, l_extendedprice AS s FROM lineitem), k AS (SELECT g, median(s) AS m FROM b GROUP BY 1),
  c AS (SELECT g, y, CAST(s >= m AS INT) AS p FROM b JOIN k USING (g)), t AS (SELECT g, {COUNTS} FROM c GROUP BY 1) SELECT g, round({MCC}, 6) AS mcc FROM t""")
def assay_mcc(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") >= 0.05).cast("int").alias("y"), F.col("l_extendedprice").alias("s"))
    return rounded(metrics.assay_mcc(rows, ["g"], "y", "s"))


@query("""WITH a AS (SELECT n_regionkey AS region, n_nationkey AS nation, avg(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
  SELECT region, round(avg(v), 6) AS c_acctbal, count(v) AS contributors FROM a GROUP BY 1""")
def hierarchical_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations at any scale
    return rounded(metrics.hierarchy(rows.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), "c_acctbal"), "c_acctbal", ["region", "nation"]))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("SELECT source, count(DISTINCT (lang)) AS combinations FROM documents GROUP BY 1 HAVING count(DISTINCT (lang)) > 1")
def inconsistent_groups(spark: SparkSession, d: str) -> DataFrame:
    return tables.inconsistent(read(spark, d, "documents"), ["source"], ["lang"])


U = "u AS (SELECT s_suppkey AS k, s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)"


@query(f"""WITH {U}, n AS (SELECT count(*) AS n FROM u), m AS (SELECT b, avg(v) AS v FROM (SELECT b, {h("'boot|' || b || '|' || i")} % n AS j FROM u, n, (SELECT unnest(range(0, 200)) AS b)) JOIN u ON u.i = j GROUP BY 1)
  SELECT round(avg(v), 4) AS mean, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM m""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    drawn = inference.resamples(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", 200, "boot")
    means = drawn.groupBy("resample").agg((F.sum(F.col("s_acctbal") * F.col("multiplicity")) / F.sum("multiplicity")).alias("v"))
    return rounded(inference.interval(means, [], "v"), 4)  # quantiles of cents have seven digits, the last often 5


@query(f"""WITH u AS (SELECT o_orderkey AS k, avg(l_quantity) - avg(l_extendedprice) / 1500 AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), o AS (SELECT avg(d) AS o FROM u),
  m AS (SELECT t, avg(CASE WHEN ({h("'perm|' || t // 30 || '|' || k")} >> (t % 30)::int) % 2 = 0 THEN d ELSE -d END) AS m FROM u, (SELECT unnest(range(0, 100)) AS t) GROUP BY 1)
  SELECT round(o, 6) AS observed, round((count(*) FILTER (abs(m) >= abs(o) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM m, o GROUP BY o""")
def permutation_p(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.avg("l_quantity").alias("a"), (F.avg("l_extendedprice") / 1500).alias("b"))
    units = units.join(read(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", "left_semi")
    return rounded(inference.permutation_p(units, "k", "a", "b", 100, "perm", two_sided=True))


@query("""WITH p AS (SELECT p_brand AS g, p_partkey AS k, (p_size / 100.0)::double AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY g ORDER BY p) AS r, count(*) OVER (PARTITION BY g) AS n FROM p)
  SELECT g, k, round(p, 6) AS p, round(least(1.0, min(p * n / r) OVER (PARTITION BY g ORDER BY p DESC)), 6) AS q FROM r""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), (F.col("p_size") / 100.0).alias("p"))
    return rounded(inference.benjamini_hochberg(rows, ["g"], "p"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem),
  b AS (SELECT ps AS k, i, row_number() OVER (PARTITION BY ps ORDER BY i) AS r FROM (SELECT p_partkey AS i, p_partkey % 100 + 1 AS ps FROM part)) SELECT k, l_orderkey * 10 + l_linenumber AS i, b.i AS j, (b.i IS NOT NULL AND l_orderkey IS NOT NULL) AS matched FROM a FULL JOIN b USING (k, r)""")
def multiset_align(spark: SparkSession, d: str) -> DataFrame:
    left = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))
    right = read(spark, d, "part").select((F.col("p_partkey") % 100 + 1).alias("k"), F.col("p_partkey").alias("j"))
    return tables.align_multiset(left, right, ["k"], "i", "j")


@query("""SELECT c_nationkey AS k, 'test' AS split, 1.0::double AS value, NULL::double AS extra FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
  UNION ALL SELECT DISTINCT s_nationkey, 'test', NULL::double, 2.0::double FROM supplier WHERE s_acctbal > 5000""")
def report_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct().withColumn("value", F.lit(1.0))
    new = read(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.lit("test").alias("split"), F.lit(2.0).alias("extra")).distinct()
    return tables.upsert(stored, new, ["k", "split"]).select("k", "split", "value", "extra")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def subset_filter(spark: SparkSession, d: str) -> DataFrame:
    return tables.subset(read(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_orderstatus")


@query("SELECT item_id, list_concat(list_concat([1], list_transform(string_split(text, '')[1:62], x -> CASE WHEN x BETWEEN 'a' AND 'e' THEN ascii(x) - 92 ELSE 3 END)), [2])::int[] AS ids FROM benchmark".replace("x ->", "lambda x:"))
def tokenise_crop(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = {c: 5 + i for i, c in enumerate("abcde")}
    return read(spark, d, "benchmark").select("item_id", sequences.tokenise(F.col("text"), vocabulary, 1, 2, 3, 64).alias("ids"))


@query("SELECT item_id || ':' || (i - 1) AS id, (i - 1)::int AS position, substr(text, i, 1) AS residue, substr(text, 1, i - 1) || '?' || substr(text, i + 1) AS masked FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)")
def masked_expand(spark: SparkSession, d: str) -> DataFrame:
    return baselines.masked_rows(read(spark, d, "benchmark"), "item_id", "text")


@query("SELECT k::int AS class, count(label) AS n, round(count(label) / (SELECT count(*) FROM embeddings), 6) AS prior FROM (SELECT unnest(range(0, 12)) AS k) LEFT JOIN embeddings ON label = k GROUP BY 1")
def class_priors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baselines.class_counts(read(spark, d, "embeddings"), "label", 12))


@query("SELECT label AS class, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    return baselines.majority(read(spark, d, "embeddings"), "label")


@query("""WITH c AS (SELECT CASE WHEN x BETWEEN 'a' AND 'e' THEN x ELSE 'X' END AS letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS x FROM documents) WHERE x <> '' GROUP BY 1),
  a AS (SELECT letter, coalesce(n, 0) + 1 AS n FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'X']) AS letter) LEFT JOIN c USING (letter)) SELECT letter, round(ln(n / sum(n) OVER ()), 6) AS log_probability FROM a""")
def aa_frequency_logprob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baselines.letter_log_probabilities(read(spark, d, "documents"), "text", "abcde"))


@query("""WITH u AS (SELECT conv_id AS unit, list(turn::int ORDER BY turn) AS p FROM conversations GROUP BY 1), i AS (SELECT unit, unnest(p) AS i, p FROM u), j AS (SELECT unit, i, unnest(p) AS j FROM i)
  SELECT unit, i, j, (j - i = 3)::int AS label, round(1 / (1 + abs(i - j)), 6) AS prior FROM j WHERE j - i >= 2""")
def contact_pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("unit")).agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("p"))
    units = turns.withColumn("true", F.transform("p", lambda x: F.array(x, x + 3)))
    return rounded(baselines.contact_pairs(units, "unit", "p", "true", 2))


L = "x AS (SELECT l_suppkey AS unit, l_orderkey AS i, l_orderkey + l_linenumber * 3 AS j, l_extendedprice AS score, (l_discount >= 0.05)::int AS label, 60 AS length FROM lineitem)"


@query(f"""WITH {L}, k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, i, j) AS r, count(*) OVER (PARTITION BY unit) AS n FROM x WHERE j - i >= 6), y AS (SELECT *, sum(label) OVER (PARTITION BY unit ORDER BY r ROWS UNBOUNDED PRECEDING) AS hits FROM k),
  c AS (SELECT unit, d, hits / r AS p FROM y, (SELECT unnest(range(1, 11)) AS d) WHERE r = greatest(1, least(n, (length * d) // 10)))
  SELECT unit, round(avg(p), 6) AS auc, round(max(p) FILTER (d = 10), 6) AS p_at_l, round(max(p) FILTER (d = 5), 6) AS p_at_l2, round(max(p) FILTER (d = 2), 6) AS p_at_l5 FROM c GROUP BY 1""")
def precision_at_l(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("i"), (F.col("l_orderkey") + F.col("l_linenumber") * 3).alias("j"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") >= 0.05).cast("int").alias("label"), F.lit(60).alias("length"))
    return rounded(metrics.contact_precision(rows, "unit", "length"))


@query("""WITH x AS (SELECT c_mktsegment AS unit, c_nationkey AS i, n_regionkey AS j, sum(c_acctbal) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3)
  SELECT unit, i, j, round(value - sum(value) OVER (PARTITION BY unit, i) * sum(value) OVER (PARTITION BY unit, j) / sum(value) OVER (PARTITION BY unit), 3) AS value FROM x""")
def product_correction(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations at any scale
    cells = joined.groupBy(F.col("c_mktsegment").alias("unit"), F.col("c_nationkey").alias("i"), F.col("n_regionkey").alias("j")).agg(F.sum("c_acctbal").alias("value"))
    return rounded(baselines.product_corrected(cells, "unit"), 3)


@query(f"""WITH a AS (SELECT o_orderpriority AS g, o_orderkey AS i, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {h("'scr|' || o_orderkey")}, o_orderkey) AS q FROM orders)
  SELECT x.g, x.i, y.v FROM a x JOIN a y ON x.g = y.g AND x.r = y.q""")
def label_scramble(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    return inference.shuffled(rows, ["g"], "i", "v", "scr")


@query(f"SELECT p_partkey, ((row_number() OVER (ORDER BY {h('''('k|' || p_partkey)''')}, p_partkey) - 1) % 5)::int AS fold FROM part")
def k_folds(spark: SparkSession, d: str) -> DataFrame:
    return curriculum.folds(read(spark, d, "part").select("p_partkey"), "p_partkey", 5, "k")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) JOIN customer ON c_custkey = o_custkey WHERE r = 1")
def best_hit(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice").withColumn("e", F.lit(0.0))
    return baselines.best_hit(hits, "c_custkey", "o_totalprice", "e", "o_orderkey").join(read(spark, d, "customer").select("c_custkey"), "c_custkey").drop("e")


@query("SELECT o_orderpriority, metric, round(value, 3) AS value FROM (SELECT o_orderpriority, avg(o_totalprice) AS mean, max(o_totalprice) AS most FROM orders GROUP BY 1) UNPIVOT (value FOR metric IN (mean, most))")
def long_report(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return rounded(inference.long_report(wide, ["o_orderpriority"], ["mean", "most"]), 3)


@query("SELECT doc_id, 'DOC_' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::varchar, 12, '0') AS sequence_id FROM documents")
def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    from .operators.ranges import numbered

    docs = numbered(read(spark, d, "documents").select("doc_id"), ["doc_id"], "n")
    return docs.select("doc_id", sequences.sequence_id("DOC", F.col("n")).alias("sequence_id"))


@query(f"SELECT doc_id, {h('doc_id::varchar')} AS hash, round({h('doc_id::varchar')} / 1152921504606846976.0::double, 9) AS uniform FROM documents")
def keyed_hash(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    return rounded(read(spark, d, "documents").select("doc_id", hashing.h60(k).alias("hash"), hashing.uniform(k).alias("uniform")), 9)
