"""Queries of sequences, batches and model outputs. Letters of texts stand for residues, their codes for token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import h, query, read, rounded
from .functions import sequences
from .operators import alignment, baselines, batching, calibration, contacts, curriculum
from .sources import stores


def ids_of(text: Column, most: int = 40) -> Column:
    """Codes of the first letters."""
    return F.transform(sequences.letters(F.substring(text, 1, most)), F.ascii)


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


@query("SELECT source, sum(length(text) - length(translate(text, 'XBZJ', '')))::bigint AS ambiguous, count(*) FILTER (length(text) > length(translate(text, 'XBZJ', ''))) AS texts FROM documents GROUP BY 1")
def ambiguous_counts(spark: SparkSession, d: str) -> DataFrame:
    n = sequences.ambiguous(F.col("text"))
    return read(spark, d, "documents").groupBy("source").agg(F.sum(n).cast("long").alias("ambiguous"), F.count_if(n > 0).alias("texts"))


@query("""WITH u AS (SELECT item_id, unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS letter, text FROM benchmark), c AS (SELECT item_id, letter, length(text) - length(replace(text, letter, '')) AS n FROM u)
  SELECT item_id, letter, round(n / sum(n) OVER (PARTITION BY item_id), 6) AS share FROM c""")
def composition(spark: SparkSession, d: str) -> DataFrame:
    shares = sequences.composition(F.col("text"), "abcdefgh")
    rows = read(spark, d, "benchmark").select("item_id", F.posexplode(shares).alias("i", "share"))
    return rounded(rows.select("item_id", F.substring(F.lit("abcdefgh"), F.col("i") + 1, F.lit(1)).alias("letter"), "share"))


@query("SELECT md5(text) AS sequence_md5, quality AS score, lang, source, length(text)::int AS sequence_length FROM documents JOIN labels USING (doc_id)")
def prepared_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").withColumnRenamed("quality", "score")
    out = stores.prepared_columns(rows, "text", "score", ["source", "lang"])
    return out.select(F.md5(F.col("text").cast("binary")).alias("sequence_md5"), "score", "lang", "source", "sequence_length")


@query("SELECT count(*) AS n, count(*) AS in_one_bucket FROM documents")
def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    own = sum((stores.bucket(F.col("doc_id"), 7, i).cast("int") for i in range(7)), F.lit(0))
    return read(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(own == 1).alias("in_one_bucket"))


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {h('''('v|' || doc_id)''')}, doc_id) <= (SELECT round_even(count(*) * 0.1, 0) FROM documents) THEN 'validation' ELSE 'train' END AS split FROM documents")
def carved_validation(spark: SparkSession, d: str) -> DataFrame:
    return stores.carve_validation(read(spark, d, "documents").select("doc_id", F.lit("train").alias("split")), "doc_id", 0.1, "v")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'train' WHEN 'F' THEN 'test' END AS split FROM orders WHERE o_orderstatus IN ('O', 'F')")
def split_roles(spark: SparkSession, d: str) -> DataFrame:
    return stores.roles(read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), {"train": "O", "test": "F"}, ("train", "test"))


@query(f"""WITH n AS (SELECT count(*) AS n, 8 * least(count(*) // 32, 50) AS run FROM documents), s AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {h("'g|' || doc_id")}, doc_id) - 1 AS n FROM documents),
  p AS (SELECT doc_id, n_chars, (s.n // run) * run + row_number() OVER (PARTITION BY s.n // run ORDER BY n_chars DESC, s.n) - 1 AS place FROM s, n), t AS (SELECT min(place) AS top FROM p WHERE n_chars = (SELECT max(n_chars) FROM p))
  SELECT doc_id, n_chars, (CASE WHEN place = top THEN 0 WHEN place = 0 THEN top ELSE place END)::bigint AS place FROM p, t""")
def length_grouped(spark: SparkSession, d: str) -> DataFrame:
    return batching.length_grouped(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8, "g")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
  p AS (SELECT conv_id, turn, r, cost AS used, 0::bigint AS batch FROM t WHERE r = 1 UNION ALL
  SELECT t.conv_id, t.turn, t.r, CASE WHEN p.used + t.cost > 300 THEN t.cost ELSE p.used + t.cost END, CASE WHEN p.used + t.cost > 300 THEN p.batch + 1 ELSE p.batch END FROM p JOIN t ON t.conv_id = p.conv_id AND t.r = p.r + 1)
  SELECT conv_id, turn, batch FROM p""")
def evaluation_batches(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    return batching.evaluation_batches(turns, "conv_id", "turn", "n", 300)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 5 AND o_custkey < (SELECT (max(o_custkey) + 1) // 7 * 7 FROM orders)")
def even_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.remaining(batching.even_batches(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7), "o_custkey", 5)


@query(f"SELECT item_id, s::int AS start, substr(text, s + 1, 40) AS kept, '-1,' || array_to_string(range(s, s + least(40, length(text))), ',') || ',-1' AS positions FROM (SELECT *, CASE WHEN length(text) <= 40 THEN 0 ELSE {h("'c|' || item_id")} % (length(text) - 39) END AS s FROM benchmark)")
def cropped(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "benchmark").withColumn("r", F.transform(sequences.letters(F.col("text")), F.ascii))
    out = batching.cropped(rows, "item_id", "r", 40, "c", 1, 2)
    kept = F.array_join(F.transform(F.slice("input_ids", 2, F.size("input_ids") - 2), lambda x: F.char(x)), "")
    return out.select("item_id", F.get("original_positions", F.lit(1)).alias("start"), kept.alias("kept"), joined(F.col("original_positions")).alias("positions"))


FIRST = "u AS (SELECT item_id, unnest(range(1, least(40, length(text)) + 1)) AS k, text FROM benchmark), c AS (SELECT item_id, (k - 1)::int AS i, ascii(substr(text, k, 1)) AS x FROM u)"


@query(f"""WITH {FIRST}, f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM c WHERE x <> 32), m AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS p, row_number() OVER (PARTITION BY item_id ORDER BY {h("'m|' || item_id || '|' || i")}, x) AS q FROM f WHERE r > 1),
  a AS (SELECT m.item_id, m.i, o.x FROM m JOIN m AS o ON m.item_id = o.item_id AND m.p = o.q UNION ALL SELECT item_id, i, x FROM c WHERE x = 32 UNION ALL SELECT item_id, i, x FROM f WHERE r = 1)
  SELECT item_id, string_agg(x, ',' ORDER BY i) AS ids FROM a GROUP BY 1""")
def scrambled_sequence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", joined(batching.scrambled(ids_of(F.col("text")), [32], F.col("item_id"), "m")).alias("ids"))


@query(f"""WITH {FIRST}, p AS (SELECT *, x <> 32 AND {h("'k|' || item_id || '|' || i")} / 1152921504606846976.0::double < 0.15 AS hit FROM c), f AS (SELECT item_id, list(i ORDER BY i) FILTER (x <> 32) AS free, count(*) FILTER (hit) AS hits FROM p GROUP BY 1),
  o AS (SELECT item_id, hits, free[1 + {h("'k|one|' || item_id")} % len(free)] AS one FROM f)
  SELECT item_id, string_agg(CASE WHEN hit OR (hits = 0 AND i = one) THEN 3 ELSE x END, ',' ORDER BY i) AS input_ids, string_agg(CASE WHEN hit OR (hits = 0 AND i = one) THEN x ELSE -100 END, ',' ORDER BY i) AS labels FROM p JOIN o USING (item_id) GROUP BY 1""")
def corrupted(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "benchmark").withColumn("ids", ids_of(F.col("text")))
    return batching.corrupted(rows, "item_id", "ids", 3, [32], "k", rate=0.15).select("item_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"))


T = """t AS (SELECT conv_id, turn, least(20, length(text))::int AS n, text FROM conversations), s AS (SELECT conv_id, sum(n)::int AS total, max(n)::int AS most, count(*)::int AS k FROM t GROUP BY 1)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", ids_of(F.col("text"), 20).alias("ids"))


@query(f"""WITH {T}, b AS (SELECT conv_id, string_agg(upto, ',' ORDER BY turn) AS borders FROM (SELECT conv_id, turn, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn))::int AS upto FROM t) GROUP BY 1)
  SELECT conv_id, '0,' || borders || ',' || (total + (8 - total % 8) % 8) AS cu_seqlens, greatest(most, (8 - total % 8) % 8)::int AS max_seqlen, k AS num_sequences, total AS num_tokens, (total + (8 - total % 8) % 8)::int AS buffer FROM s JOIN b USING (conv_id)""")
def packed_batches(spark: SparkSession, d: str) -> DataFrame:
    out = batching.packed(turns(spark, d), "conv_id", "turn", "ids", 0, 8)
    return out.select("conv_id", joined(F.col("cu_seqlens")).alias("cu_seqlens"), "max_seqlen", "num_sequences", "num_tokens", F.size("input_ids").alias("buffer"))


@query(f"SELECT conv_id, k * (most + (8 - most % 8) % 8) AS cells, total AS kept, k AS rows FROM (SELECT conv_id, total, most, k FROM (WITH {T} SELECT * FROM s))")
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    out = batching.padded(turns(spark, d), "conv_id", "turn", "ids", 0, 8)
    flat = F.flatten("attention_mask")
    return out.select("conv_id", F.size(F.flatten("input_ids")).alias("cells"), F.aggregate(flat, F.lit(0), lambda a, x: a + x).alias("kept"), F.size("input_ids").alias("rows"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS place, array_to_string(list_transform(string_split(substr(text, 1, 20), ''), lambda x: ascii(x)), ',') AS ids FROM conversations WHERE text <> ''")
def unpacked_batches(spark: SparkSession, d: str) -> DataFrame:
    packed = batching.packed(turns(spark, d), "conv_id", "turn", "ids", 0, 8)
    return batching.unpacked(packed, "conv_id").select("conv_id", "place", joined(F.col("ids")).alias("ids")).filter("ids <> ''")


@query("SELECT item_id, regexp_replace(substr(text, 1, 40), '[^a-z]', '', 'g') AS sequence FROM benchmark")
def decoded(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = {chr(97 + i): 5 + i for i in range(26)} | {"<b>": 1, "<e>": 2, "<u>": 3}
    ids = sequences.tokenise(F.substring("text", 1, 40), {k: v for k, v in vocabulary.items() if len(k) == 1}, 1, 2, 3)
    return read(spark, d, "benchmark").select("item_id", batching.decoded(ids, vocabulary, [1, 2, 3]).alias("sequence"))


@query("""WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::double AS x FROM embeddings), a AS (SELECT vec_id, min(i) FILTER (x = m)::int AS argmax, count(*) FILTER (1 / (1 + exp(-x)) > 0.5)::int AS decided, ln(sum(exp(x - m))) + any_value(m) AS total, max(x) FILTER (i = label) AS own
  FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM u) GROUP BY 1) SELECT vec_id, argmax, decided, round(own - total, 6) AS log_prob FROM a""")
def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    out = read(spark, d, "embeddings").select("vec_id", batching.argmax(x).alias("argmax"), F.aggregate(batching.decided(x), F.lit(0), lambda a, v: a + v).alias("decided"), batching.target_log_prob(x, F.col("label")).alias("log_prob"))
    return rounded(out)


@query("SELECT * FROM (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS place, length(text) AS prediction, CAST(turn AS INT) AS label FROM conversations) WHERE label <> 1")
def token_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").withColumn("n", F.length("text").cast("long")).withColumn("y", F.when(F.col("turn") == 1, -100).otherwise(F.col("turn")).cast("int"))
    lists = alignment.lists(rows, ["conv_id"], "turn", "n", "y")
    return batching.token_rows(lists, "conv_id", "n", "y")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    return alignment.lists(read(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", F.array_join("role", ",").alias("roles"))


@query("SELECT count(*) AS n, count(*) FILTER (label < 0 OR label >= 10) AS bad_classes, 0::bigint AS bad_numbers FROM embeddings")
def label_problems(spark: SparkSession, d: str) -> DataFrame:
    bad = lambda kind, c, n: F.count_if(alignment.label_problem(c, kind, n).isNotNull())
    return read(spark, d, "embeddings").agg(F.count("*").alias("n"), bad("class", F.col("label"), 10).alias("bad_classes"), bad("number", F.col("label"), None).alias("bad_numbers"))


@query("SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first, arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem GROUP BY 1")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"), F.col("l_extendedprice").alias("price"))
    return alignment.first_seen(rows, "l_suppkey", "first")


@query("SELECT count(quality) AS matched, count(*) - count(quality) AS fallback, count(*) AS total, round(count(quality) / count(*), 6) AS fraction FROM documents LEFT JOIN labels USING (doc_id)")
def hit_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select(F.col("quality").isNull().alias("fallback"))
    return rounded(alignment.hit_coverage(rows))


@query("SELECT o_orderkey AS id, o_totalprice AS prediction, (o_custkey % 7)::double AS control FROM orders")
def control_alignment(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    trained, other = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("prediction")), orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).cast("double").alias("prediction"))
    return alignment.control(trained, other)


@query("SELECT l_suppkey AS id, l_orderkey * 10 + l_linenumber AS place, (row_number() OVER (PARTITION BY l_suppkey, l_discount::float ORDER BY l_orderkey * 10 + l_linenumber))::double AS prediction FROM lineitem")
def baseline_alignment(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_discount").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    n = F.row_number().over(Window.partitionBy("id", F.col("label").cast("float")).orderBy("place"))
    shared = rows.withColumn("prediction", n.cast("double")).withColumn("label", F.col("label").cast("float").cast("double")).withColumn("place", -1000000 + n)
    return alignment.baseline(rows, shared, "place", regression=True).select("id", "place", "prediction")


@query("SELECT conv_id AS id, (turn)::int AS original_position, (length(text) % 5)::int AS label, (conv_id % 3)::double AS prediction FROM conversations WHERE turn % 2 = 0 AND turn < (SELECT count(*) FROM conversations AS c WHERE c.conv_id = conversations.conv_id)")
def token_prior(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("p"), (F.length("text") % 5).cast("int").alias("y"))
    whole = alignment.lists(rows, ["id"], "p", "p", "y")
    seen = F.filter(F.arrays_zip("p", "y"), lambda z: (z["p"] % 2 == 0) & (z["p"] < F.size("y")))
    asked = whole.withColumn("z", seen).filter(F.size("z") > 0).select("id", F.transform("z", lambda z: z["y"]).alias("label"), F.transform("z", lambda z: z["p"]).alias("original_positions"))
    priors = whole.join(asked.select("id"), "id", "left_semi").select("id", F.col("y").alias("label"), (F.col("id") % 3).cast("double").alias("prediction"))
    return alignment.token_prior(asked, priors)


@query("SELECT l_orderkey AS id, l_linenumber, o_orderpriority AS metric_group FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def metric_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    groups = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("metric_group")).join(rows.select("id").distinct(), "id", "left_semi")
    rows = rows.join(groups.select("id"), "id", "left_semi")
    return alignment.attach_groups(rows, groups, "id", "metric_group")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def attached_sequences(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return alignment.attach(read(spark, d, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "c_name")


@query("""WITH s AS (SELECT item_id, text, unnest([3, length(text) // 2, length(text) - 1]) AS p FROM benchmark), w AS (SELECT *, CASE WHEN length(text) <= 64 THEN 0 ELSE greatest(0, least(p - 32, length(text) - 64)) END AS s FROM s)
  SELECT item_id || ':' || p AS id, (p - s)::int AS place, substr(text, s + 1, p - s) || '?' || substr(text, p + 2, s + 64 - p - 1) AS masked FROM w""")
def site_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    sites = F.transform(F.array(F.lit(3), F.floor(n / 2).cast("int"), n - 1), lambda p: F.struct(p.alias("position")))
    return calibration.site_rows(read(spark, d, "benchmark").withColumn("sites", sites), "item_id", "text", "sites", 64).drop("site")


@query("""WITH u AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS k, text FROM benchmark), c AS (SELECT item_id, k, substr(text, k, 1) AS x FROM u), n AS (SELECT *, CASE WHEN x BETWEEN 'a' AND 'm' THEN sum((x BETWEEN 'a' AND 'm')::int) OVER (PARTITION BY item_id ORDER BY k) - 1 ELSE -1 END::int AS i FROM c)
  SELECT item_id, string_agg(i, ',' ORDER BY k) AS places, max(i) + 1 AS kept FROM n GROUP BY 1""")
def canonical_places(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "benchmark").select("item_id", joined(contacts.inverse_places(t, "abcdefghijklm")).alias("places"), F.size(contacts.retained(t, "abcdefghijklm")).alias("kept"))


@query("""WITH c AS (SELECT CASE WHEN x BETWEEN 'a' AND 'e' THEN x ELSE 'X' END AS letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS x FROM benchmark) WHERE x <> '' GROUP BY 1),
  a AS (SELECT letter, ln((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER ()) AS lp FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'X']) AS letter) LEFT JOIN c USING (letter)),
  r AS (SELECT item_id, k - 1 AS position, substr(text, k, 1) AS residue FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS k FROM benchmark))
  SELECT item_id || ':' || position AS id, position::int AS position, residue, round(lp, 6) AS log_probability FROM r JOIN a ON letter = CASE WHEN residue BETWEEN 'a' AND 'e' THEN residue ELSE 'X' END""")
def residue_log_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(baselines.residue_log_probabilities(read(spark, d, "benchmark"), "item_id", "text", "abcde"))


@query("SELECT e, round(0.1 + 0.4 * least(1, e / 10), 6) AS linear, round(0.1 + 0.4 * (1 - cos(pi() * least(1, e / 10))) / 2, 6) AS cosine, round(0.1 * 5 ** least(1, e / 10), 6) AS exponential FROM (SELECT DISTINCT (o_custkey % 15) AS e FROM orders)")
def threshold_ramps(spark: SparkSession, d: str) -> DataFrame:
    epochs = read(spark, d, "orders").select((F.col("o_custkey") % 15).alias("e")).distinct()
    return rounded(epochs.select("e", *(curriculum.ramped(F.col("e"), kind, 0.1, 0.5, 10).alias(kind) for kind in ("linear", "cosine", "exponential"))))
