"""Sequence files as tables. Files are read in order of their names; a record's place is its number over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences
from ..operators.ranges import numbered


#: What tells the records of several files apart, in order: a file's name, where a task began in it, the record in the task.
ORDER = ["file", "block", "place"]


def records(spark: SparkSession, path: str | list[str], separator: str = "\n>") -> DataFrame:
    """ORDER and the text of each record, without its leading mark."""
    text = lines(spark, path, separator)
    return text.filter(F.trim("value") != "").withColumn("value", F.regexp_replace("value", r"^>", ""))


def lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    read = spark.read if separator is None else spark.read.option("lineSep", separator)
    return read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value"))


def fasta(spark: SparkSession, path: str | list[str], prefix: str, strip_header: bool = False) -> DataFrame:
    """sequence_id, original_id, description and sequence. strip_header keeps a header's first word only."""
    raw = records(spark, path)
    header = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    header = F.regexp_replace(header, r"\s.+", "") if strip_header else header
    out = numbered(raw.select(*ORDER, header.alias("header"), body.alias("sequence")), ORDER, "n")
    return out.select(sequences.sequence_id(prefix, F.col("n")).alias("sequence_id"), sequences.original_id(F.col("header")).alias("original_id"), sequences.description_rest(F.col("header")).alias("description"), "sequence")


def alignment(spark: SparkSession, path: str | list[str], prefix: str) -> DataFrame:
    """A3M records: comments, consensus rows and rows of curated databases are left out, gaps go, letters become capitals."""
    raw = records(spark, path).withColumn("value", F.regexp_replace("value", r"[^\x20-\x7E\t\n]", ""))
    kept_lines = F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#"))
    head = F.element_at(kept_lines, 1)
    kept = raw.filter(F.size(kept_lines) > 1).filter(~head.contains("consensus") & ~F.array_contains(F.transform(F.array(*map(F.lit, ("sp", "tr", "UP"))), lambda p: head.startswith(p)), True))
    sequence = F.upper(F.translate(F.array_join(F.slice(kept_lines, 2, 1 << 30), ""), "-", ""))
    out = numbered(kept.select(*ORDER, F.substring_index(head, " ", 1).alias("original_id"), sequence.alias("sequence")), ORDER, "n")
    return out.select(sequences.sequence_id(prefix, F.col("n")).alias("sequence_id"), "original_id", F.lit("").alias("description"), "sequence")


def paired(table: DataFrame, stem: Column, heavy: str = "heavy", light: str = "light", keep: tuple[str, ...] = ()) -> DataFrame:
    """Paired chains of rows whose numbering status is complete: chains are joined by a bar in `sequence` and by XXXXX in `fasta`."""
    good = ~F.coalesce(F.col(f"ANARCI_status_{heavy}"), F.lit("")).contains("Shorter") & ~F.coalesce(F.col(f"ANARCI_status_{light}"), F.lit("")).contains("Shorter")
    a, b = (F.coalesce(F.col(f"sequence_alignment_aa_{x}"), F.lit("")) for x in (heavy, light))
    name = F.concat(stem, F.lit(":"), F.coalesce(F.col(f"sequence_id_{heavy}"), F.lit("")), F.lit("|"), F.coalesce(F.col(f"sequence_id_{light}"), F.lit("")))
    return table.filter(good).select(name.alias("original_id"), F.concat(a, F.lit("|"), b).alias("sequence"), F.concat(a, F.lit("XXXXX"), b).alias("fasta"), *keep)


def paired_files(spark: SparkSession, path: str | list[str], prefix: str, linker: str = "|") -> DataFrame:
    """sequence_id, original_id, description and sequence of paired CSV files: a line about the file, a header, lines of text.

    Files are read in order of their names, the stem of which begins the original id; the linker is a bar, or XXXXX for
    sequences to be clustered. Lines are dealt to tasks like any others; only the headers go by file.
    """
    at = F.struct("block", "place")
    text = lines(spark, path).withColumn("value", F.regexp_replace("value", r"\r$", "")).withColumn("at", at)
    first = text.groupBy("file").agg(F.min("at").alias("first"))
    rest = text.join(first, "file").filter(F.col("at") > F.col("first")).drop("first")
    header = rest.groupBy("file").agg(F.min(F.struct("at", "value")).alias("h")).select("file", F.col("h.at").alias("header"), F.transform(_cells(F.col("h.value")), lambda c: F.trim(c)).alias("names"))
    rows = rest.join(header, "file").filter((F.col("at") > F.col("header")) & (F.col("value") != "")).withColumn("cells", _cells(F.col("value")))
    wanted = [f"{c}_{x}" for x in ("heavy", "light") for c in ("sequence_id", "sequence_alignment_aa", "ANARCI_status")]
    value = lambda n: F.get("cells", (F.array_position("names", n) - 1).cast("int"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.csv(\.gz)?$", "")
    good = paired(rows.select(*ORDER, stem.alias("stem"), *(value(n).alias(n) for n in wanted)), F.col("stem"), keep=tuple(ORDER))
    out = numbered(good.withColumn("sequence", F.replace("sequence", F.lit("|"), F.lit(linker))), ORDER, "n")
    return out.select(sequences.sequence_id(prefix, F.col("n")).alias("sequence_id"), "original_id", F.lit("").alias("description"), "sequence")


def _cells(line: Column) -> Column:
    """Cells of a CSV line; a quoted one may hold commas and doubled quotes."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')))


def cluster_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless cluster<TAB>sequence rows as (sequence_id, cluster_id); an empty file gives no rows, a missing one an error."""
    rows = spark.read.csv(path, sep="\t", schema="cluster_id string, sequence_id string", quote="")
    return rows.select("sequence_id", "cluster_id")


def splits(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files named <split>-N-of-M.parquet, with their split; a file of another name is an error."""
    df = spark.read.parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)-\d+-of-\d+\.parquet$", 1)
    return df.withColumn("split", F.when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("not a split: "), F.col("_metadata.file_name"))).cast("string")))
