"""The corpus pipeline: language ID, quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame, which is written
as Parquet and read again. All but the last return the columns of documents.

What all stages do alike: an empty table gives an empty one; ids may be null or shared by several texts; other columns
may be null and are carried along, and ones with names that a stage uses itself are no concern of it; very long texts
are read whole. Where stages differ, they say so.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import langid, linededup, packing, quality, simhash
from strandframe.llm.common import Staging


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without doubt. Null and empty texts, and those without a letter, go; so does one whose two best languages tie. Repeated rows are judged alike and all stay or go."""
    marked = langid.identify(docs, langid.learn(docs))
    return marked.filter(~F.col(marked.columns[-1])).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is high enough; ratings come from the table labels.

    Null texts count as empty. Documents without a rating, or with a null id, are judged but not learned from; repeated
    rows are judged alike. With no ratings at all, all stay.
    """
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    marked = quality.predict(docs, quality.fit(quality.sample(docs, ratings)))
    return marked.filter(F.col(marked.columns[-2]) >= quality.SELECT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share, but for a line's first occurrence (smallest doc_id), so that a group of copies keeps one whole text.

    A null text stays null, an empty one empty, and an empty line stays. A null doc_id is the smallest. Repeated rows of a
    document (doc_id and text) keep the same lines. n_chars follows the text.
    """
    return linededup.apply(docs, linededup.bitmaps(docs, "shared_but_first", min_docs=10))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates; of its repeated rows one stays.

    Rows are told apart by doc_id and text: rows that share a doc_id but not their text are documents of their own, and a
    null doc_id is an id like others, the last. Texts without a word are one group, null and empty ones included. Of
    equally old copies the smallest hash of the text stays.
    """
    return simhash.survivors(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens. A null text is an empty one, whose only token is the end; repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", good_quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("packing", packed)]

#: Compression, regression, fingerprints and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
