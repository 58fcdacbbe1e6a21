"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir), works on all rows of
``docs`` and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next stage's documents.  All but the last return the columns of documents.

Defined cases, for every stage: null and empty texts have no words and no lines to lose; they pass the
filters and are packed as their end id.  Very long texts are taken whole.  Repeated rows are judged
alike; of rows that repeat id and text the near-duplicate stage keeps one.  Rows without id are judged by
their texts.  Ties: see the operator of the stage.  Extra columns, whatever their names, go through the
filters unchanged.  Without documents every stage gives an empty table, without labels the classifier
keeps every row, and without a benchmark no row is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import common, decontaminate, jaccard_join, line_dedup, packing, quality_classifier
from casemill.llm.queries import tokenizer_path

#: SQL can't express the trained classifier nor the tokenizer; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ordinal classifier expects to be below grade 1."""
    ratings = quality_classifier.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, ratings, accept=1, least=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of at least ten documents stays in the first of them only."""
    kept = line_dedup.dedup_lines(docs, min_docs=10, keep_first=True)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.8 or more on five-word shingles the first stays."""
    return jaccard_join.first_of_each(docs, shingle=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 ids, similar documents together."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), space_leads=True, end_id=0, window=1024)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
