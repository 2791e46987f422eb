"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; :func:`run` writes each result as Parquet and reads it again.  All but the
last return the columns of ``documents``.  Nulls, empty texts, repeated rows and
empty tables are handled as the operators' docstrings say: a document with a null
doc_id takes part in every stage but the near-duplicate join, where it is kept.
Further columns pass through whatever their names, but those that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions.session import ship
from maskflow.functions.storage import discard, scratch, temporary
from maskflow.llm import decontaminate, encoding, quality, secrets, similarity

#: Components of shingle sets aren't expressible in SQL; tests use a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's limits go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return similarity.keep_one(docs, similarity.JaccardRule(words=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go; from others those words go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks."""
    return secrets.redact(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids, their number, and whether they decode to the text; columns of these names are replaced."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    added = ("ids", "n_pieces", "round_trip")
    asked = docs.toDF(*inner).withColumn("text", F.col(inner[docs.columns.index("text")]))
    kept = [F.col(i).alias(c) for i, c in zip(inner, docs.columns) if c not in added]
    return encoding.encode(asked).select(*kept, *[f"_pieces.{c}" for c in added])


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_redaction),
    ("sentencepiece_encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's intermediates and input are deleted once its result is written."""
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
