"""Queries of the corpus operators, by name, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.quality import judged

    return judged(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id",
        *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.warc import read_records, write_bundles

    found = read_records(spark, write_bundles(_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.similarity import JaccardRule, similar

    return similar(_table(spark, sf_dir, "documents"), JaccardRule(words=4, num=85, den=100))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents")).drop("matched")


def op5_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.repeats import repeats

    return repeats(_table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.encoding import encode

    return encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_pieces.n_pieces", "_pieces.ids", "_pieces.round_trip")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.secrets import digested, scan

    return digested(scan(_table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.kneser_ney import score

    return score(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.importance import importance

    found = importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", *[f"_importance.{c}" for c in ("n_features", "weight", "score", "rank")])


#: The rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.url_filters import RULES, judged

    found = judged(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULES), keep=["page_id"])
    return found.select("page_id", *[f"_url.{c}" for c in ("host", "path", "rule", "verdict", "decided_by")])


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskflow.llm.centroids import report

    return report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scans": op4_license_scans,
    "op5_repeat_removal": op5_repeat_removal,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_secret_scans": op7_secret_scans,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_url_filters": op12_url_filters,
    "op13_centroid_clustering": op13_centroid_clustering,
}

def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The numbered queries and, where the repository has it, the corpus pipeline."""
    import importlib.util

    found = dict(QUERIES)
    if importlib.util.find_spec("corpus_pipeline") is not None:
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
    return found


def all_sql() -> dict[str, str]:
    from maskflow.llm.sql import SQL

    return dict(SQL)
