"""Working again on only what new keywords touch, and the whole job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.operators import mapping as M
from maskflow.operators.dictionary import contains_any
from maskflow.operators.resolve import detect_each


def new_keywords(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(keyword): keywords that the last run didn't have; removed ones don't count."""
    return current.select("keyword").distinct().join(snapshot.select("keyword"), "keyword", "left_anti")


def affected(documents: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """Documents that hold a new keyword, whatever the case; those without a readable text too, to be safe."""
    return documents.filter(F.col(text).isNull() | contains_any(F.col(text), keywords))


@dataclass
class Job:
    """Sanitizes fragments (file, file_ord, frag_ord, text) with a mapping that lasts from run to run."""

    keywords: list[tuple[str, str]] = field(default_factory=list)
    salt: str = ""

    def run(self, fragments: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(fragments with ``sanitized``, the new mapping, counts by file and type)."""
        key = ["file_ord", "frag_ord"]
        spans = M.held_spans(detect_each(fragments, self.keywords), "file", *key)
        grown = M.upsert(M.first_seen(spans, key, "file"), mapping, self.salt)
        counts = spans.groupBy("file", "entity_type").agg(F.count(F.lit(1)).alias("n"))
        return M.rewrite(fragments, spans, grown, key), grown, counts

    def run_incrementally(self, fragments: DataFrame, mapping: DataFrame, snapshot: DataFrame) -> tuple[DataFrame | None, DataFrame, str]:
        """(rewritten fragments or None, mapping, what was done): without a snapshot a full run, without new keywords nothing."""
        spark = fragments.sparkSession
        if snapshot.limit(1).isEmpty():
            done, grown, _ = self.run(fragments, mapping)
            return done, grown, "full"
        current = spark.createDataFrame([(k,) for _, k in self.keywords], "keyword string")
        fresh = [r["keyword"] for r in new_keywords(current, snapshot).collect()]  # a user's list
        if not fresh:
            return None, mapping, "nothing new"
        files = affected(fragments, fresh).select("file_ord").distinct()
        chosen = fragments.join(files, "file_ord", "left_semi")
        done, grown, _ = self.run(chosen, mapping)
        return done, grown, "incremental"
