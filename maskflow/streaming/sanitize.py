"""The detector on a stream, and a mapping that micro-batches add to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskflow.functions.spans import splice
from maskflow.operators import mapping as M
from maskflow.operators.pseudonyms import FORMED, formed
from maskflow.operators.mapping import held_spans
from maskflow.operators.resolve import detect_each


def mask_formed(stream: DataFrame, keywords: list[tuple[str, str]] = (), salt: str = "", text: str = "text") -> DataFrame:
    """A stream with ``sanitized``: entities that need no number are replaced, others become their type in brackets. No state."""
    detected = detect_each(stream, keywords, text=text)
    pieces = F.transform(
        "spans",
        lambda m: F.struct(
            m["s"].alias("s"),
            m["e"].alias("e"),
            F.when(m["entity_type"].isin(*FORMED), formed(m["entity_type"], m["original"], salt))
            .otherwise(F.concat(F.lit("["), m["entity_type"], F.lit("]")))
            .alias("replacement"),
        ),
    )
    return detected.withColumn("sanitized", splice(F.col(text), pieces)).drop("spans")


def sanitize_stream(stream: DataFrame, mapping_path: str, output_path: str, key: str, keywords: list[tuple[str, str]] = (), salt: str = "") -> DataStreamWriter:
    """A writer whose batches extend a stored mapping and append rewritten rows.

    Each batch writes the mapping's new rows, and its output, under its number, so a
    batch that runs again after a failure replaces what it had written.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spans = held_spans(detect_each(batch, keywords), key)
        try:
            before = spark.read.schema(M.MAPPING + ", batch bigint").parquet(mapping_path).filter(F.col("batch") < number).drop("batch")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = M.empty_mapping(spark)
        seen = M.first_seen(spans, [key])
        fresh = M.new_rows(seen, before, salt)
        fresh.write.mode("overwrite").parquet(f"{mapping_path}/batch={number}")
        whole = before.unionByName(spark.read.schema(M.MAPPING).parquet(f"{mapping_path}/batch={number}"))
        M.rewrite(batch, spans, whole, [key]).write.mode("overwrite").parquet(f"{output_path}/batch={number}")

    return stream.writeStream.foreachBatch(work)
