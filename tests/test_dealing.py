import re

from pyspark.sql import functions as F

from maskflow.functions.spans import MARK
from maskflow.operators import pseudonyms
from maskflow.operators.resolve import exploded
from maskflow.operators.rules import RULES, raw_matches
from maskflow.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_small_file_of_many_rows_is_worked_on_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "ROWS", 100)
    spark.range(1000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert spark.read.parquet(str(tmp_path / "customer.parquet")).rdd.getNumPartitions() == 1
    for name in ("spans_tx_hash", "spans_resolved_built", "mask_china_id"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_spans_are_found_once(spark):
    rule = next(r for r in RULES if r.name == "tx_hash")
    texts = spark.createDataFrame([(1, "x " + "ab" * 32), (2, "none"), (3, None)], "doc_id int, text string")
    found = exploded(texts.select("doc_id", raw_matches(F.col("text"), rule).alias("spans")), "doc_id").select("doc_id", "s", "e")
    assert [tuple(r) for r in found.collect()] == [(1, 2, 66)]
    assert plan(found).count("regexp_extract_all") == 1


def test_a_stream_is_made_once_for_an_original(spark):
    made = spark.range(3).select(pseudonyms.formed(F.lit("crypto_address"), F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256).substr(1, 40))).alias("y"))
    # the original's own and four of its stream
    assert plan(made).count("sha2(") == 9
    assert {len(r["y"]) for r in made.collect()} == {42}


def test_matches_are_marked_in_one_pass(spark):
    rule = next(r for r in RULES if r.name == "tx_hash")
    texts = ["x " + "ab" * 32, "0x" + "1" * 64 + " " + "c" * 64, f"{MARK}{MARK} {'d' * 64}{MARK}, {'e' * 64}", MARK, "", "none", None, "\U0001f600 " + "f" * 64 + "\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = exploded(rows.select("doc_id", raw_matches(F.col("text"), rule).alias("spans")), "doc_id").select("doc_id", "s", "e", "original")
    want = [(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer(r"\b(?:0x)?[0-9a-fA-F]{64}\b", t or "")]
    assert sorted(tuple(r) for r in found.collect()) == want
    # the text that holds the mark is searched and split by the pattern, all others are searched once
    assert plan(found).count("regexp_replace(") == 1
