"""All queries of the de-identification engine by name, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions.storage import stored
from maskflow.operators import incremental, keyword_index, names, pseudonyms, scaling
from maskflow.operators import mapping as M
from maskflow.operators.dictionary import find_keywords, parse_keywords
from maskflow.operators.keyword_table import matched
from maskflow.operators.resolve import detect_each, exploded
from maskflow.operators.rules import RULES, passes_china_id, passes_luhn, raw_matches
from maskflow.plans import oracle
from maskflow.plans.oracle import KEYWORDS
from maskflow.sources import files, html

FLAGSHIP = "sanitized_emails"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
EPOCH = "2000-01-01 00:00:00"
#: Rows of a table that one task works on where each costs much.
ROWS = 10_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "source", "text")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over tasks of about ``ROWS``: a table of a few bytes a row lies in one split, however many rows it has."""
    return rows.repartition(max(1, -(-rows.count() // ROWS)), key)


def built(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): one text with every kind of identifier for each customer."""
    keys = _dealt(_table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return keys.select(F.col("c_custkey").alias("doc_id"), F.expr(oracle.BUILT_SPARK).alias("text"))


def _rule_query(k: int) -> Query:
    rule = RULES[k]

    def run(spark: SparkSession, d: str) -> DataFrame:
        source = _documents(spark, d) if rule.name in oracle.NATURAL else built(spark, d)
        found = source.select("doc_id", raw_matches(F.col("text"), rule).alias("spans"))
        return exploded(found, "doc_id").select("doc_id", "s", "e", "original")

    return run


for _k, _rule in enumerate(RULES):
    QUERIES[f"spans_{_rule.name}"] = _rule_query(_k)


@query
def spans_resolved(spark, d):
    return exploded(detect_each(_documents(spark, d)), "doc_id").select("doc_id", "s", "e", "entity_type", "original")


@query
def spans_resolved_built(spark, d):
    return exploded(detect_each(built(spark, d)), "doc_id").select("doc_id", "s", "e", "entity_type", "original")


@query
def luhn_check(spark, d):
    x = F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0"))
    return _table(spark, d, "orders").select("o_orderkey", x.alias("number"), passes_luhn(x).alias("ok"))


@query
def china_id_check(spark, d):
    k = F.col("o_orderkey")
    x = F.concat(F.lit("11010519900101"), F.lpad((k % 1000).cast("string"), 3, "0"), F.when(k % 11 == 10, F.lit("X")).otherwise((k % 11).cast("string")))
    return _table(spark, d, "orders").select("o_orderkey", x.alias("number"), passes_china_id(x).alias("ok"))


@query
def entity_counts_by_type(spark, d):
    return exploded(detect_each(_documents(spark, d)), "doc_id").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query
def entity_counts_by_source(spark, d):
    return exploded(detect_each(_documents(spark, d)), "source").groupBy("source", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query
def dictionary_matches(spark, d):
    found = _documents(spark, d).select("doc_id", find_keywords(F.col("text"), KEYWORDS).alias("spans"))
    return exploded(found, "doc_id").select("doc_id", "s", "e", "entity_type", "original")


@query
def cross_layer_resolution(spark, d):
    return exploded(detect_each(_documents(spark, d), KEYWORDS), "doc_id").select("doc_id", "s", "e", "layer", "entity_type", "original")


@query
def dictionary_table_matches(spark, d):
    """A keyword for each customer and for each stretch of numbers, in texts about orders."""
    customers = _table(spark, d, "customer").select("c_custkey", "c_name")
    whole = customers.select(F.lit("company").alias("entity_type"), F.col("c_name").alias("keyword"), F.col("c_custkey").cast("int").alias("ord"))
    short = customers.select(F.lit("person").alias("entity_type"), F.substring("c_name", 1, 15).alias("keyword"), F.lit(1_000_000_000).alias("ord")).distinct()
    texts = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(oracle.ORDER_TEXT_SPARK).alias("text"))
    found = matched(texts, whole.unionByName(short), ["doc_id"])
    return exploded(found, "doc_id").select("doc_id", "s", "e", "entity_type", "original")


@query
def keyword_file_parse(spark, d):
    """Lines made of customers' and nations' names, with every mark and comments."""
    lines = _table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("ord"), F.expr(oracle.KEYWORD_LINE_SPARK).alias("value"))
    return parse_keywords(lines)


def _numbered_query(name: str, table: str, column: str, key: str, kind: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        seen = _table(spark, d, table).groupBy(F.col(column).alias("original")).agg(F.min(key).alias("seen"))
        placed = M.numbered(seen, by=None)
        return placed.select("original", pseudonyms.labelled(F.lit(kind), F.col("number")).alias("replacement"))

    QUERIES[name] = run


for _args in oracle.NUMBERED:
    _numbered_query(*_args)


def _email_spans(spark: SparkSession, d: str) -> DataFrame:
    rule = next(r for r in RULES if r.name == "email")
    return _documents(spark, d).withColumn("spans", raw_matches(F.col("text"), rule))


def _mapping_of(spans: DataFrame, order: list[str]) -> DataFrame:
    return M.upsert(M.first_seen(spans, order), M.empty_mapping(spans.sparkSession), created_at=EPOCH)


def _rewritten(detected: DataFrame, key: list[str]) -> DataFrame:
    spans = M.held_spans(detected, *key)
    return M.rewrite(detected.drop("spans"), spans, _mapping_of(spans, key), key)


@query
def map_email(spark, d):
    return _mapping_of(exploded(_email_spans(spark, d), "doc_id"), ["doc_id"]).select("original", "replacement")


@query
def sanitized_emails(spark, d):
    return _rewritten(_email_spans(spark, d), ["doc_id"]).select("doc_id", "sanitized")


@query
def sanitized_documents(spark, d):
    return _rewritten(detect_each(_documents(spark, d), KEYWORDS), ["doc_id"]).select("doc_id", "sanitized")


def _formed_query(kind: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = F.expr(oracle.ORIGINALS_SPARK[kind])
        keys = _dealt(_table(spark, d, "customer").select("c_custkey"), "c_custkey")
        return keys.select("c_custkey", x.alias("original"), pseudonyms.formed(F.lit(kind), x).alias("replacement"))

    QUERIES[f"mask_{kind}"] = run


for _kind in pseudonyms.FORMED:
    _formed_query(_kind)


@query
def mapping_upsert(spark, d):
    first = _table(spark, d, "customer").filter("c_custkey % 2 = 0").groupBy(F.col("c_name").alias("original")).agg(F.min("c_custkey").alias("seen"))
    second = _table(spark, d, "customer").groupBy(F.col("c_name").alias("original")).agg(F.min("c_custkey").alias("seen"))
    kind, nowhere = F.lit("company").alias("entity_type"), F.lit(None).cast("string").alias("first_seen_file")
    before = M.upsert(first.select("original", kind, "seen", nowhere), M.empty_mapping(spark), created_at=EPOCH)
    return M.upsert(second.select("original", kind, "seen", nowhere), before, created_at=EPOCH).select("original", "entity_type", "replacement")


def _customer_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = [("c_name", "company"), ("c_mktsegment", "bank_name")]
    seen = None
    for column, kind in rows:
        one = _table(spark, d, "customer").groupBy(F.col(column).alias("original")).agg(F.min("c_custkey").alias("seen"))
        one = one.select("original", F.lit(kind).alias("entity_type"), "seen", F.lit(None).cast("string").alias("first_seen_file"))
        seen = one if seen is None else seen.unionByName(one)
    return M.upsert(seen, M.empty_mapping(spark), created_at=EPOCH)


@query
def mapping_statistics(spark, d):
    return M.statistics(_customer_mapping(spark, d))


@query
def mapping_report(spark, d):
    return M.report(_customer_mapping(spark, d)).select("section", "entity_type", "original", "replacement", "note")


@query
def scale_factors(spark, d):
    seeds = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("seed")).distinct()
    return seeds.select("seed", scaling.drawn_factor(F.col("seed"), "salt", 0.7, 1.3).alias("factor"))


def _scaled(spark: SparkSession, d: str, seed: Column, v: Column, table: str, *keys: str) -> DataFrame:
    factors = spark.createDataFrame([], "seed string, factor double")
    df = scaling.with_factors(_table(spark, d, table).withColumn("seed", seed), "seed", factors, "salt", 0.7, 1.3)
    return df.select(*keys, F.round(F.when(scaling.is_year(v), v).otherwise(scaling.scale_number(v, F.col("factor"))), 1).alias("scaled"))


@query
def scale_unified(spark, d):
    return _scaled(spark, d, F.lit(scaling.GLOBAL_SEED), F.floor("l_extendedprice").cast("double"), "lineitem", "l_orderkey", "l_linenumber")


@query
def scale_per_seed(spark, d):
    return _scaled(spark, d, F.col("o_orderpriority"), F.floor("o_totalprice").cast("double"), "orders", "o_orderkey")


@query
def scale_fractions(spark, d):
    by = F.expr("CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 1024 WHEN 3 THEN 16384 ELSE -131072 END")
    v = F.col("p_retailprice").cast("double") / by
    return _table(spark, d, "part").select("p_partkey", F.round(scaling.scale_number(v, F.lit(1.37)), 4).alias("scaled"))


@query
def csv_cells(spark, d):
    df = _table(spark, d, "part").select("p_partkey", F.expr(oracle.CSV_CELL).alias("cell"))
    return df.select("p_partkey", "cell", scaling.csv_number(F.col("cell")).alias("number"), scaling.scale_csv_cell(F.col("cell"), F.lit(2.0)).alias("scaled"))


@query
def excel_cell_dispatch(spark, d):
    df = _table(spark, d, "orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'string' WHEN o_orderkey % 3 = 1 THEN 'number' ELSE 'boolean' END").alias("cell_type"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN ' ' ELSE o_orderpriority END").alias("s"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 2024D ELSE o_totalprice END").alias("d"),
        F.expr("CASE o_orderkey % 7 WHEN 0 THEN 'yyyy-mm-dd' WHEN 1 THEN '' ELSE 'General' END").alias("number_format"),
    )
    return df.withColumn("action", scaling.cell_action()).select("o_orderkey", "action")


@query
def scale_text(spark, d):
    return _documents(spark, d).select("doc_id", scaling.scale_in_text(F.col("text"), F.lit(1.5)).alias("scaled"))


@query
def html_text_nodes(spark, d):
    return html.text_nodes(_table(spark, d, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def sanitized_pages(spark, d):
    pages = _table(spark, d, "pages").select("page_id", "html")
    nodes = detect_each(html.text_nodes(pages), KEYWORDS)
    rewritten = _rewritten(nodes, ["page_id", "frag_ord"])
    return html.with_nodes(pages, rewritten).select("page_id", "sanitized")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.expr(oracle.PATH_SPARK).alias("path"), F.col("n_chars").alias("size"))


@query
def file_type_histogram(spark, d):
    return files.file_type_histogram(files.manifest(_listed(spark, d), "/root"))


@query
def folder_manifest(spark, d):
    return files.manifest(_listed(spark, d), "/root").select("relative", "extension", "size", "file_ord")


@query
def output_paths(spark, d):
    parts = detect_each(files.path_parts(files.manifest(_listed(spark, d), "/root")), [("company", "src1")])
    return files.joined_paths(_rewritten(parts, ["relative", "part_ord"]))


@query
def new_keywords(spark, d):
    """Customers' names against a snapshot with two thirds of them and names that are gone."""
    names_ = _table(spark, d, "customer").select(F.col("c_name").alias("keyword"), "c_custkey")
    before = names_.filter("c_custkey % 3 <> 0").select("keyword").unionByName(_table(spark, d, "supplier").select(F.col("s_name").alias("keyword")))
    return incremental.new_keywords(names_.select("keyword"), before)


@query
def incremental_documents(spark, d):
    return incremental.affected(_documents(spark, d), [k for _, k in KEYWORDS]).select("doc_id")


@query
def indexed_documents(spark, d):
    """Documents as files with an index, asked for keywords; what may hold one is searched exactly."""
    texts = _documents(spark, d).select(F.col("doc_id").cast("string").alias("relative"), "text")
    listed = texts.select("relative", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), F.lit(EPOCH).cast("timestamp").alias("modified"))
    words = [k for _, k in KEYWORDS]
    index = stored(keyword_index.build(texts, listed), "index")
    asked = keyword_index.candidates(index, listed, words)
    return incremental.affected(texts.join(asked, "relative", "left_semi"), words).select(F.col("relative").cast("bigint").alias("doc_id"))


@query
def response_parse(spark, d):
    """Answers about customers: alone, in a fenced block, amid prose, after thoughts, or none."""
    df = _table(spark, d, "customer").select("c_custkey", F.expr(oracle.RESPONSE_SPARK).alias("response"))
    return df.select("c_custkey", F.to_json(names.parse_response(F.col("response"))).alias("entities"))
