import pytest
from pyspark.sql import functions as F

from maskflow.operators import mapping as M
from maskflow.operators import pseudonyms, scaling
from maskflow.operators.incremental import Job
from maskflow.operators.names import ask, parse_response


def fragments(spark, *texts):
    return spark.createDataFrame([(f"f{i}", i, 0, t) for i, t in enumerate(texts)], "file string, file_ord int, frag_ord int, text string")


def test_numbers_run_from_right_to_left(spark):
    done, mapping, _ = Job().run(fragments(spark, "a@x.com then b@x.com", "b@x.com"), M.empty_mapping(spark))
    assert [r["sanitized"] for r in done.orderBy("file_ord").collect()] == ["user_02@example.com then user_01@example.com", "user_01@example.com"]
    assert {(r["original"], r["first_seen_file"]) for r in mapping.collect()} == {("a@x.com", "f0"), ("b@x.com", "f0")}


def test_mapping_lasts_and_case_matters(spark):
    job = Job([("company", "acme")])
    _, first, _ = job.run(fragments(spark, "ACME"), M.empty_mapping(spark))
    done, second, _ = job.run(fragments(spark, "Acme and ACME"), first)
    assert done.first()["sanitized"] == "Company_B and Company_A"
    assert second.count() == 2


def test_incremental(spark):
    frags, empty = fragments(spark, "acme here", "nothing", None), M.empty_mapping(spark)
    job = Job([("company", "acme")])
    snapshot = lambda *k: spark.createDataFrame([(x,) for x in k], "keyword string")
    assert job.run_incrementally(frags, empty, snapshot())[2] == "full"
    assert job.run_incrementally(frags, empty, snapshot("acme"))[2] == "nothing new"
    done, _, what = job.run_incrementally(frags, empty, snapshot("other"))
    assert what == "incremental" and {r["file"] for r in done.collect()} == {"f0", "f2"}


def test_numbering_by_ranges_equals_one_window(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("entity_type"), F.col("id").alias("seen"))
    one = {(r["entity_type"], r["seen"]): r["number"] for r in M.numbered(df).collect()}
    many = {(r["entity_type"], r["seen"]): r["number"] for r in M.numbered(df, ranges=7).collect()}
    assert one == many


def test_letters(spark):
    n = [1, 26, 27, 52, 702, 703, 18278, 18279]
    out = spark.createDataFrame([(x,) for x in n], "n bigint").select(pseudonyms.letters(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in out] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ", "AAAA"]


@pytest.mark.parametrize(
    "kind, original, form",
    [
        ("bank_account", "6222021234567890", r"[1-9]\d{15}"),
        ("phone", "+852 9123-4567", r"\+\d{3} \d{4}-\d{4}"),
        ("hk_id", "AB123456(7)", r"A\d{6}\(\d\)"),
        ("iban", "GB82 WEST 1234 5698 7654 32", r"GB\d{20}"),
        ("swift_code", "BKCHCNBJ110", r"[A-Z]{6}[A-Z0-9]{5}"),
        ("crypto_address", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", r"bc1[02-9ac-hj-np-z]{39}"),
        ("tx_hash", "0x" + "ab" * 32, r"0x[0-9a-f]{64}"),
        ("china_id", "11010519491231002X", r"\d{18}"),
    ],
)
def test_forms(spark, kind, original, form):
    import re

    df = spark.createDataFrame([(original,)], "x string").select(pseudonyms.formed(F.lit(kind), F.col("x")).alias("y"), pseudonyms.formed(F.lit(kind), F.col("x")).alias("z"))
    row = df.first()
    assert re.fullmatch(form, row["y"]) and row["y"] == row["z"] != original


def test_report_and_statistics(spark):
    rows = [("A", "company", "Company_A", None, None), ("s", "scale_factor", "1.25", None, None), ("__salt__", "_meta", "x", None, None)]
    mapping = spark.createDataFrame(rows, M.MAPPING)
    assert [(r["original"], r["note"]) for r in M.report(mapping).collect()] == [("A", ""), ("s", "+25.0%")]
    assert {r["entity_type"]: r["n"] for r in M.statistics(mapping).collect()} == {"company": 1, "_meta": 1, "total": 2}
    assert M.has_entities(mapping) and not M.has_entities(M.empty_mapping(spark))


def test_prose(spark):
    cases = {
        "1,234,567.89": "2,469,136.00",
        "HK$ 5,000": "HK$ 10,000",
        "2024": "2024",
        "999.99": "999.99",
        "12345.": "12345.",
        "a 1500 b $1234.50": "a 3000 b $2469.00",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scaling.scale_in_text(F.col("t"), F.lit(2.0)).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases


def test_csv_cells(spark):
    cases = {"1,000": "2,000", "3.50": "7.00", "2024": "2024", "123456789": None, "nan": None, "=SUM(A1)": None, "12d": None, "1e3": "2000", "-7": "-14", "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scaling.scale_csv_cell(F.col("t"), F.lit(2.0)).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases


def test_scale_number(spark):
    df = spark.createDataFrame([(0.0,), (1000.0,), (2000.0,), (0.123,), (5.0,)], "v double").select(scaling.scale_number(F.col("v"), F.lit(0.5)).alias("o"))
    assert [r["o"] for r in df.collect()] == [0.0, 500.0, 1000.0, 0.062, 2.0]
    assert scaling.checked_range(2, 1) == scaling.DEFAULT_RANGE and scaling.checked_range(0.7, 1.3) == (0.7, 1.3)
    f = spark.range(50).select(scaling.drawn_factor(F.concat(F.lit("s"), "id"), "salt", 0.7, 1.3).alias("f")).collect()
    assert all(0.7 <= r["f"] <= 1.3 for r in f) and len({r["f"] for r in f}) > 40


def test_responses(spark):
    responses = [
        '[{"text": "Acme", "type": "company"}]',
        '```json\n[{"text": "Zhang", "type": "person"}]\n```',
        "[]",
        "no json",
        'Found:\n[{"text": "B", "type": "company"}]\nEnd.',
        '<think>hm [1]</think>\n[{"text": "Ali", "type": "company"}]',
    ]
    df = spark.createDataFrame(list(enumerate(responses)), "n int, r string").select("n", parse_response(F.col("r")).alias("e"))
    assert [[x["text"] for x in r["e"]] for r in df.orderBy("n").collect()] == [["Acme"], ["Zhang"], [], [], ["B"], ["Ali"]]

    def broken(texts):
        raise OSError

    assert ask(spark.createDataFrame([("x",)], "text string"), broken).first()["response"] == "[]"
