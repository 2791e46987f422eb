import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskflow.operators.dictionary import as_keywords, parse_keywords
from maskflow.operators.resolve import detect, detect_each, located
from pyspark.sql import functions as F


def spans(spark, text, keywords=()):
    row = detect_each(spark.createDataFrame([(text,)], "text string"), list(keywords)).first()
    return [(m["entity_type"], m["original"]) for m in row["spans"]]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("收款账号为 622202123456789", [("bank_account", "622202123456789")]),
        ("请发送到 finance@company.com 和 admin@example.org", [("email", "finance@company.com"), ("email", "admin@example.org")]),
        ("联系电话 13812345678", [("phone", "13812345678")]),
        ("海外联系 +852 9123 4567", [("phone", "+852 9123 4567")]),
        ("SWIFT: BKCHCNBJ110", [("swift_code", "BKCHCNBJ110")]),
        ("持证人 A123456(7)", [("hk_id", "A123456(7)")]),
        ("电话13812345678", []),
        ("Invoice No: ABC123456", [("invoice_no", "Invoice No: ABC123456")]),
        ("合同编号：HT-2024-001", [("contract_no", "合同编号：HT-2024-001")]),
        ("no 123456789012345678 here", [("tax_id", "123456789012345678")]),
        ("card 4111 1111 1111 1111.", [("credit_card", "4111 1111 1111 1111")]),
        ("id 11010519491231002X", [("china_id", "11010519491231002X")]),
        ("see https://a.example.com/x?y=1", [("url", "https://a.example.com/x?y=1")]),
        ("", []),
        (None, []),
        ("   ", []),
    ],
)
def test_rules(spark, text, expected):
    assert spans(spark, text) == expected


def lone_matches():
    """Fragments that hold one match each, of every rule, without six letters or four digits in a row where the rule allows it."""
    return [
        "0xa1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f8a9b0",
        "1a2b3c4d5e6f7g8h9i1j2k3m4n5p6q7r8s",
        "bc1qa2b3c4d5e6f7g8h9j2k3m4n5p6q7r8s9",
        "Ta2b3c4d5e6f7g8h9i1j2k3m4n5p6q7r8s",
        "T" + "abcdefghijk" * 3,
        "a1" * 32,
        "0x" + "b2" * 32,
        "abcdef" * 10 + "abcd",
        "GB29 NW1K 6R1A 3B1C 9D2E 1F",
        "A123456(7)",
        "AB123456(1)",
        "4111 1111 1111 1111",
        "11010519491231002X",
        "BKCHCNBJ110",
        "BKCHCNBJ",
        "Inv# abc-de-f",
        "票号 ab-cd-ef",
        "合同 ab-cd",
        "协议 ab-cd",
        "a@b.co",
        "www.a.io",
        "http://a.io",
        "+1 2 3456",
        "13812345678",
        "12123456ABCDEFGHJK",
        "123456789",
    ]


def test_prefilter_is_a_superset(spark):
    from maskflow.functions.spans import first_wins
    from maskflow.operators.rules import RULES, find_all, raw_matches

    df = spark.createDataFrame([(t,) for t in lone_matches()], "text string")
    raw = first_wins(F.concat(*[raw_matches(F.col("text"), rule) for rule in RULES]))
    rows = df.select("text", find_all(F.col("text")).alias("found"), raw.alias("raw")).collect()
    for r in rows:
        assert r["raw"] and r["found"] == r["raw"], r["text"]
    hit = df.select(*[F.max(F.size(raw_matches(F.col("text"), rule))).alias(rule.name) for rule in RULES]).first()
    assert all(hit), hit  # each rule has a fragment


def test_rules_of_others_are_not_prefiltered(spark):
    from maskflow.operators.rules import Rule, find_all

    df = spark.createDataFrame([("a-b",)], "text string")
    assert [m["original"] for m in df.select(find_all(F.col("text"), (Rule("x", "x", "a-b"),)).alias("s")).first()["s"]] == ["a-b"]


def test_layers(spark):
    kw = [("company", "acme")]
    assert spans(spark, "Acme@x.com", kw) == [("company", "Acme")]  # a tie in start: keywords win
    assert spans(spark, "a.acme@x.com", kw) == [("email", "a.acme@x.com")]  # the earliest start wins
    assert spans(spark, "CLEARY GOTTLIEB STEEN", [("company", "CLEARY"), ("company", "CLEARY GOTTLIEB STEEN")]) == [("company", "CLEARY GOTTLIEB STEEN")]
    assert spans(spark, "xACME Acmey", kw) == [("company", "ACME"), ("company", "Acme")]
    assert spans(spark, "a+b (c) a+b", [("company", "a+b"), ("person", "(c)")]) == [("company", "a+b"), ("person", "(c)"), ("company", "a+b")]
    assert spans(spark, "x", [("company", "x")]) == []  # too short


def test_repeated_texts_and_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.com from Bob Ray", '[{"text": "Bob Ray", "type": "person"}, {"text": "a@b.com", "type": "company"}]')] * 2 + [(2, None, None)], "k int, text string, found string")
    df = df.withColumn("names", located(F.col("text"), F.from_json("found", "array<struct<text:string,type:string>>")))
    out = detect(df, names="names").orderBy("k").collect()
    assert len(out) == 3
    assert [(m["layer"], m["original"]) for m in out[0]["spans"]] == [(1, "a@b.com"), (2, "Bob Ray")]


def test_keyword_file(spark):
    lines = ["# c", " Acme ", "[人名] 张三", "[人名]", ""]
    parsed = parse_keywords(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    assert as_keywords(parsed) == [("company", "Acme"), ("person", "张三"), ("company", "[人名]")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1@.+ 9-A(中😀", max_size=60), min_size=1, max_size=20))
def test_spans_never_overlap(spark, texts):
    rows = detect_each(spark.createDataFrame([(t,) for t in texts], "text string"), [("company", "ab")]).collect()
    for row in rows:
        end = 0
        for m in row["spans"]:
            assert m["s"] >= end and row["text"][m["s"] : m["e"]] == m["original"]
            end = m["e"]
