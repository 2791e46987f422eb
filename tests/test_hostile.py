"""Texts that make a backtracking engine recurse or start over: long runs of every shape, and very many matches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

N = 1_000_000
SHAPES = {
    "unquoted tag": "<a " + "x" * N + ">",
    "open tag": "<b" + " y" * (N // 2),
    "open tags": "<b x" * (N // 4),
    "open quotes": "<b '" * (N // 4) + '<b "',
    "open scripts": "<script " * (N // 8),
    "pairs of quotes": "<a " + "b='c' " * (N // 6) + ">",
    "dotted host": "see www" + ".ab" * (N // 3),
    "dotted numbers": "http://a" + ".1" * (N // 2),
    "dashes": "http://a" + "-" * N,
    "digits": "+" + "1" * N,
    "groups of digits": "+1 " + "(22) " * (N // 5),
    "short groups": "+1" + " 234" * (N // 4),
    "local part": "a." * (N // 2) + "@",
    "words before @": "ab " * (N // 3) + "@",
    "domain": "a@" + "b." * (N // 2),
    "cards": "1234 " * (N // 5),
    "iban": "GB82" + "WEST" * (N // 4),
    "iban groups": "GB82 " + "WEST " * (N // 5),
    "letters": "ABCDEFGH" * (N // 8),
    "colons": "Invoice No" + ":" * N,
    "spaces": "x" + " " * N + "y",
    "thousands": "1" + ",000" * (N // 4) + ".5.",
    "currencies": "$ " * (N // 2),
    "fractions": "1.5" * (N // 3),
    "underscores": "1_" * (N // 2) + "1",
    "references": "&#1" * (N // 3),
}


@pytest.fixture(scope="module")
def shapes(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shapes") / "t")
    spark.createDataFrame(list(SHAPES.items()), "shape string, text string").repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_every_rule_ends(shapes):
    from maskflow.operators.rules import RULES, find_all, raw_matches

    began = time.time()
    counts = {r["shape"]: r for r in shapes.select("shape", *[F.size(raw_matches(F.col("text"), rule)).alias(rule.name) for rule in RULES]).collect()}
    assert len(counts) == len(SHAPES)
    assert counts["dotted host"]["url"] == 1 and counts["dotted numbers"]["url"] == 0
    assert counts["digits"]["phone"] == 1 and counts["short groups"]["phone"] == 0
    assert counts["local part"]["email"] == 0
    assert shapes.select(F.sum(F.size(find_all(F.col("text"))))).first()[0] > 0
    assert time.time() - began < 240


def test_numbers_end(shapes):
    from maskflow.operators.scaling import csv_number, scale_in_text

    got = {r["shape"]: r for r in shapes.select("shape", csv_number(F.col("text")).alias("number"), F.length(scale_in_text(F.col("text"), F.lit(2.0))).alias("n")).collect()}
    assert got["digits"]["n"] == N + 1 and got["thousands"]["n"] == len(SHAPES["thousands"])
    assert all(got[k]["n"] >= len(v) - 1 for k, v in SHAPES.items())


def test_pages_end(shapes):
    from maskflow.sources.html import text_nodes, with_nodes

    pages = shapes.select(F.col("shape").alias("page_id"), F.concat(F.lit("<pre>a</pre><p>b</p>"), "text").alias("html"))
    nodes = text_nodes(pages)
    counts = {r["page_id"]: r["n"] for r in nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(counts) == len(SHAPES)
    assert counts["unquoted tag"] == counts["pairs of quotes"] == counts["open scripts"] == 1
    changed = nodes.withColumn("sanitized", F.when(F.col("text") == "b", "c").otherwise(F.col("text")))
    back = {r["page_id"]: r["sanitized"] for r in with_nodes(pages, changed).collect()}
    assert all(back[k] == "<pre>a</pre><p>c</p>" + v for k, v in SHAPES.items())


def test_many_matches(spark):
    """80,000 addresses in a text, with digits inside that other rules want, resolved and replaced."""
    from maskflow.functions.spans import splice
    from maskflow.operators.resolve import detect_each

    n = 80_000
    text = " ".join(f"u{k:06d}@ex.org" for k in range(n)) + " 123456789"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string").repartition(2)
    began = time.time()
    found = detect_each(df, [("company", "nothing here")]).select("doc_id", "text", "spans")
    pieces = F.transform("spans", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit("é").alias("replacement")))
    row = found.select(F.size("spans").alias("n"), splice(F.col("text"), pieces).alias("out")).first()
    assert row["n"] == n + 1 and row["out"] == " ".join(["é"] * (n + 1))
    assert time.time() - began < 120


@pytest.mark.parametrize("name", ["email", "url", "phone"])
def test_safe_patterns_find_the_same(spark, name):
    """What runs finds what the rule's pattern finds under Python's engine."""
    from maskflow.operators.rules import RULES, raw_matches

    alphabet = {
        "email": [*"ab1.-_%+@@字 ", "a.bc", "@x.co", "x" * 70],
        "url": ["http://", "https://", "www.", "WWW.", *"ab1-../x字 ", "com", "ſ"],
        "phone": [*"+++123456789012 ..-()()٣x", "1234", "55555"],
    }[name]
    rng = random.Random(9)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 24))) for _ in range(6000)]
    rule = next(r for r in RULES if r.name == name)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r["i"]: [(m["s"], m["e"]) for m in r["x"]] for r in df.select("i", raw_matches(F.col("t"), rule).alias("x")).collect()}
    plain = re.compile(re.sub(r"^\(\?i?U\)", "", rule.pattern), re.I if rule.pattern.startswith("(?iU)") else 0)
    want = {i: [m.span() for m in plain.finditer(t)] for i, t in enumerate(texts)}
    assert got == want
    assert sum(map(bool, want.values())) > 500


def test_resolution_by_groups(spark):
    """The same spans as by comparing each with all accepted ones."""
    from maskflow.functions.spans import SPANS, earliest_wins, first_wins

    rng = random.Random(2)
    rows = []
    for i in range(300):
        spans = []
        for rule in range(4):
            at = 0
            while at < 40 * (1 + i % 9):
                at += rng.randint(0, 12)
                e = at + rng.randint(1, 9)
                spans.append((at, e, rng.randint(0, 2), rule, "t", str(len(spans))))
                at = e
        rows.append((i, spans))
    rows.append((1000, []))

    def plain(spans):
        kept = []
        for m in sorted(spans, key=lambda m: (m[3], m[0])):
            if all(m[0] >= z[1] or m[1] <= z[0] for z in kept):
                kept.append(m)
        return sorted(kept)

    def across(spans):
        end, kept = 0, []
        for m in sorted(spans, key=lambda m: (m[0], m[2], m[3])):
            if m[0] >= end:
                kept.append(m)
                end = m[1]
        return kept

    df = spark.createDataFrame(rows, f"i int, spans {SPANS}")
    for r in df.select("i", "spans", first_wins(F.col("spans")).alias("a"), earliest_wins(F.col("spans")).alias("b")).collect():
        spans = [tuple(m) for m in r["spans"]]
        assert [tuple(m) for m in r["a"]] == plain(spans)
        assert [tuple(m) for m in r["b"]] == across(spans)
