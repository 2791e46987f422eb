"""Keyword tables against a plain search, in one block and in many."""

import random
import time

import pytest
from pyspark.sql import functions as F

SCHEMA = "entity_type string, keyword string, ord int"


def plain(text, keywords):
    """Longest first; a keyword's occurrences from left to right, each kept that no longer one covers."""
    if text is None or not text.strip():
        return []
    order = {}
    for kind, _, o in keywords:
        order[kind] = min(o, order.get(kind, o))
    ranked = sorted((k for k in keywords if k[1] and len(k[1]) >= 2), key=lambda k: (-len(k[1]), order[k[0]], k[2]))
    low, covered, out = text.lower(), set(), []
    for kind, word, _ in ranked:
        at = low.find(word.lower())
        while at >= 0:
            end = at + len(word)
            if not covered & set(range(at, end)):
                covered |= set(range(at, end))
                out.append((at, end, kind, text[at:end]))
            at = low.find(word.lower(), end)
    return sorted(out)


def made():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abAé ") for _ in range(rng.randint(1, 6)))
    keywords = [(rng.choice(["company", "person", "address"]), word(), k) for k in range(120)]
    keywords += [("company", None, 200), ("person", "\\E.*", 201), ("address", "ΑΣ", 202), ("company", "İx", 203)]
    texts = ["".join(rng.choice("abAÉé  xy") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return keywords, [*texts, None, "", "  ", "a\\E.*b", "İxΑΣα", "aaaaaaa"]


@pytest.mark.parametrize("block", [None, 60])
def test_equals_plain_search(spark, monkeypatch, block):
    from maskflow.operators import keyword_table

    if block:
        monkeypatch.setattr(keyword_table, "BLOCK", block)
    keywords, texts = made()
    fragments = spark.createDataFrame([(k, None if k % 7 else 1, t) for k, t in enumerate(texts)], "a int, b int, text string")
    got = keyword_table.matched(fragments, spark.createDataFrame(keywords, SCHEMA), ["a", "b"])
    assert got.columns == ["a", "b", "text", "spans"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(r["text"], keywords) if r["text"] != "İxΑΣα" else [(0, 2, "company", "İx"), (2, 4, "address", "ΑΣ")]
        assert [(m["s"], m["e"], m["entity_type"], m["original"]) for m in r["spans"]] == want, r["text"]


def test_lists_of_any_length_find_the_same(spark):
    """Keywords as literals of the plan and as an automaton."""
    from maskflow.operators import dictionary

    keywords, texts = made()
    listed = [(kind, word) for kind, word, _ in keywords[:8]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    few = [[(m["s"], m["e"]) for m in r[0]] for r in df.select(dictionary.find_keywords(F.col("text"), listed)).collect()]
    many = [[(m["s"], m["e"]) for m in r[0]] for r in df.select(dictionary.find(spark, F.col("text"), dictionary.by_priority(listed))).collect()]
    assert few == many and any(few)


def test_a_hundred_thousand_keywords(spark):
    """The plan doesn't grow, and texts are searched once."""
    from maskflow.operators.keyword_table import matched

    keywords = spark.range(100_000).select(F.lit("company").alias("entity_type"), F.format_string("Company number %06d", "id").alias("keyword"), F.col("id").cast("int").alias("ord"))
    texts = spark.range(2000).select("id", F.concat(F.lit("from company NUMBER "), F.lpad((F.col("id") * 53 % 120_000).cast("string"), 6, "0"), F.lit(" on")).alias("text"))
    began = time.time()
    df = matched(texts, keywords, ["id"])
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert df.filter(F.size("spans") == 1).count() == sum(k * 53 % 120_000 < 100_000 for k in range(2000))
    assert time.time() - began < 90


def test_no_keywords(spark):
    from maskflow.operators.keyword_table import matched

    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert matched(df, spark.createDataFrame([], SCHEMA), ["id"]).first()["spans"] == []
