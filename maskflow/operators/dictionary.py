"""User keywords: reading a keyword file and finding its entries in text.

A few keywords are compiled into the plan as literals, longest first; a longer list is
searched by an automaton (:mod:`maskflow.operators.keyword_table`), which also takes
tables of any size.  Matching ignores case, knows no word boundaries and keeps the
text's own spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions.spans import first_wins, found_by, is_blank, let, literal, no_spans, search
from maskflow.operators.keyword_table import find

# Marks before a keyword and the types they give.
PREFIXES = (("[人名]", "person"), ("[公司]", "company"), ("[地址]", "address"), ("[银行]", "bank_name"), ("[签字]", "person"))
SHORTEST = 2
#: More keywords than these aren't written into the plan.
LITERALS = 8


def parse_keywords(lines: DataFrame, column: str = "value", order: str = "ord") -> DataFrame:
    """(entity_type, keyword, ord) from the lines of a keyword file.

    ``#`` begins a comment line, blank lines go, a line without a mark is a
    company, and so is a mark with nothing after it.
    """
    strip = r"(?U)^\s++|(?<!\s)\s++$"
    line = F.regexp_replace(F.col(column), strip, "")
    df = lines.select(line.alias("line"), F.col(order).alias("ord")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    marked = F.lit(None).cast("string")
    for mark, kind in reversed(PREFIXES):
        marked = F.when(F.col("line").startswith(mark), F.lit(kind)).otherwise(marked)
    after = F.regexp_replace(F.regexp_replace(F.col("line"), r"^[^\]]*\]", ""), strip, "")
    after = F.regexp_replace(F.regexp_replace(after, "^】", ""), strip, "")
    df = df.withColumn("kind", marked).withColumn("rest", after)
    named = F.col("kind").isNotNull() & (F.col("rest") != "")
    return df.select(
        F.when(named, F.col("kind")).otherwise(F.lit("company")).alias("entity_type"),
        F.when(named, F.col("rest")).otherwise(F.col("line")).alias("keyword"),
        "ord",
    )


def as_keywords(parsed: DataFrame) -> list[tuple[str, str]]:
    """The keyword list in file order: a user's list, small by nature."""
    return [(r["entity_type"], r["keyword"]) for r in parsed.orderBy("ord").collect()]


def by_priority(keywords: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Longest first; among equals the order of types, then of lines."""
    grouped: dict[str, list[str]] = {}
    for kind, word in keywords:
        grouped.setdefault(kind, []).append(word)
    flat = [(kind, word) for kind, words in grouped.items() for word in words if len(word) >= SHORTEST]
    return sorted(flat, key=lambda x: -len(x[1]))


def find_keywords(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """Spans (layer 0) of all keywords, longer ones first where they overlap."""
    ranked = by_priority(keywords)
    if not ranked:
        return no_spans()
    if len(ranked) > LITERALS:
        return find(SparkSession.getActiveSession(), text, ranked)
    found = found_by([search(text, literal(word, True), k, kind) for k, (kind, word) in enumerate(ranked)], 0)
    return F.when(is_blank(text), no_spans()).otherwise(first_wins(found))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether a text holds any keyword, whatever the case."""
    if len(keywords) > LITERALS:
        return F.size(find(SparkSession.getActiveSession(), text, [("", k) for k in keywords])) > 0

    def held(lowered: Column) -> Column:
        found = F.lit(False)
        for word in keywords:
            found = found | F.contains(lowered, F.lower(F.lit(word)))
        return found

    return let(F.lower(text), held)
