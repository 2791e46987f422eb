"""Detection over all layers: keywords, rules, and names from a recogniser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.spans import earliest_wins, no_spans, quoted
from maskflow.operators.dictionary import find_keywords
from maskflow.operators.rules import RULES, Rule, find_all

#: Characters of a text that may repeat, as cells and names of files do.
REPEATED = 200


def detect(
    fragments: DataFrame,
    keywords: list[tuple[str, str]] = (),
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    names: str | None = None,
) -> DataFrame:
    """``fragments`` with ``spans``: what is to be replaced, by start.

    Each distinct short text is searched once and joined back, as texts of tables and
    forms repeat; longer ones are searched where they lie, so no long text is exchanged.
    ``names`` is a column of spans from a recogniser (layer 2).
    """
    def found() -> Column:
        return earliest_wins(
            F.concat(find_keywords(F.col(text), list(keywords)), find_all(F.col(text), rules), F.coalesce(F.col(names), no_spans()) if names else no_spans())
        )

    short = F.coalesce(F.length(text) <= REPEATED, F.lit(False))
    carried = [text] + ([names] if names else [])
    distinct = fragments.filter(short).select(*carried).dropDuplicates([text])
    hits = distinct.select(F.col(text).alias("_text"), found().alias("spans")).filter(F.size("spans") > 0)
    joined = fragments.filter(short).join(hits, F.col(text) == F.col("_text"), "left").drop("_text").withColumn("spans", F.coalesce("spans", no_spans()))
    long = fragments.filter(~short)
    return joined.unionByName(long.withColumn("spans", found()))


def detect_each(fragments: DataFrame, keywords: list[tuple[str, str]] = (), rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """As :func:`detect` for texts that hardly repeat: no exchange, each text where it lies."""
    return fragments.withColumn("spans", earliest_wins(F.concat(find_keywords(F.col(text), list(keywords)), find_all(F.col(text), rules))))


def exploded(detected: DataFrame, *keep: str) -> DataFrame:
    """One row per span."""
    # a plain inline() filters by the array's size first, and so finds all spans twice
    return detected.select(*keep, F.inline_outer("spans")).filter(F.col("s").isNotNull())


def span_counts(detected: DataFrame, *by: str) -> DataFrame:
    return exploded(detected, *by).groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def located(text: Column, entities: Column) -> Column:
    """Spans (layer 2) of recognised names, ``array<struct<text, type>>``: exact spelling, companies and persons only.

    Spans that earlier layers take are sorted out by ``earliest_wins``.
    """
    kept = F.filter(
        F.transform(
            F.coalesce(entities, F.array().cast("array<struct<text:string,type:string>>")),
            lambda e: F.struct(F.regexp_replace(e["text"], r"(?U)^\s++|(?<!\s)\s++$", "").alias("text"), e["type"].alias("type")),
        ),
        lambda e: (F.length(e["text"]) >= 2) & e["type"].isin("company", "person"),
    )

    def places(e: Column, k: Column) -> Column:
        gaps = F.split(text, quoted(e["text"]), -1)
        ends = F.aggregate(
            F.slice(gaps, 1, F.size(gaps) - 1),
            F.struct(F.lit(0).alias("at"), no_spans().alias("out")),
            lambda acc, gap: F.struct(
                (acc["at"] + F.length(gap) + F.length(e["text"])).alias("at"),
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + F.length(gap)).alias("s"),
                        (acc["at"] + F.length(gap) + F.length(e["text"])).alias("e"),
                        F.lit(2).alias("layer"),
                        k.alias("rule_id"),
                        e["type"].alias("entity_type"),
                        e["text"].alias("original"),
                    ),
                ).alias("out"),
            ),
        )
        return ends["out"]

    return F.flatten(F.transform(kept, places))
