"""License scans, in DataFrame functions only.

Two ways of finding licences: phrases whose words stand consecutively, and an
exact set-similarity join between text blocks and licence templates (public
licence texts and notices).  Blocks are windows of words, so line ends make no
difference.  For templates of up to n words (n from ``WINDOWS``) they are 2 n words
long, one at every n words: a shorter text is one block, and any stretch of n words
lies in a block whole.  The join orders tokens by their frequency over all blocks, rarest first, and finds every
block that holds at least ``threshold`` of a template's distinct tokens:

* prefix: a block that shares ``o`` of ``t`` template tokens shares one of the
  template's first ``t - o + 1``, and that one is among the block's own first
  ``b - o + 1``;
* length: a block with fewer than ``o`` template tokens can't match;
* position: a first match at places (i, j) leaves at most ``1 + min(t-i, b-j)``
  shared tokens.

Templates are a fixed list, so their side of the join has a fixed size, and so has
the table of their tokens' frequencies, which the driver reads.

Defined results: null and empty texts have no words and no labels; repeated rows
each get their own result; the base labels always stay; an empty table gives an
empty table; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.license_texts import PHRASES, TEXTS
from maskflow.llm.shared import stored

#: Words of short and of long templates, at most.
WINDOWS = (32, 256)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"  # lower() would turn it into an ASCII k


def _words(text: Column) -> Column:
    """Lower-cased words; only the first or last part of a split can be empty."""
    lowered = F.lower(F.replace(text, F.lit(KELVIN), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _place(first: str, rest: list[str], label: str):
    def at(x: Column, i: Column) -> Column:
        same = x == first
        for k, w in enumerate(rest, 1):
            same = same & (F.get("words", i + k) == w)
        return F.when(same, F.struct(i.alias("at"), F.lit(label).alias("label")))

    return at


def _base(df: DataFrame) -> DataFrame:
    """Adds ``places``: every (start, label) of a phrase."""
    lowered = F.lower("text")
    found = []
    for phrase, label in PHRASES:
        first, *rest = phrase.split()

        found.append(
            F.when(
                F.contains(lowered, F.lit(rest[-1])) & F.contains(lowered, F.lit(first)),
                F.filter(F.transform("words", _place(first, rest, label)), lambda x: x.isNotNull()),
            ).otherwise(F.array().cast("array<struct<at:int,label:string>>"))
        )
    return df.withColumn("places", F.concat(*found))


def templates(threshold: float) -> list[tuple[int, int, str, list[str], int]]:
    """(number, words of its windows, label, distinct tokens, tokens that a block must hold)."""
    rows = []
    for k, (label, text) in enumerate(TEXTS):
        words = re.findall("[0-9a-z]+", text.lower())
        tokens = sorted(set(words))
        rows.append((k, min(n for n in WINDOWS if n >= len(words)), label, tokens, math.ceil(threshold * len(tokens) - 1e-9)))
    return rows


def _blocks(size: int, listed) -> Column:
    """(size, block, tokens) of the windows that hold enough tokens of any template of their size."""
    own = [(tokens, o) for _, n, _, tokens, o in listed if n == size]
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for tokens, _ in own for t in tokens})])
    least = min(o for _, o in own)
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - size - 1, F.lit(0)), F.lit(size))
    windows = F.transform(
        places, lambda b, i: F.struct(F.lit(size).alias("size"), i.alias("block"), F.array_intersect(F.slice("words", b + 1, 2 * size), vocabulary).alias("tokens"))
    )
    return F.filter(windows, lambda x: F.size(x["tokens"]) >= least)


def scan(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, matched.

    ``matched`` lists the matching (size, block, label, containment); block k of a size begins at word k * size.
    """
    spark = docs.sparkSession
    listed = templates(threshold)
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", _words(F.col("text")))
    df = _base(df)
    df = df.withColumn("blocks", F.concat(*[_blocks(n, listed) for n in WINDOWS]))
    scanned = stored(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.size("words").cast("bigint").alias("n_words"),
            F.size("places").cast("bigint").alias("n_base"),
            F.array_min(F.transform("places", lambda p: p["at"])).cast("bigint").alias("first_word"),
            F.array_max(F.transform("places", lambda p: p["at"])).cast("bigint").alias("last_word"),
            F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("own"),
            "blocks",
        ),
        "license-blocks",
    )
    blocks = scanned.select("row", F.inline("blocks"))
    # Ranks of at most a few hundred template tokens; those no block holds come first.
    ranks = (
        blocks.select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    quoted = ", ".join(
        f"({k}, {n}, '{label}', array({', '.join(repr(t) for t in tokens)}), {o})" for k, n, label, tokens, o in listed
    )
    table = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(template, size, label, tokens, needed)")
    # one number for each token of the templates
    counts = {r["token"]: r["n"] for r in ranks.collect()}
    number = F.create_map(*[F.lit(x) for token in sorted({t for *_, tokens, _ in listed for t in tokens}) for x in (token, counts.get(token, 0))])

    def by_frequency(tokens: Column) -> Column:
        pairs = F.transform(tokens, lambda x: F.struct(F.element_at(number, x).alias("n"), x.alias("token")))
        return F.transform(F.sort_array(pairs), lambda x: x["token"])

    index = (
        table.withColumn("template_tokens", by_frequency(F.col("tokens")))
        .withColumn("t", F.size("tokens"))
        .select("template", "size", "label", "needed", "t", "template_tokens", F.posexplode(F.slice("template_tokens", F.lit(1), F.col("t") - F.col("needed") + 1)).alias("i", "token"))
    )
    ordered = blocks.withColumn("tokens", by_frequency(F.col("tokens")))
    met = (
        ordered.select("row", "size", "block", "tokens", F.posexplode("tokens").alias("j", "token"))
        .join(F.broadcast(index), ["size", "token"])
        .filter(
            (F.size("tokens") >= F.col("needed"))
            & (F.col("j") <= F.size("tokens") - F.col("needed"))
            & (1 + F.least(F.col("t") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1) >= F.col("needed"))
        )
        .withColumn("shared", F.size(F.array_intersect("tokens", "template_tokens")))
        .filter("shared >= needed")
        .groupBy("row", "size", "block", "template")
        .agg(F.first("label").alias("label"), F.max(F.col("shared") / F.col("t")).alias("containment"))
    )
    per_row = met.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("size", "block", "label", "containment"))).alias("matched")
    )
    labels = F.array_sort(F.array_distinct(F.concat("own", F.coalesce(F.transform("matched", lambda m: m["label"]), F.array().cast("array<string>")))))
    return scanned.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("matched", lambda m: m["containment"])), F.lit(0.0)))
        .alias("score"),
        "matched",
    )
