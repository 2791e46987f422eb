"""Importance resampling towards a target distribution, over hashed n-grams.

A text's features are its runs of one to three words; each falls into a bucket.  A
bucket's gain is the logarithm of how much more frequent it is in the target than in
all documents, a document's weight the sum of gains over its features, and the
documents with the largest weights plus noise are drawn: sampling without replacement
by the Gumbel trick.

Texts that occur several times are collapsed by grouping on the full text: features
are made once, their counts go into the corpus with the text's multiplicity, and the
weight is computed once and joined back, by length and SHA-256 of the text, before
the noise of each document.  The two passes over features read one stored table of
bucket numbers.  Only the counts of buckets (``buckets`` rows) reach the driver, and
ranks are given over ranges, so that no task sorts all documents.  All is DataFrame
functions.

Defined results: null and empty texts have no features and weight 0; a null doc_id
counts as an empty text for the noise and comes last among equals; repeated rows are
documents of their own, their copies of a rank are dealt in any order; null target
texts add nothing; an empty table gives an empty table; other columns pass through
whatever their names, but a column ``_importance`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.shared import Shelf, sized_join
from maskflow.operators.mapping import numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ImportanceRule:
    """``percent`` of the documents with ``min_words`` words or more are drawn; ``unit`` parts make one of a logarithm."""

    runs: int = 3
    buckets: int = 10_000
    unit: int = 1000
    seed: str = "42:"
    min_words: int = 20
    percent: int = 5


def text_key() -> Column:
    """What tells full texts apart where the texts themselves don't travel: length and SHA-256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.hex(F.length(text).cast("string"))))


def featured(texts: DataFrame, rule: ImportanceRule, *keep: str) -> DataFrame:
    """``keep``, n_words and the bucket of every feature of ``text``."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    # a generator's output stays above it, so that lambdas see an array and not its expression
    cut = texts.select(*keep, F.explode(F.array(words)).alias("_words"))
    n = F.size("_words")

    def runs(k: int) -> Column:
        def bucket(i: Column) -> Column:
            parts = [x for j in range(k) for x in (F.lit(" "), F.get("_words", i + j))][1:]
            return (F.crc32(F.concat(*parts)) % rule.buckets).cast("int")

        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), bucket)).otherwise(F.array().cast("array<int>"))

    return cut.select(*keep, n.cast("bigint").alias("n_words"), F.concat(*[runs(k) for k in range(1, rule.runs + 1)]).alias("found"))


def bucket_counts(features: DataFrame, rule: ImportanceRule, times: str | None = None) -> list[int]:
    """How many features each bucket holds: a row for each bucket reaches the driver."""
    each = features.select(F.explode("found").alias("bucket"), (F.col(times) if times else F.lit(1)).cast("bigint").alias("times"))
    held = [0] * rule.buckets
    for r in each.groupBy("bucket").agg(F.sum("times").alias("n")).collect():
        held[r["bucket"]] = r["n"]
    return held


def gains(corpus: list[int], target: list[int], rule: ImportanceRule) -> list[int]:
    """Gain of each bucket, with one added to every count."""
    import math

    all_s, all_t = float(sum(corpus) + rule.buckets), float(sum(target) + rule.buckets)
    return [math.floor(rule.unit * math.log(((t + 1) * all_s) / ((s + 1) * all_t))) for s, t in zip(corpus, target)]


def weighed(docs: DataFrame, target: DataFrame, rule: ImportanceRule, shelf: Shelf) -> DataFrame:
    """(key, n_words, n_features, weight) of the distinct texts of ``docs``."""
    grouped = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    keyed = grouped.select(text_key().alias("key"), "times", "text")
    features = shelf.put("importance-features", featured(keyed, rule, "key", "times"))
    gained = gains(bucket_counts(features, rule, "times"), bucket_counts(featured(target.select("text"), rule), rule), rule)
    # one literal, read once
    table = F.split(F.lit(",".join(map(str, gained))), ",").cast("array<bigint>")
    weight = F.aggregate("found", F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(table, b))
    done = shelf.put("importance-weights", features.select("key", "n_words", F.size("found").cast("bigint").alias("n_features"), weight.alias("weight")))
    shelf.drop("importance-features")
    return done


def noise(key: Column, rule: ImportanceRule) -> Column:
    """Gumbel noise of a document, from a hash of its id."""
    digits = F.sha2(F.concat(F.lit(rule.seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-1.0 * rule.unit * F.log(-1.0 * F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def importance(docs: DataFrame, target: DataFrame, rule: ImportanceRule = ImportanceRule(), keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all, if not given) with ``_importance``: n_words, n_features, weight, score and rank (null if not drawn)."""
    shelf = Shelf(docs.sparkSession)
    keep = [c for c in docs.columns if c != "_importance"] if keep is None else keep
    weights = weighed(docs, target, rule, shelf)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("_id"), text_key().alias("key"))
    joined = sized_join(rows, weights, "key", "inner").drop("key")
    scored = shelf.put("importance-scores", joined.withColumn("score", F.col("weight") + noise(F.col("_id"), rule)))
    long = F.col("n_words") >= rule.min_words
    drawn = scored.filter(long).count() * rule.percent // 100
    # the last part deals copies of a row to several ranges
    order = F.struct((-F.col("score")).alias("s"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.monotonically_increasing_id().alias("m"))
    ranked = numbered(scored.filter(long).withColumn("_order", order), None, "_order", "rank").drop("_order")
    whole = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.filter(~long).withColumn("rank", F.lit(None).cast("bigint")))
    return whole.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.struct("n_words", "n_features", "weight", "score", "rank").alias("_importance"))


def drawn(docs: DataFrame, target: DataFrame, rule: ImportanceRule = ImportanceRule()) -> DataFrame:
    """The documents that are drawn, with their columns as they came."""
    names = docs.columns
    inner = [f"d{i}" for i in range(len(names))]
    asked = docs.toDF(*inner).select(*inner, *[F.col(inner[names.index(c)]).alias(c) for c in ("doc_id", "text")])
    return importance(asked, target, rule, inner).filter("_importance.rank IS NOT NULL").select(*[F.col(i).alias(c) for i, c in zip(inner, names)])
