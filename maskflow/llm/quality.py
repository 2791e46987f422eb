"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines and repeated five-word
windows) and three rates in thousandths.  The rates go into quantile sketches,
one per (lang, source): a histogram with 32 steps to each power of two, whose
bucket numbers come from integer arithmetic.  Such sketches merge by adding
counts, so a partial aggregate in each task is a sketch and the result does not
depend on how rows are dealt out.  Limits are read from the merged sketch and
joined back; they replace fixed cutoffs.  A limit stands on the median and the
upper quartile, which a quarter of junk doesn't move, and a group's is at most
``cap`` times that of the whole table, so a source that is mostly junk doesn't
set its own standard.

Counts are made once and stored with the columns to keep; the limits are read from
them.  Defined results: a null text counts as empty; null ``lang`` or ``source``
form a group of their own; repeated rows are judged alike, each for itself; groups
with fewer than ``min_group`` documents take the limits of the whole table; an
empty table gives an empty table; other columns pass through whatever their names,
but a column ``_quality`` is replaced by :func:`judged`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.shared import Shelf, sized_join

WHITE = r"[\x20\x09-\x0D]+"
RATES = ("symbols", "dup_lines", "word_length")


@dataclass(frozen=True)
class QualityParams:
    """``spread`` times the distance from median to ``upper`` quantile (``floor`` at least) may lie above ``upper``; ``cap`` times the whole table's limit at most."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    upper: float = 0.75
    spread: int = 4
    cap: int = 2
    #: least distance, in thousandths, for each of RATES
    floor: tuple[int, int, int] = (50, 100, 300)
    min_group: int = 30


def _counted(docs: DataFrame, keep: list[str], p: QualityParams) -> DataFrame:
    """The columns in ``keep`` as c0, c1, ..., lang and source as q_lang and q_source, and a struct _quality of counts and rates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    df = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
        F.col("lang").alias("q_lang"),
        F.col("source").alias("q_source"),
        text.alias("_q_text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE)).alias("_q_words"),
    )
    df = df.withColumn("_q_hashes", F.transform("_q_words", lambda x: F.xxhash64(x)))
    df = df.withColumn("_q_n", F.size("_q_hashes"))
    k = p.window

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("_q_hashes", i + j) for j in range(k)])

    df = df.withColumn(
        "_q_grams",
        F.when(F.col("_q_n") >= k, F.transform(F.sequence(F.lit(0), F.col("_q_n") - k), window)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    repeats = F.size("_q_grams") != F.size(F.array_distinct("_q_grams"))
    df = df.withColumn(
        "_q_sorted",
        F.when(
            repeats,
            F.sort_array(F.transform("_q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        "_q_at",
        F.when(
            F.col("_q_sorted").isNotNull(),
            F.sort_array(
                F.filter(
                    F.transform(
                        "_q_sorted",
                        lambda x, j: F.when(
                            (F.get("_q_sorted", j - 1)["h"] == x["h"]) | (F.get("_q_sorted", j + 1)["h"] == x["h"]),
                            x["i"],
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform("_q_at", lambda i, j: F.least(F.lit(k), F.coalesce(F.get("_q_at", j + 1) - i, F.lit(k)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    df = df.withColumn(
        "_q_lines",
        F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    n = F.col("_q_n").cast("bigint")
    df = df.withColumn(
        "_quality",
        F.struct(
            n.alias("n_words"),
            F.length(F.array_join("_q_words", "")).cast("bigint").alias("word_chars"),
            (F.length("_q_text") - F.length(F.regexp_replace("_q_text", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
            (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
            F.size("_q_lines").cast("bigint").alias("n_lines"),
        ),
    )
    q = F.col("_quality")
    df = df.withColumn(
        "_quality",
        q.withField("symbols", F.expr("_quality.n_symbols * 1000 div greatest(_quality.n_words, 1)"))
        .withField("dup_lines", F.expr("_quality.n_dup_lines * 1000 div greatest(_quality.n_lines, 1)"))
        .withField("word_length", F.expr("_quality.word_chars * 1000 div greatest(_quality.n_words, 1)"))
        .withField(
            "base_failed",
            (q["n_words"] < p.min_words) | (q["n_repeat_words"] * 100 > q["n_words"] * p.max_repeat_percent),
        ),
    )
    # A generator's output stays above it: a filter on the counts isn't pushed
    # down, where every count would be written out again inside the lambdas.
    return df.select(*[f"c{i}" for i in range(len(keep))], "q_lang", "q_source", F.explode(F.array("_quality")).alias("_quality"))


def bucket(v: Column) -> Column:
    """Histogram bucket of a rate: itself up to 31, then 32 steps to each power of two."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest rate that falls into a bucket."""
    e = F.when(b < 64, F.lit(0)).otherwise(F.floor(b / 32) - 1).cast("int")
    return F.call_function("shiftleft", (b - e * 32 + 1).cast("bigint"), e) - 1


def sketches(counted: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: (lang, source, rate, bucket, n) over documents that pass the base rules."""
    return (
        counted.filter(~F.col("_quality.base_failed"))
        .select(
            F.col("q_lang").alias("s_lang"),
            F.col("q_source").alias("s_source"),
            F.inline(
                F.array(*[F.struct(F.lit(k).alias("rate"), bucket(F.col(f"_quality.{name}")).alias("bucket")) for k, name in enumerate(RATES)])
            ),
        )
        .groupBy("s_lang", "s_source", "rate", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def limits(sketch: DataFrame, p: QualityParams) -> DataFrame:
    """Per group the largest rates that are kept; ``s_all`` marks the row for the whole table.

    One row for each (lang, source); the buckets of a group are at most a few
    hundred, whatever the number of documents.
    """
    whole = sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).select(
        F.lit(None).cast("string").alias("s_lang"), F.lit(None).cast("string").alias("s_source"), "rate", "bucket", "n", F.lit(True).alias("s_all")
    )
    both = sketch.select("s_lang", "s_source", "rate", "bucket", "n", F.lit(False).alias("s_all")).unionByName(whole)
    per_rate = both.groupBy("s_all", "s_lang", "s_source", "rate").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h")
    )

    def quantile(q: float) -> Column:
        found = F.aggregate(
            "h",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).alias("at")),
            lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.when((a["at"] < 0) & ((a["seen"] + x["n"]) * 100 >= F.col("total") * round(q * 100)), x["bucket"])
                .otherwise(a["at"])
                .alias("at"),
            ),
        )
        return bucket_top(found["at"])

    floors = F.element_at(F.array(*[F.lit(x) for x in p.floor]), F.col("rate") + 1)
    read = per_rate.withColumn("middle", quantile(0.5)).withColumn("upper", quantile(p.upper))
    limit = (F.col("upper") + p.spread * F.greatest(F.col("upper") - F.col("middle"), floors)).cast("bigint")
    return read.groupBy("s_all", "s_lang", "s_source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("rate") == k, limit)).alias(name) for k, name in enumerate(RATES)]
    )


def judged(docs: DataFrame, p: QualityParams = QualityParams(), keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all, if not given) with a struct ``_quality`` (counts, rates, base_failed, kept)."""
    keep = [c for c in docs.columns if c != "_quality"] if keep is None else keep
    shelf = Shelf(docs.sparkSession)
    counted = shelf.put("quality-counts", _counted(docs, keep, p))
    table = shelf.put("quality-limits", limits(sketches(counted), p))
    own = table.filter(~F.col("s_all") & (F.col("total") >= p.min_group)).select("s_lang", "s_source", F.struct(*RATES).alias("s_own"))
    whole = table.filter("s_all").first()  # one row at most: the limits of all documents
    df = sized_join(counted, own, counted["q_lang"].eqNullSafe(own["s_lang"]) & counted["q_source"].eqNullSafe(own["s_source"]))
    within = F.lit(True)
    for name in RATES:
        everywhere = F.lit(whole[name] if whole else None).cast("bigint")
        limit = F.when(F.col("s_own").isNull(), everywhere).otherwise(F.least(F.col("s_own")[name], everywhere * p.cap))
        within = within & F.coalesce(F.col(f"_quality.{name}") <= limit, F.lit(True))
    kept = F.col("_quality").withField("kept", ~F.col("_quality.base_failed") & within)
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], kept.alias("_quality"))


def keep_good(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents that pass, with their columns as they came."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    asked = docs.toDF(*inner).select(*inner, *[F.col(inner[names.index(c)]).alias(c) for c in ("text", "lang", "source")])
    return judged(asked, p, inner).filter("_quality.kept").select(*[F.col(i).alias(c) for i, c in zip(inner, names)])
