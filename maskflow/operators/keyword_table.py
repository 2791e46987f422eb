"""Keywords as a table of any size, found by an automaton.

Keywords are ranked (longest first, then types and lines in their order) and dealt
into blocks of ``BLOCK`` characters, so that a worker's automaton has a bounded size
whatever the list.  A block is broadcast and its automaton is built once in a worker;
it goes through a text once, whatever the number of keywords.  Occurrences of a
keyword don't overlap each other, from left to right; over all keywords the longer one
wins (:func:`maskflow.functions.spans.first_wins`).  The plan is the same for ten
keywords and for a million.

A list that fits one block is a column expression (:func:`find`).  A longer one goes
block by block: what each finds is stored under the fragments' key, and a fragment's
spans are gathered before they are resolved (:func:`matched`).

Defined results: a null or blank text has no spans; keywords of fewer than two
characters and nulls are left out; of keywords that differ only in case the first
counts; an empty list finds nothing; a character whose small form has another length
stays as it is.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskflow.functions.numbering import numbered
from maskflow.functions.spans import SPANS, first_wins, is_blank, no_spans
from maskflow.functions.storage import stored

SHORTEST = 2
#: Characters of the keywords of one automaton.
BLOCK = 2_000_000
#: The automaton of this worker, by its finder's number; one at a time.
_built: dict = {}


def folded(text: str) -> str:
    """Small letters, one for each character."""
    small = text.lower().replace("ς", "σ")
    return small if len(small) == len(text) else "".join(s if len(s := c.lower()) == 1 else c for c in text).replace("ς", "σ")


def automaton(words: list[str]):
    """An automaton that gives the place in the list of every word that ends somewhere; of equal words the first."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k in range(len(words) - 1, -1, -1):
        made.add_word(folded(words[k]), k)
    if words:
        made.make_automaton()
    return made


def occurrences(made, lengths: list[int], text: str) -> list[tuple[int, int]]:
    """(start, place of the keyword), each keyword's occurrences from left to right without overlaps."""
    ends: dict[int, int] = {}
    found = []
    for last, k in made.iter(folded(text)):
        start = last + 1 - lengths[k]
        if start >= ends.get(k, 0):
            ends[k] = last + 1
            found.append((start, k))
    return found


def _finder(spark: SparkSession, block: list[tuple[str, str]], first: int) -> Callable[[Column], Column]:
    """A function of text columns: the spans of a block's keywords (type, keyword), whose ranks begin with ``first``."""
    import pyarrow as pa

    held, number = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        from maskflow.operators import keyword_table as here  # the worker's module, not a copy that travels with the task

        if number not in here._built:
            here._built.clear()
            here._built[number] = automaton([w for _, w in held.value]), [len(w) for _, w in held.value]
        made, lengths = here._built[number]
        offsets, starts, ends, ranks, kinds, originals = [0], [], [], [], [], []
        for text in texts.to_pylist():
            for s, k in occurrences(made, lengths, text) if text and lengths else ():
                starts.append(s)
                ends.append(s + lengths[k])
                ranks.append(first + k)
                kinds.append(held.value[k][0])
                originals.append(text[s : s + lengths[k]])
            offsets.append(len(starts))
        fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([0] * len(starts), pa.int32()), pa.array(ranks, pa.int32()), pa.array(kinds, pa.string()), pa.array(originals, pa.string())]
        spans = pa.StructArray.from_arrays(fields, names=["s", "e", "layer", "rule_id", "entity_type", "original"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)

    return F.arrow_udf(run, SPANS)


def find(spark: SparkSession, text: Column, ranked: list[tuple[str, str]]) -> Column:
    """Spans (layer 0) of keywords (type, keyword) in order of priority, for a list that fits one block."""
    if sum(len(w) for _, w in ranked) > BLOCK:
        raise ValueError(f"keywords of more than {BLOCK} characters: use matched()")
    searched = F.when(~is_blank(text), text)
    return F.when(searched.isNull(), no_spans()).otherwise(first_wins(_finder(spark, ranked, 0)(searched)))


def ranked(keywords: DataFrame) -> DataFrame:
    """(entity_type, keyword, rank, block) of (entity_type, keyword, ord): longest first, then by the first line of the type, then by line."""
    kept = keywords.filter(F.length("keyword") >= SHORTEST)
    # one row for each type
    types = keywords.groupBy(F.col("entity_type").alias("_type")).agg(F.min("ord").alias("type_ord"))
    placed = kept.join(F.broadcast(types), F.expr("entity_type <=> _type")).drop("_type")
    order = F.struct((-F.length("keyword")).alias("n"), "type_ord", "ord", "entity_type", "keyword")
    numbers = numbered(placed.withColumn("place", order), None, "place", "rank")
    # keywords of one length follow each other, so characters before a rank are sums over the lengths
    sized = numbers.withColumn("n", F.length("keyword")).select("entity_type", "keyword", (F.col("rank") - 1).cast("int").alias("rank"), "n")
    lengths = sized.groupBy("n").agg(F.count(F.lit(1)).alias("held"), F.min("rank").alias("first"))  # a row for each length
    before = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chars = lengths.select("n", "first", F.coalesce(F.sum(F.col("held") * F.col("n")).over(before), F.lit(0)).alias("chars"))
    at = F.col("chars") + (F.col("rank") - F.col("first") + 1).cast("bigint") * F.col("n")
    return sized.join(F.broadcast(chars), "n").select("entity_type", "keyword", "rank", F.floor((at - 1) / BLOCK).cast("int").alias("block"))


def matched(fragments: DataFrame, keywords: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``fragments`` with ``spans`` (layer 0) of a keyword table (entity_type, keyword, ord) of any size.

    ``key`` names a fragment; it is used where keywords need several blocks.
    """
    spark = fragments.sparkSession
    placed = stored(ranked(keywords), "keywords")
    blocks = [r["block"] for r in placed.select("block").distinct().orderBy("block").collect()]

    def block(b: int) -> tuple[list[tuple[str, str]], int]:
        rows = placed.filter(F.col("block") == b).orderBy("rank").collect()  # a block's characters at most
        return [(r["entity_type"], r["keyword"]) for r in rows], rows[0]["rank"]

    searched = F.when(~is_blank(F.col(text)), F.col(text))
    if not blocks:
        return fragments.withColumn("spans", no_spans())
    if len(blocks) == 1:
        return fragments.withColumn("spans", F.when(searched.isNull(), no_spans()).otherwise(first_wins(_finder(spark, *block(blocks[0]))(searched))))
    parts = None
    for b in blocks:
        found = fragments.select(*key, _finder(spark, *block(b))(searched).alias("_found")).filter(F.size("_found") > 0)
        part = stored(found, "keyword-spans")
        parts = part if parts is None else parts.unionByName(part)
    spans = parts.groupBy(*key).agg(F.flatten(F.collect_list("_found")).alias("_found"))  # bounded by a text's spans
    resolved = spans.select(*[F.col(c).alias(f"_{c}") for c in key], first_wins(F.col("_found")).alias("spans"))
    same = [fragments[c].eqNullSafe(resolved[f"_{c}"]) for c in key]
    joined = fragments.join(resolved, same, "left").drop(*[f"_{c}" for c in key])
    return joined.withColumn("spans", F.coalesce("spans", no_spans()))
