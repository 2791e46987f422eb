"""The table of replacements: one row for each (original, entity_type), kept from run to run.

New entities are numbered in the order of first sight: by file, by fragment, and
within a fragment from right to left.  Numbers go on from the rows that a type has.
They are numbered over ranges (:mod:`maskflow.functions.numbering`), so that a type with
a third of all entities isn't sorted in one task.

Spans are found once: :func:`held_spans` stores them, the mapping is made from them
and :func:`rewrite` brings their replacements back to the fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.functions.numbering import numbered
from maskflow.functions.spans import splice
from maskflow.functions.storage import stored
from maskflow.operators.pseudonyms import replacement
from maskflow.operators.resolve import exploded

MAPPING = "original string, entity_type string, replacement string, first_seen_file string, created_at timestamp"
META = "_meta"


def empty_mapping(spark) -> DataFrame:
    return spark.createDataFrame([], MAPPING)


def first_seen(spans: DataFrame, order: list[str], file: str | None = None) -> DataFrame:
    """(original, entity_type, seen, first_seen_file): each entity at its first place; ``spans`` has the span columns and ``order``."""
    place = F.struct(*[F.col(c) for c in order], (-F.col("s")).alias("right"))
    return spans.groupBy("entity_type", "original").agg(
        F.min(place).alias("seen"),
        (F.min_by(F.col(file), place) if file else F.lit(None).cast("string")).alias("first_seen_file"),
    )


def held_spans(detected: DataFrame, *key: str) -> DataFrame:
    """One row per span with its fragment's key, stored: texts aren't searched again."""
    return stored(exploded(detected, *key), "spans")


def new_rows(seen: DataFrame, mapping: DataFrame, salt: str = "", created_at=None, ranges: int | None = None) -> DataFrame:
    """Mapping rows for the entities that the mapping doesn't have."""
    fresh = seen.join(mapping.select("original", "entity_type"), ["original", "entity_type"], "left_anti")
    held = mapping.groupBy("entity_type").agg(F.count(F.lit(1)).alias("held"))
    placed = numbered(fresh, ranges=ranges).join(F.broadcast(held), "entity_type", "left")  # one row for each type
    number = F.col("number") + F.coalesce("held", F.lit(0))
    return placed.select(
        "original",
        "entity_type",
        replacement(F.col("entity_type"), F.col("original"), number.cast("bigint"), salt).alias("replacement"),
        "first_seen_file",
        (F.current_timestamp() if created_at is None else F.lit(created_at)).alias("created_at"),
    )


def upsert(seen: DataFrame, mapping: DataFrame, salt: str = "", created_at=None) -> DataFrame:
    """The mapping with what is new; the rows it had stay as they are."""
    return mapping.select("original", "entity_type", "replacement", "first_seen_file", "created_at").unionByName(new_rows(seen, mapping, salt, created_at))


def rewrite(fragments: DataFrame, spans: DataFrame, mapping: DataFrame, key: list[str], text: str = "text", into: str = "sanitized") -> DataFrame:
    """``fragments`` with ``into``: the text with each of its spans replaced by its entity's replacement.

    ``key`` names a fragment.  Only spans travel to the mapping; fragments without
    any stay as they are.
    """
    placed = spans.select(*key, "s", "e", "original", "entity_type").join(mapping.select("original", "entity_type", "replacement"), ["original", "entity_type"])
    per_fragment = placed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("s", "e", "replacement"))).alias("_replacements"))
    joined = fragments.join(per_fragment, key, "left")
    empty = F.array().cast("array<struct<s:int,e:int,replacement:string>>")
    return joined.withColumn(into, splice(F.col(text), F.coalesce("_replacements", empty))).drop("_replacements")


def statistics(mapping: DataFrame) -> DataFrame:
    """(entity_type, n) and a row for the total; scale factors don't count."""
    return (
        mapping.filter("entity_type <> 'scale_factor'")
        .rollup("entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce("entity_type", F.lit("total")).alias("entity_type"), "n")
    )


def has_entities(mapping: DataFrame) -> bool:
    return not mapping.filter(F.col("entity_type") != META).limit(1).isEmpty()


def report(mapping: DataFrame) -> DataFrame:
    """Rows of the mapping report in order: entities by type and time, then scale factors by seed with a note.

    Internal rows hold the salt and the keyword list and are left out.
    """
    factor = F.col("replacement").cast("double")
    note = F.when(factor >= 1, F.format_string("+%.1f%%", (factor - 1) * 100)).otherwise(F.format_string("%.1f%%", (factor - 1) * 100))
    shown = mapping.filter(F.col("entity_type") != META)
    is_factor = F.col("entity_type") == "scale_factor"
    return shown.select(
        F.when(is_factor, F.lit(2)).otherwise(F.lit(1)).alias("section"),
        "entity_type",
        "original",
        "replacement",
        "first_seen_file",
        F.when(is_factor, note).otherwise(F.lit("")).alias("note"),
        "created_at",
    ).orderBy("section", F.when(is_factor, F.lit("")).otherwise(F.col("entity_type")), F.when(~is_factor, F.col("created_at")), "original")
