"""Numbers in an order, without sorting everything in one task.

Rows are ranged by group and order and stored so, counted for each range, and numbered
within it after the counts before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskflow.functions.storage import stored


def numbered(entities: DataFrame, by: str | None = "entity_type", order: str = "seen", name: str = "number", ranges: int | None = None) -> DataFrame:
    """``entities`` with their number from 1 within ``by`` (or over all), in the order of ``order``; in ``ranges`` tasks."""
    ranges = ranges or int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [by] if by else []
    # stored, as the ranges have to be the same for counting and for numbering
    dealt = stored(entities.repartitionByRange(ranges, *groups, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_held"))
    # a row for each type and range
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*groups, "_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(order)))
    return own.join(F.broadcast(before), [*groups, "_range"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).select(*entities.columns, name)
