"""A stored index of what files may hold: a Bloom filter of three-character strings for each file.

A run that finds new keywords asks the index first and reads only the files that may
hold one; what those hold is then searched exactly.  A file whose size or time is not
the indexed one, or that isn't in the index, may hold anything.  The filter has one
hash and as many bits as the file's size asks for; it lies in rows of 32,768 bits, made
by partial aggregates (:func:`bitmap_or_agg`), so a file of any size, in any number of
fragments, has no task of its own.

Filters are made from what the readers find, so packed formats are covered.  A file
that holds a keyword is always found.  Defined results: null texts add nothing; a keyword
of fewer than three characters may be in every file; case doesn't count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.operators.keyword_table import folded

INDEX = "relative string, size bigint, modified timestamp, log_bits int, bucket int, bits binary"
GRAM = 3
#: Bits of a row, as Spark's bitmap functions have them.
ROW_BITS = 32768
#: Powers of two of a filter's bits, and bits for each byte of a file.
LEAST_LOG, MOST_LOG, BITS_A_BYTE = 12, 26, 8
#: Characters whose strings are hashed at a time.
SLICE = 1 << 20


def hashes(text: str) -> np.ndarray:
    """64-bit hashes of the distinct strings of GRAM characters."""
    codes = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < GRAM:
        return np.zeros(0, np.uint64)
    h = (codes[:-2] << np.uint64(42)) ^ (codes[1:-1] << np.uint64(21)) ^ codes[2:]
    h = np.unique(h)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def log_bits(size: Column) -> Column:
    """The power of two of the bits of a file's filter."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)) * BITS_A_BYTE)), F.lit(LEAST_LOG)), F.lit(MOST_LOG)).cast("int")


def build(fragments: DataFrame, listed: DataFrame) -> DataFrame:
    """INDEX of the files ``listed`` (relative, size, modified) from their fragments (relative, text)."""

    def positions(batches):
        import pyarrow as pa

        for batch in batches:
            names, logs, rows, bits = [], [], [], []
            for name, log, text in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(0, max(len(text) - GRAM + 1, 0), SLICE):
                    place = np.unique(hashes(text[at : at + SLICE + GRAM - 1]) & np.uint64((1 << log) - 1)).astype(np.int64)
                    for row in np.unique(place // ROW_BITS).tolist():
                        own = place[place // ROW_BITS == row] % ROW_BITS
                        held = np.zeros(ROW_BITS, np.uint8)
                        held[own] = 1
                        names.append(name)
                        logs.append(log)
                        rows.append(row)
                        bits.append(np.packbits(held, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(logs, pa.int32()), pa.array(rows, pa.int32()), pa.array(bits, pa.binary())], names=["relative", "log_bits", "bucket", "part"])

    sized = listed.select("relative", "size", "modified", log_bits(F.col("size")).alias("log_bits"))
    texts = fragments.filter("text IS NOT NULL").select("relative", "text").join(sized.select("relative", "log_bits"), "relative").select("relative", "log_bits", "text")
    found = texts.mapInArrow(positions, "relative string, log_bits int, bucket int, part binary")
    merged = found.groupBy("relative", "bucket").agg(F.bitmap_or_agg("part").alias("bits"))
    # a file without any string has a row as well: it was read
    whole = sized.join(merged, "relative", "left")
    return whole.select("relative", "size", "modified", "log_bits", F.coalesce("bucket", F.lit(0)).alias("bucket"), F.coalesce("bits", F.lit(b"")).alias("bits"))


def _asked(spark: SparkSession, keywords: list[str]) -> DataFrame:
    """(a_log, a_bucket, keyword number, gram number, offset, needed): where every filter has to have bits."""
    rows = []
    for k, word in enumerate(keywords):
        own = hashes(word)
        for log in range(LEAST_LOG, MOST_LOG + 1):
            for g, h in enumerate(own.tolist()):
                place = h & ((1 << log) - 1)
                rows.append((log, place // ROW_BITS, k, g, place % ROW_BITS, len(own)))
    return spark.createDataFrame(rows, "a_log int, a_bucket int, k int, g int, offset int, needed int")


def candidates(index: DataFrame, listed: DataFrame, keywords: list[str]) -> DataFrame:
    """(relative) of the files ``listed`` (relative, size, modified) that may hold a keyword of a list."""
    spark = listed.sparkSession
    if any(len(k) < GRAM for k in keywords):
        return listed.select("relative")
    same = F.expr("relative = i_relative AND size = i_size AND modified <=> i_modified")
    known = index.select(F.col("relative").alias("i_relative"), F.col("size").alias("i_size"), F.col("modified").alias("i_modified")).distinct()
    unknown = listed.join(known, same, "left_anti").select("relative")
    asked = _asked(spark, keywords)
    # the strings of a user's list of keywords, for each size of filter
    met = index.join(F.broadcast(asked), F.expr("log_bits = a_log AND bucket = a_bucket"))
    octet = F.conv(F.hex(F.substring("bits", F.floor(F.col("offset") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("getbit(octet, offset % 8)")
    hits = met.filter(F.octet_length("bits") > 0).withColumn("octet", octet).filter(held == 1)
    per_file = hits.groupBy("relative", "k").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).filter("n = needed")
    return per_file.select("relative").distinct().join(listed.select("relative"), "relative", "left_semi").unionByName(unknown).distinct()
