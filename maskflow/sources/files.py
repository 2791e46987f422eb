"""Files as DataFrames: the manifest of a folder, texts, CSV cells, keyword files, output paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.operators.mapping import numbered
from maskflow.sources import csv_cells

# The extensions that are read, and their groups.
EXTENSIONS = (".xlsx", ".xls", ".csv", ".tsv", ".txt", ".docx", ".pdf", ".html", ".htm")
GROUPS = (("Excel", (".xlsx", ".xls")), ("CSV", (".csv", ".tsv")), ("Word", (".docx",)), ("PDF", (".pdf",)), ("Text", (".txt",)), ("HTML", (".html", ".htm")))
KINDS = {".xlsx": "xlsx", ".xls": "xls", ".csv": "csv", ".tsv": "csv", ".txt": "text", ".docx": "docx", ".pdf": "pdf", ".html": "html", ".htm": "html"}


def of_kind(kind: str) -> tuple[str, ...]:
    """The extensions that one reader takes."""
    return tuple(e for e, k in KINDS.items() if k == kind)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def manifest(listed: DataFrame, root: str = "") -> DataFrame:
    """(path, relative, extension, size, file_ord) of listed files (path, size): no hidden folders, no temporary files, known types."""
    path = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    df = listed.select(path.alias("path"), *[c for c in listed.columns if c != "path"]).withColumn("relative", F.expr(f"ltrim('/', substring(path, {len(root.rstrip('/')) + 1}))") if root else F.col("path"))
    folders = F.regexp_replace("path", r"[^/]*$", "")
    name = F.substring_index("path", "/", -1)
    kept = df.withColumn("extension", extension(F.col("path"))).filter(
        ~folders.rlike(r"(^|/)\.[^/]+/") & ~name.startswith(".") & ~name.startswith("~$") & F.col("extension").isin(*EXTENSIONS)
    )
    return numbered(kept, None, "relative", "file_ord").withColumn("file_ord", F.col("file_ord").cast("int"))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder, at any depth."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return manifest(listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")), folder)


#: Bytes of a file that one task reads as a whole; larger ones aren't read.
LARGEST = 1 << 30


def named_so(*extensions: str) -> str:
    """A glob for file names with given extensions, in any case."""
    letters = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(letters(e) for e in extensions) + "}"


def literally(paths: str | list[str]) -> str | list[str]:
    """Paths of single files without their marks of patterns; a folder as it is."""
    return paths if isinstance(paths, str) else [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def contents(spark: SparkSession, folder: str | list[str], *extensions: str, largest: int = LARGEST) -> DataFrame:
    """(path, content) of the files with given extensions, of up to ``largest`` bytes; no other file is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", named_so(*extensions)).load(literally(folder))
    # files that are too large are left out before their content is read
    return listed.filter(F.col("length") <= largest).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")


def too_large(listed: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(file_ord, error) of files that :func:`contents` leaves out; tables of text are read in parts."""
    apart = ~F.col("extension").isin(*of_kind("csv")) & (F.col("size") > largest)
    return listed.filter(apart).select("file_ord", F.format_string(f"more than {largest} bytes: %d", "size").alias("error"))


#: Bytes at a file's beginning from which its encoding is told.
SAMPLE = 10_000
#: Encodings of Chinese and Japanese texts, and the first bytes of their common characters.
FREQUENT = {"gb18030": ((0xB0, 0xD7),), "big5": ((0xA4, 0xC6),), "shift_jis": ((0x82, 0x83), (0x88, 0x97))}
LEAST_FREQUENT = 0.6


def guessed_encoding(data: bytes) -> str:
    """Of bytes that aren't UTF-8: the encoding most of whose characters are common ones, else that of Western Europe."""
    import codecs

    best, found = LEAST_FREQUENT, "cp1252"
    for name, ranges in FREQUENT.items():
        try:
            text = codecs.getincrementaldecoder(name)("strict").decode(data[:SAMPLE])  # a character cut off at the end is no error
        except UnicodeDecodeError:
            continue
        wide = [c.encode(name) for c in text if c > "\x7f"]
        # two bytes, and in the Chinese standard's own part of its code the second is high
        common = sum(len(b) == 2 and any(lo <= b[0] <= hi for lo, hi in ranges) and (name != "gb18030" or b[1] >= 0xA1) for b in wide)
        if wide and common / len(wide) > best:
            best, found = common / len(wide), name
    return found


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes, of UTF-16 with a byte order mark, else of the guessed encoding; line ends become ``\\n``."""

    @F.pandas_udf(T.StringType())
    def other(column):
        return column.map(lambda b: None if b is None else bytes(b).decode(guessed_encoding(bytes(b)), errors="replace"))

    head = F.hex(F.substring(content, 1, 2))
    text = (
        F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", ""))
        .otherwise(other(content))
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def read_texts(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(path, text): each text file as one fragment."""
    return contents(spark, folder, *of_kind("text")).select("path", decoded(F.col("content")).alias("text"))


def read_csv_cells(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(path, row, col, cell) of CSV and TSV files of any size: no header, rows of any length."""

    @F.pandas_udf(T.StringType())
    def guess(samples):
        return samples.map(lambda b: guessed_encoding(bytes(b or b"")))

    def whole(paths: list[str]) -> DataFrame:
        return contents(spark, paths, *of_kind("csv")).select("path", decoded(F.col("content")).alias("text"))

    return csv_cells.read_cells(spark, literally(folder), named_so(*of_kind("csv")), guess, whole)


def read_keyword_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord) of the lines of a keyword file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("ord", "value"))


def file_type_histogram(files: DataFrame) -> DataFrame:
    """(file_type, n) of a manifest."""
    kind = F.lit("Other")
    for name, extensions in reversed(GROUPS):
        kind = F.when(F.col("extension").isin(*extensions), F.lit(name)).otherwise(kind)
    return files.groupBy(kind.alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


def output_extension(name: Column) -> Column:
    """Old Excel files are written as new ones."""
    return F.regexp_replace(name, r"(?i)\.xls$", ".xlsx")


def path_parts(files: DataFrame) -> DataFrame:
    """(relative, part_ord, text, suffix): the segments of each path as fragments; the file's name without its extension."""
    parts = files.select("relative", "extension", F.posexplode(F.split("relative", "/")).alias("part_ord", "part"), F.size(F.split("relative", "/")).alias("n"))
    last = F.col("part_ord") == F.col("n") - 1
    stem = F.when(last, F.expr("substring(part, 1, length(part) - length(extension))")).otherwise(F.col("part"))
    return parts.select("relative", "part_ord", stem.alias("text"), F.when(last, F.expr("right(part, length(extension))")).otherwise(F.lit("")).alias("suffix"))


def joined_paths(parts: DataFrame, text: str = "sanitized") -> DataFrame:
    """(relative, output): rewritten segments put together again."""
    segment = F.struct("part_ord", F.concat(text, output_extension(F.col("suffix"))).alias("segment"))
    return parts.groupBy("relative").agg(F.array_join(F.transform(F.sort_array(F.collect_list(segment)), lambda x: x["segment"]), "/").alias("output"))


def told_apart(outputs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(file_ord, output) with one file for each output path: the first keeps it, another has its number put behind the name.

    Old and new workbooks of one name, and paths that were rewritten alike, would else
    be written over each other; ``taken`` has the outputs of files that aren't written
    now.  Letters of either case count as the same.
    """
    all_ = outputs.select("output", "file_ord")
    if taken is not None:
        all_ = all_.unionByName(taken.select("output", F.lit(-1).alias("file_ord")))
    again = F.row_number().over(Window.partitionBy(F.lower("output")).orderBy("file_ord"))
    stem, ending = F.regexp_replace("output", r"\.[^./]+$", ""), F.regexp_extract("output", r"\.[^./]+$", 0)
    for mark in (" (%d)", " (%d)(%d)"):  # a file may have the name with the first mark already
        marked = F.concat(stem, F.format_string(mark, *[F.col("file_ord")] * mark.count("%d")), ending)
        all_ = all_.withColumn("_again", again).withColumn("output", F.when((F.col("_again") > 1) & (F.col("file_ord") >= 0), marked).otherwise(F.col("output"))).drop("_again")
    return all_.filter("file_ord >= 0").select("file_ord", "output")
