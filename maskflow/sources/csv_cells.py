"""Cells of CSV files of any size: a file is read in many tasks, wherever its splits fall.

Whether a line lies inside a quoted cell depends on all lines before it.  So each split
is first summed up for both cases: how many rows it ends, and whether and in which column
it stops inside a quoted cell.  A fold over a file's splits (a row each) gives every
split its true beginning: in a quoted cell or not, and its row and column.  Then each
split gives its cells with their numbers; a cell that lies in several splits comes in
pieces, which are put together.

Line ends inside cells become ``\\n``.  Texts are parsed as bytes, which is the same for
all encodings that this reads but UTF-16, and cells are decoded.  Files in UTF-16 are
read as wholes.  A quoted cell that the file doesn't close ends with its last line.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions.spans import scanned
from maskflow.functions.storage import stored

CELLS = "path string, row bigint, col int, cell string"
SUMMARY = "path string, block bigint, rows0 bigint, inside0 boolean, col0 int, rows1 bigint, inside1 boolean, col1 int, utf8 boolean, utf16 boolean, sample binary"
#: Bytes at a file's beginning from which its encoding is told.
SAMPLE = 10_000
BATCH = 50_000
_END = 'END"'


def line_cells(line: str, inside: bool, delimiter: str) -> tuple[list[str], bool]:
    """(cells of a line, whether the last goes on); the first is the rest of an open one if ``inside``."""
    import csv

    if '"' not in line:
        return ([line + "\n"], True) if inside else (line.split(delimiter) if line else [], False)
    rows = list(csv.reader(['"' + line + "\n" if inside else line + "\n", _END], delimiter=delimiter))
    if len(rows) == 2:
        return rows[0], False
    return [*rows[0][:-1], rows[0][-1].removesuffix(_END[:-1])], True


def delimiter_of(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def summed(lines: Iterable[str], inside: bool, delimiter: str) -> tuple[int, bool, int]:
    """(rows that end, whether the last line ends inside a cell, that cell's column; counted from the open one's if no row ends)."""
    rows, col = 0, 0
    for line in lines:
        rows, inside, col = _after(line, rows, inside, col, delimiter)
    return rows, inside, col


def _after(line: str, rows: int, inside: bool, col: int, delimiter: str) -> tuple[int, bool, int]:
    if '"' not in line:
        return (rows, True, col) if inside else (rows + 1, False, 0)
    cells, goes_on = line_cells(line, inside, delimiter)
    return (rows, True, (col if inside else 0) + len(cells) - 1) if goes_on else (rows + 1, False, 0)


def placed(lines: Iterable[str], inside: bool, row: int, col: int, last: bool, delimiter: str) -> Iterator[tuple[int, int, str, bool]]:
    """(row, column, text, whether it's a piece) of a split's cells, in order."""
    piece, held = inside, []
    if not inside:
        col = 0
    for line in lines:
        cells, goes_on = line_cells(line, inside, delimiter)
        if inside:
            held.append(cells[0])
            cells = cells[1:]
            if not cells and goes_on:
                continue
            yield row, col, "".join(held), piece
            col, piece, held = col + 1, False, []
        if goes_on:
            held = [cells[-1]]
            cells = cells[:-1]
        for cell in cells:
            yield row, col, cell, False
            col += 1
        inside = goes_on
        if not goes_on:
            row, col = row + 1, 0
    if inside and held:
        text = "".join(held)
        yield row, col, text.removesuffix("\n") if last else text, piece or not last


def _lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, block, line as bytes): lines as they lie in the splits, which tasks read in order."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return read.select(F.regexp_replace(path, r"^file:/*", "/").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _by_split(batches) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Splits with their lines, one after the other; a split's lines are read as they are asked for."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for key, group in groupby(rows(), key=lambda r: r[:2] + r[3:]):
        yield key, (r[2] for r in group)


def _summaries(lines: DataFrame) -> DataFrame:
    def run(batches):
        import csv
        import sys

        import pyarrow as pa

        csv.field_size_limit(sys.maxsize)
        for (path, block, *_), own in _by_split(batches):
            delimiter, states, utf8, sample = delimiter_of(path), [(0, False, 0), (0, True, 0)], True, b""
            for line in own:
                text = line.decode("latin-1")
                states = [_after(text, *state, delimiter) for state in states]
                if utf8:
                    try:
                        line.decode()
                    except UnicodeDecodeError:
                        utf8 = False
                if block == 0 and len(sample) < SAMPLE:
                    sample += line + b"\n"
            flat = [path, block, *states[0], *states[1], utf8, sample[:2] in (b"\xff\xfe", b"\xfe\xff"), sample[:SAMPLE]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(flat, kinds)], names=[c.split()[0] for c in SUMMARY.split(", ")])

    return lines.mapInArrow(run, SUMMARY)


def _beginnings(summaries: DataFrame, guess) -> DataFrame:
    """(path, block, inside, row, col, last, encoding, utf16) of each split, from a fold over its file's splits."""
    split = F.struct("block", "rows0", "inside0", "col0", "rows1", "inside1", "col1")
    per_file = summaries.groupBy("path").agg(
        F.sort_array(F.collect_list(split)).alias("splits"), F.min("utf8").alias("utf8"), F.max("utf16").alias("utf16"), F.max_by("sample", F.length("sample")).alias("sample")
    )

    def step(state, x):
        def after(rows, inside, col):
            return F.struct(
                x[inside].alias("inside"),
                (state["row"] + x[rows]).alias("row"),
                (x[col] + F.when(state["inside"] & (x[rows] == 0), state["col"]).otherwise(0)).cast("int").alias("col"),
            )

        done = F.when(state["inside"], after("rows1", "inside1", "col1")).otherwise(after("rows0", "inside0", "col0"))
        return F.struct(done.alias("carried"), F.struct(x["block"].alias("block"), state["inside"].alias("inside"), state["row"].alias("row"), state["col"].alias("col"), done["inside"].alias("goes_on")).alias("out"))

    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("row"), F.lit(0).alias("col"))
    found = scanned(F.col("splits"), begin, step, "struct<block:bigint,inside:boolean,row:bigint,col:int,goes_on:boolean>")
    encoding = F.when(F.col("utf8"), F.lit("utf-8")).otherwise(guess(F.col("sample")))
    return per_file.select("path", "utf16", encoding.alias("encoding"), F.posexplode(found).alias("k", "split"), F.size("splits").alias("n")).select(
        "path", "split.*", (F.col("k") == F.col("n") - 1).alias("last"), "encoding", "utf16"
    )


def _cells(lines: DataFrame) -> DataFrame:
    """(path, row, col, cell, part) of lines with their split's beginning; ``part`` is the split of a piece."""

    def run(batches):
        import csv
        import sys

        import pyarrow as pa

        csv.field_size_limit(sys.maxsize)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "row", "col", "cell", "part"])

        held = []
        for (path, block, inside, row, col, last, encoding), own in _by_split(batches):
            texts = (line.removeprefix(b"\xef\xbb\xbf" if first else b"").decode("latin-1") for first, line in _first(own, block == 0))
            for r, c, cell, piece in placed(texts, inside, row, col, last, delimiter_of(path)):
                held.append((path, r, c, cell if cell.isascii() else cell.encode("latin-1").decode(encoding, "replace"), block if piece else None))
                if len(held) >= BATCH:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return lines.mapInArrow(run, CELLS + ", part bigint")


def _first(lines: Iterator[bytes], at_file: bool) -> Iterator[tuple[bool, bytes]]:
    for k, line in enumerate(lines):
        yield at_file and k == 0, line


def read_cells(spark: SparkSession, folder: str, glob: str, guess, whole) -> DataFrame:
    """CELLS of the files of ``folder`` that ``glob`` names: no header, rows of any length.

    ``guess`` gives the encoding of a sample of bytes that aren't UTF-8, ``whole`` the
    texts (path, text) of files given by their paths, for those in UTF-16.
    """
    lines = _lines(spark, folder, glob)
    begins = stored(_beginnings(_summaries(lines), guess), "csv-splits")
    splits = begins.filter("NOT utf16")
    # a row for each split: the driver holds as many to plan the scan
    known = F.broadcast(splits.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "inside", "row", "col", "last", "encoding"))

    def cells(of: DataFrame, how: str) -> DataFrame:
        joined = lines.join(of, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")), how)
        return _cells(joined.select("path", "block", "line", "inside", "row", "col", "last", "encoding"))

    done = cells(known, "inner").filter("part IS NULL").drop("part")
    if not splits.filter("inside").isEmpty():
        crossed = splits.filter("inside OR (goes_on AND NOT last)")
        some = F.broadcast(crossed.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "inside", "row", "col", "last", "encoding"))
        pieces = cells(some, "inner").filter("part IS NOT NULL").groupBy("path", "row", "col").agg(F.sort_array(F.collect_list(F.struct("part", "cell"))).alias("pieces"))
        done = done.unionByName(pieces.select("path", "row", "col", F.array_join(F.transform("pieces", lambda p: p["cell"]), "").alias("cell")))
    wide = [r["path"] for r in begins.filter("utf16").select("path").distinct().collect()]  # of the files that the driver has listed
    return done.unionByName(_whole_cells(whole(wide))) if wide else done


def _whole_cells(texts: DataFrame) -> DataFrame:
    """CELLS of whole texts (path, text)."""

    def run(batches):
        import csv
        import sys

        import pyarrow as pa

        csv.field_size_limit(sys.maxsize)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = placed((text or "").removesuffix("\n").split("\n") if text else (), False, 0, 0, True, delimiter_of(path))
                rows = []
                for r, c, cell, _ in found:
                    rows.append((path, r, c, cell))
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["path", "row", "col", "cell"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["path", "row", "col", "cell"])

    return texts.mapInArrow(run, CELLS)
