"""Writing results: texts and CSV as files of their own, and the mapping report."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (output, content) as files below a folder that all executors mount; (output, size, error) of each.

    A file is renamed into place when it is whole, so a task may run again.
    """

    def run(batches):
        import os
        import uuid

        import pyarrow as pa

        for batch in batches:
            sizes, errors = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = content.encode() if isinstance(content, str) else bytes(content or b"")
                path = os.path.join(folder, name)
                try:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                        f.write(data)
                    os.replace(own, path)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["output", "size", "error"])

    return files.select("output", "content").mapInArrow(run, "output string, size bigint, error string")


def csv_contents(cells: DataFrame, key: str = "output", cell: str = "cell", delimiter: str = ",") -> DataFrame:
    """(key, content): cells (row, col) put together as CSV with CRLF line ends and quotes where needed."""
    from pyspark.sql import functions as F

    quoted = F.when(
        F.col(cell).rlike(f'[{delimiter}"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(cell), F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(F.coalesce(cell, F.lit("")))
    rows = cells.groupBy(key, "row").agg(F.sort_array(F.collect_list(F.struct("col", quoted.alias("cell")))).alias("cells"))
    line = F.array_join(F.transform("cells", lambda c: c["cell"]), delimiter)
    whole = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row", line.alias("line")))).alias("lines"))
    return whole.select(key, F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n"), F.lit("\r\n")).alias("content"))


def report_csv(report: DataFrame, folder: str) -> None:
    """The mapping report as CSV files with headers; the report is sorted by ranges, and the files follow each other in its order."""
    report.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(folder)
