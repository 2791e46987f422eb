"""The whole job over a folder: scan, read, detect, rewrite, scale, write, report.

Files of all types become fragments of one table, in one order: files by path, a
file's path segments before its contents.  Texts are searched once; distinct
entities get their replacements from the store's mapping and bring them back;
numbers are scaled by the factor of their seed.  A later run for new keywords asks an
index which files may hold one (:mod:`maskflow.operators.keyword_index`) and reads no
others.  Every file is then put together
and written below the output folder, under a path whose segments went through the
same mapping.  A file that can't be read or written is listed with its error.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions.storage import stored
from maskflow.operators import mapping as M
from maskflow.operators import keyword_index, scaling
from maskflow.operators.incremental import affected, new_keywords
from maskflow.operators.names import answered, ask, parse_response
from maskflow.operators.resolve import detect, located
from maskflow.operators.store import Store
from maskflow.sources import files, html, office, sinks

# What a folder's name gets for its output, and the report's name.
OUTPUT_SUFFIX = "_脱敏"
REPORT = "_映射报告"
KEY = ["file_ord", "stage", "frag_ord", "sub_ord"]
PATH, CONTENT = 0, 1
#: Bits of a cell's row in its fragment's number; above them is the sheet, the column is a number of its own.
ROW_BITS = 40


def output_folder(source: str) -> str:
    """Beside the source."""
    return source.rstrip("/") + OUTPUT_SUFFIX


@dataclass
class Outcome:
    """What a run did; ``done`` is full, incremental, nothing new or nothing affected."""

    done: str
    output: str
    written: DataFrame | None = None
    counts: DataFrame | None = None
    errors: DataFrame | None = None


@dataclass
class FolderJob:
    """``keywords``: (type, keyword) of the user; ``recogniser``: answers to texts, for names; ``unified``: one factor for all numbers."""

    spark: SparkSession
    store: Store
    keywords: list[tuple[str, str]] = field(default_factory=list)
    unified: bool = True
    limits: tuple[float, float] = scaling.DEFAULT_RANGE
    recogniser: Callable[[list[str]], list[str]] | None = None

    def run(self, source: str, output: str | None = None, incremental: bool = False) -> Outcome:
        output = output or output_folder(source)
        if posixpath.normpath(output) == posixpath.normpath(source):
            raise ValueError("the output folder must not be the source folder")
        listed = stored(files.scan_folder(self.spark, source), "files")
        done, where, fresh = "full", source, []
        words = [k for _, k in self.keywords]
        if incremental:
            snapshot = self.store.read("keywords")
            incremental = not snapshot.isEmpty()  # else this run makes the first one
        if incremental:
            current = self.spark.createDataFrame([(k,) for k in words], "keyword string")
            fresh = [r["keyword"] for r in new_keywords(current, snapshot).collect()]  # a user's list
            if not fresh:
                return Outcome("nothing new", output)
            asked = stored(keyword_index.candidates(self.store.read("index"), listed, fresh), "candidates")
            listed = stored(listed.join(asked, "relative", "left_semi"), "files")
            where = [r["path"] for r in listed.select("path").collect()]  # the driver lists as many to read them
            if not where:
                self.store.save_keywords(words)
                return Outcome("nothing affected", output)
        fragments, errors = self._fragments(where, listed)
        contents = F.col("stage") == CONTENT
        read = listed.join(errors.select("file_ord"), "file_ord", "left_anti")
        self.store.update_index(keyword_index.build(fragments.filter(contents), read), listed if incremental else None)
        if incremental:
            touched = affected(fragments.filter(contents & F.col("text").isNotNull()), fresh).select("file_ord").unionByName(errors.select("file_ord")).distinct()
            listed = stored(listed.join(touched, "file_ord", "left_semi"), "files")
            if listed.isEmpty():
                self.store.save_keywords(words)
                return Outcome("nothing affected", output)
            where = [r["path"] for r in listed.select("path").collect()]
            fragments = stored(fragments.join(listed.select("file_ord"), "file_ord", "left_semi"), "fragments")
            errors = errors.join(listed.select("file_ord"), "file_ord", "left_semi")
            done = "incremental"
        sanitized, spans = self._sanitized(fragments)
        paths = self._paths(listed, sanitized, incremental)
        contents = self._contents(where, listed, sanitized, paths)
        written = stored(sinks.write_files(contents, output), "written")
        self.store.save_keywords(words)
        sinks.report_csv(M.report(self.store.read("mapping").unionByName(self._factor_rows())), f"{output}/{REPORT}")
        counts = spans.groupBy("relative", "entity_type").agg(F.count(F.lit(1)).alias("n"))
        failed = errors.join(listed.select("file_ord", "relative"), "file_ord").select("relative", "error").unionByName(
            written.filter("error IS NOT NULL").select(F.col("output").alias("relative"), "error")
        )
        return Outcome(done, output, written.filter("error IS NULL"), counts, failed)

    # reading

    def _fragments(self, source: str | list[str], listed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(fragments of all files, (file_ord, error) of those without a reader or that can't be read)."""
        spark, number = self.spark, listed.select("path", "file_ord")
        cells = stored(office.read_cells(files.contents(spark, source, *files.of_kind("xlsx"), *files.of_kind("xls"))).join(number, "path"), "cells")
        paragraphs = stored(office.read_paragraphs(files.contents(spark, source, *files.of_kind("docx"))).join(number, "path"), "paragraphs")
        pages = _pages(spark, source).join(number, "path")
        csv = files.read_csv_cells(spark, source).join(number, "path")
        segments = files.path_parts(listed).join(listed.select("relative", "file_ord"), "relative")
        parts = [
            _fragment(segments, PATH, "path", F.col("part_ord").cast("bigint")),
            _fragment(files.read_texts(spark, source).join(number, "path"), CONTENT, "text", F.lit(0).cast("bigint")),
            _fragment(html.text_nodes(pages, "file_ord", "html"), CONTENT, "html", F.col("frag_ord")),
            _fragment(csv.withColumnRenamed("cell", "text"), CONTENT, "csv", _cell_number(F.lit(0)), "row", "col"),
            _fragment(
                cells.filter("error IS NULL").withColumnRenamed("s", "text"), CONTENT, "workbook", _cell_number(F.col("sheet_ord")),
                "sheet_ord", "sheet", "row", "col", "cell_type", "d", "b", "number_format",
            ),
            _fragment(paragraphs.filter("error IS NULL"), CONTENT, "document", F.col("frag_ord").cast("bigint")),
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        whole = whole.join(listed.select("file_ord", "relative"), "file_ord")
        unread = listed.filter(F.col("extension").isin(*files.of_kind("pdf"))).select("file_ord", F.lit("no reader for this type").alias("error"))
        bad = [x.filter("error IS NOT NULL").select("file_ord", "error") for x in (cells, paragraphs)]
        unread = unread.unionByName(files.too_large(listed.filter(~F.col("extension").isin(*files.of_kind("pdf")))))
        return stored(whole, "fragments"), stored(unread.unionByName(bad[0]).unionByName(bad[1]), "unread")

    # rewriting

    def _sanitized(self, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(fragments with ``sanitized`` and scaled numbers, spans)."""
        typed = fragments.withColumn(
            "action",
            F.when(F.col("kind") == "csv", F.when(scaling.csv_number(F.col("text")).isNull(), "sanitize").otherwise("scale"))
            .when(F.col("kind") == "workbook", scaling.cell_action("text"))
            .otherwise(F.lit("sanitize")),
        )
        searched = typed.filter("action = 'sanitize' AND text IS NOT NULL").select(*KEY, "relative", "text")
        names = None
        if self.recogniser is not None:
            asked = stored(ask(searched, self.recogniser, answers=self.store.read("answers")), "answers")
            known = self.store.read("answers").select("hash", "length")
            self.store.append("answers", answered(asked).join(known, ["hash", "length"], "left_anti"))
            searched = asked.drop("error").withColumn("names", located(F.col("text"), parse_response(F.col("response"))))
            names = "names"
        spans = M.held_spans(detect(searched, self.keywords, names=names), *KEY, "relative")
        salt = self.store.salt()
        self.store.append("mapping", M.new_rows(M.first_seen(spans, KEY, "relative"), self.store.read("mapping"), salt))
        rewritten = M.rewrite(typed, spans, self.store.read("mapping"), KEY)
        name = F.substring_index("relative", "/", -1)
        seed = (
            F.lit(scaling.GLOBAL_SEED)
            if self.unified
            else F.when(F.col("kind") == "workbook", F.concat(name, F.lit("::"), "sheet")).when(F.col("kind") == "csv", F.concat(name, F.lit("::data"))).otherwise(name)
        )
        seeded = rewritten.withColumn("seed", F.when((F.col("action") == "scale") | (F.col("kind") == "document"), seed))
        factors = self.store.factors(seeded.filter("seed IS NOT NULL").select("seed"), *scaling.checked_range(*self.limits))
        scaled = seeded.join(factors, "seed", "left")
        text = (
            F.when((F.col("kind") == "csv") & (F.col("action") == "scale"), scaling.scale_csv_cell(F.col("text"), F.col("factor")))
            .when(F.col("kind") == "document", scaling.scale_in_text(F.col("sanitized"), F.col("factor")))
            .otherwise(F.col("sanitized"))
        )
        number = F.when((F.col("kind") == "workbook") & (F.col("action") == "scale"), scaling.scale_number(F.col("d"), F.col("factor"))).otherwise(F.col("d"))
        return stored(scaled.withColumn("sanitized", text).withColumn("d", number).drop("seed", "factor", "action"), "sanitized"), spans

    def _factor_rows(self) -> DataFrame:
        """Scale factors as rows of the report."""
        none = F.lit(None)
        return self.store.read("scale_factors").select(
            F.col("seed").alias("original"),
            F.lit("scale_factor").alias("entity_type"),
            F.col("factor").cast("string").alias("replacement"),
            none.cast("string").alias("first_seen_file"),
            none.cast("timestamp").alias("created_at"),
        )

    # writing

    def _paths(self, listed: DataFrame, sanitized: DataFrame, incremental: bool) -> DataFrame:
        """(file_ord, output): output paths, from rewritten segments; each is given once."""
        segments = files.path_parts(listed).select("relative", F.col("part_ord").cast("bigint").alias("frag_ord"), "part_ord", "suffix")
        rewritten = sanitized.filter("kind = 'path'").select("relative", "frag_ord", "sanitized")
        joined = files.joined_paths(segments.join(rewritten, ["relative", "frag_ord"]))
        own = joined.join(listed.select("relative", "file_ord"), "relative").select("file_ord", "output")
        taken = self.store.read("outputs").join(listed, "relative", "left_anti") if incremental else None
        done = stored(files.told_apart(own, taken), "outputs")
        rows = done.join(listed.select("relative", "file_ord"), "file_ord").select("relative", "output")
        self.store.update_outputs(rows, listed if incremental else None)
        return done

    def _contents(self, source: str | list[str], listed: DataFrame, sanitized: DataFrame, paths: DataFrame) -> DataFrame:
        """(output, content) of every file that was read."""
        spark, number = self.spark, listed.select("path", "file_ord")
        own = lambda kind: sanitized.filter(F.col("kind") == kind).join(paths, "file_ord")
        as_bytes = lambda c: F.encode(c, "utf-8")
        texts = own("text").select("output", as_bytes(F.col("sanitized")).alias("content"))
        pages = _pages(spark, source).join(number, "path").join(paths, "file_ord")
        nodes = sanitized.filter("kind = 'html'").select("file_ord", "frag_ord", "text", "sanitized")
        done = html.with_nodes(pages, nodes, "file_ord", "html").select("output", as_bytes(F.col("sanitized")).alias("content"))
        tables = own("csv").select("output", "row", "col", F.col("sanitized").alias("cell"))
        tabbed = F.lower("output").endswith(".tsv")
        csv = [sinks.csv_contents(tables.filter(~tabbed)), sinks.csv_contents(tables.filter(tabbed), delimiter="\t")]
        csv = [x.select("output", as_bytes(F.col("content")).alias("content")) for x in csv]
        books = office.workbook_contents(own("workbook").withColumn("s", F.col("sanitized")))
        changed = sanitized.filter("kind = 'document' AND NOT text <=> sanitized").groupBy("file_ord").agg(
            F.collect_list(F.struct("frag_ord", F.col("sanitized").alias("text"))).alias("paragraphs")
        )
        readable = sanitized.filter("kind = 'document'").select("file_ord").distinct()
        originals = files.contents(spark, source, *files.of_kind("docx")).join(number, "path").join(readable, "file_ord", "left_semi").join(paths, "file_ord")
        documents = office.document_contents(originals.join(changed, "file_ord", "left"))
        whole = texts
        for part in (done, *csv, books, documents):
            whole = whole.unionByName(part)
        return whole


def _pages(spark: SparkSession, source: str | list[str]) -> DataFrame:
    return files.contents(spark, source, *files.of_kind("html")).select("path", files.decoded(F.col("content")).alias("html"))


def _cell_number(sheet: Column) -> Column:
    """One number for sheet and row, in reading order."""
    return F.shiftleft(sheet.cast("bigint"), ROW_BITS) + F.col("row")


def _fragment(df: DataFrame, stage: int, kind: str, number: Column, *keep: str) -> DataFrame:
    sub = F.col("col") if "col" in keep else F.lit(0)
    return df.select("file_ord", F.lit(stage).alias("stage"), number.alias("frag_ord"), sub.cast("int").alias("sub_ord"), F.lit(kind).alias("kind"), F.col("text"), *keep)
