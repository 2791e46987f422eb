"""What lasts from run to run: the mapping, scale factors, the salt, and the keywords of the last run.

Each table is kept in versions; a run writes the next one and then names it in a
small pointer table, so a run that fails leaves the last version in force.  A version
is a whole table, or, of the mapping, the rows that a run adds: what is written follows
what is new, and :meth:`Store.compact` puts the rows together again from time to time.
One run at a time may write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.operators import mapping as M
from maskflow.operators.keyword_index import INDEX
from maskflow.operators.names import ANSWERS
from maskflow.operators.scaling import drawn_factor

TABLES = {
    "mapping": M.MAPPING,
    "scale_factors": "seed string, factor double",
    "meta": "key string, value string",
    "keywords": "keyword string",
    "index": INDEX,
    "answers": ANSWERS,
    "outputs": "relative string, output string",
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, table: str) -> tuple[int, int]:
        """(first, last) version that is in force; (1, 0) if there is none."""
        try:
            row = self.spark.read.schema("n bigint, base bigint").parquet(f"{self.path}/{table}/current").orderBy(F.desc("n")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 1, 0
            raise
        return (row["base"] or row["n"], row["n"]) if row else (1, 0)

    def read(self, table: str) -> DataFrame:
        first, last = self._versions(table)
        schema = TABLES[table]
        paths = [f"{self.path}/{table}/v{n}" for n in range(first, last + 1)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame) -> None:
        """``df`` is the table from now on."""
        n = self._versions(table)[1] + 1
        self._put(table, df, n, n)

    def append(self, table: str, df: DataFrame) -> None:
        """The rows of ``df`` belong to the table from now on."""
        first, last = self._versions(table)
        self._put(table, df, last + 1, first)

    def compact(self, table: str) -> None:
        """Write the table's rows as one version."""
        self.write(table, self.read(table))

    def _put(self, table: str, df: DataFrame, n: int, base: int) -> None:
        columns = [c.split()[0] for c in TABLES[table].split(", ")]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{table}/v{n}")
        self.spark.range(n, n + 1).select(F.col("id").alias("n"), F.lit(base).cast("bigint").alias("base")).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}/current")

    def salt(self) -> str:
        """Made once for a store."""
        found = self.read("meta").filter("key = 'salt'").first()
        if found:
            return found["value"]
        value = uuid.uuid4().hex
        self.write("meta", self.read("meta").unionByName(self.spark.createDataFrame([("salt", value)], TABLES["meta"])))
        return value

    def factors(self, seeds: DataFrame, low: float = 0.01, high: float = 100.0) -> DataFrame:
        """(seed, factor) for the seeds; new ones are drawn and kept, kept ones stay whatever the limits."""
        kept = self.read("scale_factors")
        fresh = seeds.select("seed").distinct().join(kept, "seed", "left_anti")
        if not fresh.limit(1).isEmpty():
            self.write("scale_factors", kept.unionByName(fresh.select("seed", drawn_factor(F.col("seed"), self.salt(), low, high).alias("factor"))))
        return self.read("scale_factors").join(seeds.select("seed").distinct(), "seed", "left_semi")

    def update_index(self, rows: DataFrame, files: DataFrame | None) -> None:
        """Put a run's rows of the keyword index in place of those of its ``files``, or of all."""
        self._replace("index", rows, files)

    def update_outputs(self, rows: DataFrame, files: DataFrame | None) -> None:
        """The same for output paths."""
        self._replace("outputs", rows, files)

    def _replace(self, table: str, rows: DataFrame, files: DataFrame | None) -> None:
        self.write(table, rows if files is None else self.read(table).join(files.select("relative"), "relative", "left_anti").unionByName(rows))

    def save_keywords(self, keywords: list[str]) -> None:
        self.write("keywords", self.spark.createDataFrame([(k,) for k in sorted(set(keywords))], TABLES["keywords"]))


def counts_differ(before: DataFrame, after: DataFrame, share: float = 0.05) -> DataFrame:
    """(sheet, rows_before, rows_after) of sheets that were lost or whose number of rows changed by more than ``share``."""
    n = lambda df, name: df.groupBy("sheet").agg(F.countDistinct("row").alias(name))
    both = n(before, "rows_before").join(n(after, "rows_after"), "sheet", "left")
    return both.filter(F.col("rows_after").isNull() | (F.abs(F.col("rows_after") - F.col("rows_before")) > share * F.col("rows_before")))


def summary(counts: DataFrame, errors: DataFrame, most_errors: int = 10) -> tuple[DataFrame, DataFrame]:
    """(entities by type with a total, the first errors by path)."""
    totals = counts.rollup("entity_type").agg(F.sum("n").alias("n")).select(F.coalesce("entity_type", F.lit("total")).alias("entity_type"), "n")
    return totals, errors.orderBy("path").limit(most_errors)
