"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is ``spark.checkpoint.dir``.  Where that is unset and the master is local
    (tests on one machine) a temporary folder is made and set as checkpoint
    folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="maskflow-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Scratch folders that are still there, by application.
_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in made:
            made.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Delete every scratch folder of this application; for when its results are written."""
    discard(spark, *list(_made.get(spark.sparkContext.applicationId, [])))


@contextmanager
def temporary(spark: SparkSession):
    """Scratch folders made inside are deleted at the end: what is kept must be written by then."""
    before = set(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        discard(spark, *[p for p in _made.get(spark.sparkContext.applicationId, []) if p not in before])


class Shelf:
    """Intermediate tables of one operator by name; a table that is put in another's place is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written to the shared folder and read back."""
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        discard(self.spark, *[self.paths.pop(n) for n in names if n in self.paths])


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    return Shelf(df.sparkSession).put(label, df)
