"""Reading the given tables and making room for null texts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamplight.functions.memory import release, turn_to
from lamplight.session import shared_folder

__all__ = ["Scratch", "release", "sampled", "table", "text_of", "turn_to", "unsent"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, never collected by the driver and sent to all tasks.

    Spark takes rows that an array or Python made many of for as large as those they were made from, and a table for its files."""
    return df.hint("merge")


def sampled(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """About ``rows`` rows of ``df``, or all if there are fewer: those whose keys' hash lies under a bound set from the
    count. The same rows on every run; no row is sorted or moved."""
    total = df.count()
    if total <= rows:
        return df
    span = 1 << 30
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(span)) < int(span * rows / total))


class Scratch:
    """Intermediate tables in the shared folder, each deleted when its caller is done with it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back; ``drop`` takes what is returned."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        self._settle()
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that nothing still to be computed reads."""
        for df in kept:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _settle(self) -> None:
        # Spark deletes the shuffle files of what nothing refers to any more when the driver's garbage is collected.
        self.spark._jvm.System.gc()
