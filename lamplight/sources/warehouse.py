"""Stored tables: partitioned Parquet under one root folder.

Every change replaces whole partitions through Spark's dynamic partition overwrite:
new files are staged beside the table and moved in when the job commits, so a lost
executor or a failed job leaves the old partition. Readers during the move are not
isolated. Chunks are laid out by channel and by bucket of report, which keeps a
re-ingest away from the rest of a channel and a large channel spread over many
folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamplight import schemas
from lamplight.functions import ids
from lamplight.operators import catalog
from lamplight.session import cut_lineage, stored
from lamplight.settings import DEFAULTS, Settings

WHOLE = "part"


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _hadoop(self, location: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, table: str) -> bool:
        fs, path = self._hadoop(self.path(table))
        return fs.exists(path)

    def _keys(self, table: str) -> list[str]:
        return schemas.PARTITIONS.get(table, [WHOLE])

    def read(self, table: str) -> DataFrame:
        ddl = schemas.TABLES[table]
        if not self.exists(table):
            return self.spark.createDataFrame([], ddl)
        extra = "" if table in schemas.PARTITIONS else f", {WHOLE} int"
        stored = self.spark.read.schema(ddl + extra).parquet(self.path(table))
        return stored.drop(WHOLE)

    def _shape(self, table: str, rows: DataFrame) -> DataFrame:
        names = self.spark.createDataFrame([], schemas.TABLES[table]).columns
        shaped = rows.select(*names)
        return shaped if table in schemas.PARTITIONS else shaped.withColumn(WHOLE, F.lit(0))

    def dealt(self, table: str, rows: DataFrame) -> DataFrame:
        """Groups a partition's rows but splits a partition that is too large."""
        return rows.hint("rebalance", *self._keys(table))

    def overwrite(self, table: str, rows: DataFrame, dealt: bool = False) -> None:
        """Replace the partitions that ``rows`` touch, all at the job's commit. ``dealt``: they are grouped already."""
        keys = self._keys(table)
        shaped = self._shape(table, rows)
        if keys != [WHOLE] and not dealt:
            shaped = self.dealt(table, shaped)
        (
            shaped.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy(*keys)
            .parquet(self.path(table))
        )

    def append(self, table: str, rows: DataFrame) -> None:
        shaped = self._shape(table, rows)
        shaped.write.mode("append").partitionBy(*self._keys(table)).parquet(self.path(table))

    def drop_partitions(self, table: str, emptied: DataFrame) -> None:
        """Remove partition folders that have no rows left.

        The list is as long as the folders a change emptied, never as the data.
        """
        keys = self._keys(table)
        for row in emptied.select(*keys).distinct().toLocalIterator():
            folder = "/".join(f"{k}={row[k]}" for k in keys)
            fs, path = self._hadoop(f"{self.path(table)}/{folder}")
            fs.delete(path, True)

    def assert_unique(self, table: str, rows: DataFrame) -> None:
        for key in schemas.UNIQUE_KEYS.get(table, []):
            clash = catalog.duplicates(rows, key).limit(1).collect()
            if clash:
                raise ValueError(f"{table}: {key} is not unique, for example {clash[0].asDict()}")

    def with_bucket(self, rows: DataFrame, report: str = "report_id") -> DataFrame:
        return rows.withColumn(
            "report_bucket", ids.report_bucket(F.col(report), self.settings.report_buckets)
        )

    def replace_chunks(self, incoming: DataFrame, replaced: DataFrame, again: bool = False, dealt: bool = False) -> DataFrame:
        """Swap the chunks of the reports in ``replaced`` (channel_id, report_id).

        Returns the deleted count of each report. A report with no incoming chunks
        loses its old ones, even when that empties a partition. ``again``: the keys of
        ``incoming`` are cheap to make more than once, so that it is not written before;
        its other columns are computed for the write only. ``dealt``: it is grouped by folder already.
        """
        keys = self._keys("report_chunks")
        incoming = self.with_bucket(incoming)
        if not again:
            incoming = stored(incoming, "incoming")
        self.assert_unique("report_chunks", incoming)
        gone = cut_lineage(self.with_bucket(replaced.select("channel_id", "report_id").distinct()))
        current = self.read("report_chunks")
        touched = gone.select(*keys).distinct()
        affected = current.join(touched, keys, "left_semi")
        deleted = cut_lineage(catalog.chunks_per_report(affected, gone))
        # The reports beside them that stay are told by their ids; chunks are moved only where there are such.
        staying = affected.select(*keys, "report_id").distinct()
        staying = stored(catalog.without_reports(staying, gone), "staying")
        after = incoming
        if not staying.isEmpty():
            kept = current.join(staying, [*keys, "report_id"], "left_semi")
            after = (self.dealt("report_chunks", kept) if dealt else kept).unionByName(incoming)
        filled = cut_lineage(staying.select(*keys).unionByName(incoming.select(*keys)).distinct())
        emptied = touched.join(filled, keys, "left_anti")
        self.overwrite("report_chunks", after, dealt)
        self.drop_partitions("report_chunks", emptied)
        return deleted.withColumnRenamed("chunks", "deleted")
