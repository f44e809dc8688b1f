"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession


#: Bytes of rows that go to Python at a time, where the session keeps Spark's own default: rows may be long texts.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def build_session(app: str = "lamplight", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        BATCH_KEY: BATCH_BYTES,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that tasks find it wherever they run, and bounds
    the batches they are given.

    The archive is the driver's own file; Spark's file server hands it on.
    """
    if spark.conf.get(BATCH_KEY, None) in (None, "67108864b"):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_lamplight_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lamplight-ship-"), "lamplight.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._lamplight_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in ``spark.checkpoint.dir``.

    A machine-local folder is made only in local mode, where driver and tasks are
    one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lamplight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df):
    """Materialise ``df`` in the shared folder and drop its lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df, name: str = "stage"):
    """``df`` written to the shared folder and read back, so later uses read only the
    columns they need instead of computing it again."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
