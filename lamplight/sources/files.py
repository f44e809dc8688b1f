"""Files on disk: listing, validation, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What a PDF must look like.
PDF_MIN_BYTES = 32
PDF_MAGIC = "%PDF-"


def pdf_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """PDFs under ``path`` (a file or folder): path, modificationTime, length, content.

    Columns that are not selected are not read, so listing alone never opens a file.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{pdf,PDF}")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def pdf_fault(content: Column) -> Column:
    """Why the bytes cannot be a PDF, or null."""
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) < PDF_MIN_BYTES, "too small")
        .when(F.substring(content, 1, len(PDF_MAGIC)) != F.lit(PDF_MAGIC).cast("binary"), "missing header")
    )


def validate(files: DataFrame) -> DataFrame:
    """Adds ``fault``, ``size_bytes`` and the first eight bytes as hex."""
    content = F.col("content")
    return files.withColumns(
        {
            "fault": pdf_fault(content),
            "size_bytes": F.octet_length(content).cast("long"),
            "header_hex": F.lower(F.hex(F.substring(content, 1, 8))),
        }
    )


def sql_files(spark: SparkSession, folder: str) -> DataFrame:
    """Migration files as (version, sql), whole files, in name order."""
    return (
        spark.read.option("pathGlobFilter", "*.sql")
        .text(folder, wholetext=True)
        .select(file_name(F.input_file_name()).alias("version"), F.col("value").alias("sql"))
        .orderBy("version")
    )
