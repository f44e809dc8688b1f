"""Ids that depend on the natural key only, so a re-run yields the same row ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_uuid(kind: str, *key: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[k.cast("string") for k in key]))
    return F.regexp_replace(digest, r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def canonical_uuid(text: Column) -> Column:
    """Lower-case UUID text, or null when the text is not a UUID."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"\Aurn:uuid:|[{}-]", "")
    dashed = F.regexp_replace(bare, r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike(r"\A[0-9a-f]{32}\z"), dashed)


def report_bucket(report_id: Column, buckets: int) -> Column:
    return F.pmod(F.hash(report_id), F.lit(buckets)).cast("int")
