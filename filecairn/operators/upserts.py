"""Merging a new scan into an existing inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_REFRESHED = ["folder_id", "size", "mtime"]
FOLDER_REFRESHED = ["parent_id", "mtime"]


def upsert_by_path(old: DataFrame, new: DataFrame, refreshed: list[str]) -> DataFrame:
    """New paths are added; known paths take only the ``refreshed`` columns."""
    n, o = new.alias("n"), old.alias("o")

    def pick(column: str, first: str, second: str):
        has_first = F.col(f"{first}.path").isNotNull()
        return F.when(has_first, F.col(f"{first}.{column}")).otherwise(F.col(f"{second}.{column}"))

    joined = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    return joined.select(*[
        (pick(c, "n", "o") if c in refreshed else pick(c, "o", "n")).alias(c) for c in old.columns
    ])


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known files keep id, tag, labels, hash and flag."""
    return upsert_by_path(old, new, FILE_REFRESHED)


def without_stale_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known files that ``new`` shows with another size or mtime lose their hash.

    Applied to the old side before a merge, so that changed content is hashed again.
    """
    seen = new.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    changed = (F.col("size") != F.col("_size")) | (F.col("mtime") != F.col("_mtime"))
    kept = F.when(~F.coalesce(changed, F.lit(False)), F.col("hash_value"))
    joined = old.join(seen, "path", "left").withColumn("hash_value", kept)
    return joined.select(*old.columns)


def upsert_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known folders keep id, tag and rollups."""
    return upsert_by_path(old, new, FOLDER_REFRESHED)
