"""Table schemas, empty tables and upgrade on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _field(name, kind, nullable=True):
    return StructField(name, kind, nullable)


FILES = StructType([
    _field("id", LongType(), False),
    _field("folder_id", LongType(), False),
    _field("path", StringType(), False),
    _field("dir_path", StringType(), False),
    _field("filename", StringType(), False),
    _field("file_ext", StringType()),
    _field("size", LongType(), False),
    _field("mtime", TimestampType(), False),
    _field("hash_value", StringType()),
    _field("is_duplicate", BooleanType()),
    _field("tag", StringType()),
    _field("top_folder", StringType()),
])

FOLDERS = StructType([
    _field("id", LongType(), False),
    _field("parent_id", LongType()),
    _field("path", StringType(), False),
    _field("name", StringType(), False),
    _field("mtime", TimestampType()),
    _field("tag", StringType()),
    _field("size", LongType(), False),
    _field("number_files", LongType(), False),
    _field("subtree_size", LongType(), False),
    _field("subtree_files", LongType(), False),
])

DUPLICATE_GROUPS = StructType([
    _field("hash_value", StringType(), False),
    _field("file_count", LongType(), False),
    _field("total_size", LongType(), False),
    _field("first_seen", TimestampType(), False),
    _field("last_updated", TimestampType(), False),
])

DUPLICATE_RUNS = StructType([
    _field("id", LongType(), False),
    _field("started_at", TimestampType(), False),
    _field("finished_at", TimestampType()),
    _field("status", StringType(), False),
    _field("total_groups", LongType()),
    _field("processed_groups", LongType()),
    _field("processed_files", LongType()),
    _field("processed_size", LongType()),
    _field("last_hash_value", StringType()),
    _field("note", StringType()),
])

# Hashed files only, in the order of their hashes: what groups, resuming and the rebuild read.
FILE_HASHES = StructType([
    _field("hash_value", StringType(), False),
    _field("size", LongType(), False),
    _field("mtime", TimestampType(), False),
    _field("id", LongType(), False),
])

# Stages: root, list and stat in the crawl, hash when content is read.
SCAN_ERRORS = StructType([
    _field("path", StringType(), False),
    _field("tag", StringType()),
    _field("stage", StringType(), False),
    _field("message", StringType()),
])

# What purges did to files on disk: deleted, missing (gone before the purge began) or error.
PURGE_LOG = StructType([
    _field("id", LongType(), False),
    _field("path", StringType(), False),
    _field("outcome", StringType(), False),
    _field("message", StringType()),
    _field("purged_at", TimestampType(), False),
])

TABLES = {
    "files": FILES,
    "file_hashes": FILE_HASHES,
    "folders": FOLDERS,
    "duplicate_groups": DUPLICATE_GROUPS,
    "duplicate_runs": DUPLICATE_RUNS,
    "scan_errors": SCAN_ERRORS,
    "purge_log": PURGE_LOG,
}

ROLLUPS = ["size", "number_files", "subtree_size", "subtree_files"]


def empty(spark: SparkSession, table: str) -> DataFrame:
    """Typed empty table."""
    return spark.createDataFrame([], TABLES[table])


def upgrade_folders(folders: DataFrame) -> DataFrame:
    """Older folder tables gain the rollup columns; absent or NULL reads as 0."""
    present = [
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in folders.columns
        else F.lit(0).cast("long").alias(c)
        for c in ROLLUPS
    ]
    others = [F.col(c) for c in folders.columns if c not in ROLLUPS]
    return folders.select(*others, *present)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast a frame to a table schema, column order included."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]])
