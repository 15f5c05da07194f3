"""Snapshots: one Parquet folder per scan, never rewritten in place."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filecairn.plans.cut import exists, remove, work_path
from filecairn.schemas import TABLES, conform, empty, upgrade_folders


# Written after all tables; a folder without it is no snapshot.
MARK = "commit"


def snapshot_path(base: str, at: datetime) -> str:
    """Folder of the scan taken at a given time."""
    return f"{base.rstrip('/')}/scan_{at:%Y%m%d_%H%M%S}"


def write_table(df: DataFrame, path: str, table: str, cluster_by: str | None = None) -> None:
    """Write one table of a new snapshot; an existing one is an error.

    ``cluster_by`` range-sorts the rows so that filters on the column skip row groups.
    """
    out = conform(df, table)
    if cluster_by:
        out = out.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    out.write.mode("errorifexists").parquet(f"{path}/{table}")


def bucketed(spark: SparkSession, where: str, schema: StructType, buckets: int) -> DataFrame:
    """A folder written by ``write_bucketed``: joins on the path need no shuffle of it."""
    name = "filecairn_" + hashlib.md5(where.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        location = where.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet "
            f"CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
    return spark.table(name)


def write_bucketed(df: DataFrame, where: str, buckets: int, aligned: bool = False) -> None:
    """Write rows bucketed by the hash of their path, sorted by path in each bucket.

    ``aligned`` rows come from a join on the path with a bucketed table, so that every bucket is in one task
    already; others are dealt out first. Either way each bucket is one file.
    """
    rows = df if aligned else df.repartition(buckets, "path")
    name = "filecairn_" + hashlib.md5(where.encode()).hexdigest()
    (
        rows.write.mode("errorifexists").format("parquet").option("path", where)
        .bucketBy(buckets, "path").sortBy("path").saveAsTable(name)
    )


def written_bucketed(df: DataFrame, name: str, buckets: int, aligned: bool = False) -> DataFrame:
    """Write an intermediate table to the shared folder by path buckets, and read it back."""
    where = work_path(df.sparkSession, name)
    write_bucketed(df, where, buckets, aligned)
    return bucketed(df.sparkSession, where, df.schema, buckets)


def write_snapshot(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    path: str,
    cluster_by: dict[str, str | None] | None = None,
    buckets: int = 0,
) -> str:
    """Write a snapshot; tables not given are written empty. The commit mark comes last.

    ``file_hashes`` is always taken from the file table as it was written, and sorted by hash. With ``buckets`` the
    file table, whose rows must be aligned to them, is bucketed by path instead of clustered.
    """
    if exists(spark, path):
        raise FileExistsError(f"a snapshot is never overwritten: {path}")
    clustered = {**(cluster_by or {}), "file_hashes": "hash_value"}
    for table in TABLES:
        if table == "file_hashes":
            rows = hash_rows(read_table(spark, path, "files"))
        else:
            rows = tables[table] if table in tables else empty(spark, table)
        if table == "files" and buckets:
            write_bucketed(conform(rows, table), f"{path}/{table}", buckets, aligned=True)
        else:
            write_table(rows, path, table, clustered.get(table))
    mark = spark.range(1).select(F.expr("uuid()").alias("commit_id"), F.lit(buckets).alias("buckets"))
    mark.coalesce(1).write.parquet(f"{path}/{MARK}")
    return path


def hash_rows(files: DataFrame) -> DataFrame:
    """The hashed files of a file table, without what groups do not need."""
    present = F.col("hash_value").isNotNull() & (F.col("hash_value") != "")
    return files.filter(present).select(*TABLES["file_hashes"].names)


def discard_unfinished(spark: SparkSession, path: str) -> None:
    """Remove what a failed write of a snapshot left; a committed one is never removed."""
    if exists(spark, f"{path}/{MARK}/_SUCCESS"):
        raise FileExistsError(f"a snapshot is never overwritten: {path}")
    if exists(spark, path):
        remove(spark, path)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of a snapshot; an absent one is empty, and missing rollup columns read as 0.

    A folder whose write did not finish is an error.
    """
    where = f"{path}/{table}"
    if not exists(spark, where):
        return empty(spark, table)
    if not exists(spark, f"{where}/_SUCCESS"):
        raise FileNotFoundError(f"unfinished table {where}")
    if table == "folders":
        return upgrade_folders(spark.read.schema(TABLES[table]).parquet(where))
    return spark.read.schema(TABLES[table]).parquet(where)


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a committed snapshot; without its commit mark or its file table there is none."""
    for needed in (MARK, "files"):
        if not exists(spark, f"{path}/{needed}/_SUCCESS"):
            raise FileNotFoundError(f"no complete snapshot at {path}: {needed} is missing")
    tables = {table: read_table(spark, path, table) for table in TABLES}
    buckets = snapshot_buckets(spark, path)
    if buckets:
        tables["files"] = bucketed(spark, f"{path}/files", TABLES["files"], buckets)
    if not exists(spark, f"{path}/file_hashes"):
        tables["file_hashes"] = hash_rows(tables["files"])
    return tables


def snapshot_buckets(spark: SparkSession, path: str) -> int:
    """Number of path buckets of a snapshot's file table, 0 if it is not bucketed."""
    return spark.read.schema("commit_id string, buckets int").parquet(f"{path}/{MARK}").first()["buckets"] or 0


def register_views(tables: dict[str, DataFrame]) -> None:
    """Offer the tables to ``spark.sql`` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
