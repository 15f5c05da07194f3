"""Inventories built from tables that already list paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.functions.paths import base_name, components, extension, parent_dir, scope_prefix, top_folder

# Directory names left out of a scan unless the caller names others.
DEFAULT_EXCLUDED = [".git", ".streams", "@Recently-Snapshot", "@Recycle", "COREBanking"]


def describe(rows: DataFrame) -> DataFrame:
    """Add the columns that follow from the path."""
    name = base_name(F.col("path"))
    return (
        rows.withColumn("dir_path", parent_dir(F.col("path")))
        .withColumn("filename", name)
        .withColumn("file_ext", extension(name))
        .withColumn("top_folder", top_folder(F.col("path")))
    )


def below_root(dir_path: Column, roots: list[str]) -> Column:
    """Directory path with the longest matching root removed; '' for a root itself."""
    rest = dir_path
    for root in sorted(roots, key=len):
        prefix = scope_prefix(root)
        rest = (
            F.when(dir_path == root, F.lit(""))
            .when(F.startswith(dir_path, F.lit(prefix)), F.substring(dir_path, len(prefix) + 1, 2**31 - 1))
            .otherwise(rest)
        )
    return rest


def exclude_directories(files: DataFrame, names: list[str], roots: list[str]) -> DataFrame:
    """Drop files that lie in a subtree whose directory name is excluded.

    Names of the roots themselves and of files never count.
    """
    inside = components(below_root(F.col("dir_path"), roots))
    return files.filter(~F.arrays_overlap(inside, F.array(*[F.lit(n) for n in names])))


def regular_files(entries: DataFrame) -> DataFrame:
    """Only the regular files of a crawl."""
    return entries.filter(F.col("kind") == "file")


def lookup_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in a list of any length."""
    return files.join(ids.select("id"), "id", "left_semi")


def colliding_ids(files: DataFrame) -> DataFrame:
    """Ids that more than one path carries; ids derived from paths may collide."""
    return files.groupBy("id").agg(F.count("*").alias("paths")).filter("paths > 1")


def totals_by_tag(files: DataFrame) -> DataFrame:
    """File count and bytes per root tag."""
    return files.groupBy("tag").agg(
        F.count("*").alias("file_count"), F.sum("size").alias("total_size")
    )
