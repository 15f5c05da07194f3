"""Folder table and rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.functions.paths import ancestors, base_name, parent_dir, path_id
from filecairn.plans.skew import ROWS_PER_SALT, salted_join
from filecairn.schemas import ROLLUPS


def folders_of(
    files: DataFrame, min_depth: int, id_of: Callable[[Column], Column] = path_id
) -> DataFrame:
    """Folder table of an inventory that has none: all ancestors down from the roots.

    Roots are the folders with ``min_depth`` components; they have no parent.
    """
    dirs = files.groupBy("dir_path", "tag").agg(F.max("mtime").alias("mtime"))
    path = F.col("path")
    root = F.size(F.split(path, "/")) <= min_depth + 1
    parent = F.when(~root, parent_dir(path))
    return (
        dirs.select(F.explode(ancestors(F.col("dir_path"), min_depth)).alias("path"), "tag", "mtime")
        .groupBy("path")
        .agg(F.min("tag").alias("tag"), F.max("mtime").alias("mtime"))
        .select(
            id_of(path).alias("id"),
            F.when(~root, id_of(parent_dir(path))).alias("parent_id"),
            "path",
            base_name(path).alias("name"),
            "mtime",
            "tag",
            parent.alias("parent_path"),
            *[F.lit(0).cast("long").alias(c) for c in ROLLUPS],
        )
    )


def direct_totals(files: DataFrame) -> DataFrame:
    """Bytes and files that lie directly in each directory."""
    return files.groupBy(F.col("dir_path").alias("path")).agg(
        F.sum("size").alias("size"), F.count("*").alias("number_files")
    )


def rollups(files: DataFrame) -> DataFrame:
    """The four rollups of every directory: what lies directly in it and at any depth below.

    Files are summed per directory first, so only directories are repeated per ancestor.
    """
    spread = direct_totals(files).select(
        F.explode(ancestors(F.col("path"), root=True)).alias("at"), "path", "size", "number_files"
    )
    own = F.col("at") == F.col("path")
    return spread.groupBy(F.col("at").alias("path")).agg(
        F.sum(F.when(own, F.col("size"))).alias("size"),
        F.sum(F.when(own, F.col("number_files"))).alias("number_files"),
        F.sum("size").alias("subtree_size"),
        F.sum("number_files").alias("subtree_files"),
    )


def with_rollups(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folder table with all four rollups filled, 0 where nothing lies below."""
    kept = [c for c in folders.columns if c not in ROLLUPS]
    joined = folders.select(*kept).join(rollups(files), "path", "left")
    return joined.select(*kept, *[F.coalesce(c, F.lit(0)).alias(c) for c in ROLLUPS])


def files_with_folder(
    files: DataFrame, folders: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Each file beside the folder row of its directory, joined by path.

    A directory of very many files is salted; files without a folder row drop out.
    """
    counts = files.groupBy("dir_path").agg(F.count("*").alias("file_count"))
    known = folders.select(
        F.col("path").alias("dir_path"), F.col("id").alias("folder_row_id"), F.col("name").alias("folder_name")
    )
    keyed = counts.join(known, "dir_path")
    return salted_join(
        files, keyed, "dir_path", "inner", F.col("path"), counts, rows_per_salt
    )


def files_without_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files whose directory has no folder row (the foreign key, checked by path)."""
    dirs = files.groupBy("dir_path").agg(F.count("*").alias("file_count"))
    return dirs.join(folders.select(F.col("path").alias("dir_path")), "dir_path", "left_anti")


def with_parent(folders: DataFrame) -> DataFrame:
    """Each folder beside its parent's path and name; roots have NULL."""
    parent = folders.select(
        F.col("path").alias("parent_path"),
        F.col("name").alias("parent_name"),
    )
    rows = folders.drop("parent_path").withColumn("parent_path", parent_dir(F.col("path")))
    joined = rows.join(parent, "parent_path", "left")
    known = F.col("parent_name").isNotNull()
    return joined.withColumn("parent_path", F.when(known, F.col("parent_path")))
