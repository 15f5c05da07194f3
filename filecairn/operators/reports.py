"""Report figures: largest files, summary, wasted space, browse orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecairn.operators.duplicates import hash_present
from filecairn.plans.ordering import ranked

TOP_N = 100
MIN_DUPLICATE_SIZE = 1024


def largest_files(files: DataFrame, n: int = TOP_N, nonempty: bool = False) -> DataFrame:
    """Top ``n`` files by size with their rank; ``nonempty`` leaves out zero sizes."""
    rows = files.filter(F.col("size") > 0) if nonempty else files
    return ranked(rows, [("size", True), ("path", False)], n)


def summary(files: DataFrame) -> DataFrame:
    """One row of totals from a single pass.

    ``duplicate_files_ref`` is total minus distinct hashes, so files never hashed
    count as duplicates; ``redundant_copies`` counts only real extra copies.
    """
    named = F.when(hash_present(F.col("hash_value")), F.col("hash_value")).alias("hash_value")
    cells = files.groupBy(named, "size").agg(F.count("*").alias("n"))
    copies = F.when(F.col("hash_value").isNotNull(), F.col("n") - 1).otherwise(F.lit(0))
    totals = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("total_size"),
        F.count_distinct("hash_value").alias("unique_files"),
        F.coalesce(F.sum(copies * F.col("size")), F.lit(0)).alias("wasted_space"),
        F.coalesce(F.sum(copies), F.lit(0)).alias("redundant_copies"),
    )
    average = F.when(F.col("total_files") > 0, F.expr("total_size div total_files")).otherwise(F.lit(0))
    return totals.withColumn(
        "duplicate_files_ref", F.col("total_files") - F.col("unique_files")
    ).withColumn("average_file_size", average)


def wasted_space(groups: DataFrame) -> DataFrame:
    """Bytes held by all copies but one, from groups by hash and size."""
    extra = (F.col("file_count") - 1) * F.col("size")
    return groups.agg(F.coalesce(F.sum(extra), F.lit(0)).alias("wasted_space"))


# Browse orders offered on each table: (column, descending), ties broken by the key.
FILE_ORDERS = {
    "by_mtime": [("mtime", True)],
    "by_folder_size": [("dir_path", False), ("size", True)],
    "by_folder_tag_size": [("dir_path", False), ("tag", False), ("size", True)],
    "by_size_mtime": [("size", True), ("mtime", True)],
    "by_tag": [("tag", False)],
    "by_extension": [("file_ext", False)],
}
FOLDER_ORDERS = {
    "by_size": [("size", True)],
    "by_number_files": [("number_files", True)],
    "by_subtree_size": [("subtree_size", True)],
    "by_subtree_files": [("subtree_files", True)],
    "by_mtime": [("mtime", True)],
    "by_tag": [("tag", False)],
}
GROUP_ORDERS = {"by_total_size": [("total_size", True)], "by_file_count": [("file_count", True)]}
RUN_ORDERS = {"by_status": [("status", False)], "by_started_at": [("started_at", True)]}


def browse(df: DataFrame, orders: dict, name: str, key: str, n: int = TOP_N) -> DataFrame:
    """Top ``n`` rows of a table in one of its browse orders, with their rank."""
    return ranked(df, [*orders[name], (key, False)], n)
