"""Duplicate groups, their members, flags and the group table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.functions.times import first_seen_or
from filecairn.plans.ordering import positions
from filecairn.plans.skew import ROWS_PER_SALT, key_counts, salted_join

PAGE_SIZE = 1000
MEMBER = ["id", "path", "filename", "size", "mtime", "tag", "top_folder"]


def hash_present(hash_value: Column) -> Column:
    return hash_value.isNotNull() & (hash_value != "")


def hashed_files(files: DataFrame, from_hash: str = "") -> DataFrame:
    """Files with a hash, optionally only those after ``from_hash``."""
    rows = files.filter(hash_present(F.col("hash_value")))
    return rows.filter(F.col("hash_value") > from_hash) if from_hash else rows


def duplicate_groups(files: DataFrame, from_hash: str = "", now: Column | None = None) -> DataFrame:
    """Hashes held by more than one file, with count, bytes and earliest mtime."""
    seen = F.min("mtime")
    return (
        hashed_files(files, from_hash)
        .groupBy("hash_value")
        .agg(
            F.count("*").alias("file_count"),
            F.sum("size").alias("total_size"),
            (seen if now is None else first_seen_or(seen, now)).alias("first_seen"),
        )
        .filter("file_count > 1")
    )


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """Groups, files and bytes over all groups."""
    return groups.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"),
    )


def groups_by_hash_and_size(files: DataFrame, min_size: int = 0) -> DataFrame:
    """Groups by hash and size from ``min_size`` up."""
    return (
        hashed_files(files)
        .filter(F.col("size") >= min_size)
        .groupBy("hash_value", "size")
        .agg(F.count("*").alias("file_count"))
        .filter("file_count > 1")
        .withColumn("total_size", F.col("size") * F.col("file_count"))
    )


def group_key(by_size: bool) -> Column:
    """Hash, or hash and size as one text: salted joins take a single key."""
    if not by_size:
        return F.col("hash_value")
    return F.concat_ws("/", "hash_value", F.col("size").cast("string"))


def members_of_groups(
    files: DataFrame,
    groups: DataFrame,
    complete: bool = False,
    rows_per_salt: int = ROWS_PER_SALT,
    every: DataFrame | None = None,
) -> DataFrame:
    """One row per file of the given groups, with every group column.

    Groups are by hash, or by hash and size if they have a size. A hash of very many
    files is salted; ``complete`` says that the groups are all there are of these
    files, so that their counts already tell which ones to salt. ``every`` are all groups
    where the given ones are some of them.
    """
    by_size = "size" in groups.columns
    rows = hashed_files(files).withColumn("_key", group_key(by_size))
    shared = ["hash_value", "size"] if by_size else ["hash_value"]
    keyed = groups.withColumn("_key", group_key(by_size)).drop(*shared)
    counts = keyed if complete else None
    if every is not None:
        counts = every.select(group_key(by_size).alias("_key"), "file_count")
    return salted_join(rows, keyed, "_key", "inner", F.col("path"), counts, rows_per_salt).drop("_key")


def duplicate_members(
    files: DataFrame, min_size: int | None = None, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """One row per file of a duplicate group: by hash, or by hash and size from ``min_size``."""
    if min_size is None:
        # Only the count is needed, so the hot-key lookup shares this aggregation.
        groups = duplicate_groups(files).select("hash_value", "file_count")
    else:
        groups = groups_by_hash_and_size(files, min_size)
        files = files.filter(F.col("size") >= min_size)
    return members_of_groups(files, groups, True, rows_per_salt)


def ordered_members(members: DataFrame) -> DataFrame:
    """Members by hash, then size descending, then path."""
    return members.orderBy("hash_value", F.desc("size"), "path")


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Groups by size descending."""
    return groups.orderBy(F.desc("size"), "hash_value")


def nested_members(files: DataFrame, groups: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Group rows with their files nested in path order.

    ``groups`` are all groups of these files. An array holds at most ``page_size`` files. A larger group
    continues on further rows, ``page`` 1, 2, ... in path order, so no task ever holds a whole large group.
    """
    by_size = "size" in groups.columns
    key = ["hash_value", "size"] if by_size else ["hash_value"]
    groups = groups.select(*key, "file_count")
    file = F.struct("path", *[c for c in MEMBER if c != "path"])

    def nest(rows: DataFrame, total: Column) -> DataFrame:
        return rows.groupBy(*key, "page").agg(
            F.first("file_count").alias("file_count"),
            total.alias("total_size"),
            F.sort_array(F.collect_list(file)).alias("files"),
        )

    whole = members_of_groups(files, groups.filter(F.col("file_count") <= page_size), every=groups)
    small = nest(whole.withColumn("page", F.lit(1).cast("long")), F.sum("size"))
    large = groups.filter(F.col("file_count") > page_size)
    if large.isEmpty():
        return small
    members = members_of_groups(files, large, every=groups).drop("file_count")
    placed = positions(members, [F.col(c) for c in (*key, "path")], "_position").withColumn(
        "_key", group_key(by_size)
    )
    starts = placed.groupBy("_key").agg(
        F.min("_position").alias("_start"),
        F.count("*").alias("file_count"),
        F.sum("size").alias("_total"),
    )
    paged = salted_join(placed, starts, "_key", "inner", F.col("path"), starts)
    page = F.floor((F.col("_position") - F.col("_start")) / page_size) + 1
    return small.unionByName(nest(paged.withColumn("page", page.cast("long")), F.first("_total")))


def mark_duplicates(
    files: DataFrame, groups: DataFrame, complete: bool = False, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Set the flag of every file in a group; a set flag is never cleared.

    ``complete`` says that the groups are all there are of these files.
    """
    keyed = groups.select(F.col("hash_value").alias("_key"), "file_count")
    # An empty hash is no key: NULL, so that its rows are spread like those without a hash.
    files_keyed = files.withColumn("_key", F.when(hash_present(F.col("hash_value")), F.col("hash_value")))
    counts = keyed if complete else key_counts(files_keyed, "_key")
    member = keyed.select("_key", F.lit(True).alias("_member"))
    joined = salted_join(files_keyed, member, "_key", "left", F.col("path"), counts, rows_per_salt)
    flag = F.coalesce("is_duplicate", F.lit(False)) | F.coalesce("_member", F.lit(False))
    return joined.withColumn("is_duplicate", flag).select(*files.columns)


def mark_members(files: DataFrame, groups: DataFrame) -> DataFrame:
    """The flags of ``mark_duplicates`` where ``groups`` are all there are and no flag is set.

    Only hashes and paths go to the groups and only the members' paths come back, so that a file table bucketed
    by path is not shuffled.
    """
    members = members_of_groups(files.select("path", "hash_value"), groups.select("hash_value", "file_count"), True)
    member = members.select("path", F.lit(True).alias("_member"))
    joined = files.join(member, "path", "left").withColumn("is_duplicate", F.coalesce("_member", F.lit(False)))
    return joined.select(*files.columns)


def reset_flags(files: DataFrame) -> DataFrame:
    """All flags cleared."""
    return files.withColumn("is_duplicate", F.lit(False))


def _merge_groups(old: DataFrame, new: DataFrame, now: Column, keep_first_seen: bool) -> DataFrame:
    fresh = new.withColumn("last_updated", now)
    n, o = fresh.alias("n"), old.alias("o")
    is_new = F.col("n.hash_value").isNotNull()
    is_old = F.col("o.hash_value").isNotNull()

    def newest(c):
        return F.when(is_new, F.col("n." + c)).otherwise(F.col("o." + c)).alias(c)

    first = (
        F.when(is_old, F.col("o.first_seen")).otherwise(F.col("n.first_seen")).alias("first_seen")
        if keep_first_seen
        else newest("first_seen")
    )
    return n.join(o, F.col("n.hash_value") == F.col("o.hash_value"), "full_outer").select(
        newest("hash_value"), newest("file_count"), newest("total_size"), first, newest("last_updated")
    )


def upsert_groups_scan(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """After a scan: refresh count, size and last_updated, keep first_seen."""
    return _merge_groups(old, new, now, keep_first_seen=True)


def upsert_groups_rebuild(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """After a rebuild: refresh every column."""
    return _merge_groups(old, new, now, keep_first_seen=False)
