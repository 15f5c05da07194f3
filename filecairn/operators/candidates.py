"""Which files may be identical, their hashes, and the write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.functions.text import percent
from filecairn.plans.cut import written
from filecairn.plans.skew import ROWS_PER_SALT, fits, salted_join
from filecairn.sources.content import content_hash

MAX_BROADCAST_SIZES = 1_000_000


def open_files(files: DataFrame) -> DataFrame:
    """Non-empty files without a hash."""
    return files.filter((F.col("size") > 0) & F.col("hash_value").isNull())


def shared_sizes(files: DataFrame) -> DataFrame:
    """Sizes held by more than one file."""
    return files.groupBy("size").agg(F.count("*").alias("file_count")).filter("file_count > 1")


def candidate_sizes(files: DataFrame, include_hashed: bool = False) -> DataFrame:
    """Sizes shared by more than one open file.

    ``include_hashed`` also counts files hashed earlier, so that a new file of the
    size of a known one is a candidate in an incremental run.
    """
    return shared_sizes(files.filter(F.col("size") > 0) if include_hashed else open_files(files))


def candidate_files(
    files: DataFrame, include_hashed: bool = False, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Open files whose size is shared; a size held by very many files is salted."""
    sizes = candidate_sizes(files, include_hashed)
    return salted_join(open_files(files), sizes, "size", "left_semi", F.col("path"), sizes, rows_per_salt)


def candidate_count(files: DataFrame, include_hashed: bool = False) -> DataFrame:
    """Number of candidates, from the sizes alone."""
    if include_hashed:
        return candidate_files(files, True).agg(F.count("*").alias("candidates"))
    return candidate_sizes(files).agg(F.coalesce(F.sum("file_count"), F.lit(0)).alias("candidates"))


def hash_candidates(
    files: DataFrame, listing: DataFrame | None = None, max_sizes: int = MAX_BROADCAST_SIZES
) -> DataFrame:
    """Hash the candidates of a table that has a ``content`` column.

    Content never goes through a shuffle and is read once. With a stored ``listing``
    (the same files without content) the candidate sizes are known beforehand: up to
    ``max_sizes`` of them are broadcast to the content scan, so only candidates are
    hashed. Otherwise every open file is hashed as it is read and ids, sizes and
    hashes are joined.
    """
    hashed = content_hash(F.col("content"), F.col("size")).alias("hash_value")
    no_error = F.lit(None).cast("string").alias("hash_error")
    rows = open_files(files)
    if listing is not None:
        sizes = candidate_sizes(listing)
        if fits(sizes, max_sizes):
            rows = rows.join(F.broadcast(sizes), "size", "left_semi")
            return rows.select("id", "path", "size", hashed, no_error)
        narrow = rows.select("id", "path", "size", hashed, no_error)
    else:
        narrow = written(rows.select("id", "path", "size", hashed, no_error), "hashed")
        sizes = shared_sizes(narrow)
    kept = salted_join(narrow, sizes, "size", "left_semi", F.col("path"), sizes)
    return kept.select("id", "path", "size", "hash_value", "hash_error")


def write_back(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files with the new hashes; failed and empty results change nothing.

    Joined by path, the key of the file table, so that a table bucketed by it stays where it is.
    """
    good = hashes.filter(F.col("hash_error").isNull() & F.col("hash_value").isNotNull()).select(
        "path", F.col("hash_value").alias("_hash")
    )
    return (
        files.join(good, "path", "left")
        .withColumn("hash_value", F.coalesce("_hash", "hash_value"))
        .drop("_hash")
        .select(*files.columns)
    )


def with_content_hashes(files: DataFrame) -> DataFrame:
    """Candidate hashing and write-back over a content table without a listing.

    Equal to ``write_back(files, hash_candidates(files))`` without the content
    column. The content is read once, into a written table of the other columns.
    """
    can_hash = (F.col("size") > 0) & F.col("hash_value").isNull()
    digest = F.when(can_hash, content_hash(F.col("content"), F.col("size")))
    kept = [c for c in files.columns if c != "content"]
    narrow = written(files.withColumn("_hash", digest).drop("content"), "listed")
    shared = candidate_sizes(narrow).select("size", F.lit(True).alias("_shared"))
    joined = salted_join(narrow, shared, "size", "left", F.col("path"))
    found = F.when(F.col("_shared"), F.col("_hash"))
    return joined.withColumn("hash_value", F.coalesce("hash_value", found)).select(*kept)


def hash_figures() -> list[Column]:
    """Figures of a hash stage, as aggregates of its rows.

    A success has a hash and no error; every other row is an error, an empty file's too.
    """
    good = F.col("hash_error").isNull() & F.col("hash_value").isNotNull()
    return [
        F.count(F.lit(1)).alias("processed"),
        F.count_if(good).alias("success"),
        F.count_if(~good).alias("errors"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    ]


def success_percent() -> Column:
    return F.round(percent(F.col("success"), F.col("processed")), 2).alias("success_percent")


def hash_metrics(hashes: DataFrame) -> DataFrame:
    """Processed, successful and failed hashes of a finished stage."""
    return hashes.agg(*hash_figures()).select("*", success_percent())


def scan_errors(crawled: DataFrame, hashes: DataFrame) -> DataFrame:
    """What a scan could not read: path, tag, stage and message.

    ``crawled`` are the errors of the crawl; of ``hashes`` the rows with an error are taken. A file that was empty
    when it was opened is no error.
    """
    unread = hashes.filter(F.col("hash_error").isNotNull()).select(
        "path", "tag", F.lit("hash").alias("stage"), F.col("hash_error").alias("message")
    )
    return crawled.select("path", "tag", "stage", "message").unionByName(unread)


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors per root tag and stage, with the first path of each."""
    return errors.groupBy("tag", "stage").agg(F.count("*").alias("errors"), F.min("path").alias("first_path"))
