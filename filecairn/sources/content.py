"""MD5 of candidate content, from a table column or from files on a shared mount."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from filecairn.functions.paths import path_bytes
from filecairn.plans.balance import load_bins

HASHED = StructType([
    StructField("id", LongType(), False),
    StructField("path", StringType(), False),
    StructField("size", LongType()),
    StructField("tag", StringType()),
    StructField("hash_value", StringType()),
    StructField("hash_error", StringType()),
])

# Bytes a hash task reads at least before a new one is begun; opening a file counts as so many bytes more.
BYTES_PER_TASK = 4 << 30
OPEN_COST = 64 << 10


def content_hash(content: Column, size: Column) -> Column:
    """Lower-case MD5; NULL for empty content."""
    return F.when(size > 0, F.md5(content.cast("binary")))


def _without_waiting(path: bytes, flags: int) -> int:
    """A pipe put where a file was must not hold a task for ever."""
    return os.open(path, flags | os.O_NONBLOCK)


def _digest(path: str) -> tuple[str | None, str | None]:
    try:
        with open(path_bytes(path), "rb", opener=_without_waiting) as content:
            info = os.fstat(content.fileno())
            if not stat.S_ISREG(info.st_mode):
                return None, "no longer a regular file"
            if info.st_size == 0:
                return None, None
            return hashlib.file_digest(content, "md5").hexdigest(), None
    except OSError as problem:
        return None, str(problem)


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        results = [_digest(path) for path in batch["path"]]
        yield pd.DataFrame({
            "id": batch["id"],
            "path": batch["path"],
            "size": batch["size"],
            "tag": batch["tag"],
            "hash_value": pd.Series([r[0] for r in results], dtype=object),
            "hash_error": pd.Series([r[1] for r in results], dtype=object),
        })


def hash_bins(candidates: DataFrame, target: int | None = None) -> tuple[DataFrame, int]:
    """Candidates with the task that reads each, and the number of tasks.

    Bins are cut by bytes, what opening costs included, in descending order of size: files of at least
    ``target`` bytes alone, the rest together up to it. Unless given, the target is an equal share of all bytes for
    each core, at most ``BYTES_PER_TASK``.
    """
    columns = [c for c in ("id", "path", "size", "tag") if c in candidates.columns]
    rows = candidates.select(*columns).withColumn("load", F.coalesce("size", F.lit(0)) + F.lit(OPEN_COST))
    if target is None:
        total = rows.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
        cores = candidates.sparkSession.sparkContext.defaultParallelism
        target = min(BYTES_PER_TASK, max(1, -(-total // cores)))
    return load_bins(rows, "load", target, [F.asc("path"), F.asc("id")])


def hash_mounted(candidates: DataFrame, target: int | None = None) -> DataFrame:
    """Read and hash candidate files; a failure becomes ``hash_error``.

    Only ids, paths and sizes are shuffled. Every task reads one bin of ``hash_bins``, the
    largest files first, so neither many huge files nor very many small ones meet in one task.
    """
    binned, tasks = hash_bins(candidates, target)
    tag = F.col("tag") if "tag" in candidates.columns else F.lit(None).cast("string")
    return (
        binned.select("id", "path", "size", tag.alias("tag"), "bin")
        .repartitionById(tasks, "bin")
        .select("id", "path", "size", "tag")
        .mapInPandas(_hash_batches, HASHED)
    )
