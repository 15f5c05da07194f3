"""Distributed crawl of tagged directory trees on a mount that all executors see."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from filecairn.functions.paths import parent_dir, path_bytes, path_id, path_text
from filecairn.plans.cut import work_path, written
from filecairn.sources.tables import DEFAULT_EXCLUDED, describe, regular_files

# What a crawl writes; rows of kind ``error`` say at which stage (root, list, stat) and why.
ENTRY = StructType([
    StructField("kind", StringType(), False),
    StructField("path", StringType(), False),
    StructField("size", LongType()),
    StructField("mtime_us", LongType()),
    StructField("tag", StringType()),
    StructField("root_no", IntegerType()),
    StructField("stage", StringType()),
    StructField("error", StringType()),
])
FRONTIER = StructType([ENTRY["path"], ENTRY["tag"], ENTRY["root_no"]])

_OUT_ROWS = 10_000


class Crawl(NamedTuple):
    """Inventory frames of a crawl, and what it could not read."""

    files: DataFrame
    folders: DataFrame
    errors: DataFrame


def _failed(path: str, tag: str, root_no: int, stage: str, problem: OSError | str) -> tuple:
    return ("error", path, None, None, tag, root_no, stage, str(problem))


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A folder row and a first frontier row for each root that is a directory, an error row for others."""
    for batch in batches:
        rows = []
        for root in batch.itertuples():
            try:
                info = os.lstat(path_bytes(root.path))
            except OSError as problem:
                rows.append(_failed(root.path, root.tag, root.root_no, "root", problem))
                continue
            if stat.S_ISDIR(info.st_mode):
                seen = (root.path, info.st_size, info.st_mtime_ns // 1000, root.tag, root.root_no, None, None)
                rows += [("folder", *seen), ("todo", *seen)]
            else:
                rows.append(_failed(root.path, root.tag, root.root_no, "root", "not a directory"))
        yield pd.DataFrame(rows, columns=ENTRY.names, dtype=object)


def _lister(exclude: frozenset[bytes], budget: int):
    """List frontier directories depth-first; past ``budget`` entries the rest goes back.

    What a task holds is bounded by the budget, also for directories of any size. Directories are
    opened by their bytes; only what leaves the task is text.
    """

    def entries(first: str, tag: str, root_no: int) -> Iterator[tuple]:
        pending, seen = [path_bytes(first)], 0
        while pending:
            folder = pending.pop()
            if seen >= budget:
                yield ("todo", path_text(folder), None, None, tag, root_no, None, None)
                continue
            try:
                with os.scandir(folder) as listing:
                    for item in listing:
                        seen += 1
                        try:
                            info = item.stat(follow_symlinks=False)
                        except OSError as problem:
                            yield _failed(path_text(item.path), tag, root_no, "stat", problem)
                            continue
                        if stat.S_ISDIR(info.st_mode) and item.name in exclude:
                            continue
                        shown = (path_text(item.path), info.st_size, info.st_mtime_ns // 1000, tag, root_no, None, None)
                        if stat.S_ISDIR(info.st_mode):
                            yield ("folder", *shown)
                            if seen < budget:
                                pending.append(item.path)
                            else:
                                yield ("todo", *shown)
                        elif stat.S_ISREG(info.st_mode):
                            yield ("file", *shown)
            except OSError as problem:
                yield _failed(path_text(folder), tag, root_no, "list", problem)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for start in batch.itertuples():
                for row in entries(start.path, start.tag, start.root_no):
                    rows.append(row)
                    if len(rows) >= _OUT_ROWS:
                        yield pd.DataFrame(rows, columns=ENTRY.names, dtype=object)
                        rows = []
        yield pd.DataFrame(rows, columns=ENTRY.names, dtype=object)

    return run


def _root_text(path: str) -> str:
    """Text of a root as the caller names it."""
    return path_text(os.fsencode(os.path.abspath(path)))


def crawl_entries(
    spark: SparkSession,
    roots: list[tuple[str, str]],
    exclude: list[str] = DEFAULT_EXCLUDED,
    budget: int = 20_000,
    tasks: int | None = None,
) -> DataFrame:
    """All folder, file and error rows below the roots.

    Each round lists the current frontier in parallel and is written to the shared
    folder before the next starts, so a lost executor repeats one round at most. Each kind of row
    has a folder of its own, so that whoever wants one kind reads only that.
    """
    out = work_path(spark, "crawl")
    width = tasks or max(spark.sparkContext.defaultParallelism * 4, 32)
    seeds = spark.createDataFrame(
        [(_root_text(path), tag, n) for n, (path, tag) in enumerate(roots)], FRONTIER
    )
    found = seeds.mapInPandas(_roots, ENTRY)
    lister = _lister(frozenset(map(os.fsencode, exclude)), budget)
    rounds = 0
    while True:
        here = f"{out}/round={rounds}"
        found.write.partitionBy("kind").parquet(here)
        frontier = spark.read.schema(ENTRY).parquet(here).filter("kind = 'todo'").select(*FRONTIER.names)
        if frontier.isEmpty():
            break
        found = frontier.repartition(width, "path").mapInPandas(lister, ENTRY)
        rounds += 1
    every = spark.read.schema(ENTRY).option("basePath", out).parquet(*[f"{out}/round={n}" for n in range(rounds + 1)])
    return every.filter("kind != 'todo'").select(*ENTRY.names)


def _overlap(roots: list[tuple[str, str]]) -> bool:
    paths = sorted(_root_text(path).rstrip("/") + "/" for path, _ in roots)
    return any(b.startswith(a) for a, b in zip(paths, paths[1:]))


def once_per_path(entries: DataFrame) -> DataFrame:
    """Entries met through several roots keep the first root's tag and the last stat."""
    return entries.groupBy("path", "kind").agg(
        F.max_by("size", "root_no").alias("size"),
        F.max_by("mtime_us", "root_no").alias("mtime_us"),
        F.min_by("tag", "root_no").alias("tag"),
    )


def entry_errors(entries: DataFrame) -> DataFrame:
    """What could not be read: path, tag, stage and message, once for each path and stage."""
    return entries.filter("kind = 'error'").groupBy("path", "stage").agg(
        F.min_by("tag", "root_no").alias("tag"), F.min_by("error", "root_no").alias("message")
    ).select("path", "tag", "stage", "message")


def crawl(
    spark: SparkSession,
    roots: list[tuple[str, str]],
    exclude: list[str] = DEFAULT_EXCLUDED,
    budget: int = 20_000,
    tasks: int | None = None,
) -> Crawl:
    """Files, folders and errors of all ``(root, tag)`` pairs as inventory frames.

    A root that is no directory, a directory that cannot be listed and an entry that is gone when it is
    looked at give no file or folder rows but an error row.
    """
    every = crawl_entries(spark, roots, exclude, budget, tasks)
    entries = every.filter("kind != 'error'")
    if _overlap(roots):
        entries = written(once_per_path(entries), "entries")
    tops = [_root_text(path) for path, _ in roots]
    mtime = F.timestamp_micros("mtime_us").alias("mtime")
    files = describe(regular_files(entries).select("path", "size", mtime, "tag")).select(
        path_id(F.col("path")).alias("id"),
        path_id(F.col("dir_path")).alias("folder_id"),
        "path", "dir_path", "filename", "file_ext", "size", "mtime",
        F.lit(None).cast("string").alias("hash_value"),
        F.lit(False).alias("is_duplicate"),
        "tag", "top_folder",
    )
    top = _without_parent(tops)
    folders = entries.filter("kind = 'folder'").select(
        path_id(F.col("path")).alias("id"),
        F.when(~F.col("path").isin(top), path_id(parent_dir(F.col("path")))).alias("parent_id"),
        "path",
        F.when(F.col("path") == "/", "/").otherwise(F.substring_index("path", "/", -1)).alias("name"),
        mtime,
        "tag",
        *[F.lit(0).cast("long").alias(c) for c in ("size", "number_files", "subtree_size", "subtree_files")],
    )
    return Crawl(files, folders, entry_errors(every))


def _without_parent(tops: list[str]) -> list[str]:
    """Roots that no other root contains; an inner root has its real parent."""
    return [t for t in tops if not any(t != o and t.startswith(o.rstrip("/") + "/") for o in tops)]
