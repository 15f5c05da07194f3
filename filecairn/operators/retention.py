"""Scoped deletion: selection, dry run, export, removal of rows and files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from filecairn.functions.paths import path_bytes, scope_prefix
from filecairn.plans.cut import exists, work_path
from filecairn.plans.ordering import first_rows

# Field separators of the list formats.
LIST_SEPARATORS = {"csv": ",", "tsv": "\t"}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERING = str.maketrans(_UPPER, _UPPER.lower())
_UPPERING = str.maketrans(_UPPER.lower(), _UPPER)

FILES_PER_TASK = 20_000

INTENT = StructType([
    StructField("id", LongType(), False),
    StructField("path", StringType(), False),
    StructField("present", BooleanType(), False),
])
OUTCOME = StructType([
    StructField("id", LongType(), False),
    StructField("path", StringType(), False),
    StructField("outcome", StringType(), False),
    StructField("message", StringType()),
])


def like_bounds(path: Column, pattern: str) -> Column:
    """Bounds that every match of a pattern lies in: its literal part up to the first wildcard, in either case.

    Upper-case letters come before lower-case ones, so the literal in upper case is the least match and what
    follows its lower-case form the first text beyond all of them.
    """
    literal = re.split("[_%]", pattern, maxsplit=1)[0]
    least, most = literal.translate(_UPPERING), literal.translate(_LOWERING)
    # The last character that has a successor; one before the surrogates is followed by the one after them.
    most = most.rstrip(chr(0x10FFFF))
    if not most:
        return path >= least
    following = ord(most[-1]) + 1
    return (path >= least) & (path < most[:-1] + chr(0xE000 if following == 0xD800 else following))


def in_scope(scope: str, match: str = "literal") -> Column:
    """The scope itself and everything below it.

    ``like`` treats ``_`` and ``%`` in the scope as wildcards and ignores ASCII case
    below it, as the SQL pattern of older tools did; the default takes it literally.
    """
    path = F.col("path")
    prefix = scope_prefix(scope)
    if match == "literal":
        return (path == scope) | F.startswith(path, F.lit(prefix))
    if match == "like":
        lowered = F.translate(path, _UPPER, _UPPER.lower())
        pattern = (prefix + "%").replace("\\", "\\\\").translate(_LOWERING)
        # The bounds hold the scope and what lies below it; they reach the scan, the pattern cannot.
        return like_bounds(path, scope) & ((path == scope) | lowered.like(pattern))
    raise ValueError("match is 'literal' or 'like'")


def deletion_filter(
    scope: str, size_zero: bool = False, extensions: list[str] | None = None, match: str = "literal"
) -> Column:
    """Scope and all given filters; extensions are normalised, compared in lower case."""
    wanted = in_scope(scope, match)
    if size_zero:
        wanted = wanted & (F.col("size") == 0)
    if extensions:
        wanted = wanted & F.lower("file_ext").isin(extensions)
    return wanted


def scope_counts(files: DataFrame, folders: DataFrame, scope: str, match: str = "literal") -> DataFrame:
    """Dry run by path: folders and files that would go."""
    hit = in_scope(scope, match)
    return deletion_list(files.filter(hit), folders.filter(hit)).agg(
        F.count_if(F.col("type") == "folder").alias("folders"),
        F.count_if(F.col("type") == "file").alias("files"),
    )


def remaining_after_scope(
    files: DataFrame, folders: DataFrame, scope: str, match: str = "literal"
) -> tuple[DataFrame, DataFrame]:
    """Files and folders outside the scope."""
    keep = ~in_scope(scope, match)
    return files.filter(keep), folders.filter(keep)


def remaining_after_filter(files: DataFrame, condition: Column) -> DataFrame:
    """Files that do not pass the filters: no join where the whole selection goes."""
    return files.filter(~F.coalesce(condition, F.lit(False)))


def select_for_deletion(files: DataFrame, condition: Column, limit: int = 0) -> DataFrame:
    """Ids and paths to delete, in id order up to a limit (0 means no limit)."""
    chosen = files.filter(condition).select("id", "path")
    return first_rows(chosen, [("id", False), ("path", False)], limit) if limit > 0 else chosen


def without(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Files that are not in a limited or purged selection, by path."""
    return files.join(selection.select("path"), "path", "left_anti")


def deletion_list(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Typed rows of the export; folders come first when given."""
    rows = files.select(F.lit("file").alias("type"), "id", "path")
    if folders is None:
        return rows
    return folders.select(F.lit("folder").alias("type"), "id", "path").unionByName(rows)


def write_deletion_list(rows: DataFrame, path: str, list_format: str = "csv") -> bool:
    """Write the export in type and id order; a blank path writes nothing."""
    if not path.strip():
        return False
    name = list_format.strip().lower() or "csv"
    if name not in LIST_SEPARATORS:
        raise ValueError(f"unsupported list format {list_format!r} (use csv or tsv)")
    (
        rows.orderBy(F.desc("type"), "id", "path")
        .select("type", "id", "path")
        .write.mode("errorifexists")
        .options(
            header=True,
            sep=LIST_SEPARATORS[name],
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )
    return True


def _present(path: str) -> bool:
    return os.path.lexists(os.path.normpath(path_bytes(path)))


def _intend_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({
            "id": batch["id"], "path": batch["path"], "present": [_present(path) for path in batch["path"]],
        })


def _remove(path: str, present: bool) -> tuple[str, str | None]:
    """Remove a file. One that was there when the purge began and is gone was removed by an attempt of this purge."""
    try:
        os.remove(os.path.normpath(path_bytes(path)))
    except FileNotFoundError:
        return ("deleted", "by an earlier attempt") if present else ("missing", None)
    except OSError as problem:
        return "error", str(problem)
    return "deleted", None


def _purge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [_remove(*row) for row in zip(batch["path"], batch["present"])]
        yield pd.DataFrame({
            "id": batch["id"],
            "path": batch["path"],
            "outcome": [outcome for outcome, _ in done],
            "message": pd.Series([message for _, message in done], dtype=object),
        })


def _spread(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows over as many tasks as their number asks for."""
    if tasks is None:
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILES_PER_TASK))
    return rows.repartition(tasks, "path")


def purge_intent(selection: DataFrame, journal: str, tasks: int | None = None) -> DataFrame:
    """The files a purge is about to remove and whether each is there, written before any is touched.

    A journal that has its intent already is an unfinished purge: its files are taken up, whatever
    the selection is now.
    """
    spark = selection.sparkSession
    path = f"{journal.rstrip('/')}/intent"
    if not exists(spark, f"{path}/_SUCCESS"):
        rows = _spread(selection.select("id", "path"), tasks)
        rows.mapInPandas(_intend_batches, INTENT).write.mode("overwrite").parquet(path)
    return spark.read.schema(INTENT).parquet(path)


def purge_files(
    selection: DataFrame, dry_run: bool = True, tasks: int | None = None, journal: str | None = None
) -> DataFrame:
    """Remove the selected files from the shared mount and report each outcome.

    The intent is written first, then files are removed, and the outcomes are written once and read
    back. A lost executor or a failed job repeats removals, but as the intent tells which files were
    there, the outcomes are exact: such a file is ``deleted`` whichever attempt removed it,
    ``missing`` is only what was gone before. With the same ``journal`` a later call goes
    on with an unfinished purge, and gives the outcomes of a finished one without touching anything.
    """
    spark = selection.sparkSession
    if dry_run:
        return selection.select(
            "id", "path", F.lit("would_delete").alias("outcome"), F.lit(None).cast("string").alias("message")
        )
    journal = (journal or work_path(spark, "purge")).rstrip("/")
    intent, path = purge_intent(selection, journal, tasks), f"{journal}/outcomes"
    if not exists(spark, f"{path}/_SUCCESS"):
        _spread(intent, tasks).mapInPandas(_purge_batches, OUTCOME).write.mode("overwrite").parquet(path)
    return spark.read.schema(OUTCOME).parquet(path)


def purged(outcomes: DataFrame) -> DataFrame:
    """Selection whose rows may leave the inventory."""
    return outcomes.filter(F.col("outcome").isin("deleted", "missing"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Rows leaving the inventory, files removed from disk, and errors."""
    outcome = F.col("outcome")
    return outcomes.agg(
        F.count_if(outcome != "error").alias("db_deleted"),
        F.count_if(outcome == "deleted").alias("disk_deleted"),
        F.count_if(outcome == "error").alias("errors"),
    )
