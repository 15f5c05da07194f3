"""The jobs a user runs: scan, rebuild, two reports, delete.

Each reads one snapshot and writes another, so a job that fails leaves its input as it was.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filecairn.functions.paths import clean_scope, normalize_extensions
from filecairn.operators.candidates import candidate_files, hash_figures, scan_errors, write_back
from filecairn.operators.duplicates import (
    duplicate_groups,
    groups_by_hash_and_size,
    mark_duplicates,
    mark_members,
    members_of_groups,
    nested_members,
    ordered_members,
    reset_flags,
    upsert_groups_rebuild,
    upsert_groups_scan,
)
from filecairn.operators.folders import with_rollups
from filecairn.operators.renderers import (
    basic_console,
    basic_duplicate_sheet,
    basic_html,
    basic_top_sheet,
    json_groups,
    json_head,
    json_top_files,
    numbered_groups,
    summary_console,
    summary_duplicate_sheet,
    summary_html,
    summary_sheet,
    summary_top_sheet,
    write_lines,
)
from filecairn.operators.reports import MIN_DUPLICATE_SIZE, TOP_N, largest_files, summary
from filecairn.operators.retention import (
    deletion_filter,
    deletion_list,
    in_scope,
    outcome_counts,
    purge_files,
    purge_intent,
    purged,
    remaining_after_filter,
    remaining_after_scope,
    scope_counts,
    select_for_deletion,
    without,
    write_deletion_list,
)
from filecairn.operators.upserts import upsert_files, upsert_folders, without_stale_hashes
from filecairn.plans.cut import exists, written
from filecairn.schemas import conform
from filecairn.sources.content import hash_mounted
from filecairn.sources.snapshots import (
    MARK,
    discard_unfinished,
    read_snapshot,
    snapshot_buckets,
    snapshot_path,
    write_snapshot,
    written_bucketed,
)
from filecairn.sources.tables import DEFAULT_EXCLUDED
from filecairn.sources.tree import crawl
from filecairn.streaming.rebuild import RANGE_DIGITS, rebuild_groups


BASIC_FORMATS = ("console", "html", "sheet")
SUMMARY_FORMATS = ("console", "html", "json", "sheet")


def _known_format(name: str, known: tuple[str, ...]) -> None:
    if name not in known:
        raise ValueError(f"unsupported report format {name!r} (use {', '.join(known)})")


def _stamp(at: datetime | None):
    moment = at or datetime.now(timezone.utc)
    return moment, F.lit(moment).cast("timestamp")


def scan(
    spark: SparkSession,
    roots: list[tuple[str, str]],
    output_dir: str,
    exclude: list[str] = DEFAULT_EXCLUDED,
    previous: str | None = None,
    include_hashed: bool | None = None,
    at: datetime | None = None,
    cluster_by: str | None = "path",
    buckets: int | None = None,
) -> tuple[str, DataFrame]:
    """Take a snapshot of the roots, hash candidates, mark duplicates.

    Returns the snapshot path and one row of metrics (see ``scan_metrics``). What could not be read
    is the table ``scan_errors`` of the snapshot. With ``previous`` the scan is
    merged into that snapshot: files hashed earlier count as size partners, changed
    files are hashed again, and files no longer found stay until deleted. The
    file table is range-sorted by ``cluster_by``: by path, scopes read only their part. With ``buckets`` (by
    default as many as the previous snapshot has; at least the session's shuffle partitions, or Spark will not use them)
    it is bucketed by path instead: a later scan then shuffles its new listing, its hashes and the
    members of groups, but not the inventory.
    """
    if not roots:
        raise ValueError("no roots to scan")
    moment, now = _stamp(at)
    path = snapshot_path(output_dir, moment)
    begun = time.perf_counter()
    files, folders, errors = crawl(spark, roots, exclude)
    crawled = time.perf_counter()
    old = read_snapshot(spark, previous) if previous else None
    known_buckets = snapshot_buckets(spark, previous) if previous else 0
    buckets = known_buckets if buckets is None else buckets
    aligned = buckets > 0 and buckets == known_buckets

    def kept(df: DataFrame, name: str, stays: bool) -> DataFrame:
        return written_bucketed(df, name, buckets, stays) if buckets else written(df, name)

    if old:
        known = without_stale_hashes(old["files"], files)
        files = kept(conform(reset_flags(upsert_files(known, files)), "files"), "listed", aligned)
    elif buckets:
        files = kept(conform(files, "files"), "listed", False)
    if old:
        folders = upsert_folders(old["folders"], folders)
    if include_hashed is None:
        include_hashed = old is not None
    wanted = Observation("candidates")
    candidates = candidate_files(files, include_hashed).select("id", "path", "size", "tag")
    candidates = written(candidates.observe(wanted, F.count(F.lit(1)).alias("candidates")), "candidates")
    hashing = time.perf_counter()
    hashed = Observation("hashes")
    hashes = written(hash_mounted(candidates).observe(hashed, *hash_figures()), "hashes")
    done = time.perf_counter()
    # Counted as the table is written, as the hashes are: no figure takes a pass of its own.
    listed = Observation("files")
    tags = list(dict.fromkeys(tag for _, tag in roots))
    complete = kept(write_back(files, hashes).observe(listed, *_tag_totals(tags)), "hashed", buckets > 0)
    metrics = scan_metrics(
        spark, wanted.get, hashed.get, listed.get, tags, crawled - begun, done - hashing
    )
    groups = written(duplicate_groups(complete, now=now), "groups")
    tables = {
        "files": mark_members(complete, groups) if buckets else mark_duplicates(complete, groups, complete=True),
        "folders": with_rollups(folders, complete),
        "duplicate_groups": groups.withColumn("last_updated", now),
        "scan_errors": scan_errors(errors, hashes),
    }
    if old:
        tables["duplicate_groups"] = _refreshed(old["duplicate_groups"], groups, now)
        tables["duplicate_runs"] = old["duplicate_runs"]
    return write_snapshot(spark, tables, path, {"files": cluster_by}, buckets), metrics


def _tag_totals(tags: list[str]) -> list[Column]:
    """Files and bytes of each root tag, as aggregates: the tags are few and known."""
    return [
        total
        for n, tag in enumerate(tags)
        for total in (
            F.count_if(F.col("tag") == tag).alias(f"files{n}"),
            F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("size"))), F.lit(0)).alias(f"bytes{n}"),
        )
    ]


METRICS = (
    "candidates long, processed long, success long, errors long, bytes long, success_percent double, "
    "seconds double, files_per_second double, megabytes_per_second double, remaining long, eta_seconds double, "
    "crawl_seconds double, roots array<struct<tag: string, files: long, bytes: long, files_per_second: double>>"
)


def scan_metrics(
    spark: SparkSession,
    wanted: dict,
    hashed: dict,
    listed: dict,
    tags: list[str],
    crawl_seconds: float,
    seconds: float,
) -> DataFrame:
    """One row: the hash stage's figures, rate and time left, and the totals of each root tag.

    The figures were observed while the tables were written; an empty table is observed as nothing. Tasks that Spark
    repeats after losing an executor may be observed twice; the tables and ``scan_errors`` are exact.
    ``remaining`` candidates have no result; ``eta_seconds`` is what they would take at this rate, NULL before the first.
    """
    processed, total = hashed.get("processed", 0), wanted.get("candidates", 0)
    success = hashed.get("success", 0)
    rate = processed / seconds if seconds > 0 else 0.0
    left = total - processed
    roots = [
        (tag, files, listed.get(f"bytes{n}", 0), files / crawl_seconds if crawl_seconds > 0 else 0.0)
        for n, tag in enumerate(tags)
        for files in [listed.get(f"files{n}", 0)]
    ]
    row = (
        total, processed, success, hashed.get("errors", 0), hashed.get("bytes", 0),
        round(100.0 * success / processed, 2) if processed else 0.0,
        seconds, rate, hashed.get("bytes", 0) / 1024 / 1024 / seconds if seconds > 0 else 0.0,
        left, left / rate if rate else None, crawl_seconds, roots,
    )
    return spark.createDataFrame([row], METRICS)


def _refreshed(old: DataFrame, groups: DataFrame, now: Column) -> DataFrame:
    """Current groups; those known before keep their first_seen."""
    known = old.join(groups.select("hash_value"), "hash_value", "left_semi")
    return upsert_groups_scan(known, groups, now)


def rebuild(
    spark: SparkSession,
    snapshot: str,
    output: str,
    work: str,
    run_id: int | None = None,
    reset: bool = True,
    from_hash: str = "",
    digits: int = RANGE_DIGITS,
    at: datetime | None = None,
) -> str:
    """Rebuild groups and flags from stored hashes into a new snapshot.

    ``work`` keeps the finished hash ranges and the run ledger for a restart. Every run has an id
    of its own unless ``run_id`` names the one to go on with, which must be of the same input.
    """
    if reset and from_hash:
        raise ValueError("a rebuild from a given hash must keep the earlier groups: use reset=False")
    _, now = _stamp(at)
    tables = read_snapshot(spark, snapshot)
    if run_id is None:
        run_id = (tables["duplicate_runs"].agg(F.max("id")).first()[0] or 0) + 1
        while exists(spark, f"{work.rstrip('/')}/run={run_id}"):
            run_id += 1
    note = f"snapshot={snapshot} reset={reset} from_hash={from_hash!r}"
    groups, run = rebuild_groups(tables["file_hashes"], work, run_id, from_hash, digits, now, note)
    files = reset_flags(tables["files"]) if reset else tables["files"]
    tables["files"] = mark_duplicates(files, groups, complete=not from_hash)
    tables["duplicate_groups"] = (
        groups.withColumn("last_updated", now)
        if reset
        else upsert_groups_rebuild(tables["duplicate_groups"], groups, now)
    )
    tables["duplicate_runs"] = tables["duplicate_runs"].filter(F.col("id") != run_id).unionByName(
        run.select(*tables["duplicate_runs"].columns)
    )
    return write_snapshot(spark, tables, output)


def report_basic(
    spark: SparkSession,
    snapshot: str,
    output: str | None = None,
    report_format: str = "console",
    top_n: int = TOP_N,
    at: datetime | None = None,
) -> str:
    """Largest files and duplicate groups by hash, as console, html or sheet files.

    Returns the output path, by default the snapshot's name with ``_report``.
    """
    _known_format(report_format, BASIC_FORMATS)
    output = output or f"{snapshot.rstrip('/')}_report"
    tables = read_snapshot(spark, snapshot)
    files = tables["files"]
    top = largest_files(files, top_n)
    groups = duplicate_groups(tables["file_hashes"]).select("hash_value", "file_count")
    members = members_of_groups(files, groups, complete=True)
    if report_format == "console":
        write_lines(basic_console(top, groups, members), output)
    elif report_format == "html":
        write_lines(basic_html(top, groups, members, top_n, _stamp(at)[1]), output)
    else:
        _sheet(basic_top_sheet(top).orderBy("Rank"), f"{output}/Top Largest Files")
        _sheet(basic_duplicate_sheet(ordered_members(members)), f"{output}/Duplicate Files")
    return output


def report_summary(
    spark: SparkSession,
    snapshot: str,
    output: str,
    report_format: str = "sheet",
    top_n: int = TOP_N,
    min_size: int = MIN_DUPLICATE_SIZE,
    at: datetime | None = None,
) -> None:
    """Summary, largest non-empty files and groups by hash and size from ``min_size`` up."""
    if not output.strip():
        raise ValueError("an output path is required")
    _known_format(report_format, SUMMARY_FORMATS)
    tables = read_snapshot(spark, snapshot)
    files = tables["files"]
    _, now = _stamp(at)
    top = largest_files(files, top_n, nonempty=True)
    figures = summary(files)
    groups = groups_by_hash_and_size(tables["file_hashes"], min_size)
    large_files = files.filter(F.col("size") >= min_size)
    if report_format in ("console", "html"):
        numbered = numbered_groups(groups)
        placed = members_of_groups(large_files, numbered, complete=True)
        if report_format == "console":
            write_lines(summary_console(figures, top, numbered, placed, now), output)
        else:
            write_lines(summary_html(figures, top, numbered, placed, now), output)
    elif report_format == "json":
        # One layout at every size: the head, and a folder each for the files and the groups.
        for name, documents in json_report(figures, top, nested_members(large_files, groups), now).items():
            documents.write.json(f"{output}/{name}")
    else:
        _sheet(summary_sheet(figures, now).orderBy("position").drop("position"), f"{output}/Summary")
        _sheet(summary_top_sheet(top).orderBy(F.desc("Size"), "Path"), f"{output}/Top_Largest_Files")
        duplicates = summary_duplicate_sheet(nested_members(large_files, groups))
        _sheet(duplicates.orderBy(F.desc("Size"), "Hash", "Page"), f"{output}/Duplicate_Files")


def json_report(figures: DataFrame, top: DataFrame, nested: DataFrame, generated_at: Column) -> dict[str, DataFrame]:
    """The documents of a JSON report by folder: the head with the largest files, these one by one, and the groups in order."""
    return {
        "report": json_head(figures, top, generated_at),
        "top_files": json_top_files(top),
        "duplicates": json_groups(nested).orderBy(F.desc("size"), "hash", "page"),
    }


def _sheet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def delete(
    spark: SparkSession,
    snapshot: str,
    output: str,
    scope: str,
    dry_run: bool = False,
    size_zero: bool = False,
    extensions: str = "",
    limit: int = 0,
    list_out: str = "",
    list_format: str = "csv",
    delete_disk: bool = False,
    match: str = "literal",
    at: datetime | None = None,
) -> DataFrame:
    """Remove a scope, or the files in it that pass the filters, into a new snapshot.

    Without filters files and folders go and nothing is removed from disk; with a
    filter only files go, up to ``limit``, and ``delete_disk`` removes them from the
    mount as well. Returns the counts; a dry run writes no snapshot.

    A removal from disk keeps a journal beside the output, ``<output>_purge``: what is to be removed,
    written first, and what became of it, which is also the table ``purge_log`` of the new snapshot. If the
    job fails on the way, the same call takes the journal up: it removes what is left and writes the snapshot
    with an exact account. A journal of another call is refused.
    """
    scope = clean_scope(scope)
    exts = normalize_extensions(extensions)
    journal = f"{output.rstrip('/')}_purge"
    purging = delete_disk and not dry_run and bool(size_zero or exts)
    unfinished = not dry_run and exists(spark, output)
    if unfinished and (not purging or not exists(spark, journal) or exists(spark, f"{output}/{MARK}/_SUCCESS")):
        raise FileExistsError(f"nothing was removed: {output} exists already")
    resumed = purging and _same_purge(
        spark, journal, f"snapshot={snapshot} scope={scope!r} size_zero={size_zero} extensions={exts} limit={limit} match={match}"
    )
    if unfinished:
        discard_unfinished(spark, output)
    tables = read_snapshot(spark, snapshot)
    files, folders = tables["files"], tables["folders"]
    if not (size_zero or exts):
        hit = in_scope(scope, match)
        write_deletion_list(deletion_list(files.filter(hit), folders.filter(hit)), list_out, list_format)
        counts = scope_counts(files, folders, scope, match)
        if not dry_run:
            tables["files"], tables["folders"] = remaining_after_scope(files, folders, scope, match)
            tables["scan_errors"] = tables["scan_errors"].filter(~hit)
            _write_remaining(spark, tables, output, at)
        return counts
    condition = deletion_filter(scope, size_zero, exts, match)
    selection = select_for_deletion(files, condition, limit)
    if purging:
        selection = purge_intent(selection, journal).select("id", "path")
    elif limit:
        selection = written(selection, "selection")
    if not (resumed and list_out.strip() and exists(spark, f"{list_out}/_SUCCESS")):
        write_deletion_list(deletion_list(selection), list_out, list_format)
    outcomes = purge_files(selection, dry_run=not purging, journal=journal)
    counts = outcome_counts(outcomes)
    if not dry_run:
        if delete_disk:
            tables["files"] = written(without(files, purged(outcomes)), "kept")
            _, now = _stamp(at)
            tables["purge_log"] = tables["purge_log"].unionByName(outcomes.withColumn("purged_at", now))
        elif limit:
            tables["files"] = written(without(files, selection), "kept")
        else:
            tables["files"] = remaining_after_filter(files, condition)
        _write_remaining(spark, tables, output, at)
    return counts


def _same_purge(spark: SparkSession, journal: str, call: str) -> bool:
    """Whether a journal of this very call is there; a new one is begun, that of another call is refused."""
    where = f"{journal}/call"
    if not exists(spark, f"{where}/_SUCCESS"):
        spark.createDataFrame([(call,)], "call string").write.mode("overwrite").parquet(where)
        return False
    found = spark.read.schema("call string").parquet(where).first()[0]
    if found != call:
        raise ValueError(f"{journal} is of another deletion ({found}, now {call})")
    return True


def _write_remaining(spark: SparkSession, tables: dict[str, DataFrame], output: str, at: datetime | None) -> None:
    """Snapshot after a deletion: flags, groups and rollups follow the remaining files."""
    _, now = _stamp(at)
    kept = reset_flags(tables["files"])
    groups = written(duplicate_groups(kept, now=now), "groups")
    tables["files"] = mark_duplicates(kept, groups, complete=True)
    tables["folders"] = with_rollups(tables["folders"], kept)
    tables["duplicate_groups"] = _refreshed(tables["duplicate_groups"], groups, now)
    write_snapshot(spark, tables, output)
