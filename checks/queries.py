"""One query per operator, all over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.inventory import (
    NOW,
    ROOTS,
    content_files,
    folder_table,
    hashed_inventory,
    plain_files,
    second_scan,
    table,
    with_folder_id,
)
from filecairn import jobs
from filecairn.functions import paths, text, times
from filecairn.operators import candidates as cand
from filecairn.operators import duplicates as dup
from filecairn.operators import folders as fold
from filecairn.operators import renderers as out
from filecairn.operators import reports as rep
from filecairn.operators import retention as ret
from filecairn.operators import upserts as ups
from filecairn.plans import balance
from filecairn.plans.cut import work_path, written
from filecairn.schemas import ROLLUPS, upgrade_folders
from filecairn.sources import content, snapshots, tables, tree
from filecairn.streaming import rebuild

SCOPE = "/share/corpus/documents/src1"
WILD_SCOPE = "/SHARE/corpus/doc_ments"
FROM_HASH = "8"
TOP = rep.TOP_N
now = lambda: F.expr(NOW)


# Sources


def inventory_files(spark: SparkSession, sf: str) -> DataFrame:
    return plain_files(spark, sf).drop("hash_value", "is_duplicate")


def files_by_tag(spark, sf):
    return tables.totals_by_tag(plain_files(spark, sf))


def snapshot_roundtrip(spark, sf):
    files = with_folder_id(plain_files(spark, sf))
    path = work_path(spark, "snapshot")
    snapshots.write_snapshot(spark, {"files": files}, path)
    back = snapshots.read_snapshot(spark, path)["files"]
    return back.select(
        "id", "path", "dir_path", "filename", "file_ext", "size",
        text.time_text(F.col("mtime")).alias("mtime"), "is_duplicate", "tag", "top_folder",
    )


def root_specs(spark, sf):
    files = plain_files(spark, sf)
    tagged = files.select(F.concat(F.col("dir_path"), F.lit(" : "), F.col("tag")).alias("spec"))
    bare = files.select(F.col("dir_path").alias("spec"))
    specs = tagged.unionByName(bare).distinct()
    return specs.select(
        "spec", paths.root_path(F.col("spec")).alias("root"), paths.root_tag(F.col("spec")).alias("tag")
    )


def exclude_dirs(spark, sf):
    kept = tables.exclude_directories(plain_files(spark, sf), ["fr", "src1", "documents"], [r for r, _ in ROOTS])
    return kept.select("id", "path")


def schema_upgrade_defaults(spark, sf):
    """Folders of an older table: two rollups are absent, and of one that is there some are NULL."""
    rolled = fold.with_rollups(folder_table(spark, sf), plain_files(spark, sf))
    old = rolled.drop("subtree_size", "subtree_files").withColumn("size", F.when(F.length("path") % 2 == 0, F.col("size")))
    return upgrade_folders(old).select("path", "name", "tag", *ROLLUPS)


def colliding_ids(spark, sf):
    """Ids cut to 16 bits of the path hash, so that some collide."""
    files = plain_files(spark, sf)
    short = F.conv(F.substring(F.md5("path"), 1, 4), 16, 10).cast("long")
    return tables.colliding_ids(files.select(short.alias("id"), "path"))


def lookup_by_ids(spark, sf):
    ids = table(spark, sf, "labels").select((F.col("doc_id") + 1000000000).alias("id"))
    return tables.lookup_ids(plain_files(spark, sf), ids).select("id", "path")


# Accepted and refused spellings of one time.
TIME_FORMS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'",
    "yyyy-MM-dd'T'HH:mm:ss'+07:00'",
    "yyyy-MM-dd HH:mm:ss.S'-03:30'",
    "yyyy-MM-dd HH:mm:ss'Z'",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "' 'yyyy-MM-dd HH:mm:ss' '",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "' '",
    "'bad'",
]


def parse_times(spark, sf):
    spelled = F.array(*[F.date_format("mtime", form) for form in TIME_FORMS])
    rows = plain_files(spark, sf).select("id", F.posexplode(spelled).alias("form", "value"))
    parsed = times.parse_time(F.col("value"))
    return rows.select(
        "id", "form", "value", F.unix_micros(parsed).alias("micros"),
        F.unix_micros(times.first_seen_or(parsed, F.expr("timestamp'2024-06-01 12:00:00Z'"))).alias("first_seen"),
    )


# Candidates and hashes


def candidate_sizes(spark, sf):
    return cand.candidate_sizes(plain_files(spark, sf))


def candidate_files(spark, sf):
    return cand.candidate_files(plain_files(spark, sf)).select("id", "path", "size")


def candidate_files_salted(spark, sf):
    """Same rows with every shared size treated as hot."""
    return cand.candidate_files(plain_files(spark, sf), rows_per_salt=1).select("id", "path", "size")


def candidate_count(spark, sf):
    return cand.candidate_count(plain_files(spark, sf))


def candidates_incremental(spark, sf):
    """New files against an inventory hashed earlier, hashed files counting as partners."""
    merged = ups.upsert_files(
        with_folder_id(hashed_inventory(spark, sf)), with_folder_id(second_scan(spark, sf))
    )
    return cand.candidate_files(merged, include_hashed=True).select("path", "size")


def hashed_files(spark, sf):
    return cand.hash_candidates(content_files(spark, sf))


def hashed_files_listed(spark, sf):
    """With a listing at hand: only candidates are hashed."""
    return cand.hash_candidates(content_files(spark, sf), plain_files(spark, sf))


def hashed_files_unbounded(spark, sf):
    """The way taken when the candidate sizes are too many to broadcast."""
    return cand.hash_candidates(content_files(spark, sf), plain_files(spark, sf), max_sizes=0)


def hash_write_back(spark, sf):
    found = cand.hash_candidates(content_files(spark, sf))
    return cand.write_back(plain_files(spark, sf), found).select("id", "path", "size", "hash_value")


def _mixed_hashes(spark, sf):
    """Hashes of which some failed and some files were empty when they were read."""
    found = cand.hash_candidates(content_files(spark, sf))
    failed, gone = F.col("id") % 7 == 0, F.col("id") % 11 == 0
    return found.select(
        "id", "path", "size", F.split("path", "/")[3].alias("tag"),
        F.when(~failed & ~gone, F.col("hash_value")).alias("hash_value"),
        F.when(failed, F.concat(F.lit("cannot read "), F.col("id") % 3)).alias("hash_error"),
    )


def hash_outcomes(spark, sf):
    return cand.hash_metrics(_mixed_hashes(spark, sf))


def _failing_entries(spark, sf):
    """A crawl in which some files vanished and some directories could not be listed, met through two roots."""
    files = plain_files(spark, sf)
    stage = F.when(F.col("id") % 13 == 0, "stat").when(F.col("id") % 13 == 1, "list")
    entries = files.select(
        F.when(stage.isNotNull(), "error").otherwise("file").alias("kind"), "path",
        F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))).alias("root_no"),
        "tag", stage.alias("stage"),
    )
    return entries.withColumn("tag", F.concat("tag", F.lit("-"), "root_no")).withColumn(
        "error", F.when(F.col("kind") == "error", F.concat(F.lit("gone through root "), "root_no"))
    )


def _scan_errors(spark, sf):
    return cand.scan_errors(tree.entry_errors(_failing_entries(spark, sf)), _mixed_hashes(spark, sf))


def scan_errors(spark, sf):
    """What a scan could not list, look at or read: one row per path and stage."""
    return _scan_errors(spark, sf)


def scan_error_counts(spark, sf):
    return cand.error_counts(_scan_errors(spark, sf))


BIN_BYTES = 512 * 1024


def hash_bin_loads(spark, sf):
    """Files and bytes of each hash task; what opening a file costs counts as bytes."""
    binned, _ = content.hash_bins(cand.candidate_files(plain_files(spark, sf)), BIN_BYTES)
    return balance.bin_loads(binned, "load")


# Duplicates


def duplicate_groups(spark, sf):
    return dup.duplicate_groups(hashed_inventory(spark, sf))


def duplicate_totals(spark, sf):
    totals = dup.duplicate_totals(dup.duplicate_groups(hashed_inventory(spark, sf)))
    return totals.withColumn("size_mb", F.round(text.megabytes(F.col("total_size")), 4)).withColumn(
        "size_gb", F.round(text.gigabytes(F.col("total_size")), 6)
    )


def duplicate_groups_after(spark, sf):
    return dup.duplicate_groups(hashed_inventory(spark, sf), FROM_HASH)


def duplicate_group_count_after(spark, sf):
    return dup.duplicate_groups(hashed_inventory(spark, sf), FROM_HASH).agg(F.count("*").alias("groups"))


def duplicate_groups_min_size(spark, sf):
    groups = dup.groups_by_hash_and_size(hashed_inventory(spark, sf), rep.MIN_DUPLICATE_SIZE)
    return dup.ordered_groups(groups)


def _large(spark, sf):
    """Files from the report's minimum size up, and their groups."""
    files = hashed_inventory(spark, sf).filter(F.col("size") >= rep.MIN_DUPLICATE_SIZE)
    return files, dup.groups_by_hash_and_size(files)


def duplicate_group_ids(spark, sf):
    nested = dup.nested_members(*_large(spark, sf))
    ids = F.array_join(F.array_sort("files.id").cast("array<string>"), ",")
    return nested.select("hash_value", "size", "file_count", "total_size", "page", ids.alias("ids"))


def duplicate_members(spark, sf):
    members = dup.duplicate_members(hashed_inventory(spark, sf))
    return dup.ordered_members(members).select(
        "hash_value", "file_count", "id", "path", "filename", "size", "mtime", "tag"
    )


def duplicate_members_salted(spark, sf):
    """Same rows with every group treated as hot."""
    members = dup.duplicate_members(hashed_inventory(spark, sf), rows_per_salt=1)
    return members.select("hash_value", "file_count", "id", "path", "filename", "size", "mtime", "tag")


def _nested(spark, sf, page_size):
    files = hashed_inventory(spark, sf)
    nested = dup.nested_members(files, dup.duplicate_groups(files), page_size)
    return nested.select(
        "hash_value", "file_count", "total_size", "page", F.array_join("files.path", "; ").alias("paths")
    )


def duplicate_members_nested(spark, sf):
    return _nested(spark, sf, dup.PAGE_SIZE)


def duplicate_members_paged(spark, sf):
    """Pages of two files, as a very large group is paged."""
    return _nested(spark, sf, 2)


def flagged_files(spark, sf):
    files = hashed_inventory(spark, sf)
    marked = dup.mark_duplicates(files, dup.duplicate_groups(files), complete=True)
    return marked.select("id", "path", "is_duplicate")


def flagged_files_after(spark, sf):
    """Flags of a rebuild from a given hash: the earlier groups stay unmarked here."""
    files = hashed_inventory(spark, sf)
    groups = dup.duplicate_groups(files, FROM_HASH)
    return dup.mark_duplicates(files, groups).select("id", "path", "is_duplicate")


def reset_flags(spark, sf):
    files = hashed_inventory(spark, sf)
    marked = dup.mark_duplicates(files, dup.duplicate_groups(files))
    return dup.reset_flags(marked).select("id", "path", "is_duplicate")


def _group_tables(spark, sf):
    """Groups known from the documents alone, and groups of the whole inventory."""
    files = hashed_inventory(spark, sf)
    old = dup.duplicate_groups(files.filter("tag = 'documents'")).withColumn(
        "first_seen", F.expr("first_seen + interval 1 day")
    )
    return old.withColumn("last_updated", F.expr("timestamp_ntz'2024-05-01 00:00:00'")), dup.duplicate_groups(files)


def upsert_groups_scan(spark, sf):
    return dup.upsert_groups_scan(*_group_tables(spark, sf), now())


def upsert_groups_rebuild(spark, sf):
    return dup.upsert_groups_rebuild(*_group_tables(spark, sf), now())


def _rebuilds(spark, sf):
    """Three rebuilds, one after another: of all files, after a hash, and of the documents alone."""
    files = written(hashed_inventory(spark, sf), "files")
    work = work_path(spark, "rebuilds")
    rebuild.rebuild_groups(files, work, 1, digits=1, now=now())
    rebuild.rebuild_groups(files, work, 2, FROM_HASH, digits=1, now=now())
    rebuild.rebuild_groups(files.filter("tag = 'documents'"), work, 3, digits=0, now=now())
    return work


def rebuild_ranges(spark, sf):
    """What each range of a rebuild after a hash has written; the ranges before it are empty."""
    return rebuild.written_ranges(spark, _rebuilds(spark, sf), 2)


def _runs(spark, sf):
    work = _rebuilds(spark, sf)
    events = [spark.read.schema(rebuild.EVENTS).parquet(f"{work}/run={n}/ledger") for n in (1, 2, 3)]
    return rebuild.latest_runs(events[0].unionByName(events[1]).unionByName(events[2]))


def run_ledger_latest(spark, sf):
    """State of three real runs as of their last events."""
    return _runs(spark, sf).select(
        "id", "status", F.col("finished_at").isNotNull().alias("finished"), "total_groups", "processed_groups",
        "processed_files", "processed_size", "last_hash_value",
    )


# Upserts


def upsert_files(spark, sf):
    old = with_folder_id(hashed_inventory(spark, sf))
    new = with_folder_id(second_scan(spark, sf))
    return ups.upsert_files(old, new).drop("folder_id")


def stale_hashes(spark, sf):
    """Hashes left before a merge: none for files the second scan shows changed."""
    old = hashed_inventory(spark, sf)
    return ups.without_stale_hashes(old, second_scan(spark, sf)).select("id", "path", "size", "hash_value")


def upsert_folders(spark, sf):
    old = folder_table(spark, sf).drop("parent_path")
    moved = old.filter("tag = 'pages'").withColumn("mtime", F.expr("mtime + interval 1 day")).withColumn(
        "tag", F.lit("rescan")
    ).withColumn("parent_id", F.lit(None).cast("long"))
    extra = fold.folders_of(second_scan(spark, sf).filter("tag = 'extra'"), 3, _fixture_id).drop("parent_path")
    return ups.upsert_folders(old, moved.unionByName(extra)).drop(*ROLLUPS)


def _fixture_id(path):
    return F.conv(F.substring(F.md5(path), 1, 15), 16, 10).cast("long")


# Reports


def top_files_all(spark, sf):
    return rep.largest_files(hashed_inventory(spark, sf)).select(
        "rank", "id", "path", "filename", "size", "mtime", "hash_value", "tag"
    )


def top_files_nonempty(spark, sf):
    return rep.largest_files(plain_files(spark, sf), nonempty=True).select(
        "rank", "id", "path", "size", "mtime", "tag", "top_folder"
    )


def top_files_large_limit(spark, sf):
    """A limit beyond Spark's own top-k: a cut above the last row wanted, then only those rows are sorted."""
    return rep.largest_files(plain_files(spark, sf), 1500).select("rank", "id", "path", "size")


def report_summary(spark, sf):
    return rep.summary(hashed_inventory(spark, sf))


def wasted_space(spark, sf):
    return rep.wasted_space(dup.groups_by_hash_and_size(hashed_inventory(spark, sf)))


def scalar_texts(spark, sf):
    files = plain_files(spark, sf)
    size, path = F.col("size"), F.col("path")
    markup = F.concat(F.lit('<a href="'), path, F.lit("\">&'+</a>"))
    return files.select(
        "id",
        text.format_bytes(size).alias("size_text"),
        text.format_bytes(size * size * 1024).alias("big_text"),
        text.truncate(path, 40).alias("short_path"),
        text.truncate(F.concat(F.lit("/ñandú/文書/😀"), path), 21).alias("wide_path"),
        text.truncate(F.concat(F.lit("/ñandú/文書/😀"), path), 15).alias("wider_path"),
        text.escape_html(markup).alias("plain_html"),
        text.escape_html(markup, text.TEMPLATE_ESCAPES).alias("template_html"),
        text.time_text(F.col("mtime")).alias("time_text"),
        text.rfc3339_text(F.col("mtime")).alias("rfc3339"),
        F.round(text.percent(size, size + 1000), 6).alias("share"),
        F.round(text.rate(size, F.col("id") % 60), 6).alias("rate"),
        F.round(text.remaining_seconds(size, size + 1000, F.lit(60)), 6).alias("eta"),
        F.array_join(
            paths.normalized_extensions(F.concat_ws(" ,", "file_ext", F.upper("tag"), F.lit(""), "file_ext")), ","
        ).alias("exts"),
    )


def _basic(spark, sf):
    files = hashed_inventory(spark, sf)
    return rep.largest_files(files), dup.duplicate_groups(files), dup.duplicate_members(files)


def report_console_basic(spark, sf):
    return out.basic_console(*_basic(spark, sf))


def report_html_basic(spark, sf):
    return out.basic_html(*_basic(spark, sf), TOP, now())


def report_sheet_basic_top(spark, sf):
    return out.basic_top_sheet(rep.largest_files(hashed_inventory(spark, sf)))


def report_sheet_basic_duplicates(spark, sf):
    return out.basic_duplicate_sheet(dup.duplicate_members(hashed_inventory(spark, sf)))


def _summary_parts(spark, sf):
    files = hashed_inventory(spark, sf)
    numbered = out.numbered_groups(dup.groups_by_hash_and_size(files, rep.MIN_DUPLICATE_SIZE))
    top = rep.largest_files(files, nonempty=True)
    return rep.summary(files), top, numbered, dup.members_of_groups(files, numbered)


def report_rows_console(spark, sf):
    return out.summary_console(*_summary_parts(spark, sf), now())


def report_rows_html(spark, sf):
    return out.summary_html(*_summary_parts(spark, sf), now())


def report_rows_sheet(spark, sf):
    return out.summary_duplicate_sheet(dup.nested_members(*_large(spark, sf)))


def report_sheet_summary(spark, sf):
    return out.summary_sheet(rep.summary(hashed_inventory(spark, sf)))


def report_sheet_top(spark, sf):
    return out.summary_top_sheet(rep.largest_files(plain_files(spark, sf), nonempty=True))


def _json_report(spark, sf, name):
    """One folder of the JSON report, written as the job writes it and read back as text."""
    files = hashed_inventory(spark, sf)
    documents = jobs.json_report(
        rep.summary(files), rep.largest_files(files, nonempty=True), dup.nested_members(*_large(spark, sf)),
        F.expr("timestamp'2024-06-01 12:00:00Z'"),
    )[name]
    path = work_path(spark, "json")
    documents.write.json(path)
    return spark.read.text(path).select(F.col("value").alias("document"))


def report_json(spark, sf):
    return _json_report(spark, sf, "report")


def report_json_top(spark, sf):
    return _json_report(spark, sf, "top_files")


def report_json_groups(spark, sf):
    return _json_report(spark, sf, "duplicates")


def browse_orders(spark, sf):
    """Top rows of every browse order of files, folders, groups and runs."""
    files = plain_files(spark, sf)
    folders = fold.with_rollups(folder_table(spark, sf), files)
    groups = dup.duplicate_groups(hashed_inventory(spark, sf))
    shelves = [
        (files, rep.FILE_ORDERS, "files", "path"),
        (folders, rep.FOLDER_ORDERS, "folders", "path"),
        (groups, rep.GROUP_ORDERS, "groups", "hash_value"),
        (_runs(spark, sf), rep.RUN_ORDERS, "runs", "id"),
    ]
    pages = [
        rep.browse(df, orders, name, key).select(
            F.lit(shelf).alias("shelf"), F.lit(name).alias("browse"), "rank", F.col(key).cast("string").alias("entry")
        )
        for df, orders, shelf, key in shelves
        for name in orders
    ]
    union = pages[0]
    for page in pages[1:]:
        union = union.unionByName(page)
    return union


# Retention


def scope_files(spark, sf):
    return plain_files(spark, sf).filter(ret.in_scope(SCOPE)).select("id", "path")


def scope_files_like(spark, sf):
    return plain_files(spark, sf).filter(ret.in_scope(WILD_SCOPE, "like")).select("id", "path")


def scope_folders(spark, sf):
    return folder_table(spark, sf).filter(ret.in_scope(SCOPE)).select("id", "path")


def scope_counts(spark, sf):
    return ret.scope_counts(plain_files(spark, sf), folder_table(spark, sf), SCOPE)


def delete_scope_remaining(spark, sf):
    files, _ = ret.remaining_after_scope(plain_files(spark, sf), folder_table(spark, sf), SCOPE)
    return files.select("id", "path", "size")


def delete_scope_remaining_folders(spark, sf):
    _, folders = ret.remaining_after_scope(plain_files(spark, sf), folder_table(spark, sf), SCOPE)
    return folders.select("id", "path")


FILTER = ("/share/corpus", False, paths.normalize_extensions(" .TXT, msg,,.txt"))


def delete_filter_selection(spark, sf):
    return ret.select_for_deletion(plain_files(spark, sf), ret.deletion_filter(*FILTER))


def delete_filter_limited(spark, sf):
    """The safety limit: the first ids of the selection."""
    return ret.select_for_deletion(plain_files(spark, sf), ret.deletion_filter(*FILTER), 500)


def delete_filter_limited_large(spark, sf):
    chosen = ret.select_for_deletion(plain_files(spark, sf), ret.deletion_filter("/share/corpus"), 1200)
    return chosen.select("id", "path")


def delete_size_zero_selection(spark, sf):
    return ret.select_for_deletion(plain_files(spark, sf), ret.deletion_filter("/share/corpus", size_zero=True))


def delete_filter_remaining(spark, sf):
    files = plain_files(spark, sf)
    gone = ret.select_for_deletion(files, ret.deletion_filter(*FILTER))
    return ret.without(files, gone).select("id", "path", "size")


def delete_filter_remaining_direct(spark, sf):
    """Without a limit the filter alone decides; no join."""
    kept = ret.remaining_after_filter(plain_files(spark, sf), ret.deletion_filter(*FILTER))
    return kept.select("id", "path", "size")


def delete_dry_run_outcomes(spark, sf):
    files = plain_files(spark, sf)
    return ret.outcome_counts(ret.purge_files(ret.select_for_deletion(files, ret.deletion_filter(*FILTER))))


def delete_outcomes(spark, sf):
    """Counts over outcomes of every kind."""
    chosen = ret.select_for_deletion(plain_files(spark, sf), ret.deletion_filter(*FILTER))
    kind = F.when(F.col("id") % 5 == 0, "missing").when(F.col("id") % 7 == 0, "error").otherwise("deleted")
    return ret.outcome_counts(chosen.withColumn("outcome", kind))


def delete_purged_remaining(spark, sf):
    """Files left after a purge in which some could not be removed: those stay."""
    files = plain_files(spark, sf)
    chosen = ret.select_for_deletion(files, ret.deletion_filter(*FILTER))
    kind = F.when(F.col("id") % 5 == 0, "missing").when(F.col("id") % 7 == 0, "error").otherwise("deleted")
    return ret.without(files, ret.purged(chosen.withColumn("outcome", kind))).select("id", "path", "size")


def deletion_list(spark, sf):
    hit = ret.in_scope(SCOPE)
    return ret.deletion_list(plain_files(spark, sf).filter(hit), folder_table(spark, sf).filter(hit))


def deletion_list_csv(spark, sf):
    """The export written as CSV and read back."""
    path = work_path(spark, "list")
    ret.write_deletion_list(deletion_list(spark, sf), path, "csv")
    return spark.read.csv(path, schema="type string, id bigint, path string", header=True, escape='"')


# Folders


def folders_table(spark, sf):
    return fold.with_parent(folder_table(spark, sf)).select(
        "id", "path", "name", "tag", "parent_path", "parent_name"
    )


def folder_rollup_direct(spark, sf):
    rolled = fold.with_rollups(folder_table(spark, sf), plain_files(spark, sf))
    return rolled.select("path", "size", "number_files")


def folder_rollup_subtree(spark, sf):
    rolled = fold.with_rollups(folder_table(spark, sf), plain_files(spark, sf))
    return rolled.select("path", "subtree_size", "subtree_files")


def files_in_folders(spark, sf):
    joined = fold.files_with_folder(plain_files(spark, sf), folder_table(spark, sf))
    return joined.select("id", "path", "folder_row_id", "folder_name", "file_count")


def files_without_folder(spark, sf):
    """Directories of the second scan that the first scan's folders do not list."""
    return fold.files_without_folder(second_scan(spark, sf), folder_table(spark, sf))


# The first slice


def duplicate_waste(spark, sf):
    """Duplicate groups with the bytes a clean-up would free, largest first."""
    groups = dup.groups_by_hash_and_size(hashed_inventory(spark, sf))
    return groups.withColumn("wasted", (F.col("file_count") - 1) * F.col("size")).orderBy(
        F.desc("wasted"), "hash_value"
    )


QUERIES = {
    name: fn
    for name, fn in list(globals().items())
    if getattr(fn, "__module__", None) == __name__ and not name.startswith("_") and name != "now"
}
