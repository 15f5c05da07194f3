"""Plan shapes, skew handling, ordering, rebuild and deletion properties."""

import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.inventory import NOW, content_files, hashed_inventory, plain_files, with_folder_id
from filecairn.operators import candidates as cand
from filecairn.operators import duplicates as dup
from filecairn.operators import reports as rep
from filecairn.operators import retention as ret
from filecairn.plans import ordering, skew
from filecairn.schemas import FILES, TABLES, empty, upgrade_folders
from filecairn.sources import snapshots, tables
from filecairn.streaming import rebuild
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_rows(df):
    return sorted(map(repr, df.collect()))


# Plans


def exchanged(df):
    """Output columns of every shuffle, from the formatted plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)
    return [set(re.sub(r"#\d+L?", "", b).split(", ")) for b in blocks]


@pytest.mark.parametrize("max_sizes", [0, 1_000_000])
def test_content_is_never_shuffled(spark, max_sizes):
    hashed = cand.hash_candidates(content_files(spark, SMALL), plain_files(spark, SMALL), max_sizes)
    shuffles = exchanged(hashed)
    assert shuffles and not any({"content", "text", "html"} & columns for columns in shuffles)


def test_content_is_read_once(spark):
    files = content_files(spark, SMALL)
    for df in (cand.hash_candidates(files), cand.with_content_hashes(files)):
        assert "documents.parquet" not in plan(df)


def test_write_back_equals_the_one_pass_form(spark):
    files = content_files(spark, SMALL)
    stored = cand.write_back(files.drop("content"), cand.hash_candidates(files))
    assert sorted_rows(cand.with_content_hashes(files)) == sorted_rows(stored)


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snap") / "scan")
    files = hashed_inventory(spark, SMALL).withColumn("folder_id", F.lit(1).cast("long"))
    snapshots.write_snapshot(spark, {"files": files}, path)
    return path


def test_filters_and_columns_reach_the_scan(spark, snapshot):
    files = snapshots.read_snapshot(spark, snapshot)["files"]
    after = plan(dup.duplicate_groups(files, "8").select("hash_value", "file_count"))
    assert "GreaterThan(hash_value,8)" in after and re.search(r"ReadSchema: struct<hash_value:string>", after)
    scope = plan(files.filter(ret.in_scope("/share/corpus/pages")).select("id"))
    assert "StringStartsWith(path,/share/corpus/pages/)" in scope
    top = plan(rep.largest_files(files, 5))
    assert "TakeOrderedAndProject" in top


def test_like_bounds_reach_the_scan(spark, snapshot):
    files = snapshots.read_snapshot(spark, snapshot)["files"]
    scan = files.filter(ret.in_scope("/SHARE/corpus/doc_ments", "like")).select("id")
    text = spark._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(path,/SHARE/CORPUS/DOC)" in text and "LessThan(path,/share/corpus/dod)" in text


@settings(max_examples=60, deadline=None)
@given(st.text("aAzZ/_%é\ud7ff\U0010ffff", min_size=1, max_size=6), st.text("aAzZ/é\ud7ff\U0010ffff", max_size=8))
def test_like_bounds_hold_every_match(spark, pattern, path):
    match = re.fullmatch(
        "".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in pattern) + ".*", path, re.DOTALL | re.ASCII | re.IGNORECASE
    )
    if match:
        row = spark.createDataFrame([(path,)], "path string")
        assert row.filter(ret.like_bounds(F.col("path"), pattern + "%")).count() == 1


def test_hashes_are_stored_in_their_order(spark, snapshot, tmp_path):
    """Resuming after a hash reads the narrow table, whose row groups end before or begin after it."""
    import pyarrow.parquet as pq

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide = str(tmp_path / "wide")
        snapshot = snapshots.write_snapshot(spark, {"files": snapshots.read_snapshot(spark, snapshot)["files"]}, wide)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tables = snapshots.read_snapshot(spark, snapshot)
    assert tables["file_hashes"].count() == tables["files"].filter("hash_value is not null").count()
    assert all("/file_hashes/" in f for f in tables["file_hashes"].inputFiles())
    assert "GreaterThan(hash_value,8)" in plan(dup.duplicate_groups(tables["file_hashes"], "8"))
    spans = []
    for part in Path(snapshot, "file_hashes").glob("*.parquet"):
        meta = pq.ParquetFile(part).metadata
        stats = [meta.row_group(n).column(0).statistics for n in range(meta.num_row_groups)]
        spans += [(s.min, s.max) for s in stats if s]
    spans.sort()
    assert len(spans) > 2 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sum(high <= "8" for _, high in spans) >= 1
    same = dup.duplicate_groups(tables["files"])
    assert sorted_rows(dup.duplicate_groups(tables["file_hashes"])) == sorted_rows(same)


def test_older_snapshots_have_hashes_too(spark, snapshot, tmp_path):
    import shutil

    old = str(tmp_path / "old")
    shutil.copytree(snapshot, old, ignore=shutil.ignore_patterns("file_hashes", "scan_errors", "purge_log"))
    tables = snapshots.read_snapshot(spark, old)
    assert tables["file_hashes"].count() == 70 and tables["scan_errors"].count() == tables["purge_log"].count() == 0


def test_paging_counts_no_hash_again(spark, snapshot):
    files = snapshots.read_snapshot(spark, snapshot)["files"]
    nested = dup.nested_members(files, dup.duplicate_groups(files))
    # One aggregation for the groups, one for the pages; each has a partial and a final step.
    text = nested._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\n[ :+-]*Aggregate \[hash_value", text)) <= 4


def test_hot_key_lookup_reuses_the_aggregation(spark, snapshot):
    files = snapshots.read_snapshot(spark, snapshot)["files"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = dup.duplicate_members(files)
        members.collect()
        assert "ReusedExchange" in plan(members)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshot_views(spark, snapshot):
    snapshots.register_views(snapshots.read_snapshot(spark, snapshot))
    assert spark.sql("select count(*) from files").first()[0] == 377
    assert spark.sql("select count(*) from duplicate_runs").first()[0] == 0


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from filecairn.plans.cut import shared_folder

    conf = SimpleNamespace(get=lambda name, default: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError):
        shared_folder(cluster)


# Skew and ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """Files of which a third share one hash and one size."""
    return spark.range(3000).select(
        F.col("id"),
        F.format_string("/r/%05d", "id").alias("path"),
        F.format_string("%05d", "id").alias("filename"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500 + 10).cast("long").alias("size"),
        F.when(F.col("id") % 3 == 0, F.lit("aaaa"))
        .when(F.col("id") % 3 == 1, F.md5((F.col("id") % 200).cast("string")))
        .alias("hash_value"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("mtime"),
        F.lit("t").alias("tag"), F.lit("f").alias("top_folder"), F.lit(False).alias("is_duplicate"),
    ).persist()


def test_salting_keeps_results(spark, skewed):
    open_files = skewed.withColumn("hash_value", F.lit(None).cast("string"))
    groups = dup.duplicate_groups(skewed)
    for run in (
        lambda n: cand.candidate_files(open_files, rows_per_salt=n).select("id"),
        lambda n: dup.duplicate_members(skewed, rows_per_salt=n).select("id", "hash_value", "file_count"),
        lambda n: dup.mark_duplicates(skewed, groups, True, n).select("id", "is_duplicate"),
        lambda n: dup.mark_duplicates(skewed, groups.filter("hash_value > 'a'"), False, n).select("id", "is_duplicate"),
        lambda n: dup.members_of_groups(skewed, groups.filter("file_count < 50"), False, n).select("id", "file_count"),
    ):
        assert sorted_rows(run(10)) == sorted_rows(run(1_000_000))


@pytest.mark.parametrize("condition", ["true", "hash_value <> 'aaaa'"])
def test_hot_key_is_spread(spark, skewed, condition):
    """Also a hot key without a partner."""
    keyed = dup.duplicate_groups(skewed).select("hash_value", "file_count")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.salted_join(
            skewed, keyed.filter(condition), "hash_value", "left", F.col("path"), rows_per_salt=50
        )
        largest = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Eight partitions; the hot key and the rows without a key are a third each.
    assert largest < 3000 / 8 * 1.6


def test_files_with_folder(spark, hashed):
    from filecairn.operators.folders import files_with_folder, folders_of

    folders = folders_of(hashed, 3)
    plain = files_with_folder(hashed, folders).select("path", "folder_name", "file_count")
    assert plain.count() == 377
    assert sorted_rows(plain) == sorted_rows(
        files_with_folder(hashed, folders, rows_per_salt=2).select("path", "folder_name", "file_count")
    )


def test_fits(spark):
    assert skew.fits(spark.range(5), 5) and not skew.fits(spark.range(6), 5)


def test_positions_are_exact(spark, skewed):
    got = ordering.positions(skewed, [F.desc("size"), F.asc("path")]).select("position", "id")
    rows = sorted(skewed.select("size", "path", "id").collect(), key=lambda r: (-r["size"], r["path"]))
    assert {r["position"]: r["id"] for r in got.collect()} == {i: r["id"] for i, r in enumerate(rows, 1)}


def test_large_limits_avoid_one_task(spark, skewed, monkeypatch):
    order = [("size", False), ("path", False)]
    small = skewed.orderBy("size", "path").limit(1234)
    want = [(n, r["id"]) for n, r in enumerate(small.collect(), 1)]
    for one_task in (ordering.ONE_TASK, 1):
        monkeypatch.setattr(ordering, "ONE_TASK", one_task)
        assert sorted_rows(ordering.first_rows(skewed, order, 1234)) == sorted_rows(small)
        got = ordering.ranked(skewed, order, 1234)
        assert sorted((r["rank"], r["id"]) for r in got.collect()) == want
    assert ordering.first_rows(skewed, order, 5000).count() == 3000
    assert ordering.first_rows(skewed.filter("false"), order, 5000).count() == 0


def test_only_rows_near_the_limit_are_moved(spark, monkeypatch):
    """10,000 of 10^6 rows over 500 tasks: what is sorted is little more than 10,000 rows."""
    rows = spark.range(0, 1_000_000, 1, 500).select(
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("size"), F.format_string("/r/%07d", "id").alias("path")
    )
    above = ordering._above_cut(rows, [("size", True), ("path", False)], 10_000)
    assert 10_000 <= above.count() < 15_000
    got = ordering.first_rows(rows, [("size", True), ("path", False)], 10_000)
    want = rows.orderBy(F.desc("size"), "path").limit(10_000)
    assert got.exceptAll(want).isEmpty() and got.count() == 10_000


def test_cuts_with_nulls_and_ties(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("b"), "id"
    )
    for order in ([("a", False), ("b", True), ("id", False)], [("a", True), ("b", False), ("id", True)]):
        want = rows.orderBy(*ordering.order_columns(order)).limit(1500).collect()
        assert sorted(map(repr, ordering.first_rows(rows, order, 1500).collect())) == sorted(map(repr, want))


@pytest.mark.parametrize("page_size", [1, 7, 100, 5000])
def test_nested_pages_are_whole_and_ordered(spark, skewed, page_size):
    nested = dup.nested_members(skewed, dup.duplicate_groups(skewed), page_size)
    pages = nested.select("hash_value", "page", "file_count", "files.path").collect()
    assert max(len(p["path"]) for p in pages) <= page_size
    found = {}
    for p in sorted(pages, key=lambda p: (p["hash_value"], p["page"])):
        found.setdefault(p["hash_value"], []).extend(p["path"])
    want = {}
    for r in dup.duplicate_members(skewed).orderBy("path").collect():
        want.setdefault(r["hash_value"], []).append(r["path"])
    assert found == want
    assert all(p["file_count"] == len(want[p["hash_value"]]) for p in pages)


# Rebuild


def test_rebuild_is_restartable(spark, hashed, tmp_path):
    want = dup.duplicate_groups(hashed).persist()
    work = str(tmp_path / "work")
    groups, run = rebuild.rebuild_groups(hashed, work, 1, digits=1)
    again, _ = rebuild.rebuild_groups(hashed, work, 1, digits=1)
    for other in (dict(files=hashed.filter("false"), digits=1), dict(files=hashed, digits=1, from_hash="8"), dict(files=hashed, digits=0)):
        with pytest.raises(ValueError, match="another input"):
            rebuild.rebuild_groups(other.pop("files"), work, 1, **other)
    names = ["hash_value", "file_count", "total_size"]
    assert sorted_rows(groups.select(names)) == sorted_rows(want.select(names)) == sorted_rows(again.select(names))
    state = rebuild.latest_runs(spark.read.schema(rebuild.EVENTS).parquet(f"{work}/run=1/ledger")).first()
    assert state["status"] == "done" and state["processed_groups"] == 8 and state["processed_files"] == 17
    assert state["last_hash_value"] == want.agg(F.max("hash_value")).first()[0]
    assert run.first()["finished_at"] is not None


def test_killed_rebuild_writes_only_what_is_missing(spark, hashed, tmp_path, monkeypatch):
    """The tasks of the last ranges fail; the second run writes those and leaves the others as they are."""
    work = str(tmp_path / "work")
    frame = type(hashed)
    place = frame.repartitionById

    def breaks(df, number, column):
        lost = F.raise_error(F.lit("lost")).cast("long")
        return place(df, number, column).withColumn("file_count", F.when(F.col("range") >= 13, lost).otherwise(F.col("file_count")))

    monkeypatch.setattr(frame, "repartitionById", breaks)
    with pytest.raises(Exception, match="lost"):
        rebuild.rebuild_groups(hashed, work, 9, digits=1)
    monkeypatch.undo()
    ledger = spark.read.schema(rebuild.EVENTS).parquet(f"{work}/run=9/ledger")
    assert rebuild.latest_runs(ledger).first()["status"] == "failed"
    first = {p.parent.name: p.name for p in (tmp_path / "work/run=9/groups").glob("range=*/*.parquet")}
    done = {r["range"] for r in rebuild.written_ranges(spark, work, 9).collect()}
    assert 0 < len(done) < 16 and not {13, 14, 15} & done and {f"range={n}" for n in done} == set(first)
    seen = []
    write = rebuild._write_ranges
    monkeypatch.setattr(rebuild, "_write_ranges", lambda h, missing, *rest: (seen.append(missing), write(h, missing, *rest)))
    groups, run = rebuild.rebuild_groups(hashed, work, 9, digits=1)
    assert seen == [sorted(set(range(16)) - done)]
    after = {p.parent.name: p.name for p in (tmp_path / "work/run=9/groups").glob("range=*/*.parquet")}
    assert len(after) == 16 and first.items() <= after.items()
    assert len({name.split("-c000")[0][-36:] for r, name in after.items() if r not in first}) == 1
    names = ["hash_value", "file_count", "total_size", "first_seen"]
    assert sorted_rows(groups.select(names)) == sorted_rows(dup.duplicate_groups(hashed).select(names))
    assert (run.first()["status"], run.first()["processed_groups"], run.first()["total_groups"]) == ("done", 8, 8)
    rebuild.rebuild_groups(hashed, work, 9, digits=1)
    assert len(seen) == 1


def test_rebuild_of_other_times_is_refused(spark, hashed, tmp_path):
    work = str(tmp_path / "work")
    rebuild.rebuild_groups(hashed, work, 1, digits=1)
    with pytest.raises(ValueError, match="another input"):
        rebuild.rebuild_groups(hashed.withColumn("mtime", F.expr("mtime - interval 1 day")), work, 1, digits=1)


def test_ranges_follow_the_hash_order(spark):
    rows = spark.createDataFrame([("",), ("00ff",), ("0f",), ("9z",), ("A1",), ("a0",), ("ff",), ("zz",), ("~",)], "h string")
    for digits in (0, 1, 2):
        ranges = rebuild.hash_ranges(digits)
        for r in rows.select("h", rebuild.range_of(F.col("h"), digits).alias("n")).collect():
            low, high = ranges[r["n"]]
            assert low <= r["h"] and (high is None or r["h"] < high)


def test_ranges_and_resume_cover_everything(spark, hashed):
    assert rebuild.hash_ranges(0) == [("", None)]
    ranges = rebuild.hash_ranges(1)
    assert len(ranges) == 16 and ranges[0] == ("", "1") and ranges[-1] == ("f", None)
    whole = dup.duplicate_groups(hashed)
    middle = sorted(r["hash_value"] for r in whole.collect())[3]
    rest = dup.duplicate_groups(hashed, middle)
    assert whole.filter(F.col("hash_value") <= middle).count() + rest.count() == whole.count()


def test_rebuild_job_twice_equals_once(spark, snapshot, tmp_path):
    from filecairn import jobs

    once = jobs.rebuild(spark, snapshot, str(tmp_path / "one"), str(tmp_path / "w1"), run_id=1)
    twice = jobs.rebuild(spark, once, str(tmp_path / "two"), str(tmp_path / "w2"), run_id=2, digits=1)
    a, b = snapshots.read_snapshot(spark, once), snapshots.read_snapshot(spark, twice)
    assert sorted_rows(a["files"]) == sorted_rows(b["files"])
    assert a["files"].filter("is_duplicate").count() == 17
    drop = ["last_updated"]
    assert sorted_rows(a["duplicate_groups"].drop(*drop)) == sorted_rows(b["duplicate_groups"].drop(*drop))
    assert {r["id"]: r["status"] for r in b["duplicate_runs"].collect()} == {1: "done", 2: "done"}
    fresh = jobs.rebuild(spark, twice, str(tmp_path / "fresh"), str(tmp_path / "w2"))
    assert {r["id"] for r in snapshots.read_snapshot(spark, fresh)["duplicate_runs"].collect()} == {1, 2, 3}
    # Resuming by hand keeps the groups before the given hash.
    middle = jobs.rebuild(
        spark, once, str(tmp_path / "three"), str(tmp_path / "w3"), run_id=3, reset=False, from_hash="8"
    )
    kept = snapshots.read_snapshot(spark, middle)["duplicate_groups"]
    assert kept.count() == 8 and kept.select("last_updated").distinct().count() == 2


# Deletion


def test_like_scope_matches_wildcards_and_case(spark):
    rows = spark.createDataFrame(
        [("/a_b/x",), ("/A_b/x",), ("/aXb/y",), ("/a_b",), ("/a_bc",), ("/a\\b/x",), ("/É/x",), ("/é/x",)], "path string"
    )
    literal = {r[0] for r in rows.filter(ret.in_scope("/a_b")).collect()}
    assert literal == {"/a_b/x", "/a_b"}
    like = {r[0] for r in rows.filter(ret.in_scope("/a_b", "like")).collect()}
    assert like == {"/a_b/x", "/A_b/x", "/aXb/y", "/a_b", "/a\\b/x"}
    assert {r[0] for r in rows.filter(ret.in_scope("/a\\b", "like")).collect()} == {"/a\\b/x"}
    assert {r[0] for r in rows.filter(ret.in_scope("/é", "like")).collect()} == {"/é/x"}
    with pytest.raises(ValueError):
        ret.in_scope("/a", "regex")


def test_deletion_list_quoting(spark, tmp_path):
    rows = spark.createDataFrame(
        [("file", 1, '/a,b"c'), ("folder", 2, "/trailing "), ("file", 3, "/tab\there"), ("file", 4, "/new\nline")],
        "type string, id long, path string",
    )
    for name, sep in ret.LIST_SEPARATORS.items():
        path = str(tmp_path / name)
        assert ret.write_deletion_list(rows.coalesce(1), path, f" {name.upper()} ")
        raw = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        assert '"/a,b""c"' in raw and "/trailing \n" in raw
        back = spark.read.csv(
            path, header=True, sep=sep, escape='"', multiLine=True,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        assert {r["path"] for r in back.collect()} == {r["path"] for r in rows.collect()}
    assert not ret.write_deletion_list(rows, "  ")
    with pytest.raises(ValueError):
        ret.write_deletion_list(rows, str(tmp_path / "x"), "json")


def test_delete_then_report_equals_report_of_the_rest(spark, hashed):
    gone = ret.select_for_deletion(hashed, ret.deletion_filter("/share/corpus/pages"))
    rest = ret.without(hashed, gone)
    assert rep.summary(rest).first() == rep.summary(hashed.filter("tag <> 'pages'")).first()
    assert rest.count() + gone.count() == hashed.count()


def test_deletion_limit_takes_first_ids(spark, hashed):
    chosen = ret.select_for_deletion(hashed, ret.deletion_filter("/share/corpus", extensions=[".html"]), 3)
    assert [r["id"] for r in chosen.collect()] == [2000000000, 2000000001, 2000000002]
    assert ret.select_for_deletion(hashed, F.lit(True), 0).count() == 377


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), max_size=12))
def test_waste_is_total_minus_one_copy(spark, cells):
    rows = [(i, f"/p/{i}", size, f"h{h}-{size}" if size else None) for i, (h, size) in enumerate(cells)]
    files = spark.createDataFrame(rows, "id long, path string, size long, hash_value string")
    sizes = {}
    for _, _, size, h in rows:
        if h:
            sizes.setdefault(h, []).append(size)
    figures = rep.summary(files).first()
    assert figures["wasted_space"] == sum(sum(s) - s[0] for s in sizes.values())
    assert figures["unique_files"] == len(sizes)
    assert figures["duplicate_files_ref"] == len(rows) - len(sizes)
    assert figures["average_file_size"] == (sum(r[2] for r in rows) // len(rows) if rows else 0)


# Schemas


def test_empty_tables(spark):
    for name, schema in TABLES.items():
        assert empty(spark, name).schema == schema and empty(spark, name).count() == 0


def test_upgrade_keeps_present_rollups(spark):
    old = spark.createDataFrame([("/a", 5), ("/b", None)], "path string, size long")
    got = {r["path"]: (r["size"], r["number_files"], r["subtree_files"]) for r in upgrade_folders(old).collect()}
    assert got == {"/a": (5, 0, 0), "/b": (0, 0, 0)}


def test_old_folder_snapshot_reads_with_defaults(spark, tmp_path):
    old = spark.createDataFrame([(1, "/a", "a")], "id long, path string, name string")
    old.write.parquet(str(tmp_path / "folders"))
    row = snapshots.read_table(spark, str(tmp_path), "folders").first()
    assert (row["size"], row["subtree_files"], row["parent_id"]) == (0, 0, None)
    assert snapshots.read_table(spark, str(tmp_path), "files").schema == FILES


def test_excluded_names_apply_below_roots_only(spark):
    rows = tables.describe(
        spark.createDataFrame([("/r/x/a.txt",), ("/r/y/x",), ("/r/y/z/x/q/b",), ("/x/k/f",)], "path string")
    )
    kept = tables.exclude_directories(rows, ["x"], ["/r", "/x"])
    assert {r["path"] for r in kept.collect()} == {"/r/y/x", "/x/k/f"}


def test_first_seen_falls_back_to_now(spark):
    rows = spark.createDataFrame(
        [("h", 1, None), ("h", 1, None)], "hash_value string, size long, mtime timestamp_ntz"
    )
    group = dup.duplicate_groups(rows, now=F.expr(NOW)).first()
    assert str(group["first_seen"]) == "2024-06-01 12:00:00"


def test_plain_inventory_has_unique_ids(spark):
    files = plain_files(spark, SMALL)
    assert files.select("id").distinct().count() == files.count()


# Snapshots and deletion


def test_missing_or_unfinished_snapshots_raise(spark, hashed, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, str(tmp_path / "mistyped"))
    half = str(tmp_path / "half")
    files = with_folder_id(hashed)
    snapshots.write_table(files, half, "files")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, half)
    whole = snapshots.write_snapshot(spark, {"files": files}, str(tmp_path / "whole"))
    assert snapshots.read_snapshot(spark, whole)["folders"].count() == 0
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot(spark, {"files": files}, whole)


def test_delete_removes_nothing_if_the_output_exists(spark, tmp_path):
    from filecairn import jobs

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.tmp").write_text("x")
    path, _ = jobs.scan(spark, [(str(tree), "T")], str(tmp_path / "scans"))
    taken = tmp_path / "taken"
    taken.mkdir()
    with pytest.raises(FileExistsError):
        jobs.delete(spark, path, str(taken), str(tree), extensions=".tmp", delete_disk=True)
    assert (tree / "a.tmp").exists()


def test_subtree_of_the_root(spark):
    from filecairn.functions.paths import ancestors

    got = spark.createDataFrame([("/a/b",), ("/",)], "p string").select(ancestors(F.col("p"), root=True).alias("a")).collect()
    assert [r["a"] for r in got] == [["/", "/a", "/a/b"], ["/"]]


def test_empty_hashes_are_spread(spark):
    files = spark.range(4000).select(
        "id", F.concat(F.lit("/f/"), "id").alias("path"), F.lit(1).cast("long").alias("size"),
        F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("id") % 500).cast("string"))).alias("hash_value"),
        F.lit(False).alias("is_duplicate"), F.expr("timestamp'2024-01-01 00:00:00'").alias("mtime"),
    )
    marked = dup.mark_duplicates(files, dup.duplicate_groups(files), complete=True, rows_per_salt=50)
    assert marked.count() == 4000 and marked.filter("hash_value = '' and is_duplicate").count() == 0
    assert marked.filter("is_duplicate").count() == 2000
