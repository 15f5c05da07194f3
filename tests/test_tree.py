"""Crawl, mount hashing and purge on a small tree."""

import hashlib
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from filecairn import jobs
from filecairn.functions.paths import parse_root, path_bytes, path_text
from filecairn.operators import candidates as cand
from filecairn.operators import retention as ret
from filecairn.operators import upserts as ups
from filecairn.plans.balance import bin_loads
from filecairn.schemas import ROLLUPS
from filecairn.sources.content import hash_bins, hash_mounted
from filecairn.sources.snapshots import read_snapshot
from filecairn.sources.tree import ENTRY, _lister, crawl, entry_errors


def put(root, name, data=b""):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    put(root, "a/.git/x", b"hidden")
    put(root, "a/.hid/y", b"same-bytes")
    put(root, "a/.dot", b"same-bytes")
    put(root, "_u/b/z", b"other-byte")
    put(root, "a/b/w.TXT", b"longer content")
    put(root, "a/b/empty")
    put(root, "a/c/.streams", b"a file named like an excluded directory")
    os.symlink(root / "a/b/w.TXT", root / "a/b/link")
    os.symlink(root / "a", root / "a/b/loop")
    os.mkfifo(root / "a/pipe")
    return root


EXPECTED = {"a/.hid/y", "a/.dot", "_u/b/z", "a/b/w.TXT", "a/b/empty", "a/c/.streams"}


def names(df, root):
    return {os.path.relpath(r["path"], root) for r in df.select("path").collect()}


@pytest.mark.parametrize("budget", [1, 2, 20_000])
def test_crawl(spark, tree, budget):
    files, folders, _ = crawl(spark, [(str(tree), "T")], budget=budget)
    assert names(files, tree) == EXPECTED
    assert files.count() == len(EXPECTED)
    assert names(folders, tree) == {".", "a", "a/.hid", "a/b", "a/c", "_u", "_u/b"}
    assert folders.filter("parent_id is null").select("path").first()["path"] == str(tree)
    known = folders.select(F.col("id").alias("folder_id"))
    assert files.join(known, "folder_id", "left_anti").count() == 0
    linked = folders.filter("parent_id is not null").select(F.col("parent_id").alias("folder_id"))
    assert linked.join(known, "folder_id", "left_anti").count() == 0


def test_crawl_columns(spark, tree):
    row = crawl(spark, [(str(tree), "T")])[0].filter(F.col("filename") == "w.TXT").first()
    info = os.lstat(row["path"])
    assert (row["size"], row["file_ext"], row["tag"]) == (info.st_size, ".TXT", "T")
    assert row["dir_path"] == os.path.dirname(row["path"])
    assert int(row["mtime"].timestamp() * 1e6) == info.st_mtime_ns // 1000
    assert row["hash_value"] is None and row["is_duplicate"] is False


def test_root_name_is_never_excluded_and_missing_roots_yield_nothing(spark, tree, tmp_path):
    files, folders, errors = crawl(
        spark, [(str(tree / "a/.git"), "G"), (str(tmp_path / "none"), "N"), (str(tree / "a/.dot"), "F")]
    )
    assert names(files, tree) == {"a/.git/x"}
    assert folders.count() == 1
    assert {(r["tag"], r["stage"]) for r in errors.collect()} == {("N", "root"), ("F", "root")}


def test_overlapping_roots(spark, tree):
    files, folders, _ = crawl(spark, [(str(tree), "outer"), (str(tree / "a"), "inner")])
    assert files.count() == len(EXPECTED)
    assert {r["tag"] for r in files.collect()} == {"outer"}
    assert folders.filter("parent_id is null").count() == 1
    files, _, _ = crawl(spark, [(str(tree / "a"), "inner"), (str(tree), "outer")])
    tags = {os.path.relpath(r["path"], tree): r["tag"] for r in files.collect()}
    assert tags["a/.dot"] == "inner" and tags["_u/b/z"] == "outer"


@pytest.mark.skipif(os.geteuid() == 0, reason="root can read every directory")
def test_unreadable_directory(spark, tree):
    os.chmod(tree / "a/b", 0)
    files, folders, errors = crawl(spark, [(str(tree), "T")])
    assert [(r["path"], r["tag"], r["stage"]) for r in errors.collect()] == [(str(tree / "a/b"), "T", "list")]
    assert "a/b" in names(folders, tree) and "a/b/w.TXT" not in names(files, tree)
    os.chmod(tree / "a/b", 0o755)


@pytest.fixture
def odd_tree(tmp_path):
    """A directory whose name is not UTF-8 with 50 files, and names that look like its text."""
    root = os.fsencode(tmp_path / "odd")
    bad = os.path.join(root, b"bad\xff\xe9")
    os.makedirs(bad)
    for n in range(50):
        with open(os.path.join(bad, b"f%02d\xfe" % n), "wb") as out:
            out.write(b"0123456789" if n % 2 else b"abcdefghij")
    for name in ("ok\ufffd", "bad\ufffdff\ufffde9", "plain-é"):
        put(tmp_path / "odd", f"{name}/x", b"0123456789")
    return tmp_path / "odd"


@pytest.mark.parametrize("budget", [1, 7, 20_000])
def test_names_that_are_not_utf8(spark, odd_tree, tmp_path, budget):
    files, folders, errors = crawl(spark, [(str(odd_tree), "T")], budget=budget)
    found = {path_bytes(r["path"]) for r in files.select("path").collect()}
    expected = {
        os.path.join(here, name) for here, _, names in os.walk(os.fsencode(odd_tree)) for name in names
    }
    assert found == expected and files.count() == 53 and errors.count() == 0
    assert folders.count() == 5 and folders.select("path").distinct().count() == 5
    known = folders.select(F.col("id").alias("folder_id"))
    assert files.join(known, "folder_id", "left_anti").count() == 0
    hashes = hash_mounted(files.select("id", "path", "size", "tag"))
    assert hashes.filter("hash_error is null").groupBy("hash_value").count().count() == 2
    if budget == 1:
        inside = files.filter(F.col("path").contains(path_text(b"bad\xff\xe9")))
        outcomes = ret.purge_files(ret.select_for_deletion(inside, F.lit(True)), dry_run=False)
        assert tuple(ret.outcome_counts(outcomes).first()) == (50, 50, 0)
        assert os.listdir(os.path.join(os.fsencode(odd_tree), b"bad\xff\xe9")) == []
        assert (odd_tree / "bad\ufffdff\ufffde9/x").exists()


def test_scan_over_names_that_are_not_utf8(spark, odd_tree, tmp_path):
    path, metrics = jobs.scan(spark, [(str(odd_tree), "T")], str(tmp_path / "out"))
    again, _ = jobs.scan(spark, [(str(odd_tree), "T")], str(tmp_path / "out2"), previous=path)
    for snapshot in (path, again):
        tables = read_snapshot(spark, snapshot)
        assert tables["files"].count() == 53 and tables["scan_errors"].count() == 0
        assert {(r["file_count"], r["total_size"]) for r in tables["duplicate_groups"].collect()} == {(28, 280), (25, 250)}
        assert tables["folders"].filter("parent_id is null").first()["subtree_files"] == 53


def test_every_failure_leaves_a_row(spark, tree, tmp_path, monkeypatch):
    """A root that is missing, an entry and a directory that vanish, and a file gone before it is hashed."""
    rows = list(map(tuple, (
        ("file", str(tree / "a/.dot"), 10, 0, "T", 0, None, None),
        ("error", "/r/x", None, None, "T", 0, "stat", "gone"), ("error", "/r/x", None, None, "U", 1, "stat", "gone again"),
        ("error", "/r/x", None, None, "T", 0, "list", "denied"),
    )))
    errors = entry_errors(spark.createDataFrame(rows, ENTRY))
    assert {tuple(r) for r in errors.collect()} == {("/r/x", "T", "stat", "gone"), ("/r/x", "T", "list", "denied")}

    listing = _lister(frozenset(), 100)
    os.chmod(tree, 0o755)
    real = os.scandir

    class Vanishing:
        """A listing whose entries are gone when they are looked at."""

        def __init__(self, folder):
            self.inner = real(folder)

        def __enter__(self):
            return iter([self._gone(i) for i in self.inner])

        def __exit__(self, *_):
            self.inner.close()

        @staticmethod
        def _gone(item):
            class Entry:
                path, name = item.path, item.name

                def stat(self, follow_symlinks):
                    if item.name == b".dot":
                        raise FileNotFoundError(2, "No such file or directory")
                    return item.stat(follow_symlinks=follow_symlinks)

            return Entry()

    monkeypatch.setattr(os, "scandir", Vanishing)
    seen = list(listing(iter([pd.DataFrame([(str(tree / "a"), "T", 0), (str(tree / "none"), "T", 0)], columns=["path", "tag", "root_no"])])))
    monkeypatch.undo()
    failed = {(os.path.relpath(r.path, tree), r.stage) for b in seen for r in b.itertuples() if r.kind == "error"}
    assert failed == {("a/.dot", "stat"), ("none", "list")}

    path, metrics = jobs.scan(spark, [(str(tree), "T"), (str(tmp_path / "none"), "N")], str(tmp_path / "out"))
    left = [tuple(r) for r in read_snapshot(spark, path)["scan_errors"].select("path", "tag", "stage").collect()]
    assert left == [(str(tmp_path / "none"), "N", "root")]


def test_scan_metrics_need_no_pass_of_their_own(spark, tree, tmp_path):
    _, metrics = jobs.scan(spark, [(str(tree / "a"), "A"), (str(tree / "_u"), "U"), (str(tmp_path / "no"), "N")], str(tmp_path / "out"))
    text = metrics._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in text and "Exchange" not in text
    row = metrics.first()
    assert (row["candidates"], row["processed"], row["success"], row["errors"], row["bytes"]) == (3, 3, 3, 0, 30)
    assert (row["success_percent"], row["remaining"], row["eta_seconds"]) == (100.0, 0, 0.0)
    assert row["files_per_second"] == pytest.approx(3 / row["seconds"])
    totals = {r["tag"]: (r["files"], r["bytes"]) for r in row["roots"]}
    assert totals["U"] == (1, 10) and totals["N"] == (0, 0) and totals["A"][0] == 5
    _, empty = jobs.scan(spark, [(str(tmp_path / "no"), "N")], str(tmp_path / "out2"))
    assert (empty.first()["processed"], empty.first()["eta_seconds"]) == (0, None)


def test_hash_bins_are_balanced(spark):
    files = spark.range(5000).select(
        F.col("id"), F.format_string("/r/%05d", "id").alias("path"),
        F.when(F.col("id") < 3, F.lit(50_000_000) * (F.col("id") + 1)).when(F.col("id") % 3 == 0, 4096).otherwise(F.col("id") * 7).cast("long").alias("size"),
    )
    binned, number = hash_bins(files, 20 << 20)
    loads = {r["bin"]: r for r in bin_loads(binned, "load").collect()}
    total = sum(r["load"] for r in loads.values())
    assert sum(r["files"] for r in loads.values()) == 5000 and set(loads) == set(range(number))
    assert all(r["files"] == 1 or r["load"] <= 2 * total / number for r in loads.values())
    assert [loads[n]["files"] for n in range(3)] == [1, 1, 1] and loads[0]["largest"] > loads[1]["largest"]
    per_task = binned.repartitionById(number, "bin").groupBy(F.spark_partition_id()).agg(F.count_distinct("bin").alias("bins"))
    assert {r["bins"] for r in per_task.collect()} == {1}
    assert hash_bins(files.filter("false"))[1] == 1


def test_hash_mounted(spark, tree, tmp_path):
    files, _, _ = crawl(spark, [(str(tree), "T")])
    chosen = cand.candidate_files(files)
    assert names(chosen, tree) == {"a/.hid/y", "a/.dot", "_u/b/z"}
    extra = spark.createDataFrame(
        [(1, str(tree / "gone"), 9), (2, str(tree / "a/b/empty"), 0)], "id long, path string, size long"
    )
    hashes = hash_mounted(chosen.select("id", "path", "size").unionByName(extra)).persist()
    got = {os.path.relpath(r["path"], tree): (r["hash_value"], r["hash_error"]) for r in hashes.collect()}
    digest = hashlib.md5(b"same-bytes").hexdigest()
    assert got["a/.dot"] == got["a/.hid/y"] == (digest, None)
    assert got["a/b/empty"] == (None, None)
    assert got["gone"][0] is None and "gone" in got["gone"][1]
    metrics = cand.hash_metrics(hashes).first()
    assert (metrics["processed"], metrics["success"], metrics["errors"]) == (5, 3, 2)
    assert metrics["success_percent"] == 60.0
    stored = cand.write_back(files, hashes)
    assert stored.filter("hash_value is not null").count() == 3


def test_purge(spark, tree):
    files, _, _ = crawl(spark, [(str(tree), "T")])
    gone = spark.createDataFrame([(7, str(tree / "nowhere"))], "id long, path string")
    folder = spark.createDataFrame([(8, str(tree / "a"))], "id long, path string")
    selection = ret.select_for_deletion(files, F.col("filename") == ".dot").unionByName(gone).unionByName(folder)
    dry = ret.purge_files(selection)
    assert {r["outcome"] for r in dry.collect()} == {"would_delete"} and (tree / "a/.dot").exists()
    outcomes = ret.purge_files(selection, dry_run=False)
    assert not (tree / "a/.dot").exists() and (tree / "a").exists()
    assert tuple(ret.outcome_counts(outcomes).first()) == (2, 1, 1)
    # Reading the outcomes again removes nothing more.
    put(tree, "a/.dot", b"back")
    assert tuple(ret.outcome_counts(outcomes).first()) == (2, 1, 1) and (tree / "a/.dot").exists()


def test_failed_deletion_is_taken_up(spark, tree, tmp_path, monkeypatch):
    """The write of the snapshot fails after the files are gone; the same call finishes with an exact account."""
    first, _ = jobs.scan(spark, [(str(tree), "T")], str(tmp_path / "out"))
    os.remove(tree / "a/b/w.TXT")
    output = str(tmp_path / "next")
    call = dict(scope=str(tree), extensions=".TXT,.dot,.streams", delete_disk=True, list_out=str(tmp_path / "list"))
    real = jobs.write_snapshot

    def breaks(spark, tables, path, *rest):
        tables["files"].write.parquet(f"{path}/files")
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "write_snapshot", breaks)
    with pytest.raises(RuntimeError):
        jobs.delete(spark, first, output, **call)
    monkeypatch.setattr(jobs, "write_snapshot", real)
    assert not (tree / "a/.dot").exists() and os.path.exists(f"{output}/files")
    with pytest.raises(ValueError, match="another deletion"):
        jobs.delete(spark, first, output, str(tree), extensions=".dot", delete_disk=True)
    # Put back: a finished purge is not repeated.
    put(tree, "a/.dot", b"back")
    counts = jobs.delete(spark, first, output, **call)
    assert tuple(counts.first()) == (3, 2, 0) and (tree / "a/.dot").exists()
    after = read_snapshot(spark, output)
    assert names(after["files"], tree) == {"a/.hid/y", "_u/b/z", "a/b/empty"}
    log = {os.path.relpath(r["path"], tree): r["outcome"] for r in after["purge_log"].collect()}
    assert log == {"a/.dot": "deleted", "a/c/.streams": "deleted", "a/b/w.TXT": "missing"}
    with pytest.raises(FileExistsError):
        jobs.delete(spark, first, output, **call)
    assert read_snapshot(spark, first)["purge_log"].count() == 0


def test_repeated_removals_keep_an_exact_account(spark, tree, tmp_path):
    """Files are removed and no outcome is written: the next run still tells them from those gone before."""
    journal = str(tmp_path / "journal")
    paths = [str(tree / "a/.dot"), str(tree / "a/.hid/y"), str(tree / "nowhere"), str(tree / "a")]
    selection = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    ret.purge_intent(selection, journal)
    os.remove(tree / "a/.dot")
    outcomes = ret.purge_files(selection.filter("false"), dry_run=False, journal=journal)
    got = {r["path"]: (r["outcome"], r["message"]) for r in outcomes.collect()}
    assert got[paths[0]] == ("deleted", "by an earlier attempt") and got[paths[1]] == ("deleted", None)
    assert got[paths[2]] == ("missing", None) and got[paths[3]][0] == "error"


def test_jobs_end_to_end(spark, tree, tmp_path):
    first, metrics = jobs.scan(spark, [parse_root(f"{tree}:T")], str(tmp_path / "out"))
    assert metrics.first()["success"] == 3
    tables = read_snapshot(spark, first)
    assert names(tables["files"].filter("is_duplicate"), tree) == {"a/.dot", "a/.hid/y"}
    group = tables["duplicate_groups"].first()
    assert (group["file_count"], group["total_size"]) == (2, 20)
    top = tables["folders"].filter("parent_id is null").first()
    assert (top["number_files"], top["subtree_files"]) == (0, len(EXPECTED))
    assert top["subtree_size"] == tables["files"].agg(F.sum("size")).first()[0]

    # A second scan: a new copy of a hashed file, and a changed file.
    put(tree, "new/copy", b"same-bytes")
    put(tree, "a/b/w.TXT", b"changed")
    second, _ = jobs.scan(spark, [(str(tree), "T2")], str(tmp_path / "out2"), previous=first)
    tables = read_snapshot(spark, second)
    assert names(tables["files"].filter("is_duplicate"), tree) == {"a/.dot", "a/.hid/y", "new/copy"}
    tags = {os.path.relpath(r["path"], tree): r["tag"] for r in tables["files"].collect()}
    assert tags["a/.dot"] == "T" and tags["new/copy"] == "T2"
    assert tables["duplicate_groups"].first()["file_count"] == 3
    assert tables["files"].filter(F.col("filename") == "w.TXT").first()["size"] == 7

    for kind in ("console", "html", "sheet"):
        jobs.report_basic(spark, second, str(tmp_path / f"basic-{kind}"), kind)
    for kind in ("console", "html", "sheet", "json"):
        jobs.report_summary(spark, second, str(tmp_path / f"summary-{kind}"), kind, min_size=1)
    for page in ("basic-html", "summary-html"):
        parts = sorted((tmp_path / page).glob("part-*"))
        whole = "".join(p.read_text() for p in parts)
        assert whole.startswith("<!DOCTYPE html>") and whole.rstrip().endswith("</html>")
        assert whole.count("<table>") == whole.count("</table>") == 2
    lines = [line for p in sorted((tmp_path / "summary-console").glob("part-*")) for line in p.read_text().splitlines()]
    heads = [n for n, line in enumerate(lines) if line.isupper() or line.startswith(("TOP", "DUPLICATE"))]
    assert [lines[n].split(" ")[0] for n in heads] == ["===", "SUMMARY:", "TOP", "DUPLICATE"]
    assert lines[-3:] == sorted(lines[-3:]) and all(line.startswith("      - ") for line in lines[-3:])
    assert "DUPLICATE FILES (1 groups):" in lines and "    Size: 10 B, Count: 3, Total: 30 B" in lines
    assert jobs.report_basic(spark, first) == first + "_report"
    document = spark.read.json(str(tmp_path / "summary-json/report")).first()
    assert document["summary"]["duplicateFiles"] == 7 - 2
    nested = spark.read.json(str(tmp_path / "summary-json/duplicates")).first()
    assert [os.path.basename(f["path"]) for f in nested["files"]] == [".dot", "y", "copy"]

    # Deletion by filter, then by path.
    dry = jobs.delete(spark, second, "", str(tree), dry_run=True, size_zero=True)
    assert dry.first()["db_deleted"] == 1
    third = str(tmp_path / "third")
    counts = jobs.delete(spark, second, third, str(tree), size_zero=True, delete_disk=True)
    assert tuple(counts.first()) == (1, 1, 0) and not (tree / "a/b/empty").exists()
    assert read_snapshot(spark, third)["folders"].count() == tables["folders"].count()
    fourth, listed = str(tmp_path / "fourth"), str(tmp_path / "listed")
    counts = jobs.delete(spark, third, fourth, str(tree / "a"), list_out=listed, list_format="tsv", delete_disk=True)
    assert tuple(counts.first()) == (4, 4) and (tree / "a/.dot").exists()
    left = read_snapshot(spark, fourth)
    assert names(left["files"], tree) == {"_u/b/z", "new/copy"}
    assert left["duplicate_groups"].count() == 0 and left["files"].filter("is_duplicate").count() == 0
    rows = spark.read.csv(listed, sep="\t", header=True)
    assert {r["type"] for r in rows.collect()} == {"folder", "file"} and rows.count() == 8
    assert left["folders"].columns[-4:] == ROLLUPS


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_inventory_is_not_shuffled(spark, tree, tmp_path):
    """Upsert, write-back and deletion over a bucketed file table shuffle the other side only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first, _ = jobs.scan(spark, [(str(tree), "T")], str(tmp_path / "out"), buckets=8)
        plain, _ = jobs.scan(spark, [(str(tree), "T")], str(tmp_path / "plain"))
        old, new = read_snapshot(spark, first)["files"], read_snapshot(spark, plain)["files"]
        merged = ups.upsert_files(old, new)
        assert (_exchanges(merged), _exchanges(ups.upsert_files(new, new))) == (1, 2)
        assert _exchanges(ups.upsert_files(ups.without_stale_hashes(old, new), new)) == 2
        assert "Bucketed: true" in merged._jdf.queryExecution().executedPlan().toString()
        hashes = new.select("id", "path", F.lit("x").alias("hash_value"), F.lit(None).cast("string").alias("hash_error"))
        assert (_exchanges(cand.write_back(old, hashes)), _exchanges(cand.write_back(new, hashes))) == (1, 2)
        gone = new.filter("size = 0")
        assert (_exchanges(ret.without(old, gone)), _exchanges(ret.without(new, gone))) == (1, 2)

        # The same files and groups as without buckets, over two scans.
        put(tree, "new/copy", b"same-bytes")
        put(tree, "a/b/w.TXT", b"changed")
        tables = []
        for base, before in (("out2", first), ("plain2", plain)):
            path, _ = jobs.scan(spark, [(str(tree), "T2")], str(tmp_path / base), previous=before)
            tables.append(read_snapshot(spark, path))
        shown = [sorted(map(repr, t["files"].collect())) for t in tables]
        assert shown[0] == shown[1] and tables[0]["files"].filter("is_duplicate").count() == 3
        assert len(list((tmp_path / "out2").glob("scan_*/files/*.parquet"))) <= 8
        scoped = tables[0]["files"].filter(ret.in_scope(str(tree / "a"))).select("id")
        text = spark._jvm.PythonSQLUtils.explainString(scoped._jdf.queryExecution(), "formatted")
        assert "StringStartsWith(path" in text
        third = str(tmp_path / "third")
        jobs.delete(spark, str(next((tmp_path / "out2").glob("scan_*"))), third, str(tree / "a"))
        assert names(read_snapshot(spark, third)["files"], tree) == {"_u/b/z", "new/copy"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_changed_file_is_hashed_again(spark, tree, tmp_path):
    first, _ = jobs.scan(spark, [(str(tree), "T")], str(tmp_path / "out"))
    put(tree, "a/.dot", b"other-byte")
    os.utime(tree / "a/.dot", (1, 1))
    second, metrics = jobs.scan(spark, [(str(tree), "T")], str(tmp_path / "out2"), previous=first)
    assert metrics.first()["processed"] == 1
    tables = read_snapshot(spark, second)
    assert names(tables["files"].filter("is_duplicate"), tree) == {"a/.dot", "_u/b/z"}
    group = tables["duplicate_groups"].collect()
    assert [g["hash_value"] for g in group] == [hashlib.md5(b"other-byte").hexdigest()]
    assert tables["files"].count() == len(EXPECTED)


def test_snapshot_is_never_overwritten(spark, tree, tmp_path):
    first, _ = jobs.scan(spark, [(str(tree), "T")], str(tmp_path / "out"))
    with pytest.raises(FileExistsError, match="exists already"):
        jobs.delete(spark, first, first, str(tree / "a"))
    assert read_snapshot(spark, first)["files"].count() == len(EXPECTED)


def test_job_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.scan(spark, [], str(tmp_path))
    with pytest.raises(ValueError):
        jobs.delete(spark, str(tmp_path), str(tmp_path / "x"), "/")
    with pytest.raises(ValueError):
        jobs.rebuild(spark, str(tmp_path), str(tmp_path / "x"), str(tmp_path / "w"), from_hash="8")
    with pytest.raises(ValueError):
        jobs.report_summary(spark, str(tmp_path), " ")
    with pytest.raises(ValueError):
        jobs.report_basic(spark, str(tmp_path), str(tmp_path / "r"), "pdf")
