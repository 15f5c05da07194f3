"""Headline timings; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. The inventory is listed
and hashed into a snapshot first, as a scan does; the other queries read that snapshot.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.inventory import ROOT_DEPTH, content_files, second_scan, with_folder_id
from filecairn.operators import candidates as cand
from filecairn.operators import duplicates as dup
from filecairn.operators import folders as fold
from filecairn.operators import renderers as out
from filecairn.operators import reports as rep
from filecairn.operators import retention as ret
from filecairn.operators import upserts as ups
from filecairn.plans.cut import written
from filecairn.sources.content import hash_mounted
from filecairn.sources.snapshots import read_table, write_table
from filecairn.sources.tree import crawl


def session(cores: str, shared: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("filecairn-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    """Compute every row without keeping any."""
    df.write.format("noop").mode("overwrite").save()


def put_files(tree: str, rows) -> None:
    for row in rows:
        path = tree + row["path"]
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(row["content"])


def mounted_steps(spark: SparkSession, tree: str) -> dict:
    """Crawl and hash of a tree; each step returns the files it met."""
    found = {}

    def crawl_tree() -> int:
        found["files"] = written(crawl(spark, [(tree, "T")]).files, "crawled")
        return found["files"].count()

    def hash_tree() -> int:
        chosen = written(cand.candidate_files(found["files"]).select("id", "path", "size", "tag"), "candidates")
        return written(hash_mounted(chosen), "hashes").count()

    return {"crawl": crawl_tree, "hash_mounted": hash_tree}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    base = tempfile.mkdtemp(prefix="run-")
    spark = session(cores, f"{base}/shared")
    path = f"{base}/scan"
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    content = content_files(spark, sf_dir)
    drain(spark.range(1000).groupBy(F.col("id") % 7).count())

    timed("scan_and_hash", lambda: write_table(
        with_folder_id(cand.with_content_hashes(content)), path, "files"))
    files = read_table(spark, path, "files")
    timed("folders", lambda: write_table(fold.folders_of(files, ROOT_DEPTH), path, "folders"))
    folders = read_table(spark, path, "folders")
    timed("second_listing", lambda: with_folder_id(second_scan(spark, sf_dir)).write.parquet(f"{base}/second"))
    second = spark.read.parquet(f"{base}/second")
    unhashed = files.withColumn("hash_value", F.lit(None).cast("string"))

    queries = {
        "hash_stage": lambda: cand.hash_candidates(content),
        "candidates": lambda: cand.candidate_files(unhashed).select("id", "path", "size"),
        "duplicate_groups": lambda: dup.duplicate_groups(files),
        "duplicate_members": lambda: dup.duplicate_members(files),
        "nested_members": lambda: dup.nested_members(files, dup.groups_by_hash_and_size(files, 1024)),
        "mark_duplicates": lambda: dup.mark_duplicates(files, dup.duplicate_groups(files), complete=True),
        "summary": lambda: rep.summary(files),
        "top_files": lambda: rep.largest_files(files),
        "console_report": lambda: out.basic_console(
            rep.largest_files(files), dup.duplicate_groups(files), dup.duplicate_members(files)),
        "rollups": lambda: fold.with_rollups(folders, files),
        "upsert_files": lambda: ups.upsert_files(files, second),
        "scope_counts": lambda: ret.scope_counts(files, folders, "/share/corpus/documents/src1"),
        "scoped_delete": lambda: ret.remaining_after_scope(files, folders, "/share/corpus/documents/src1")[0],
        "filtered_delete": lambda: ret.without(
            files, ret.select_for_deletion(files, ret.deletion_filter("/share/corpus", extensions=[".txt"]))),
    }
    for name, query in queries.items():
        timed(name, lambda query=query: drain(query()))

    # Cold times above are the headline. Warm ones, the best of three, tell changes from noise.
    warm = {}
    for name, query in queries.items():
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            drain(query())
            runs.append(time.perf_counter() - start)
        warm[name] = round(min(runs), 3)

    # The documents as files: crawl them, then hash the candidates from the mount.
    tree, mounted = f"{base}/tree", {}
    documents = content.filter("tag = 'documents'").select("path", F.col("content").cast("binary").alias("content"))
    documents.foreachPartition(lambda rows: put_files(tree, rows))
    for name, step in mounted_steps(spark, tree).items():
        start = time.perf_counter()
        mounted[f"{name}_files"] = step()
        mounted[name] = round(time.perf_counter() - start, 3)

    totals = files.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    hashing = times["scan_and_hash"]
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "files": totals["n"],
        "bytes": totals["b"],
        "scan_hash_files_per_sec": round(totals["n"] / hashing, 1),
        "scan_hash_mb_per_sec": round(totals["b"] / hashing / 1e6, 2),
        "warm": warm,
        "mounted": mounted,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
