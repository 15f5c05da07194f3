"""Every registered query against its SQL, and the golden numbers."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from checks.inventory import ROOT_DEPTH, content_files, hashed_inventory, plain_files
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.run import compare, duck
from filecairn.jobs import json_report
from filecairn.operators.candidates import candidate_files, candidate_sizes
from filecairn.operators.duplicates import duplicate_groups, duplicate_totals, groups_by_hash_and_size
from filecairn.operators.folders import folders_of
from filecairn.operators.reports import largest_files, summary, wasted_space
from tests.conftest import MEDIUM, SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(spark_entry.queries()) == set(QUERIES) | set(spark_entry.CORPUS)
    assert set(spark_entry.oracle_sql()) == set(ORACLE) | set(spark_entry.CORPUS_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SMALL, QUERIES[name], ORACLE[name])
    assert ok, note


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert (len(rows), sum(r["file_count"] for r in rows)) == (8, 17)
    assert (sum(r["total_size"] for r in rows), sum(r["wasted"] for r in rows)) == (49112, 26649)


GOLDEN = {
    SMALL: dict(
        files=377, size=697829, zero=2, sizes=33, candidates=70, unique=61, dup_ref=316,
        groups=(8, 17, 49112), wasted=26649, large=(6, 13, 46114, 25150), after=2, folders=137,
    ),
    MEDIUM: dict(
        files=1826, size=3581901, zero=11, sizes=352, candidates=814, unique=743, dup_ref=1083,
        groups=(60, 131, 307286), wasted=160948, large=(37, 80, 278708, 145637), after=34, folders=262,
    ),
}


@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_golden_numbers(spark, sf):
    want = GOLDEN[sf]
    plain = plain_files(spark, sf)
    files = hashed_inventory(spark, sf).persist()
    figures = summary(files).first()
    assert (figures["total_files"], figures["total_size"]) == (want["files"], want["size"])
    assert (figures["unique_files"], figures["duplicate_files_ref"]) == (want["unique"], want["dup_ref"])
    assert files.select("path").distinct().count() == want["files"]
    assert plain.filter("size = 0").count() == want["zero"]
    assert candidate_sizes(plain).count() == want["sizes"]
    assert candidate_files(plain).count() == want["candidates"]
    assert tuple(duplicate_totals(duplicate_groups(files)).first()) == want["groups"]
    assert wasted_space(groups_by_hash_and_size(files)).first()[0] == want["wasted"] == figures["wasted_space"]
    large = groups_by_hash_and_size(files, 1024)
    assert (*duplicate_totals(large).first(), wasted_space(large).first()[0]) == want["large"]
    assert duplicate_groups(files, "8").count() == want["after"]
    assert folders_of(plain, ROOT_DEPTH).count() == want["folders"]
    files.unpersist()


def test_subtree_golden(spark):
    rolled = QUERIES["folder_rollup_subtree"](spark, MEDIUM).filter(
        F.col("path").isin("/share/corpus/documents", "/share/corpus/pages")
    )
    assert {r["path"]: (r["subtree_files"], r["subtree_size"]) for r in rolled.collect()} == {
        "/share/corpus/documents": (1000, 2458062),
        "/share/corpus/pages": (250, 825947),
    }


def test_hashed_files_are_candidates(spark):
    files = content_files(spark, SMALL)
    hashed_ids = {r["id"] for r in QUERIES["hashed_files"](spark, SMALL).collect()}
    assert hashed_ids == {r["id"] for r in candidate_files(files.drop("content")).select("id").collect()}


def test_json_report_head_holds_the_top_files(spark):
    schema = "id long, path string, size long, mtime timestamp, tag string, top_folder string, hash_value string"
    when = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    files = spark.createDataFrame(
        [(n, f"/share/a/{n}", size, when, "scan", "/share/a", "h") for n, size in enumerate([0, 30, 10, 30], 1)], schema
    )
    group = "hash_value string, size long, file_count long, total_size long, page long, files array<struct<" + ", ".join(
        column.replace(" ", ": ") for column in schema.split(", ")[:-1]
    ) + ">>"
    none = spark.createDataFrame([], group)

    def head(rows):
        made = json_report(summary(rows), largest_files(rows, 2, nonempty=True), none, F.lit(when))["report"]
        return json.loads(made.toJSON().first())

    found = head(files)
    assert list(found) == ["topFiles", "summary", "metrics", "generatedAt"]
    assert found["topFiles"] == [
        dict(id=n, path=f"/share/a/{n}", size=30, mtime="2024-01-02 03:04:05", loaithumuc="scan", thumuc="/share/a")
        for n in (2, 4)
    ]
    assert head(files.filter("false"))["topFiles"] == []
