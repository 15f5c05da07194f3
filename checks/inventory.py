"""The test tables read as a file inventory of four tagged roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecairn.functions.paths import path_id
from filecairn.operators.candidates import with_content_hashes
from filecairn.operators.folders import folders_of
from filecairn.sources.tables import describe

ROOTS = [
    ("/share/corpus/documents", "documents"),
    ("/share/corpus/pages", "pages"),
    ("/share/corpus/conversations", "conversations"),
    ("/share/corpus/benchmark", "benchmark"),
]
ROOT_DEPTH = 3
NOW = "timestamp_ntz'2024-06-01 12:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, row_id: str, path: str, content: str, tag: str) -> DataFrame:
    return df.select(
        F.expr(row_id).alias("id"),
        F.expr(path).alias("path"),
        F.expr(content).alias("content"),
        F.lit(tag).alias("tag"),
    )


def content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, content, tag of every file: one union over the four roots."""
    root = "'/share/corpus/"
    parts = [
        _rows(
            table(spark, sf_dir, "documents"), "1000000000 + doc_id",
            f"concat({root}documents/', source, '/', lang, '/doc_', doc_id, '.txt')",
            "if(doc_id % 97 = 13, '', text)", "documents",
        ),
        _rows(
            table(spark, sf_dir, "pages"), "2000000000 + page_id",
            f"concat({root}pages/', regexp_extract(url, '^https?://([^/]+)', 1), '/p_', page_id, '.html')",
            "html", "pages",
        ),
        _rows(
            table(spark, sf_dir, "conversations"), "3000000000 + conv_id * 1000 + turn",
            f"concat({root}conversations/', conv_id, '/', turn, '_', role, '.msg')", "text", "conversations",
        ),
        _rows(
            table(spark, sf_dir, "benchmark"), "4000000000 + item_id",
            f"concat({root}benchmark/item_', item_id, '.TXT')", "text", "benchmark",
        ),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def content_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unhashed inventory with the content column."""
    return describe(content_rows(spark, sf_dir)).select(
        "id", "path", "dir_path", "filename", "file_ext",
        F.octet_length("content").cast("long").alias("size"),
        F.expr("timestampadd(SECOND, id % 86400, timestamp_ntz'2024-01-01 00:00:00')").alias("mtime"),
        F.lit(None).cast("string").alias("hash_value"),
        F.lit(False).alias("is_duplicate"),
        "tag", "top_folder", "content",
    )


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unhashed inventory."""
    return content_files(spark, sf_dir).drop("content")


def hashed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory after the hash stage: candidates carry their MD5."""
    return with_content_hashes(content_files(spark, sf_dir))


def folder_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the inventory from the tag roots down.

    Ids come from MD5 here so that another engine can compute them too.
    """
    as_id = lambda path: F.conv(F.substring(F.md5(path), 1, 15), 16, 10).cast("long")
    return folders_of(plain_files(spark, sf_dir), ROOT_DEPTH, as_id)


def second_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan: two roots seen again with changes, and one new root.

    Documents and pages grew by a byte and a day; every customer is a new file.
    """
    again = plain_files(spark, sf_dir).filter(F.col("tag").isin("documents", "pages")).select(
        "id", "path", (F.col("size") + 1).alias("size"),
        F.expr("mtime + interval 1 day").alias("mtime"), F.lit("rescan").alias("tag"),
    )
    new = table(spark, sf_dir, "customer").select(
        F.expr("5000000000 + c_custkey").alias("id"),
        F.expr("concat('/share/corpus/extra/', lower(c_mktsegment), '/c_', c_custkey, '.rec')").alias("path"),
        F.expr("cast(octet_length(c_name) as bigint)").alias("size"),
        F.expr("timestamp_ntz'2024-01-02 00:00:00'").alias("mtime"),
        F.lit("extra").alias("tag"),
    )
    return describe(again.unionByName(new)).select(
        "id", "path", "dir_path", "filename", "file_ext", "size", "mtime",
        F.lit(None).cast("string").alias("hash_value"), F.lit(False).alias("is_duplicate"),
        "tag", "top_folder",
    )


def with_folder_id(files: DataFrame) -> DataFrame:
    return files.withColumn("folder_id", path_id(F.col("dir_path")))
