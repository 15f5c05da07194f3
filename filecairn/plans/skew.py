"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
MAX_HOT_KEYS = 100_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a frame has at most ``max_rows`` rows; reads no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows per key, as ``file_count``."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("file_count"))


def salted_join(
    rows: DataFrame,
    keyed: DataFrame,
    key: str,
    how: str,
    spread_by: Column,
    counts: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``rows`` to ``keyed``, whose ``key`` is unique.

    A key with more than ``rows_per_salt`` rows is spread over that many salts and
    its single ``keyed`` row repeated once per salt, so no task sees a whole hot key,
    whether it has a partner or not. ``counts`` tells the rows per key if the caller
    has them; it must list every hot key. The broadcast holds hot keys only: there are
    at most ``count(rows) / rows_per_salt`` of them. Rows without a key never match
    and are spread over all tasks.
    """
    if counts is None:
        counts = key_counts(rows, key)
    hot = counts.filter(F.col("file_count") > rows_per_salt).select(
        key, F.ceil(F.col("file_count") / F.lit(rows_per_salt)).alias("_salts")
    )
    # From ROWS_PER_SALT up the list is short by its definition; with fewer rows per salt it is counted first.
    if rows_per_salt >= ROWS_PER_SALT or fits(hot, MAX_HOT_KEYS):
        hot = F.broadcast(hot)
    spread = F.xxhash64(spread_by)
    salt = (
        F.when(F.col(key).isNull(), spread)
        .when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
        .otherwise(F.lit(0))
        .cast("long")
    )
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    right = keyed.join(hot, key, "left").withColumn("_salt", each).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
