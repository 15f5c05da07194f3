"""Bins of equal load: which task reads which files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.plans.ordering import cumulative


def load_bins(df: DataFrame, load: str, target: int, order: list[Column]) -> tuple[DataFrame, int]:
    """Rows with a ``bin`` from 0 and the number of bins, largest rows first.

    A row of at least ``target`` load is a bin of its own; the others, in descending order, are cut where
    their running total passes a multiple of ``target``. So a bin of several rows holds less than
    twice the target, and there are at most total / target + 1 bins. ``order`` breaks ties.
    """
    if target < 1:
        raise ValueError("the target load of a bin must be positive")
    alone = F.col(load) >= target
    whole = df.agg(
        F.count_if(alone).alias("alone"),
        F.coalesce(F.sum(F.when(~alone, F.col(load))), F.lit(0)).alias("rest"),
    ).first()
    placed = cumulative(
        df, [F.desc(load), *order], {"_alone": F.when(alone, 1).otherwise(0), "_rest": F.when(alone, 0).otherwise(F.col(load))}
    )
    shared = whole["alone"] + F.floor((F.col("_rest") - F.col(load)) / F.lit(target))
    number = F.when(alone, F.col("_alone") - 1).otherwise(shared)
    bins = whole["alone"] + -(-whole["rest"] // target)
    return placed.withColumn("bin", number.cast("int")).drop("_alone", "_rest"), max(1, bins)


def bin_loads(binned: DataFrame, load: str) -> DataFrame:
    """Rows and load of each bin."""
    return binned.groupBy("bin").agg(F.count("*").alias("files"), F.sum(load).alias("load"), F.max(load).alias("largest"))
