"""Reading the corpus tables, exact running sums, the word pattern."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecairn.plans.cut import written

# Fixed value: a word is a longest run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_ROW_BITS = 33


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text as a string, empty where it is null."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add ``position`` (from 1) and inclusive running sums in a total order.

    Rows are range-partitioned by the order and written once. Each partition sums its own
    rows; only one row per partition, its totals, meets in one task to give the offsets.
    """
    names = ["position", *sums]
    values = {"position": F.lit(1), **sums}
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ordered.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    numbered = numbered.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy("_part").agg(*[F.sum(values[n].cast("long")).alias("_t_" + n) for n in names])
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_b_" + n) for n in names]
    )
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = numbered.select("*", *[F.sum(values[n].cast("long")).over(within).alias("_l_" + n) for n in names])
    # One row per partition of the sort, so the broadcast is bounded by their number.
    return local.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(F.col("_l_" + n) + F.col("_b_" + n)).cast("long").alias(n) for n in names]
    )


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)
    if trim:
        trim(0)


def slim(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, whose memory goes back at its end."""
    def over(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return over
