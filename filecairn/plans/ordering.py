"""Exact positions and limits over large ordered frames without one-task windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from filecairn.plans.cut import written

# Up to so many rows every task may send its own first ones to one task.
SMALL_LIMIT = 1_000
# Rows that one task may sort.
ONE_TASK = 1_000_000
# Rows of the sample expected among those wanted; its cut lies five standard deviations further on.
SAMPLED = 400
_ROW_BITS = 33

# Columns to order by and whether descending; together they must tell all rows apart.
Order = list[tuple[str, bool]]


def cumulative(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of whole numbers in a total order.

    Rows are range-partitioned and sorted and written once. Each partition sums its own rows; only the
    totals, one row per partition, are accumulated in one task.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ordered.withColumn("_row", F.monotonically_increasing_id()), "ordered").withColumn(
        "_part", F.shiftright("_row", _ROW_BITS)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy("_part").agg(*[F.sum(c.cast("long")).alias("_t_" + n) for n, c in sums.items()])
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_b_" + n) for n in sums]
    )
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = numbered.select("*", *[F.sum(c.cast("long")).over(within).alias("_l_" + n) for n, c in sums.items()])
    # One row per partition of the sort, so the broadcast is bounded by their number.
    return local.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(F.col("_l_" + n) + F.col("_b_" + n)).cast("long").alias(n) for n in sums]
    )


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in a total order.

    Rows are range-partitioned and sorted, numbered within their partition and
    written once; only the row count per partition is accumulated in one task.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ordered.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_row", _ROW_BITS)
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # One row per partition of the sort, so the broadcast is bounded by their number.
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + local + 1).cast("long"))
        .drop("_part", "_before", "_row")
    )


def order_columns(order: Order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def _up_to(order: Order, last: Row) -> Column:
    """Condition for the rows that do not come after ``last``; nulls come first ascending, last descending."""
    condition = F.lit(True)
    for name, down in reversed(order):
        column, value = F.col(name), last[name]
        if value is None:
            before = column.isNotNull() if down else F.lit(False)
        else:
            before = column > value if down else column.isNull() | (column < value)
        condition = F.coalesce(before, F.lit(False)) | (column.eqNullSafe(F.lit(value)) & condition)
    return condition


def _above_cut(df: DataFrame, order: Order, limit: int) -> DataFrame:
    """The rows up to a cut that lies a little beyond the ``limit``-th, written.

    The cut is a row of a sample of the order columns, so ties and text columns need no care. The
    sample is so thin that ``SAMPLED`` of its rows are expected among those wanted: each task
    sends no more than about that many rows. In the unlikely case that fewer rows than wanted lie above
    the cut, the next one lies where twice as many are expected.
    """
    names = [c for c, _ in order]
    wanted = limit
    while True:
        expected = min(SAMPLED, wanted)
        rank = expected + 5 * math.isqrt(expected) + 1
        sample = df.select(*names).sample(fraction=expected / wanted, seed=17)
        # At most ``rank`` rows, about 500. If the sample has fewer, so has the frame hardly more than wanted.
        head = sample.orderBy(*order_columns(order)).limit(rank).collect()
        last = head[-1] if len(head) == rank else None
        found = Observation()
        kept = (df if last is None else df.filter(_up_to(order, last))).observe(found, F.count(F.lit(1)).alias("rows"))
        rows = written(kept, "first")
        if last is None or found.get.get("rows", 0) >= limit:
            return rows
        wanted *= 2


def first_rows(df: DataFrame, order: Order, limit: int) -> DataFrame:
    """First ``limit`` rows in a total order, however large the limit and however many the tasks.

    A small limit is Spark's own top-k. For a larger one, where every task would send that many
    rows, a cut is found first and only the rows above it are sorted.
    """
    if limit <= SMALL_LIMIT:
        return df.orderBy(*order_columns(order)).limit(limit)
    above = _above_cut(df, order, limit)
    if limit <= ONE_TASK:
        return above.orderBy(*order_columns(order)).limit(limit)
    kept = positions(above, order_columns(order), "_position").filter(F.col("_position") <= limit)
    return kept.drop("_position")


def ranked(df: DataFrame, order: Order, limit: int, name: str = "rank") -> DataFrame:
    """Top ``limit`` rows with their 1-based rank."""
    columns = order_columns(order)
    if limit > ONE_TASK:
        return positions(_above_cut(df, order, limit), columns, name).filter(F.col(name) <= limit)
    return first_rows(df, order, limit).withColumn(name, F.row_number().over(Window.orderBy(*columns)).cast("long"))
