"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecairn.llm.common import WORD, running, text_of
from filecairn.plans.cut import written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``source, source_size, docs, target``: the words each source is to give.

    ``weights`` go round the sources by code point, null last. Sources fill in the order of
    limit per weight: while a source's share of what is left reaches its limit it stops there,
    and from the first that stays below on, all others share what is left by weight. Works on
    one row per source; the window over them is the only ordered step.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = running(per, [F.col("source").asc_nulls_last()], {"_seen": F.col("source_size")})
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", choice.cast("long")).withColumn("_cap", F.col("source_size") * max_repeats)
    ranked = written(ranked.select("source", "source_size", "docs", "position", "_w", "_cap"), "sources")
    sums = ranked.agg(F.sum("source_size").alias("n"), F.sum("_w").alias("w")).first()
    # Hundredths of words, so that the share is a whole number.
    budget, weight = (sums["n"] or 0) * share_percent, sums["w"] or 1
    filled = running(
        ranked.withColumnRenamed("position", "_no"),
        [F.col("_cap") / F.col("_w"), F.col("_no")],
        {"_caps": F.col("_cap"), "_ws": F.col("_w")},
    )
    wide = "decimal(38,0)"
    left = F.lit(budget).cast(wide) - (F.col("_caps") - F.col("_cap")).cast(wide) * 100
    weight_left = F.lit(weight).cast(wide) - (F.col("_ws") - F.col("_w")).cast(wide)
    stops = F.col("_cap").cast(wide) * 100 * weight_left <= F.col("_w").cast(wide) * left
    filled = written(filled.withColumn("_stops", stops), "filled")
    stopped = filled.filter("_stops").agg(F.sum("_cap").alias("c"), F.sum("_w").alias("w")).first()
    rest, rest_w = budget - 100 * (stopped["c"] or 0), max(weight - (stopped["w"] or 0), 1)
    share = (F.col("_w") * F.lit(rest)).cast("double") / F.lit(float(100 * rest_w))
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(share)
    return filled.select("source", "source_size", "docs", target.alias("target"))


def draw_key(docs: DataFrame, seed: str) -> Column:
    """The number a document is drawn by: all 64 bits follow from seed, id and text, and from nothing else."""
    return F.xxhash64(F.lit(seed), docs["doc_id"].cast("string"), text_of(docs))


def measured(docs: DataFrame, seed: str) -> DataFrame:
    """``doc_id, source, size, draw`` of every row, written."""
    return written(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
        draw_key(docs, seed).alias("draw"),
    ), "sizes")


def source_rates(sizes: DataFrame, **options) -> DataFrame:
    """``source, source_size, target, whole, cut``: copies of every document, and who gets one more.

    The rate of a source is target / source_size; ``whole`` is its floor. A document gets a further copy if
    its draw is at most ``cut``. Draws are uniform, so a cut at the fraction of their range would take that
    share of the words on average only, and miss a small source's target by a tenth and more. The cut is
    therefore moved to the draw at which the words taken come nearest the target.
    """
    targets = written(source_targets(sizes, **options), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(
        "source", "source_size", "target", F.floor(rate).alias("whole"),
        (F.col("target") - F.floor(rate) * F.col("source_size")).alias("_extra"),
    )
    # Rows that are drawn by one number are taken together.
    steps = sizes.filter("size > 0").groupBy("source", "draw").agg(F.sum("size").alias("_size"))
    summed = running(steps, [F.col("source").asc_nulls_last(), F.col("draw")], {"_upto": F.col("_size")})
    first = summed.groupBy("source").agg(F.min(F.col("_upto") - F.col("_size")).alias("_before"))
    known = rates.join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    known = written(known, "rates")
    wanted = known.select(F.col("source").alias("_s"), "_extra", "_before")
    # No hint: Spark broadcasts the sources where they are measured to be small, and splits hot ones elsewhere.
    taken = summed.join(wanted, F.col("source").eqNullSafe(F.col("_s")))
    off = F.abs(F.col("_upto") - F.col("_before") - F.col("_extra"))
    nearest = taken.groupBy("_s").agg(F.min(F.struct(off.alias("off"), F.col("draw").alias("draw"))).alias("_near"))
    joined = known.join(nearest, F.col("source").eqNullSafe(F.col("_s")), "left")
    # Without a further copy anywhere, the target is missed by the whole rest.
    cut = F.when(F.col("_near.off") < F.col("_extra"), F.col("_near.draw"))
    return written(joined.select("source", "source_size", "target", "whole", cut.alias("cut")), "cuts")


def _copies(whole: Column, cut: Column, draw: Column) -> Column:
    return (whole + F.when(cut.isNotNull() & (draw <= cut), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Copies of every document in the mix: ``doc_id, source, size, source_size, target, copies, taken``.

    Each document is emitted floor(rate) times and once more if its own draw, hashed from seed, id and
    text, is at most the cut of its source (see ``source_rates``). Reruns agree.

    Sizes count words; null and empty texts have none and a source without words takes nothing.
    A null source is a source. Rows that repeat id and text are drawn together. An empty table gives no rows.
    """
    sizes = measured(docs, seed)
    rates = source_rates(sizes, **options).withColumnRenamed("source", "_s")
    return sizes.join(rates, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", _copies(F.col("whole"), F.col("cut"), F.col("draw")).alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed documents themselves, each repeated as often as the mix takes it.

    A row's copies follow from its own draw and its source, so rows meet one row per source and
    nothing else: ids may repeat or be null, and columns may have any names.
    """
    # Names that no column of the caller has.
    free = "_" * (1 + max(map(len, docs.columns)))
    rates = source_rates(measured(docs, seed), **options).select(
        F.col("source").alias(f"s{free}"), F.col("whole").alias(f"w{free}"), F.col("cut").alias(f"c{free}")
    )
    joined = docs.join(rates, docs["source"].cast("string").eqNullSafe(rates[f"s{free}"]))
    copies = _copies(F.col(f"w{free}"), F.col(f"c{free}"), draw_key(docs, seed))
    each = F.explode(F.sequence(F.lit(1), copies)).alias(f"n{free}")
    return joined.filter(copies > 0).select(*[docs[f"`{c}`"] for c in docs.columns], each).drop(f"n{free}")
