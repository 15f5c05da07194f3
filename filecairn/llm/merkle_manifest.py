"""A Merkle manifest of a dataset: tree roots per language and over all, a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecairn.plans.cut import written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# A block is a whole subtree of 2 ** LEVELS nodes: what one array holds at most.
LEVELS = 8
TAMPER_EVERY = 7
_ROW_BITS = 33

STEP = "struct<left: string, right: string>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """Per row its tree, ``doc_id``, ``leaf``, and ``forged``: the leaf after tampering, null where there is none."""
    true = [field(docs[c]) for c in FIELDS]
    changed = [field(docs[c] + 1) if c == "n_chars" else field(docs[c]) for c in FIELDS]
    # One text per tree that orders as the languages do, null first.
    tree = F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit(""))
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(TAMPER_EVERY)) == 0
    return docs.select(
        tree.alias("tree"),
        docs["doc_id"].cast("long").alias("doc_id"),
        digest(*true).alias("leaf"),
        F.when(tampered & docs["n_chars"].isNotNull(), digest(*changed)).alias("forged"),
    )


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``rank`` (from 0) in its tree and ``n``, the tree's size, for rows ordered by tree first.

    The rows are range-sorted and written once. As a tree's rows lie side by side, a row's rank is its
    distance from the first one of the same tree and task, plus the tree's rows in earlier tasks: only
    one row per tree and task is counted up, and it meets no more rows than its task wrote.
    """
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    numbered = written(ordered.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_row", _ROW_BITS).alias("_part")
    runs = numbered.groupBy("tree", part).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "tree", "_part", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n"),
    )
    placed = numbered.withColumn("_part", part).join(starts, ["tree", "_part"])
    rank = (F.col("_row") - F.col("_first") + F.col("_before")).alias("rank")
    return placed.select("tree", rank, "n", *[c for c in rows.columns if c != "tree"])


def _node(digits: int) -> str:
    """Type of a subtree that many levels high."""
    kind = "struct<rank: bigint, hash: string, doc_id: bigint, forged: string>"
    for _ in range(digits):
        kind = f"struct<hash: string, kids: array<{kind}>>"
    return kind


def blocks(nodes: DataFrame, height: int, levels: int = LEVELS) -> DataFrame:
    """Roll nodes up by ``levels`` levels: one row per tree and block, with the block's ``hash`` and ``node``.

    ``nodes`` have a tree, its size ``n`` in leaves, a rank, and ``node``; they are ``height`` levels above
    the leaves. Every grouping takes the last binary digit of the rank away and nests the one or two
    nodes that differ in it. All groupings but the first keep the partitioning by tree and
    block, so there is one shuffle. A tree that is down to one node rises without being hashed.
    """
    block = F.shiftright("rank", levels).alias("block")
    digits = [F.shiftright("rank", d).bitwiseAND(F.lit(1)).alias(f"digit{d}") for d in range(levels)]
    rows = nodes.select("tree", "n", block, *digits, "node").repartition("tree", "block")
    for level in range(levels):
        kept = ["tree", "n", "block", *[f"digit{d}" for d in range(level + 1, levels)]]
        kids = F.sort_array(F.collect_list(F.struct(f"digit{level}", "node")))
        grouped = rows.groupBy(*kept).agg(F.transform(kids, lambda k: k["node"]).alias("kids"))
        below = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        several = F.col("n") > F.lit(1 << (height + level))
        hashed = F.when(several, F.sha2(below, 256)).otherwise(below)
        rows = grouped.select(*kept, F.struct(hashed.alias("hash"), "kids").alias("node"))
    return rows.select("tree", "n", "block", F.col("node.hash").alias("hash"), "node")


def _split(found: Column, level: int, n: Column) -> Column:
    """From (node, path) pairs to the pairs of their children: a child's path starts with its sibling."""

    def of(pair: Column) -> Column:
        kids, path = pair["node"]["kids"], pair["path"]

        def step(k: Column, place: Column) -> Column:
            other = F.coalesce(F.try_element_at(kids, F.lit(2) - place)["hash"], F.lit(""))
            own = F.struct(
                F.when(place == 1, other).otherwise("").alias("left"),
                F.when(place == 0, other).otherwise("").alias("right"),
            )
            longer = F.when(n > F.lit(1 << level), F.concat(F.array(own), path)).otherwise(path)
            return F.struct(k.alias("node"), longer.alias("path"))

        return F.transform(kids, step)

    return F.flatten(F.transform(found, of))


def unfold(found: DataFrame, height: int, levels: int, carry: list[str]) -> DataFrame:
    """One row per node below the given blocks: the ``carry`` columns, ``node`` and its ``path`` to the top.

    The blocks have the ``path`` above them. One transform per level hands it down inside the
    row, the explode comes last.
    """
    pairs = F.array(F.struct("node", "path"))
    rows = found.select("n", *carry, pairs.alias("found"))
    for level in reversed(range(levels)):
        rows = rows.withColumn("found", _split(F.col("found"), height + level, F.col("n")))
    return rows.select("n", *carry, F.explode("found").alias("_f")).select("n", *carry, "_f.node", "_f.path")


def _tiers(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """Written blocks over blocks until each tree is one block; the last has the trees' roots."""
    tiers, height = [], 0
    while True:
        made = written(blocks(nodes, height, levels), f"{name}{len(tiers)}")
        tiers.append(made)
        height += levels
        if (made.agg(F.max("block")).first()[0] or 0) == 0:
            return tiers
        nodes = made.select("tree", "n", F.col("block").alias("rank"), _inner("block", "hash"))


def _inner(rank: str, hashed: str) -> Column:
    none = F.lit(None)
    return F.struct(
        F.col(rank).cast("long").alias("rank"), F.col(hashed).alias("hash"),
        none.cast("long").alias("doc_id"), none.cast("string").alias("forged"),
    ).alias("node")


def _down(tiers: list[DataFrame], tops: DataFrame, levels: int, carry: list[str]) -> DataFrame:
    """Paths of the nodes of the lowest tier; ``tops`` has the path above each tree and the ``carry`` columns."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(range(len(tiers))):
        # Block rows meet the paths above them, one each; the nodes below never take part in a join.
        found = tiers[tier].join(above, ["tree", "block"])
        below = unfold(found, tier * levels, levels, ["tree", *carry])
        if tier == 0:
            return below
        above = below.select("tree", F.col("node.rank").alias("block"), "path", *carry)
    raise AssertionError("a tree has at least one tier")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots and proof of each row, and whether the row as it is found still folds to the root.

    Columns ``doc_id``, ``leaf``, ``subroot``, ``root``, ``path`` (what stands to the left and right at each
    level, from the leaf up), ``forged`` and ``folded_root``. Leaves are ordered by ``doc_id`` in their
    language, null ids first and rows of one id by leaf; rows equal in all five columns are leaves
    of their own. Null columns are ``-``. An empty table gives no rows; other columns do not matter.

    Three parts are written below the shared folder: the ranked leaves, the blocks of each tier, and
    the blocks over the languages' roots. No row holds more than ``2 ** levels`` nodes, whatever the
    share of one language. Paths reach a tier by one join of its block rows.
    """
    placed = ranked(leaves(docs), [F.asc_nulls_first("doc_id"), F.asc("leaf")])
    node = F.struct("rank", F.col("leaf").alias("hash"), "doc_id", "forged").alias("node")
    tiers = _tiers(placed.select("tree", "n", "rank", node), "blocks", levels)
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("hash").alias("subroot"))
    listed = written(ranked(subroots, [F.asc("name")]), "subroots")
    upper = _tiers(listed.select("tree", "n", "rank", _inner("rank", "subroot")), "roots", levels)
    root = upper[-1].select("tree", F.col("hash").alias("root"), F.lit(None).cast(f"array<{STEP}>").alias("path"))
    empty = root.withColumn("path", F.coalesce("path", F.array().cast(f"array<{STEP}>")))
    over = _down(upper, empty, levels, ["root"]).select(F.col("node.rank").alias("rank"), "path", "root")
    tops = listed.join(over, "rank").select(F.col("name").alias("tree"), "path", "subroot", "root")
    found = _down(tiers, tops, levels, ["subroot", "root"])
    shown = F.coalesce("node.forged", "node.hash")
    folded = F.aggregate("path", shown, lambda acc, s: digest(s["left"], acc, s["right"]))
    return found.select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.hash").alias("leaf"), "subroot", "root",
        "path", F.col("node.forged").alias("forged"), folded.alias("folded_root"),
    )


def verify(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest with one digest for each proof and the outcome of folding it."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return manifest(docs, levels).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
