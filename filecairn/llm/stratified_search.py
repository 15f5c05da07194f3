"""Ranked lexical search with exact integer scores over a length-stratified index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecairn.plans.cut import written

TOP = 10
# Terms asked about in one pass, and their characters: what each task holds of the queries.
ROUND_TERMS = 500_000
ROUND_CHARS = 32 << 20
# Postings in one block of the index: what a task holds of the documents.
BLOCK_POSTINGS = 2_000_000

# A term is a longest run of ASCII letters, digits and characters above ASCII; only A-Z have a lower case.
_BREAKS = [c for c in range(0x80) if not chr(c).isalnum()]
_FOLD = {**{c: " " for c in _BREAKS}, **{c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}}
COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item_no int, doc_id long, score long"


def count_terms(text: str) -> Counter:
    """How often each term stands in a whole text."""
    counts = Counter(text.translate(_FOLD).split(" "))
    counts.pop("", None)
    return counts


def _count(dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = count_terms(text.as_py() or "")
                asked = sorted((known[t], tf) for t, tf in counts.items() if t in known)
                ids.append(doc_id)
                sizes.append(sum(counts.values()))
                terms.append([t for t, _ in asked])
                tfs.append([tf for _, tf in asked])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """The terms of each item, once each; rows of one item id are one item."""
    folded = F.translate(
        F.coalesce(items["text"].cast("string"), F.lit("")),
        "".join(map(chr, _FOLD)), "".join(_FOLD.values()),
    )
    terms = items.select(items["item_id"].cast("long").alias("item_id"), F.explode(F.split(folded, " ")).alias("term"))
    return terms.filter(F.col("term") != "").distinct()


def rounds(terms: DataFrame, most_terms: int = ROUND_TERMS, most_chars: int = ROUND_CHARS) -> DataFrame:
    """Items with their sorted terms and the pass they belong to: none asks about more than the bounds.

    An item of more terms than the bounds is a pass of its own.
    """
    listed = terms.groupBy("item_id").agg(
        F.sort_array(F.collect_set("term")).alias("terms"),
        F.count("*").alias("many"), F.sum(F.length("term")).alias("chars"),
    )
    # Only one narrow row per item is counted up.
    upto = Window.orderBy(F.asc_nulls_first("item_id")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = listed.select("item_id", "many", "chars")
    before = sizes.select(
        "item_id", F.coalesce(F.sum("many").over(upto), F.lit(0)).alias("_m"),
        F.coalesce(F.sum("chars").over(upto), F.lit(0)).alias("_c"),
    )
    half = F.greatest(
        F.floor(F.col("_m") / max(1, most_terms // 2)), F.floor(F.col("_c") / max(1, most_chars // 2))
    )
    numbered = before.select(F.col("item_id").alias("_id"), half.cast("long").alias("round"))
    return listed.join(numbered, F.col("item_id").eqNullSafe(F.col("_id"))).select("round", "item_id", "terms")


class Block:
    """A stratified index of some documents: strata of one normaliser, postings by tf within a stratum.

    A segment is a term's postings of one tf in one stratum; all of them have one impact,
    worked out once per tf and stratum. The largest tf of a term in a stratum bounds what
    the term can add there.
    """

    def __init__(self, m, docs, known, starts, terms, tfs):
        self.docs, self.known = docs, known
        self.strata, stratum = np.unique(m, return_inverse=True)
        # Documents come in the order of m, so that a stratum is a stretch of them.
        self.first = np.append(np.searchsorted(stratum, np.arange(len(self.strata))), len(docs))
        owner = np.repeat(np.arange(len(docs)), np.diff(starts))
        order = np.lexsort((-tfs, stratum[owner], terms))
        self.owner, term, tf, level = owner[order], terms[order], tfs[order], stratum[owner[order]]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (level[1:] != level[:-1]) | (tf[1:] != tf[:-1])
        self.start = np.append(np.flatnonzero(new), len(term))
        self.term, self.level = term[new], level[new]
        tf = tf[new].astype(np.int64)
        pairs, at = np.unique(np.stack([tf, self.strata[self.level]]), axis=1, return_inverse=True)
        # Python's integers, for a tf that 64 bits would not hold a thousand million times.
        impacts = [1_000_000_000 * t // (1000 * t + 8 * n) for t, n in pairs.T.tolist()]
        self.impact = np.array(impacts, np.int64)[at.ravel()] if len(impacts) else np.zeros(0, np.int64)
        lead = np.ones(len(self.term), bool)
        lead[1:] = (self.term[1:] != self.term[:-1]) | (self.level[1:] != self.level[:-1])
        self.leads = lead
        self.visited = self.passed = 0

    def search(self, terms, weights, best, top):
        """The ``top`` of ``best`` and this block's documents as (score, id known, id), best first.

        Strata are visited in the order of their bounds; where the next bound is below the last of a full
        list, no document left can enter it. Equal bounds are visited: a smaller id may win the tie.
        """
        lo, hi = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        many = hi - lo
        if not many.sum():
            return best
        segments = np.repeat(lo - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        weight = np.repeat(weights, many)
        gain = weight * self.impact[segments]
        leads = self.leads[segments]
        bound = np.zeros(len(self.strata), np.int64)
        np.add.at(bound, self.level[segments][leads], gain[leads])
        by_level = np.argsort(self.level[segments], kind="stable")
        segments, gain = segments[by_level], gain[by_level]
        edges = np.searchsorted(self.level[segments], np.arange(len(self.strata) + 1))
        order = np.lexsort((np.arange(len(bound)), -bound))
        order = order[bound[order] > 0]
        at, step = 0, 1
        while at < len(order):
            if len(best) == top:
                alive = int(np.searchsorted(-bound[order], -best[-1][0], "right"))
                if at >= alive:
                    break
            else:
                alive = len(order)
            for level in order[at : min(at + step, alive)]:
                best = self._visit(level, segments[edges[level] : edges[level + 1]], gain[edges[level] : edges[level + 1]], best, top)
            at, step = min(at + step, alive), 2 * step
        self.visited += at
        self.passed += len(order) - at
        return best

    def _visit(self, level, segments, gain, best, top):
        """Exact scores of one stratum."""
        base, size = self.first[level], self.first[level + 1] - self.first[level]
        lengths = self.start[segments + 1] - self.start[segments]
        at = np.repeat(self.start[segments] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        scores = np.zeros(size, np.int64)
        np.add.at(scores, self.owner[at] - base, np.repeat(gain, lengths))
        least = max(best[-1][0], 1) if len(best) == top else 1
        hits = np.flatnonzero(scores >= least)
        if not len(hits):
            return best
        docs, known = self.docs[base + hits], self.known[base + hits]
        chosen = np.lexsort((docs, ~known, -scores[hits]))[:top]
        fresh = [(int(scores[hits[k]]), bool(known[k]), int(docs[k])) for k in chosen]
        return sorted([*best, *fresh], key=lambda f: (-f[0], not f[1], f[2]))[:top]


def _search(queries, top: int, block_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(np.array(t, np.int64), np.array(w, np.int64)) for t, w in queries.value]
        best: list[list] = [[] for _ in asked]
        held, postings = [], 0

        def close() -> None:
            table = pa.Table.from_batches(held)
            m = table.column("m").to_numpy()
            ids = table.column("doc_id")
            known = np.asarray(ids.is_valid())
            docs = ids.fill_null(0).to_numpy()
            terms = table.column("terms").combine_chunks()
            tfs = table.column("tfs").combine_chunks()
            starts = np.append(0, np.cumsum(table.column("terms").combine_chunks().value_lengths().to_numpy()))
            block = Block(m, docs, known, starts, terms.flatten().to_numpy(), tfs.flatten().to_numpy())
            for k, (wanted, weights) in enumerate(asked):
                best[k] = block.search(wanted, weights, best[k], top)

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                held.append(part)
                postings += len(part.column("terms").flatten())
                if postings >= block_postings:
                    close()
                    held, postings = [], 0
        if held:
            close()
        rows = [(k, i if known else None, s) for k, found in enumerate(best) for s, known, i in found]
        columns = list(zip(*rows)) if rows else [[]] * 3
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["item_no", "doc_id", "score"]
        )

    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _first(found: DataFrame, keys: list[str], order: list[Column], top: int, name: str = "rank") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn(name, place).filter(F.col(name) <= top)


def _one_round(docs: DataFrame, items: list, top: int, block_postings: int) -> DataFrame:
    spark = docs.sparkSession
    dictionary = {t: n for n, t in enumerate(sorted({t for item in items for t in item["terms"]}))}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = written(texts.mapInArrow(_count(spark.sparkContext.broadcast(dictionary)), COUNTED), "counted")
    whole = counted.agg(
        F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")
    ).first()
    # At most one row per term asked about in this pass.
    holding = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()
    weights = {r["t"]: weight(whole["documents"], r["df"]) for r in holding}
    queries = []
    for item in items:
        terms = sorted(dictionary[t] for t in item["terms"] if dictionary[t] in weights)
        queries.append((terms, [weights[t] for t in terms]))
    m = F.expr(f"10 + (90L * n * {whole['documents']}L) div {max(whole['length'], 1)}L").alias("m")
    hits = counted.filter(F.size("terms") > 0).select(m, "doc_id", "terms", "tfs")
    # Documents of one normaliser lie side by side; the id splits a normaliser that very many have.
    placed = hits.repartitionByRange("m", "doc_id", F.xxhash64("terms", "tfs")).sortWithinPartitions("m", "doc_id")
    found = placed.mapInArrow(_search(spark.sparkContext.broadcast(queries), top, block_postings), FOUND)
    # At most ``top`` rows per task and item are left; they are merged in two steps.
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = _first(found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64))), ["item_no", "_part"], order, top)
    names = spark.createDataFrame(
        [(n, item["item_id"]) for n, item in enumerate(items)], "item_no int, item_id long"
    )
    ranked = _first(some.drop("rank", "_part"), ["item_no"], order, top)
    # The items of one pass are bounded by its terms.
    return ranked.join(F.broadcast(names), "item_no").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    most_terms: int = ROUND_TERMS,
    most_chars: int = ROUND_CHARS,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The ``top`` documents of positive score for each item: ``item_id, rank, doc_id, score``.

    Each pass answers as many items as the two bounds allow. It counts the terms of all whole texts once and
    writes the counts of the asked ones; adds up documents, lengths and document frequencies; then lays
    documents of like length side by side and lets every task index its share, block by block,
    and search it. Short documents, whose impacts are largest, come first in a task, and what an item has found
    already holds back the strata after it.

    Equal scores are ordered by id, null ids last; rows of one document id are documents of their own, rows of
    one item id (null included) are one item. Items and documents without terms, or with a null
    text, give nothing; an empty table gives no rows; other columns do not matter.
    """
    spark = docs.sparkSession
    listed = written(rounds(item_terms(items), most_terms, most_chars), "items")
    out = None
    for number in [r["round"] for r in listed.select("round").distinct().orderBy("round").collect()]:
        # Bounded by the round.
        asked = listed.filter(F.col("round") == number).orderBy(F.asc_nulls_first("item_id")).collect()
        found = _one_round(docs, asked, top, block_postings)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
