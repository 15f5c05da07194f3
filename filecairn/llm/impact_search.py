"""Exact top-k by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filecairn.llm.common import running
from filecairn.plans.cut import written

TOP = 5
EVERY = 50
SCALE = 256
LEVELS = 512
# Components of the queries of one round, of the sample that bounds them from below, and of one block of candidates.
QUERY_CELLS = 4 << 20
SAMPLE_CELLS = 128 << 10
SAMPLE_ROWS = 2048
BLOCK_CELLS = 2 << 20
PIVOTS = 48
QUERY_ROWS = 1024
# Dimensions read between two looks at the bounds, and rows so few that they are scored at once.
TIER = 8
ENOUGH = 32
# What rounding in the bounds, relative to the longest vectors, may hide.
_SLIP = 1e-4
_EXACT = float(1 << 52)
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components floor(scale * x); vectors that are null or hold null or non-finite parts are left out."""
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = vectors.filter(good & F.col("vec_id").isNotNull())
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def fits_doubles(queries: np.ndarray, values: np.ndarray) -> bool:
    """Whether every partial sum of the products is a whole number that doubles hold exactly."""
    if not queries.size or not values.size:
        return True
    largest = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(values.astype(np.float64)).max())
    return 2 * largest * queries.shape[1] < _EXACT


class Index:
    """Posting segments of one block: in each dimension, the vectors of each quantised value.

    A segment is told by its base; every vector has one segment in each dimension, so the bases are
    kept by dimension. Alike vectors, those of one pivot, lie side by side as a group with a centre and a radius.
    """

    def __init__(self, values: np.ndarray, ids: np.ndarray, pivots: np.ndarray, levels: int = LEVELS):
        exact = values.astype(np.float64)
        nearest = np.zeros(len(exact), int)
        if len(pivots):
            nearest = np.argmax(exact @ pivots.T - (pivots**2).sum(axis=1) / 2, axis=1)
        order = np.lexsort((ids, nearest))
        self.exact, self.ids = exact[order], ids[order]
        self.first, self.last = _runs(nearest[order])
        low = self.exact.min(axis=0)
        self.spread = self.exact.max(axis=0) - low
        step = np.maximum(1, np.ceil(self.spread / levels))
        base = low + np.floor((self.exact - low) / step) * step
        # A value is its segment's base and at most this much more.
        self.error = np.minimum(step - 1, self.spread)
        # Single precision is enough for bounds: they allow for its rounding.
        self.bases = np.ascontiguousarray(base.T.astype(np.float32))
        self.squares, self.norms = self.bases**2, (base**2).sum(axis=1)
        self.longest = float(np.sqrt(max(self.norms.max(initial=0), 1)))
        self.centres = np.stack([self.exact[a:b].mean(axis=0) for a, b in zip(self.first, self.last)])
        self.radii = np.array([
            np.sqrt(((self.exact[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.first, self.last, self.centres)
        ])
        self.read = self.held = 0

    def search(self, query: np.ndarray, own: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the rows that reach ``floor``, the query's own left out.

        Groups whose centre and radius rule them out are passed over. Of the others, dimensions are read by descending
        impact, the size of the query there times how far its segments lie apart. What a vector may still gain
        is at most the length of the unread part of the query times that of the vector (Cauchy and
        Schwarz), and the rounding. A vector leaves only when its score so far and this gain are below the
        floor; those left at the end are scored exactly. Equal scores stay: a smaller id may win the tie.
        """
        width = len(query)
        self.held += len(self.ids) * width
        length = float(np.sqrt(query @ query))
        margin = _SLIP * (1 + length * self.longest)
        blur = np.float32(0.1 * _SLIP * (length * self.longest) ** 2)
        reach = self.centres @ query + length * self.radii + margin
        groups = np.flatnonzero(reach >= floor)
        if not len(groups):
            return np.zeros(0), np.zeros(0, np.int64)
        rows = None
        if len(groups) < len(self.first):
            rows = np.concatenate([np.arange(self.first[g], self.last[g]) for g in groups])
        order = np.argsort(-np.abs(query) * self.spread, kind="stable")
        slack = float(np.maximum(query, 0) @ self.error) + margin
        unread = np.append(np.cumsum((query[order] ** 2)[::-1])[::-1], 0.0)
        single = query.astype(np.float32)
        score = np.zeros(len(self.ids) if rows is None else len(rows), np.float32)
        rest = (self.norms if rows is None else self.norms[rows]).astype(np.float32)
        for at in range(0, width, TIER):
            dims = order[at : at + TIER]
            here = np.ix_(dims, rows) if rows is not None else dims
            self.read += len(score) * len(dims)
            score += single[dims] @ self.bases[here]
            rest -= self.squares[here].sum(axis=0)
            gain = np.sqrt(np.float32(unread[at + len(dims)]) * np.maximum(rest, 0) + blur)
            kept = np.flatnonzero(score + gain >= np.float32(floor - slack))
            if 4 * len(kept) < 3 * len(score):
                rows = kept if rows is None else rows[kept]
                score, rest = score[kept], rest[kept]
                if len(rows) <= ENOUGH:
                    break
        rows = np.arange(len(self.ids)) if rows is None else rows
        rows = rows[self.ids[rows] != own]
        exact = self.exact[rows] @ query
        good = exact >= floor
        return exact[good], self.ids[rows[good]]


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of equal values begins and ends."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, int)
    return first, np.append(first[1:], len(ordered)) if len(first) else first


def _huge(ids, queries, candidate_ids, candidates, top) -> list[list[tuple[int, int]]]:
    """Best rows where doubles would round: Python's integers, what 64 bits do not hold at their ends."""
    exact = candidates.astype(object) @ queries.astype(object).T
    found = []
    for k, own in enumerate(ids.tolist()):
        scored = [
            (min(max(int(s), _LONG[0]), _LONG[1]), i) for s, i in zip(exact[:, k], candidate_ids.tolist()) if i != own
        ]
        found.append(sorted(scored, key=lambda r: (-r[0], r[1]))[:top])
    return found


def search_block(
    ids: np.ndarray, queries: np.ndarray, start: np.ndarray, candidate_ids: np.ndarray, candidates: np.ndarray,
    pivots: np.ndarray, top: int,
) -> tuple[list[list[tuple]], tuple[int, int]]:
    """Best (score, id) of one block for each query, and how many segments were read of how many."""
    if not fits_doubles(queries, candidates):
        return _huge(ids, queries, candidate_ids, candidates, top), (1, 1)
    index, found = Index(candidates, candidate_ids, pivots), []
    for own, query, floor in zip(ids.tolist(), queries.astype(np.float64), start.tolist()):
        scores, members = index.search(query, own, floor)
        best = np.lexsort((members, -scores))[:top]
        found.append(list(zip(scores[best].tolist(), members[best].tolist())))
    return found, (index.read, index.held)


def _searched(shared, top: int, block_cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows, starts, pivot_rows = shared.value
        ids, vectors, cells = [], [], 0
        floor = np.array(starts, np.float64)

        def answer() -> pa.RecordBatch:
            width = max(map(len, [*vectors, *query_rows, [0]]))
            found, _ = search_block(
                np.array(query_ids, np.int64), _padded(query_rows, width), floor, np.array(ids, np.int64),
                _padded(vectors, width), _padded(pivot_rows, width).astype(np.float64), top,
            )
            # What a block has found bounds the next one.
            for k, rows in enumerate(found):
                if len(rows) == top:
                    floor[k] = max(floor[k], rows[-1][0])
            rows = [(query_ids[k], i, int(s)) for k, best in enumerate(found) for s, i in best]
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(vec_id)
                vectors.append(vector.values.to_numpy(zero_copy_only=False))
                cells += len(vectors[-1]) + 1
                if cells >= block_cells:
                    yield answer()
                    ids, vectors, cells = [], [], 0
        if ids:
            yield answer()

    return run


def start_bounds(ids: list[int], queries: list, sample: list[tuple], top: int) -> list[float]:
    """Per query the ``top``-th best score among some rows: no worse row is among the best of all."""
    width = max(map(len, [*queries, *[v for _, v in sample], [0]]))
    asked, rows = _padded(queries, width), _padded([v for _, v in sample], width)
    lowest = [-np.inf] * len(ids)
    if not fits_doubles(asked, rows):
        return lowest
    own = np.array([i for i, _ in sample], np.int64)
    for begin in range(0, len(ids), QUERY_ROWS):
        part = slice(begin, begin + QUERY_ROWS)
        scores = asked[part].astype(np.float64) @ rows.T.astype(np.float64)
        scores[np.array(ids[part], np.int64)[:, None] == own[None]] = -np.inf
        if scores.shape[1] >= top:
            lowest[part] = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top].tolist()
    return lowest


def top_by_inner_product(
    vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE,
    query_cells: int = QUERY_CELLS, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` best of all other rows for each query row.

    Queries are the rows whose vec_id is divisible by ``every``; all rows but those with the query's id are
    candidates. Scores are exact integer inner products of floor(scale * x), a shorter vector counting
    as zero where it ends; ties go to the smaller vec_id. Queries are broadcast in rounds of at most
    ``query_cells`` components (one query at least), each of which reads the candidates once. A sample of
    at most ``SAMPLE_ROWS`` rows gives each query a score it is sure to reach, and pivots to group by. Every task
    indexes its candidates in blocks of bounded size and answers every query on each, starting from what is
    sure by then; only each block's best go on.

    Vectors that are null, hold null or non-finite parts or have no id take no part. A query id
    that repeats with different vectors keeps the least vector; candidates that repeat an id count as separate rows. A
    query with fewer candidates gets all; an empty table gives no rows. Components beyond 64 bits count as the
    largest or least that 64 bits hold, and so do scores.
    """
    usable = whole_vectors(vectors, scale)
    spark = vectors.sparkSession
    known = usable.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    queries = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(running(queries, [F.col("vec_id")], {"cells": F.size("v") + 1}), "queries")
    number = F.floor((F.col("cells") - F.size("v") - 1) / F.lit(query_cells))
    rounds = queries.agg(F.max(number)).first()[0]
    # At most SAMPLE_CELLS components; which rows these are does not change the result.
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_CELLS // max(1, known["width"])))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < F.lit(int(2 * rows / max(1, known["rows"]) * 1_000_003) + 1)
    sample = [(r["vec_id"], r["v"]) for r in usable.filter(share).limit(rows).collect()]
    pivots = [v for _, v in sample[:PIVOTS]]
    found = None
    for n in range(-1 if rounds is None else rounds + 1):
        part = queries.filter(number == n).orderBy("vec_id").collect()
        ids, asked = [r["vec_id"] for r in part], [r["v"] for r in part]
        shared = spark.sparkContext.broadcast((ids, asked, start_bounds(ids, asked, sample, top), pivots))
        answers = usable.mapInArrow(_searched(shared, top, block_cells), "query_id long, vec_id long, score long")
        if rounds:
            answers = written(answers, "answers")
        found = answers if found is None else found.unionByName(answers)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
