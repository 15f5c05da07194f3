"""Exact search against brute force on awkward vectors, and how much of the index it reads."""

import numpy as np
import pytest

from filecairn.llm import impact_search
from filecairn.llm.impact_search import search_block, start_bounds, top_by_inner_product

SCHEMA = "vec_id long, embedding array<double>, v int, position int, rank int, query_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def _brute(rows, every, top):
    good = [
        (i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    limit = (-(1 << 63), (1 << 63) - 1)
    clip = lambda x: min(max(x, limit[0]), limit[1])
    good = [(i, [clip(x) for x in v]) for i, v in good]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in good if i != q)[:top]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def _search(spark, rows, every=5, top=5, **bounds):
    return sorted(map(tuple, top_by_inner_product(table(spark, rows), every, top, **bounds).collect()))


@pytest.mark.parametrize("bounds", [{}, {"query_cells": 20}, {"block_cells": 100}])
def test_search_against_brute_force(spark, bounds):
    rng = np.random.default_rng(1)
    rows = [(int(i), list(map(float, rng.normal(size=12) / 3))) for i in range(200)]
    # Ties, repeated ids and vectors, other widths, nulls and non-finite parts.
    rows += [(300 + i, rows[7][1]) for i in range(9)] + [rows[10], rows[11], (10, rows[3][1]), (15, [0.5])]
    rows += [(20, [0.1] * 14), (25, []), (None, rows[0][1]), (30, None), (35, [1.0, None]), (40, [float("nan")] * 12), (45, [float("-inf")] + [0.0] * 11)]
    assert _search(spark, rows, **bounds) == _brute(rows, 5, 5)


def test_components_beyond_what_doubles_hold(spark):
    rows = [(k, [s * 3e14, 1.0 + k, 1e-3]) for k, s in enumerate([1, -1, 1, 0, 2, -2, 1, 1])]
    assert _search(spark, rows) == _brute(rows, 5, 5)
    rows.append((8, [1e300, 0.0, 0.0]))
    assert _search(spark, rows) == _brute(rows, 5, 5)


def test_fewer_candidates_than_wanted(spark):
    assert _search(spark, [(5, [1.0, 2.0]), (6, [-1.0, 0.0])]) == [(5, 1, 6, -256 * 256)]
    assert _search(spark, [(5, [1.0])]) == [] and _search(spark, [(6, [1.0])]) == [] and _search(spark, []) == []


def _share(values, queries):
    ids = np.arange(len(values))
    asked = ids[:queries]
    sample = [(int(i), values[i]) for i in range(0, len(values), 4)]
    start = np.array(start_bounds(asked.tolist(), list(values[:queries]), sample, 5))
    found, (read, held) = search_block(asked, values[:queries], start, ids, values, values[::97].astype(float), 5)
    for q in range(queries):
        scores = values @ values[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        assert [(s, i) for s, i in found[q]] == [(scores[i], i) for i in best if scores[i] >= start[q]]
    return read / held


def test_segments_are_left_unread():
    """Unlike vectors: half of the segments are never read. Clusters: hardly any is."""
    rng = np.random.default_rng(3)
    unlike = np.floor(256 * rng.normal(size=(4000, 64)) / 8).astype(np.int64)
    centres = rng.normal(size=(40, 64))
    clustered = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) / 12) / 8).astype(np.int64)
    shares = _share(unlike, 60), _share(clustered, 60)
    print("share of segments read:", shares)
    assert shares[0] < 0.6 and shares[1] < 0.15


def test_coarse_levels_stay_exact(monkeypatch):
    rng = np.random.default_rng(4)
    values = rng.integers(-10_000, 10_000, (1500, 16))
    monkeypatch.setattr(impact_search, "LEVELS", 8)
    assert _share(values, 40) < 1
