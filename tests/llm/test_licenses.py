"""Recall of damaged notices, whole license texts, and what must not match."""

import os
import random

import pytest

from filecairn.llm import licenses

SCHEMA = "doc_id long, text string, license int, windows int, _row int, _w int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def _filler(pick, n):
    return " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))


def _share(text, template):
    have = set(licenses._ngrams(text))
    want = set(licenses._ngrams(template))
    return len(have & want) / len(want)


def _damaged(pick, template, least):
    """The template with some words replaced, as many as leave the share of its shingles at ``least`` or more."""
    words = template.split()
    for _ in range(pick.randrange(1, 4)):
        tried = list(words)
        tried[pick.randrange(len(words))] = f"x{pick.randrange(10**6)}"
        if _share(" ".join(tried), template) >= least:
            words = tried
    return " ".join(words)


def test_damaged_notices_are_found(spark):
    pick = random.Random(11)
    long = {name: t for name, t in licenses.TEMPLATES.items() if len(licenses._ngrams(t)) >= 12}
    rows, planted = [], {}
    for k in range(600):
        name = pick.choice(sorted(long))
        notice = _damaged(pick, long[name], licenses.CONTAINMENT)
        text = f"{_filler(pick, pick.randrange(60))} {notice} {_filler(pick, pick.randrange(60))}"
        rows.append((k, text))
        planted[k] = (name, _share(text, long[name]))
    rows += [(1000 + k, _filler(pick, 80)) for k in range(50)]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan_licenses(table(spark, rows)).collect()}
    found = sum((k, name) in got for k, (name, _) in planted.items())
    print("recall", found / len(planted), "damaged", sum(s < 1 for _, s in planted.values()))
    assert found >= 0.99 * len(planted) and sum(s < 1 for _, s in planted.values()) > 300
    assert all(got[k, name] == pytest.approx(s) for k, (name, s) in planted.items() if (k, name) in got)
    assert not any(i >= 1000 for i, _ in got)


def test_whole_texts_as_templates(spark, tmp_path):
    pick = random.Random(3)
    texts = {name: _filler(pick, 700) for name in ("One-1.0", "Two-2.0")}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "short").write_text("too short")
    os.makedirs(tmp_path / "folder")
    templates = licenses.templates_in(str(tmp_path))
    assert templates == texts
    rows = [
        (1, f"{_filler(pick, 40)} {texts['One-1.0']} {_filler(pick, 40)}"),
        (2, f"{_filler(pick, 300)} {' '.join(texts['Two-2.0'].split()[:640])}"),
        (3, " ".join(texts["Two-2.0"].split()[:300])), (None, None), (4, ""),
    ]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(table(spark, rows), templates).collect()}
    assert got == {(1, "One-1.0"), (2, "Two-2.0")}


def test_repeated_rows_and_null_ids(spark):
    notice = licenses.TEMPLATES["BSD"]
    rows = [(None, f"a {notice}"), (None, f"b {notice}"), (7, notice), (7, notice), (8, "nothing of the kind is here")]
    got = [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "BSD")] * 2 + [(7, "BSD")] * 2))
    assert licenses.scan_licenses(table(spark, rows).filter("false")).collect() == []


def test_bands_follow_from_the_containment():
    assert licenses.window_similarity(0.75) == pytest.approx(0.703125 / (2 - 0.703125))
    bands = licenses.bands_for(licenses.window_similarity(0.75))
    assert (1 - licenses.window_similarity(0.75) ** licenses.ROWS) ** bands <= licenses.MISS
