"""Every stage of the pipeline on awkward rows; the whole against what its stages must keep."""

from collections import Counter

import corpus_pipeline
from filecairn.llm import mixing
from tests.llm.test_operators import TEXTS, awkward, nothing, rows  # noqa: F401


def test_stages_keep_the_columns_and_their_decisions(spark, awkward):  # noqa: F811
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, awkward)
    assert {r.doc_id for r in kept.collect()} == set(range(len(TEXTS))) - {0, 1, 2, 4}
    unique = stages["near_copies"](spark, docs, awkward)
    assert not {6, 7, 8} & {r.doc_id for r in unique.collect()} and {5, 9, 13} <= {r.doc_id for r in unique.collect()}
    clean = stages["personal_data"](spark, docs, awkward).collect()
    assert len(clean) == len(TEXTS)
    assert not any("ann.lee@" in (r.text or "") or "4111 1111" in (r.text or "") for r in clean)
    assert {r.doc_id: r.text for r in clean}[14] == TEXTS[14]
    mixed = Counter(r.doc_id for r in stages["mixing"](spark, docs, awkward).collect())
    assert max(mixed.values()) <= 2
    for name in ("language", "near_copies", "personal_data", "mixing"):
        assert stages[name](spark, docs, awkward).columns == corpus_pipeline.COLUMNS


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _lines(word, n):
    return " ".join(f"{word}{k}" for k in range(n))


def _repeating(spark, extra=""):
    """Repeated and null ids: unlike texts of one id, near copies across ids, and rows that are wholly the same."""
    texts = [
        (1, _lines("a", 40)), (1, _lines("b", 40)), (None, _lines("c", 40)), (None, _lines("d", 40)), (None, _lines("e", 40)),
        (2, _lines("a", 39) + " z"), (None, _lines("a", 41)), (0, _lines("f", 40)), (1, _lines("f", 40)), (3, _lines("g", 9)),
        (3, _lines("g", 9)), (None, ""), (None, ""), (None, None), (5, None), (5, "  "), (6, _lines("e", 40)),
    ]
    rows = [(i, t, "en", ["hot", None, "web"][n % 3], None if t is None else len(t)) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_no_unlike_text_is_lost(spark):
    docs, rows = _repeating(spark)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    worded = {(i, t) for i, t in kept if t and t.strip()}
    assert worded == {
        (1, _lines("a", 40)), (1, _lines("b", 40)), (None, _lines("c", 40)), (None, _lines("d", 40)),
        (6, _lines("e", 40)), (0, _lines("f", 40)), (3, _lines("g", 9)),
    }
    assert all(kept[key] == 1 for key in worded)
    assert kept[None, ""] == 2 and kept[None, None] == kept[5, None] == kept[5, "  "] == 1


def test_mixed_rows_are_the_copies(spark):
    docs, rows = _repeating(spark)
    docs = docs.selectExpr("*", "1 as copies", "2 as _s", "'x' as draw", "3 as size", "4 as `_copy`")
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source, r["size"]] += r.copies
    mixed = Counter()
    emitted = mixing.emit(docs)
    for r in emitted.collect():
        mixed[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert emitted.columns == docs.columns
    assert mixed == +copies and sum(mixed.values()) > 10
    assert mixing.emit(docs.filter("false")).count() == 0


def test_personal_data_keeps_every_row(spark):
    docs, rows = _repeating(spark)
    clean = corpus_pipeline.personal_data(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r[0], r[1]) for r in rows)


def test_language_of_repeated_rows(spark, awkward):  # noqa: F811
    docs = spark.read.parquet(f"{awkward}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    twice = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    kept = corpus_pipeline.language(spark, twice, "")
    assert kept.count() == 2 * (len(TEXTS) - 4)


def test_pipeline_packs_what_the_stages_keep(spark, awkward, nothing):  # noqa: F811
    packed = corpus_pipeline.run(spark, awkward).collect()
    assert packed and not {0, 1, 2, 4, 6, 7, 8} & {r.doc_id for r in packed}
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    from filecairn.llm import common

    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))
    doubled = common.slim(lambda batches: (2 * b for b in batches))
    for value in doubled(iter([1, 2])):
        seen.append(value)
    assert seen == [2, 4, "released"]
    monkeypatch.undo()
    common.release()
