"""Disclosing terms against a brute-force count over whole texts, and what becomes of them."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filecairn.llm import sanitize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, terms int, t int, `_of` int, `_terms` int, text_hash int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def _terms(text):
    out = []
    for word in re.finditer(r"\S+", text):
        if "@" not in word[0]:
            out += [(m[0].lower(), word.start() + m.start(), word.start() + m.end()) for m in re.finditer(r"[^\W\d_]+(?:['-][^\W\d_]+)*", word[0])]
    return out


def _class(term):
    return term[: (len(term) + 1) // 2] + "*"


def _brute(texts, support, disclosure):
    """Disclosing terms and classes over distinct texts, by the definition."""
    distinct = {t for t in texts if t is not None} | ({""} if None in texts else set())
    held = {t: {x for w, _, _ in _terms(t) for x in (w, _class(w))} for t in distinct}
    units = defaultdict(set)
    for text in distinct:
        per = defaultdict(list)
        for kind, a, b in sanitize.find(text):
            value = text[a:b].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[a:b])
            before, after = text[:a].split()[-8:], text[b:].split()[:8]
            per[kind, value].append(" ".join(w for part in (before, after) for w, _, _ in _terms(" ".join(part))))
        for entity, contexts in per.items():
            units[entity].add((min(contexts, key=sanitize._hash), text))
    found = set()
    for contexts in units.values():
        by_context = defaultdict(list)
        for context, text in contexts:
            by_context[context].append(text)
        kept = {min(same, key=sanitize._hash) for same in by_context.values()}
        if len(by_context) < support:
            continue
        for term in set().union(*(held[t] for t in kept)):
            n_et = sum(term in held[t] for t in kept)
            n_t = sum(term in h for h in held.values())
            ic = math.log2(len(distinct) / len(by_context))
            if n_et >= support and ic > 0 and math.log2(len(distinct) * n_et / (len(by_context) * n_t)) >= disclosure * ic - 1e-12:
                found.add(term)
    return found


def _corpus(seed=4):
    pick = random.Random(seed)
    words = [f"{a}{b}" for a in ("ran", "tol", "mek", "sud", "vip", "gor") for b in ("a", "en", "ith", "ors", "um", "elle")]
    sentence = lambda n: " ".join(pick.choices(words, k=n))
    rows = []
    for k in range(100):
        text = f"{sentence(25)}. "
        if k % 10 == 0:
            # The word stands far from the address.
            text = f"Zorbulon {text} {sentence(20)} write to ann.lee@example.org {sentence(9)}"
        elif k % 10 == 1:
            text += f"call +1 (555) 010-9999 now {sentence(12)} the quixotic, plan"
        elif k in (32, 33):
            text += " zorbulon and quiXotic stand alone"
        elif k in (42, 43, 44, 45, 46, 47):
            text += " quixlet quixtum"
        rows.append((k if k % 7 else None, text))
    rows += [rows[10], rows[20], (5, None), (6, "")]
    return rows


@pytest.mark.parametrize("support, disclosure", [(3, 0.9), (2, 0.5), (3, 0.7)])
def test_terms_against_brute_force(spark, support, disclosure):
    rows = _corpus()
    docs = table(spark, rows)
    scanned = sanitize.scan(docs)
    found = {r["t"] for r in sanitize.disclosing_terms(docs, scanned, support, disclosure).collect()}
    expected = _brute([t for _, t in rows], support, disclosure)
    assert found == {sanitize._hash(t) for t in expected}
    if (support, disclosure) == (3, 0.9):
        assert {"zorbulon", "quixotic"} <= expected and not {"rana", "tola", "quix*"} & expected


def test_terms_go_wherever_they_stand(spark):
    rows = _corpus()
    docs = table(spark, rows)
    expected = {t for t in _brute([t for _, t in rows], 3, 0.9) if not t.endswith("*")}
    got = [r.asDict() for r in sanitize.find_personal_data(docs).collect()]
    assert len(got) == len(rows)
    want = sorted(
        (str(i), ",".join(
            [f"{k}:{a}:{b}" for k, a, b in sanitize.find(t or "")]
            + [f"term:{a}:{b}" for w, a, b in _terms(t or "") if w in expected]
        ))
        for i, t in rows
    )
    assert sorted((str(r["doc_id"]), r["spans"]) for r in got) == want
    assert sum("term:" in r["spans"] for r in got) == 24


def test_sanitized_texts_disclose_no_more(spark):
    rows = _corpus()
    clean = sanitize.sanitized(table(spark, rows))
    assert clean.columns == table(spark, []).columns
    texts = [r["text"] for r in clean.collect()]
    assert len(texts) == len(rows) and sum(t is None for t in texts) == 1
    joined = " ".join(t or "" for t in texts)
    assert not re.search("zorbulon|quixotic|ann.lee|010-9999", joined, re.I)
    # The class of one word covers other words and stands for it; that of the other discloses as much.
    assert "[EMAIL]" in joined and "quix*" in joined and "quiX*" in joined and "orb*" not in joined
    untouched = [t for _, t in rows if t and not re.search("zorbulon|quixotic|@|555", t, re.I)]
    assert set(untouched) <= set(texts)
    assert clean.filter("text is not null and n_chars <> length(text)").count() == 0


def test_nothing_to_disclose(spark):
    docs = table(spark, [(None, None), (None, None), (1, ""), (1, "no data here")])
    assert [r["spans"] for r in sanitize.find_personal_data(docs).collect()] == [""] * 4
    assert sanitize.find_personal_data(docs.filter("false")).collect() == []
    assert sorted(str(r["text"]) for r in sanitize.sanitized(docs).collect()) == ["", "None", "None", "no data here"]
    assert sanitize.sanitized(docs).agg(F.count("*")).first()[0] == 4
