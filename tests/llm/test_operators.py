"""The operators against brute force, round trips and held-out rows, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filecairn.llm.licenses import TEMPLATES
from filecairn.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, `_id` int, band int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _lines(word: str, n: int) -> str:
    return " ".join(f"{word}{i}" for i in range(n))


TEXTS = [
    None, "", "   ", "one two", "12 34 !!", _lines("a", 40), _lines("a", 40), _lines("A", 40),
    _lines("a", 39) + " other", _lines("long", 12_000), _lines("a", 30) + " " + _lines("b", 30),
    "mail ann.lee@example.org or 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 010-9999",
    "naïve é😀 text ann.lee@example.org " + _lines("é", 10),
    "x " + TEMPLATES["Apache-2.0-header"] + " y", "The quick brown fox jumps over the lazy dog and runs home.",
]
SOURCES = ["hot", "hot", "hot", "web", None]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    made = [
        (i, t, [None, "en", "de"][i % 3], SOURCES[i % 5], None if t is None else len(t), 1, 2, 3, 4)
        for i, t in enumerate(TEXTS)
    ]
    return made


@pytest.fixture(scope="module")
def awkward(spark, rows, tmp_path_factory):
    """Folder of tables with nulls, empty and long texts, equal texts and clashing extra columns."""
    base = str(tmp_path_factory.mktemp("awkward"))
    table(spark, rows).write.parquet(f"{base}/documents.parquet")
    labels = [(i, i % 2) for i in range(len(rows))] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    vectors = [
        (0, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (50, [1.0, 1.0, -1.0]), (2, None), (3, [1.0, None, 0.0]),
        (100, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (5, [0.1, 0.2, 0.3]), (6, [-1.0, 0.0, 0.0]),
        (7, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
    ]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{base}/embeddings.parquet")
    return base


@pytest.fixture(scope="module")
def nothing(spark, awkward, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{awkward}/{name}.parquet").filter("false").write.parquet(f"{base}/{name}.parquet")
    return base


def result(spark, name, base):
    return [r.asDict() for r in QUERIES[name](spark, base).collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert result(spark, name, nothing) == []


def test_packing_round_trip(spark, awkward):
    got = result(spark, "op1_bm25_packing", awkward)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for doc_id, parts in by_doc.items():
        encoded = tokenizer.encode(TEXTS[doc_id] or "", add_special_tokens=False).ids
        ids = np.array([*encoded, 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_quality_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in result(spark, "op2_factorization", SMALL)}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for doc_id, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[x.doc_id]["score"], x.quality) for x in labels if got[x.doc_id]["held_out"]]
    good, bad = (np.array([s for s, q in held if q == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.75


def test_quality_of_awkward_rows(spark, awkward):
    got = result(spark, "op2_factorization", awkward)
    assert sorted(r["doc_id"] for r in got) == list(range(len(TEXTS)))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mix_meets_targets(spark):
    got = result(spark, "op3_mixing", SMALL)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    size = {i: len(WORDS.findall(d.text or "")) for i, d in docs.items()}
    per = Counter()
    for i, d in docs.items():
        per[d.source] += size[i]
    names = sorted(s for s in per if s is not None) + [None] * (None in per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = 1.5 * sum(per.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * per[s]]
        target.update({s: 2.0 * per[s] for s in over} if over else share)
        open_ -= set(over or share)
    taken, largest = Counter(), Counter()
    for r in got:
        source = docs[r["doc_id"]].source
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[source]
        assert r["target"] == pytest.approx(target[source]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    assert len(got) == len(docs)
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2 * largest[s], 0.05 * target[s])
    assert sorted(map(str, got)) == sorted(map(str, result(spark, "op3_mixing", SMALL)))


def test_mix_of_awkward_rows(spark, awkward):
    got = {r["doc_id"]: r for r in result(spark, "op3_mixing", awkward)}
    assert {i: r["size"] for i, r in got.items()} == {i: len(WORDS.findall(t or "")) for i, t in enumerate(TEXTS)}


def test_top_k_leaves_broken_vectors_out_and_breaks_ties_by_id(spark, awkward):
    got = result(spark, "op4_impact_search", awkward)
    good = {0: [128, -64, 256], 1: [128, -64, 256], 50: [256, 256, -256], 5: [25, 51, 76], 6: [-256, 0, 0], 7: [0, 0, 0]}
    expected = []
    for q in (0, 50):
        scores = sorted((-int(np.dot(good[q], v)), c) for c, v in good.items() if c != q)[:5]
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == expected


def _luhn(digits):
    doubled = (int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def _digits(text):
    return re.sub(r"\D", "", text)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
)


def test_base_spans_against_patterns(spark, awkward):
    got = {r["doc_id"]: r for r in result(spark, "op5_sanitize", awkward)}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in re.finditer(p, t or "") if ok(m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i]["spans"].split(","))
        for kind, *_ in KINDS:
            assert got[i]["n_" + kind] == sum(s.startswith(kind) for s in spans)


def test_edits_and_likeness(spark, awkward):
    got = {r["doc_id"]: r for r in result(spark, "op6_fingerprints", awkward)}
    for i, t in enumerate(TEXTS):
        t, following = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[5]["near_next"] == 1
    assert got[9]["near_next"] < 0.2 and got[9]["near_edited"] > 0.3


def test_shards_are_balanced_and_gapless(spark, awkward):
    for base in (awkward, SMALL):
        got = result(spark, "op7_sharding", base)
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
        slots, sizes = defaultdict(list), Counter()
        for r in got:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
            assert 0 <= r["shard"] < 40
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(texts)
        share = sum(sizes.values()) / 40
        assert all(abs(n - share) <= 2 * max(r["size"] for r in got) for n in sizes.values())


def test_language_of_held_out_rows(spark):
    got = {r["doc_id"]: r for r in result(spark, "op8_gru_language", SMALL)}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = []
    for d in docs:
        r = got[d.doc_id]
        assert r["held_out"] == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"] and d.lang is not None and any(map(str.isalpha, d.text or "")):
            held.append(r["lang_pred"] == d.lang)
    assert len(got) == len(docs) and np.mean(held) > 0.8


def test_language_of_texts_without_a_letter(spark, awkward):
    got = {r["doc_id"]: r["lang_pred"] for r in result(spark, "op8_gru_language", awkward)}
    assert {i for i, p in got.items() if p == "und"} == {0, 1, 2, 4}


def test_license_notices(spark, awkward):
    got = [r for r in result(spark, "op9_licenses", awkward) if r["license"] == "Apache-2.0-header"]
    assert [(r["doc_id"], r["containment"]) for r in got] == [(13, 1.0)]
    assert {r["doc_id"] for r in result(spark, "op9_licenses", awkward)} == {13}


def _shingles(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _brute_components(texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in holders[x])
        for j, k in shared.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in sets[i]:
            holders[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_against_all_pairs(spark, awkward):
    for base in (awkward, SMALL):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
        got = result(spark, "op10_hyperminhash", base)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _brute_components(texts)
        assert len(got) == len(texts) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_language_windows_label_every_byte_once():
    """Pooling over overlapping windows is the mean of each byte's label in a window that holds it with a margin."""
    from filecairn.llm import gru_language

    network = gru_language.Network(["a", "b", "c"])
    pick = np.random.default_rng(5)
    texts = [bytes(pick.integers(97, 123, n).astype(np.uint8)) for n in (1, 95, 96, 97, 192, 500)]
    pooled = network.pool(texts)
    for text, got in zip(texts, pooled):
        padded = b" " * 8 + text + b" " * (96 + 8)
        labels = []
        for at in range(0, len(text), 96):
            window = np.frombuffer(padded[at : at + 112].ljust(112), np.uint8)
            p = network.positions(np.ascontiguousarray(window[:, None]))
            labels += [p[8 + k, 0] for k in range(min(96, len(text) - at))]
        assert len(labels) == len(text) and np.allclose(np.mean(labels, axis=0), got, atol=1e-5)


def test_language_training_rows_are_bounded(spark):
    from filecairn.llm import gru_language

    text = _lines("wort", 3000) + " ende"
    docs = spark.range(4000).selectExpr(
        "if(id % 3 = 0, 7, id) as doc_id", f"concat(id, ' {text}') as text", "if(id % 2 = 0, 'de', 'en') as lang"
    )
    rows = gru_language.training_rows(docs, 100).collect()
    assert len(rows) == 100 and all(len(r.parts) == 5 and max(map(len, r.parts)) <= 96 for r in rows)
    places = {int(m) for r in rows for p in r.parts for m in re.findall(r"wort(\d+) ", p)}
    assert min(places) < 300 and max(places) > 2700
    assert gru_language.training_rows(docs.filter("false"), 100).count() == 0


def test_likeness_estimates_the_generalised_jaccard(spark):
    """Over 300 texts and their edits the error is that of 64 independent samples; the texts share many words, so its mean varies too."""
    from pyspark.sql import functions as F

    from filecairn.llm import fingerprints
    from tests.conftest import MEDIUM

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").filter("doc_id < 300").select(
        F.col("doc_id").alias("_id"), F.col("text").alias("own"),
        F.expr("concat(left(text, char_length(text) - char_length(text) div 4), ' other words here')").alias("edited"),
    )
    rows = fingerprints.signatures(docs, ["_id"], ["own", "edited"]).join(docs, "_id").select(
        "own", "edited", "own_fingerprint", "edited_fingerprint",
        fingerprints.likeness(F.col("own_fingerprint"), F.col("edited_fingerprint")).alias("near"),
    ).collect()
    off = []
    for r in rows:
        a, b = (Counter(w for w in re.split(r"[ \x09-\x0D]+", t.lower()) if w) for t in (r.own, r.edited))
        if a and b:
            off.append(r.near - sum((a & b).values()) / sum((a | b).values()))
            assert len(r.own_fingerprint) == 4 * fingerprints.SAMPLES
    off = np.array(off)
    assert len(off) > 250 and np.sqrt((off**2).mean()) < 0.07 and abs(off.mean()) < 0.03


def test_terms_out_of_reach_change_no_fingerprint(spark):
    from filecairn.llm import fingerprints

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 1 + 3 * k, k)) for k in range(0, 240, 6)] + [" ", None, "solo " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, own string").selectExpr(
        "_id", "coalesce(own, '') as own", "concat(left(own, length(own) div 2), ' and more') as edited"
    )
    plain = {r["_id"]: r.asDict() for r in fingerprints.signatures(docs, ["_id"], ["own", "edited"]).collect()}
    for reach, least, most in ((fingerprints.REACH, 0, 0), (1.0, 30, 43)):
        some = {r["_id"]: r.asDict() for r in fingerprints.signatures(docs, ["_id"], ["own", "edited"], reach=reach).collect()}
        settled = {k: r for k, r in some.items() if not r.pop("open")}
        assert all(v in (None, plain[k][c]) for k, r in settled.items() for c, v in r.items())
        assert least <= len(plain) - len(settled) <= most
    whole = table(spark, [(n, t, "en", "s", 0, 1, 1, 1, 1) for n, t in enumerate(texts)])
    ends = [fingerprints.fingerprint_documents(whole, reach=reach).orderBy("doc_id").collect() for reach in (1e9, 24.0, 1.0, 1e-9)]
    assert len(ends[0]) == len(texts) and all(end == ends[0] for end in ends)


def test_fingerprints_of_repeated_and_null_ids(spark, rows):
    from filecairn.llm.fingerprints import fingerprint_documents

    made = [*rows, *[(None, *r[1:]) for r in rows[3:8]], rows[5], rows[5]]
    got = [r.asDict() for r in fingerprint_documents(table(spark, made)).collect()]
    assert len(got) == len(made)
    per = defaultdict(set)
    for r in got:
        per[str(r["doc_id"])].add(r["fingerprint"])
    assert len(per["5"]) == 1 and sum(r["doc_id"] == 5 for r in got) == 3
    assert len({r["fingerprint"] for r in got if r["doc_id"] is None}) == 3
