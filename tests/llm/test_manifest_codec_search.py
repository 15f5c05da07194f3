"""The manifest, the codec and the ranked search against brute force, on awkward and on random rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filecairn.llm import merkle_manifest, prefix_bpe, stratified_search
from filecairn.llm.queries import QUERIES
from tests.conftest import SMALL

# Extra columns named like the operators' own.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "tree int, node int, rank int, n int, ids int, _text int, terms int, m int, leaf string"
)
EXTRA = (1, 2, 3, 4, 5, 6, 7, 8, "x")


def table(spark, rows):
    """(doc_id, text, lang, source, n_chars) rows as documents."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def awkward_rows(n, seed=3):
    pick = random.Random(seed)
    texts = [None, "", " \n", "xé", "Alpha beta, beta gamma.", "alpha ALPHA delta", "é😀 beta", "gamma " * 300]
    return [
        (
            pick.choice([None, *range(n // 4)]), pick.choice(texts), pick.choice([None, "en", "en", "en", "", "zz", "é"]),
            pick.choice([None, "a", "bé"]), pick.choice([None, 3, 99]),
        )
        for _ in range(n)
    ]


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


# Manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _tree(hashes):
    """The root, and for each leaf what stands left and right of it on the way up."""
    paths, members = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, joined = [], []
        for i in range(0, len(hashes), 2):
            run = hashes[i : i + 2]
            for j, group in enumerate(members[i : i + 2]):
                for leaf in group:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(_h(*run))
            joined.append(sum(members[i : i + 2], []))
        hashes, members = above, joined
    return hashes[0], paths


def _brute_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
    built = {name: _tree([_leaf(*r) for r in trees[name]]) for name in names}
    root, over = _tree([built[name][0] for name in names])
    out = []
    for name, upper in zip(names, over):
        for row, path in zip(trees[name], built[name][1]):
            doc_id, text, lang, source, n_chars = row
            folded = _leaf(*row)
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
                folded = _leaf(doc_id, text, lang, source, n_chars + 1)
            for left, right in path + upper:
                folded = _h(left, folded, right)
            proof = _h(*[a + b for a, b in path + upper])
            out.append((doc_id, _leaf(*row), built[name][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, levels", [(300, 2), (300, 8), (33, 1), (1, 8), (2, 3)])
def test_manifest_of_awkward_rows(spark, n, levels):
    rows = awkward_rows(n)
    assert tuples(merkle_manifest.verify(table(spark, rows), levels)) == _brute_manifest(rows)


def test_manifest_of_documents(spark):
    rows = [
        (r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    ]
    got = tuples(QUERIES["op11_merkle_manifest"](spark, SMALL))
    assert got == _brute_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_equal_rows(spark):
    rows = [(7, "same", "en", "a", 4)] * 20
    got = tuples(merkle_manifest.verify(table(spark, rows), 2))
    assert got == _brute_manifest(rows) and len(got) == 20


# Codec


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


AWKWARD_TEXTS = [
    None, "", "  ", "aaaaaaaaaa aaaa", "Hello world's 12 foo<|endoftext|>bar <|ENDOFTEXT|> x <|startoftext|><|endoftext|>",
    "naïve é😀 don't é", "a\x1cb\x85c\xa0d　e", "ΣΑΣ İI ſ ǅ", "́x", "supercalifragilistic" * 400, "!?" * 3000,
]


def _same(codec, library, text):
    expected = library.encode(text, add_special_tokens=False).ids
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == expected, text
    assert codec.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_codec_equals_the_library_on_random_texts(library):
    codec = prefix_bpe.codec(prefix_bpe.vocabulary_path())
    pick = random.Random(1)
    letters = [*map(chr, range(32, 127)), *"éàñßçÉΣσςİıſ́̇中文日本😀‍\x85\xa0　 \x1c\x0b\t\n", "the", "'s", "'LL", "<|endoftext|>"]
    vocabulary = [t.replace("</w>", "") for t in library.get_vocab()]
    for text in AWKWARD_TEXTS:
        _same(codec, library, text or "")
    for _ in range(3000):
        _same(codec, library, "".join(pick.choices(letters, k=pick.randint(1, 40))))
        _same(codec, library, "".join(pick.choices(vocabulary, k=3)).lower())
        _same(codec, library, "".join(pick.choices("aehlotin", k=pick.randint(1, 30))))


def _digests(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        out.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def test_codec_over_rows(spark, library):
    rows = [(i if i % 3 else None, t) for i, t in enumerate([*AWKWARD_TEXTS, *AWKWARD_TEXTS])]
    docs = table(spark, [(i, t, None, None, None) for i, t in rows])
    assert tuples(prefix_bpe.round_trip(docs)) == _digests(library, rows)
    assert prefix_bpe.round_trip(docs.filter("false")).collect() == []
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert tuples(QUERIES["op12_prefix_bpe"](spark, SMALL)) == _digests(library, [tuple(r) for r in documents.collect()])


def test_codec_keeps_other_columns(spark, library):
    docs = table(spark, [(1, "one two", "en", None, 7)])
    back = prefix_bpe.decode(prefix_bpe.encode(docs, carry=["doc_id", "lang", "n"])).first()
    assert (back.doc_id, back.lang, back.n, back.n_tokens, back.decoded) == (1, "en", 4, 2, "one</w> two</w>")


def test_codec_refuses_other_vocabularies():
    with pytest.raises(ValueError, match="word ends"):
        prefix_bpe.PrefixCodec(public_tokenizers.path("byte_bpe_50k.json"))


# Search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def _brute_search(docs, items):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    number, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(_terms(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc_id, c in counted:
            m = 10 + 90 * sum(c.values()) * number // length
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:10], start=1)]
    return sorted(out, key=str)


def _search(spark, docs, items, **bounds):
    rows = table(spark, [(i, t, None, None, None) for i, t in docs])
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, n int")
    return tuples(stratified_search.rank_documents(rows, asked, **bounds))


ITEMS = [(1, "Alpha, beta!"), (1, "zeta gamma"), (2, None), (3, "..."), (None, "delta É xé"), (4, "é😀 ALPHA"), (5, "unknown")]


@pytest.mark.parametrize("bounds", [{}, {"most_terms": 2}, {"block_postings": 3}, {"most_chars": 8, "block_postings": 1}])
def test_search_of_awkward_rows(spark, bounds):
    docs = [(r[0], r[1]) for r in awkward_rows(120)]
    assert _search(spark, docs, ITEMS, **bounds) == _brute_search(docs, ITEMS)


def test_search_of_nothing(spark):
    assert _search(spark, [(1, "alpha")], []) == [] and _search(spark, [], ITEMS) == []
    assert _search(spark, [(1, None), (None, " .")], ITEMS) == []


def test_search_of_random_rows_over_small_blocks(spark):
    pick = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    docs = [
        (pick.randrange(300), " ".join(pick.choices(words, weights=[1 / (k + 1) for k in range(60)], k=pick.choice([3, 30, 31, 400]))))
        for _ in range(600)
    ]
    items = [(k, " ".join(pick.choices(words, k=8))) for k in range(25)]
    assert _search(spark, docs, items, block_postings=700) == _brute_search(docs, items)


def test_bounds_pass_strata_over():
    """Once the list is full, strata that cannot enter it are not visited."""
    rng = np.random.default_rng(2)
    m = np.sort(rng.integers(10, 400, 4000))
    lengths = np.full(4000, 5)
    terms = np.concatenate([np.sort(rng.choice(40, 5, replace=False)) for _ in m])
    tfs = rng.integers(1, 4, len(terms))
    starts = np.append(0, np.cumsum(lengths))
    block = stratified_search.Block(m, np.arange(4000), np.ones(4000, bool), starts, terms, tfs)
    wanted, weights = np.array([3, 7, 21]), np.array([900, 1100, 500])
    best = block.search(wanted, weights, [], 10)
    scores = []
    for k in range(4000):
        held = dict(zip(terms[starts[k] : starts[k + 1]].tolist(), tfs[starts[k] : starts[k + 1]].tolist()))
        scores.append((-sum(int(w) * (1_000_000_000 * held[t] // (1000 * held[t] + 8 * int(m[k]))) for t, w in zip(wanted.tolist(), weights) if t in held), k))
    assert [(-s, d) for s, _, d in best] == sorted(scores)[:10]
    assert block.passed > 5 * block.visited
