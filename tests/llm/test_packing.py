"""Packing: ids of many texts against the tokenizer, words remembered, the room of a shard's index."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from filecairn.llm import bm25_packing


def _texts(n, seed):
    pick = random.Random(seed)
    words = [
        "the", "The", "naïve", "straße", "ÉCOLE", "don't", "it's", "x'", "a_b", "€,", "٣٤", "²", "Ⅷ.", "日本語", "ét", "ς", "Σ", "İ",
        "<|endoftext|>", "...", "&&&", "1234,", "a.b@c.de", "\x1cz", "é!!", "",
    ]
    made = lambda: "".join(pick.choice("abcdeäéßж") for _ in range(pick.randrange(1, 12))) + pick.choice(["", "", ",", ".&&&", "'"])
    gaps = [" ", "  ", "\n", "\t", " ", " ", "\r\n"]
    return ["".join((pick.choice(words) if pick.random() < 0.3 else made()) + pick.choice(gaps) for _ in range(pick.randrange(40))) for _ in range(n)]


def test_ids_of_many_texts_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(bm25_packing, "REMEMBER", 300)
    path = bm25_packing.vocabulary_path()
    whole, tokens = Tokenizer.from_file(path), bm25_packing.Tokens(path)
    for seed in range(20):
        texts = ["", " ", *_texts(60, seed)]
        assert [ids.tolist() for ids in tokens(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in tokens([])] == [] and len(tokens.known) < 3_000


def test_every_letter_of_the_first_plane_parts_words_as_the_tokenizer():
    path = bm25_packing.vocabulary_path()
    whole, tokens = Tokenizer.from_file(path), bm25_packing.Tokens(path)
    # White space as Python and Arrow know it is what the tokenizer parts words at.
    texts = [f"ab{chr(c)}cd" for c in range(1, 0x3100)]
    assert [ids.tolist() for ids in tokens(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_a_word_in_use_is_encoded_once(monkeypatch):
    monkeypatch.setattr(bm25_packing, "REMEMBER", 50)
    tokens, learned = bm25_packing.Tokens(bm25_packing.vocabulary_path()), []
    learn = tokens._learn_letters
    monkeypatch.setattr(tokens, "_learn_letters", lambda words: (learned.extend(words), learn(words)))
    letters = "abcdefghij"
    for k in range(40):
        rare = " ".join(f"q{letters[k // 10]}{letters[k % 10]}{letters[j // 10]}{letters[j % 10]}" for j in range(30))
        tokens([f"common, {rare} common.", "common Common;"])
    assert learned.count("common") == 1 and len(learned) == 40 * 30 + 1
    assert len(tokens.known) + len(tokens.older) < 200


def test_cut_takes_few_texts_at_a_time(monkeypatch):
    path, texts = bm25_packing.vocabulary_path(), [*_texts(50, 7), None, "", None]
    batch = pa.record_batch({"doc_id": pa.array([*range(52), None], pa.int64()), "text": pa.array(texts, pa.string())})
    cut = lambda: [r for b in bm25_packing._cut(path, 16, 2, True)(iter([batch, batch[:0]])) for r in b.to_pylist()]
    together = cut()
    monkeypatch.setattr(bm25_packing, "TEXT_BYTES", 500)
    assert len(list(bm25_packing._slices(batch.column(1)))) > 5
    assert cut() == together and {r["doc_id"] for r in together} == {*range(52), None}


def test_index_takes_little_room_and_weighs_by_bm25():
    pick = np.random.default_rng(1)
    pieces = [pick.zipf(1.3, 400).clip(0, 40_000).astype("<u2") for _ in range(1_000)]
    tracemalloc.start()
    index = bm25_packing.Index(pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * sum(map(len, pieces))
    many = bm25_packing.Index([*pieces, *[np.array([41_000], "<u2")] * 70_000])
    assert many.docs[many.starts[41_000] :].tolist() == list(range(1_000, 71_000))
    assert all((many.docs[many.starts[k] : many.starts[k + 1]] == index.docs[index.starts[k] : index.starts[k + 1]]).all() for k in (1, 2, 17))
    mean = np.mean([len(p) for p in pieces])
    for term in (1, 2, 17, 333):
        held = [(k, int((p == term).sum()), len(p)) for k, p in enumerate(pieces) if (p == term).any()]
        span = slice(index.starts[term], index.starts[term + 1])
        assert index.docs[span].tolist() == [k for k, _, _ in held]
        idf = np.log1p((len(pieces) - len(held) + 0.5) / (len(held) + 0.5))
        assert np.allclose(index.weights[span], [idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) for _, tf, n in held])
