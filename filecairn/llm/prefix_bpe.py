"""BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
REMEMBER = 400_000
# What a word's last letter gains in the automaton's alphabet, far above any stand-in of a byte.
_LAST = 0x10000
# Texts of these characters are in normal form already, and all versions of Unicode agree on their lower case.
_PLAIN = re.compile(r"[\x00-\x1b\x20-ɏ]*")

_CODECS: dict[str, "PrefixCodec"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCodec:
    """Encodes and decodes with a byte-level BPE vocabulary that marks the ends of words.

    Merging the pair of least rank first, leftmost first, gives each prefix of a word an encoding of
    its own, and the encoding of the word's prefix up to its last token is that encoding without
    this token. So a prefix is known by its last token. An automaton over the vocabulary lists the
    tokens that end at each place; among them exactly one stands alone at the start of the word or
    goes with the last token of the prefix before it, that is, no merge across the border of the
    two would have come before the merges that built them. Following the last tokens back from the
    end gives the ids, without any queue of merges and in time linear in the word.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as handle:
            described = json.load(handle)
        model, added = described["model"], described["added_tokens"]
        self.suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.suffix or described["decoder"] is not None:
            raise ValueError(f"{path} is no BPE vocabulary with word ends and without a decoder")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens with rules of their own")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        # The stand-in of each byte: itself where it can be shown, else the next letter after 255.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in plain]
        self.shown = [chr(b if b in plain else 256 + hidden.index(b)) for b in range(256)]
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

        vocabulary = model["vocab"]
        self.tokens = [""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for token, number in [*vocabulary.items(), *self.added.items()]:
            self.tokens[number] = token
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Per token: its letters, the rank of the merge that makes it (-1: a letter), and that merge's two sides.
        letters: dict[int, str] = {}
        self.rank, self.sides, self.pairs = {}, {}, {}
        made = {a + b for a, b in merges}
        for token, number in vocabulary.items():
            if token not in made:
                head = token.removesuffix(self.suffix) if len(token) > 1 else token
                letters[number] = head if head == token else chr(ord(head) + _LAST)
                self.rank[number] = -1
        for rank, (left, right) in enumerate(merges):
            a, b, number = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if number in self.rank:
                raise ValueError(f"{path} makes a token by two merges")
            if max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError(f"{path} uses a token before it is made")
            letters[number] = letters[a] + letters[b]
            self.rank[number], self.sides[number], self.pairs[a, b] = rank, (a, b), rank
        self.stands: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for number, shown in letters.items():
            if self._stands_alone(number):
                self.automaton.add_word(shown, (number, len(shown)))
        self.automaton.make_automaton()
        self.together: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def _border_holds(self, left: int, right: int, before: float) -> bool:
        """Whether no merge across the border of two tokens comes ahead of those that build them.

        Goes back in time: of the two tokens at the border the one merged later is taken apart,
        which leaves its side at the border, until both are letters. A pair across the border
        must not be due before the merge just undone; of merges of one rank the left one is first.
        """
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < before:
                return False
            of_left, of_right = self.rank[left], self.rank[right]
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                before, left = of_left, self.sides[left][1]
            else:
                before, right = of_right + 0.5, self.sides[right][0]

    def _stands_alone(self, token: int) -> bool:
        """Whether the letters of a token are encoded as that token."""
        known = self.stands.get(token)
        if known is None:
            known = True
            if token in self.sides:
                left, right = self.sides[token]
                known = (
                    self._stands_alone(left)
                    and self._stands_alone(right)
                    and self._border_holds(left, right, self.rank[token])
                )
            self.stands[token] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as the stand-ins of its bytes."""
        marked = word[:-1] + chr(ord(word[-1]) + _LAST)
        last, start_of = [-1] * (len(marked) + 1), [0] * (len(marked) + 1)
        together = self.together
        for place, (token, length) in self.automaton.iter(marked):
            end = place + 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                pair = last[start], token
                fits = together.get(pair)
                if fits is None:
                    if len(together) > 4 * REMEMBER:
                        together.clear()
                    fits = together[pair] = self._border_holds(*pair, float("inf"))
                if not fits:
                    continue
            last[end], start_of[end] = token, start
        ids, end = [], len(marked)
        while end:
            ids.append(last[end])
            end = start_of[end]
        return ids[::-1]

    def _pieces(self, chunk: str) -> list[str]:
        """The words of a stretch without white space, as stand-ins of their bytes."""
        if chunk.isalpha() and _PLAIN.fullmatch(chunk):
            # Letters alone are one word.
            return [chunk if chunk.isascii() else "".join(map(self.shown.__getitem__, chunk.encode()))]
        return [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space, remembered."""
        ids = [n for piece in self._pieces(chunk) for n in self.encode_word(piece)]
        if len(self.words) > REMEMBER:
            self.words.clear()
        found = self.words[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _chunks(self, text: str) -> list[str]:
        """The text in normal form, cut at white space, which parts words in this kind of vocabulary."""
        if _PLAIN.fullmatch(text):
            return text.lower().split()
        return [c for c in self.normalizer.normalize_str(text).split(" ") if c]

    def _plain(self, text: str) -> bytes:
        known = self.words.get
        return b"".join([known(c) or self._chunk(c) for c in self._chunks(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(t in text for t in self.added):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(
            np.array([self.added[p]], "<u4").tobytes() if n % 2 else self._plain(p) for n, p in enumerate(parts)
        )

    def decode(self, ids: bytes) -> str:
        """Tokens parted by blanks, special ones included: this kind of vocabulary has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str) -> PrefixCodec:
    """The codec of a vocabulary file, built once in each worker."""
    if path not in _CODECS:
        _CODECS[path] = PrefixCodec(path)
    return _CODECS[path]


def _each(path: str, column: str, kind: pa.DataType, apply, schema: list[str]):
    """Batches with ``column`` replaced by what ``apply`` makes of it; long rows leave in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                values = pa.array([apply(made, v.as_py()) for v in part.column(at)], kind)
                columns = [values if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=schema)

    return run


def encode(docs: DataFrame, path: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (by default ``doc_id``), ``ids`` and ``n_tokens`` of each row.

    ``ids`` are those the tokenizer library gives without special tokens added, as little-endian
    unsigned 32-bit integers. Special tokens spelled out in a text are their ids. Null and empty
    texts have no ids; repeated rows are encoded each; an empty table gives no rows; other columns do not matter.
    """
    carry = ["doc_id"] if carry is None else carry
    rows = docs.select(*[docs[c] for c in carry], docs[text].cast("string").alias("_text"))
    schema = [*carry, "ids"]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "ids binary"])
    made = rows.mapInArrow(
        _each(path or vocabulary_path(), "_text", pa.binary(), lambda c, v: c.encode(v or ""), schema), fields
    )
    return made.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns, with the text of ``ids`` in their place as ``decoded``; null ids give an empty text."""
    others = [c for c in encoded.columns if c != ids]
    rows = encoded.select(*[encoded[c] for c in others], encoded[ids].alias("_ids"))
    fields = ", ".join(
        [*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "decoded string"]
    )
    return rows.mapInArrow(
        _each(path or vocabulary_path(), "_ids", pa.string(), lambda c, v: c.decode(v or b""), [*others, "decoded"]),
        fields,
    )


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, per row."""
    encoded = encode(docs, path).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
