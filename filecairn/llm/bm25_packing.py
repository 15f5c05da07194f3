"""Packing token sequences of related documents by retrieval from sharded BM25 indexes."""

from __future__ import annotations

import codecs
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecairn.llm.common import release, slim
from filecairn.plans.cut import written

WINDOW = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
SHARD_TOKENS = 3_000_000
QUERY_TERMS = 24
TAILS_PER_GROUP = 256
K1, B = 1.2, 0.75
REMEMBER = 150_000
TEXT_BYTES = 2_000_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, route long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

# ASCII marks that are neither letters, digits nor the apostrophe, which the vocabulary treats apart.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_LAST = np.ones(1, bool)
_TOKENIZERS: dict[str, "Tokens"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next letter after 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + n) for n, b in enumerate(rest)}}


def _strings(values: pa.Array, at: np.ndarray) -> list[str]:
    return values.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()


class Tokens:
    """Ids of whole texts, equal to the tokenizer's; words met before are looked up.

    White space always parts the pieces of this vocabulary, and its normal form works letter by
    letter, so the ids of a text are those of its words, and each different word of many texts
    is looked up once. Words of letters with a tail of marks go straight to the merge model, head
    and tail apart; all others, and texts with characters on which the rules for white space or
    case differ, to the tokenizer. Words are remembered in two generations: when the newer one is
    full it becomes the older, whose words move on as they are met again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.shown = "".join(" " if b == 0x20 else letter for b, letter in sorted(_byte_letters().items()))
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        """Remember the ids of words of letters: one call for many, parted where a token ends a word."""
        shown = " ".join(words)
        if not shown.isascii():
            shown = codecs.charmap_decode(shown.encode(), "strict", self.shown)[0]
        ids = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.int64)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 2
        raw, start = ids.astype("<u2").tobytes(), 0
        for word, end in zip(words, cuts.tolist(), strict=True):
            self.known[word] = raw[start:end]
            start = end

    def _met(self, words: list[str]) -> list[str]:
        """Those of the words that are not remembered; the newer generation has the others from now on."""
        known, fresh = self.known, []
        for word in [word for word in words if word not in known]:
            ids = self.older.get(word)
            if ids is None:
                fresh.append(word)
            else:
                known[word] = ids
        return fresh

    def _ids(self, letters: list[str], others: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of different words of letters, and of others."""
        if len(self.known) > REMEMBER:
            self.known, self.older = {"": b""}, self.known
        fresh = self._met(letters)
        for at in range(0, len(fresh), 200):
            self._learn_letters(fresh[at : at + 200])
        for word in self._met(others):
            self.known[word] = self._encode(word)
        return list(map(self.known.__getitem__, letters)), list(map(self.known.__getitem__, others))

    @staticmethod
    def _plain(text: str) -> str | None:
        """The normal form of a text, or None if only the tokenizer knows it."""
        if text.isascii():
            plain = "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        else:
            text = unicodedata.normalize("NFC", text) if "<|" not in text else text
            plain = "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1fΣİ")
        return text.lower() if plain else None

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        normal = [self._plain(text) for text in texts]
        split = pc.utf8_split_whitespace(pa.array([n or "" for n in normal], pa.large_string()))
        words = split.flatten().dictionary_encode()
        trimmed = pc.utf8_rtrim(words.dictionary, characters=_MARKS)
        heads = trimmed.dictionary_encode()
        names = heads.dictionary.to_numpy(zero_copy_only=False).tolist()
        lettered = np.fromiter(map(str.isalpha, names), bool, len(names))
        codes = heads.indices.to_numpy()
        tails = pc.subtract(pc.binary_length(words.dictionary), pc.binary_length(trimmed)).to_numpy()
        odd, tailed = np.flatnonzero(~lettered[codes]), np.flatnonzero(lettered[codes] & (tails > 0))
        whole = _strings(words.dictionary, odd)
        marks = [word[-n:] for word, n in zip(_strings(words.dictionary, tailed), tails[tailed].tolist())]
        parts = [name if plain else "" for name, plain in zip(names, lettered.tolist())]
        parts, others = self._ids(parts, whole + marks)
        ids = list(map(parts.__getitem__, codes.tolist()))
        for k, more in zip(odd.tolist() + tailed.tolist(), others):
            ids[k] += more
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        codes = words.indices.to_numpy()
        counts = sizes[codes]
        ends = np.cumsum(counts)
        # Where the ids of each word lie among those of the different words, less where they come to lie.
        moved = (np.cumsum(sizes) - sizes)[codes] - (ends - counts)
        narrow = np.int32 if ends.size and ends[-1] < 1 << 31 else np.int64
        source = np.repeat(moved.astype(narrow), counts)
        source += np.arange(len(source), dtype=narrow)
        flat = np.frombuffer(b"".join(ids), "<u2")[source]
        bounds = np.append(0, ends)[split.offsets.to_numpy()].tolist()
        return [
            flat[a:b] if n is not None else np.frombuffer(self._encode(text), "<u2")
            for text, n, a, b in zip(texts, normal, bounds, bounds[1:])
        ]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and how often each is there."""
    ordered = np.sort(ids)
    last = np.flatnonzero(np.concatenate([ordered[1:] != ordered[:-1], _LAST]))
    counts = last + 1
    counts[1:] -= counts[:-1].copy()
    return ordered[last], counts


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Runs of rows of about ``TEXT_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def _route(ids: np.ndarray) -> int:
    """Most frequent token (high bits) and the least hash of a token pair: alike texts lie side by side."""
    values, counts = _counted(ids)
    pairs = ids[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + ids[1:].astype(np.uint32)
    least = int(((pairs ^ (pairs >> np.uint32(15))) * np.uint32(0x85EBCA6B)).min()) if len(pairs) else 0
    return int(values[np.argmax(counts)]) << 32 | least


def _cut(path: str, window: int, end: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            # What the worker's last task left, and then what reading the vocabulary took, goes back first.
            release()
            _TOKENIZERS[path] = Tokens(path)
            release()
        tokens = _TOKENIZERS[path]
        for batch, part in ((batch, part) for batch in batches for part in _slices(batch.column(1))):
            rows = []
            texts = [text or "" for text in batch.column(1)[part].to_pylist()]
            for doc_id, ids in zip(batch.column(0)[part].to_pylist(), tokens(texts)):
                ids = np.append(ids, np.uint16(end))
                n = len(ids)
                full = n - n % window
                wide = ids.astype("<u4")
                for start in range(0, full, window):
                    rows.append((doc_id, start, window, zlib.crc32(wide[start : start + window].tobytes()), n, 0, ids[start : start + window].tobytes() if keep else None))
                if n > full:
                    rest = ids[full:]
                    rows.append((doc_id, full, n - full, zlib.crc32(wide[full:].tobytes()), n, _route(rest), rest.tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(columns)],
                names=[f.split()[0] for f in PIECE.split(", ")],
            )

    return run


class Index:
    """BM25 inverted index over the token ids of one shard's pieces."""

    def __init__(self, pieces: list[np.ndarray]):
        self.size = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        # One number of a term and its piece, no wider than it must be.
        wide, bits = (np.uint32, 16) if self.size <= 1 << 16 else (np.uint64, 32)
        key = np.concatenate(pieces).astype(wide)
        key <<= wide(bits)
        key |= np.repeat(np.arange(self.size, dtype=wide), lengths)
        key, tf = _counted(key)
        tf = tf.astype(np.int32)
        self.docs = (key & wide((1 << bits) - 1)).astype(np.int32)
        term = (key >> wide(bits)).astype(np.uint16)
        del key
        df = np.bincount(term)
        self.starts = np.append(0, np.cumsum(df))
        self.idf = np.log1p((self.size - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        self.weights = np.empty(len(term), np.float32)
        for at in range(0, len(term), 1 << 17):
            k = slice(at, at + (1 << 17))
            self.weights[k] = self.idf[term[k]] * tf[k] * (K1 + 1) / (tf[k] + norm[self.docs[k]])

    def scores(self, ids: np.ndarray, most: int) -> np.ndarray:
        """Scores of all pieces for the ``most`` weightiest terms of a seed that others hold too."""
        terms, tf = _counted(ids)
        terms = terms.astype(np.int64)
        shared = self.starts[terms + 1] - self.starts[terms] > 1
        terms, tf = terms[shared], tf[shared]
        if len(terms) > most:
            best = np.argpartition(-(self.idf[terms] * tf / (tf + K1)), most)[:most]
            terms = terms[best]
        if not len(terms):
            return np.zeros(self.size, np.float32)
        slices = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        docs = np.concatenate([self.docs[s] for s in slices])
        return np.bincount(docs, np.concatenate([self.weights[s] for s in slices]), self.size)


def _fill(pieces: list[tuple], window: int) -> Iterator[tuple[list[tuple], bool]]:
    """Sequences over one shard: each seed is filled with its unused neighbours in order of score.

    Neighbours that fit go in whole; when none of the best does, the first is cut and its rest
    stays unused. Yields the pieces of a sequence and whether it is full; only the last may not be.
    """
    rest = [[p[0], p[1], np.frombuffer(p[2], "<u2"), p[3]] for p in pieces]
    index = Index([r[2] for r in rest]) if len(rest) > 1 else None
    lengths = np.array([len(r[2]) for r in rest])
    unused = np.ones(len(rest), bool)
    seed = 0
    while True:
        while seed < len(rest) and not unused[seed]:
            seed += 1
        if seed == len(rest):
            return
        chosen, space = [], window

        def take(k: int) -> None:
            nonlocal space
            doc_id, start, ids, total = rest[k]
            part = ids[:space]
            chosen.append((doc_id, start, part, total))
            space -= len(part)
            if len(part) < len(ids):
                rest[k] = [doc_id, start + len(part), ids[len(part) :], total]
                lengths[k] = len(ids) - len(part)
            else:
                unused[k] = False

        first = rest[seed][2]
        take(seed)
        if space and index is not None and unused.any():
            score = np.where(unused, index.scores(first, QUERY_TERMS), -1.0)
            best = np.argsort(-score, kind="stable")[:64]
            best = best[score[best] >= 0]
            for k in best:
                if not space:
                    break
                if lengths[k] <= space:
                    take(k)
            for k in best:
                if space and unused[k]:
                    take(k)
            while space and unused.any():
                take(int(np.argmax(unused)))
        yield chosen, not space


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(columns)],
        names=[f.split()[0] for f in PACKED.split(", ")],
    )


def _rows(chosen: list[tuple], sequence: int | None, keep: bool) -> list[tuple]:
    rows, offset = [], 0
    for doc_id, start, ids, total in chosen:
        kept = ids.tobytes() if keep or sequence is None else None
        rows.append((doc_id, start, len(ids), _crc(ids), total, sequence, offset, kept))
        offset += len(ids)
    return rows


def _pack_partition(window: int, shard_tokens: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The words are encoded by now, and the index needs the room.
        if _TOKENIZERS:
            _TOKENIZERS.clear()
            release()
        number = TaskContext.get().partitionId() << 32
        shard, held = [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal number, shard, held
            rows = []
            for chosen, full in _fill(shard, window):
                rows += _rows(chosen, number if full else None, keep)
                number += 1
                if len(rows) > 20_000:
                    yield _arrow(rows)
                    rows = []
            shard, held = [], 0
            yield _arrow(rows)

        for batch in batches:
            rows = []
            for doc_id, start, length, crc, total, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if length == window:
                    rows.append((doc_id, start, length, crc, total, number, 0, ids if keep else None))
                    number += 1
                    continue
                shard.append((doc_id, start, ids, total))
                held += length
                if held >= shard_tokens:
                    yield from finish()
            yield _arrow(rows)
        if shard:
            yield from finish()

    return run


def _pack_tails(window: int, keep: bool):
    def run(key: tuple, tails: pd.DataFrame) -> pd.DataFrame:
        tails = tails.sort_values(["doc_id", "start"])
        pieces = list(zip(tails["doc_id"].astype(object).where(tails["doc_id"].notna(), None), tails["start"], tails["ids"], tails["doc_tokens"]))
        number, rows = (1 << 60) + (int(key[0]) << 32), []
        for chosen, _ in _fill(pieces, window):
            rows += _rows(chosen, number, keep)
            number += 1
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in PACKED.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pieces(
    docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, keep_ids: bool = True
) -> DataFrame:
    """Token pieces of whole texts: full windows as they are, and the rest of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(slim(_cut(path or vocabulary_path(), window, end, keep_ids)), PIECE)


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    end: int = END,
    shard_tokens: int = SHARD_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of sequences of at most ``window`` tokens, filled with lexically related documents.

    A document is its token ids and ``end``; null and empty texts are ``end`` alone. Full windows of
    long documents are sequences of their own. What is left is sorted by ``_route``, which lays alike
    texts side by side and, by id, splits groups of copies of any size evenly; consecutive runs of
    about ``shard_tokens`` tokens are shards. Each shard has a BM25 inverted index; the first unused
    piece seeds a sequence and its unused neighbours fill it in order of score. So every
    sequence of a shard is full but the last; the last ones of many shards are packed once
    more together, ``TAILS_PER_GROUP`` sequences at a time.

    ``start`` counts from the document's first token, ``offset`` from the sequence's; each id lies in
    exactly one piece. Repeated rows are separate documents; ids may be null; an empty table gives no rows.
    ``keep_ids`` adds the ids (unsigned 16 bit); the digest columns do not need them. Two writes
    to the shared folder make the result the same whichever executors are lost.
    """
    cut = written(pieces(docs, path, window, end, keep_ids), "pieces")
    order = ["route", "doc_id", "start", "ids_crc32"]
    ordered = cut.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = written(ordered.mapInArrow(slim(_pack_partition(window, shard_tokens, keep_ids)), PACKED), "packed")
    tails = packed.filter(F.col("sequence_id").isNull())
    tokens = tails.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // (TAILS_PER_GROUP * window)))
    group = F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups))
    again = tails.select(
        "doc_id", "start", "doc_tokens", "ids", group.alias("_group")
    ).groupBy("_group").applyInPandas(_pack_tails(window, keep_ids), PACKED)
    whole = packed.filter(F.col("sequence_id").isNotNull()).unionByName(again)
    return whole if keep_ids else whole.drop("ids")
