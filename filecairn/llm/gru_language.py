"""Language of whole texts from a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecairn.llm.common import slim

UNKNOWN = "und"
HIDDEN = 8
WINDOW = 96
# Bytes that a window sees beyond the ones it labels, on either side.
MARGIN = 8
MAX_TRAINING_ROWS = 6_000
# Stretches of a training text, from places all over it, and their characters.
STRETCHES, STRETCH = 5, 96
STEPS = 150
BATCH = 128
FOLDS, HELD_OUT = 3, 1
_SLICE = 1024
_CHARS = 1 << 19


def _hard(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0.0, 1.0, out=x)


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): a bounded activation without transcendental functions."""
    return x / (1 + np.abs(x))


class Direction:
    """One gated recurrent layer: update z, reset r, candidate n = soft(W x + r * (U h))."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.hid = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)

    def forward(self, seq: np.ndarray, keep: bool = False):
        """States after each step; ``seq`` is steps x rows of bytes."""
        steps, rows = seq.shape
        k = self.hidden
        h = np.zeros((rows, k), np.float32)
        states = np.empty((steps, rows, k), np.float32)
        saved = []
        for t in range(steps):
            a = self.table[seq[t]]
            u = h @ self.hid
            gates = _hard(a[:, : 2 * k] + u[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            pre = a[:, 2 * k :] + r * u[:, 2 * k :]
            n = _soft(pre)
            if keep:
                saved.append((h, z, r, u[:, 2 * k :], pre, n))
            h = n + z * (h - n)
            states[t] = h
        return states, saved

    def backward(self, seq: np.ndarray, saved: list, d_states: np.ndarray):
        """Gradients of the table and the recurrent weights by backpropagation through time."""
        k = self.hidden
        d_hid = np.zeros_like(self.hid)
        d_inputs = np.empty((*seq.shape, 3 * k), np.float32)
        d_h = np.zeros_like(d_states[0])
        for t in range(len(saved) - 1, -1, -1):
            h, z, r, un, pre, n = saved[t]
            d_h = d_h + d_states[t]
            d_n, d_z = d_h * (1 - z), d_h * (h - n)
            d_pre = d_n / (1 + np.abs(pre)) ** 2
            d_r = d_pre * un
            inside = lambda g: 0.25 * ((g > 0) & (g < 1))
            d_a = np.concatenate([d_z * inside(z), d_r * inside(r), d_pre], axis=1)
            d_u = np.concatenate([d_a[:, : 2 * k], d_pre * r], axis=1)
            d_hid += h.T @ d_u
            d_inputs[t] = d_a
            d_h = d_h * z + d_u @ self.hid.T
        bytes_, flat = seq.ravel(), d_inputs.reshape(-1, 3 * k)
        d_table = np.stack([np.bincount(bytes_, flat[:, c], 256) for c in range(3 * k)], axis=1)
        return d_table, d_hid


class Network:
    """Two directions and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.hid, self.back.table, self.back.hid, self.out, self.bias]

    def positions(self, seq: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each position: steps x rows x languages."""
        a, _ = self.ahead.forward(seq)
        b, _ = self.back.forward(seq[::-1])
        k = self.ahead.hidden
        logits = a @ self.out[:k] + b[::-1] @ self.out[k:] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def loss_gradients(self, seq: np.ndarray, target: np.ndarray):
        """Cross entropy at every position and its gradients."""
        a, kept_a = self.ahead.forward(seq, True)
        b, kept_b = self.back.forward(seq[::-1], True)
        k = self.ahead.hidden
        states = np.concatenate([a, b[::-1]], axis=2)
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(seq.shape[1])
        loss = -np.log(p[:, rows, target] + 1e-9).mean()
        p[:, rows, target] -= 1
        p /= seq.size
        d_out = np.tensordot(states, p, axes=([0, 1], [0, 1]))
        d_states = p @ self.out.T
        return loss, [
            *self.ahead.backward(seq, kept_a, d_states[:, :, :k]),
            *self.back.backward(seq[::-1], kept_b, d_states[::-1, :, k:]), d_out, p.sum(axis=(0, 1)),
        ]

    def fit(self, texts: list[bytes], target: np.ndarray, steps: int, batch: int, window: int, rate: float = 0.02):
        """Adam over random windows, languages drawn equally often."""
        rng = np.random.default_rng(4)
        by = [np.flatnonzero(target == c) for c in range(len(self.languages))]
        first = [np.zeros_like(w) for w in self._weights()]
        second = [np.zeros_like(w) for w in self._weights()]
        for step in range(1, steps + 1):
            chosen = np.array([rng.choice(by[c]) for c in rng.integers(0, len(by), batch)])
            seq = np.full((window, batch), 32, np.uint8)
            for k, row in enumerate(chosen):
                raw = texts[row]
                at = rng.integers(0, max(len(raw) - window, 0) + 1)
                part = np.frombuffer(raw[at : at + window], np.uint8)
                seq[: len(part), k] = part
            _, gradients = self.loss_gradients(seq, target[chosen])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(self._weights(), gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pool(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean probability over all positions of each text.

        Texts are cut into windows, which run side by side. A window begins and ends ``MARGIN`` bytes beyond what it
        labels, so that no position stands at an edge and letters of several bytes are whole.
        """
        counts = np.array([-(-len(t) // window) for t in texts])
        sums = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), counts)
        size, width = int(counts.sum()), window + 2 * MARGIN
        seq = np.full((size, width), 32, np.uint8)
        mask = np.zeros((size, width), bool)
        row = 0
        for t, count in zip(texts, counts):
            # The text's windows overlap: each starts ``window`` after the one before and is ``width`` long.
            padded = np.full(count * window + 2 * MARGIN, 32, np.uint8)
            padded[MARGIN : MARGIN + len(t)] = np.frombuffer(t, np.uint8)
            seq[row : row + count] = np.lib.stride_tricks.sliding_window_view(padded, width)[::window]
            mask[row : row + count, MARGIN : MARGIN + window] = True
            last = len(t) - (count - 1) * window
            mask[row + count - 1, MARGIN + last :] = False
            row += count
        for at in range(0, size, _SLICE):
            p = self.positions(np.ascontiguousarray(seq[at : at + _SLICE].T))
            p *= mask[at : at + _SLICE].T[:, :, None]
            np.add.at(sums, owner[at : at + _SLICE], p.sum(axis=0))
        return sums / np.maximum([[len(t)] for t in texts], 1)


def _fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``lang, parts`` of at most ``most`` documents with a language outside the held-out fold.

    Documents are chosen by a hash of id and text, first by a bound on it that about twice as many as wanted
    pass, so that no more than those are sorted. Of each, ``STRETCHES`` stretches from hashed places of the
    whole text are taken, so what comes to the driver is bounded whatever the texts' lengths.
    """
    text = F.col("text").cast("string")
    usable = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & text.rlike(r"\p{L}") & F.coalesce(_fold(F.col("doc_id")) != HELD_OUT, F.lit(False)))
    # Counted without the texts, so those without a letter too; a bound twice as wide as needed makes up for them.
    many = docs.filter(F.col("lang").isNotNull() & F.coalesce(_fold(F.col("doc_id").cast("long")) != HELD_OUT, F.lit(False))).count()
    bound = min(1 << 40, int(2 * most / max(many, 1) * (1 << 40)) + 1)
    keyed = usable.withColumn("_h", F.xxhash64("doc_id", "text")).filter(F.pmod("_h", F.lit(1 << 40)) < F.lit(bound))
    room = F.greatest(F.char_length("text") - STRETCH, F.lit(0)) + 1
    parts = F.array(*[
        F.substring(F.col("text"), (F.pmod(F.xxhash64("_h", F.lit(n)), room) + 1).cast("int"), F.lit(STRETCH)) for n in range(STRETCHES)
    ])
    return keyed.select("_h", "doc_id", "lang", parts.alias("parts")).orderBy("_h", "doc_id", "lang").limit(most).select("lang", "parts")


def train(docs: DataFrame, most: int = MAX_TRAINING_ROWS, steps: int = STEPS) -> Network | None:
    """Fit on ``training_rows``; predictions read whole texts."""
    rows = training_rows(docs, most).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    network = Network(languages)
    parts = [(p.encode("utf-8", "replace"), languages.index(r["lang"])) for r in rows for p in r["parts"]]
    if len(languages) > 1:
        network.fit([p for p, _ in parts], np.array([c for _, c in parts]), steps, BATCH, WINDOW)
    return network


def _identified(shared, at: int, names_out: list[str]):
    def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of a batch that hold about ``_CHARS`` characters, or one row."""
        import pyarrow.compute as pc

        lengths = np.array(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), np.int64)
        parts = np.cumsum(lengths) // _CHARS
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column(at).to_pylist()]
                known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                names = np.full(len(texts), UNKNOWN, object)
                score = np.zeros(len(texts))
                told = np.flatnonzero(known)
                if network is not None and len(told):
                    pooled = network.pool([texts[k].encode("utf-8", "replace") for k in told])
                    best = pooled.argmax(axis=1)
                    names[told] = np.array(network.languages, object)[best]
                    score[told] = np.clip(pooled[np.arange(len(told)), best], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names_out)], pa.array(names, pa.string()), pa.array(score)],
                    names=[*names_out, "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, carry: list[str] = ("doc_id",), most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The columns ``carry`` with ``lang_pred`` and ``score`` for every document row.

    Every byte of the whole text is labelled, in windows of ``WINDOW`` bytes that see ``MARGIN`` bytes beyond either
    end, and a document's score is the mean probability of its best language over all its bytes. ``und`` with score 0 stands for null texts
    and texts without a letter, and for all if no language can be learned; with one language
    learned, that one is predicted. Only text and language of rows outside the held-out fold are learned from;
    a null language is not. Ids may be null, rows may repeat (scored alike), an empty table gives no
    rows. The network has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, most))
    carry = list(carry)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["lang_pred string", "score double"])
    # A text that is carried goes to the tasks once.
    once = "text" in carry and docs.schema["text"].dataType.simpleString() == "string"
    texts = docs.select(*[docs[c] for c in carry], *([] if once else [docs["text"].cast("string").alias("_text")]))
    return texts.mapInArrow(slim(_identified(shared, carry.index("text") if once else len(carry), carry)), schema)


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``."""
    held = F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return identify(docs).select("doc_id", held.alias("held_out"), "lang_pred", "score")
