"""Quality scores from a factorisation machine over hashed words, text statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecairn.llm.common import text_of
from filecairn.plans.cut import written

BUCKETS = 1 << 14
RANK = 8
THRESHOLD = 0.3
MAX_TRAINING_ROWS = 12_000
EPOCHS = 6
FOLDS = 5

STATISTICS = (
    "log_chars", "log_words", "log_lines", "upper", "digits", "marks", "beyond_ascii", "blanks", "word_length",
    "marked_words", "upper_words", "distinct_words", "top_word", "repeated_lines", "log_n_chars",
)
_REMEMBER = 300_000
_KNOWN: dict[str, int] = {}

_KIND = np.zeros(256, np.int64)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 3
_KIND[128:] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def _bucket(word: str) -> int:
    """Bucket of a word (bits from 2 up), whether it ends in a mark (bit 0) and is all capitals (bit 1)."""
    import xxhash

    bucket = xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
    marked = not word[-1].isalnum() and word[-1] not in ".,"
    return bucket << 2 | (2 if len(word) > 1 and word.isupper() else 0) | int(marked)


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets, their weights (log counts of length 1), and the statistics."""
    words = text.split()
    if len(_KNOWN) > _REMEMBER:
        _KNOWN.clear()
    try:
        coded = np.fromiter(map(_KNOWN.__getitem__, words), np.int64, len(words))
    except KeyError:
        for word in words:
            if word not in _KNOWN:
                _KNOWN[word] = _bucket(word)
        coded = np.fromiter(map(_KNOWN.__getitem__, words), np.int64, len(words))
    index, counts = np.unique(coded >> 2, return_counts=True)
    weights = np.log1p(counts)
    weights = weights / max(np.sqrt((weights**2).sum()), 1e-9)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6) / max(len(raw), 1)
    lines = text.split("\n")
    n = max(len(words), 1)
    stats = np.array([
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        len(raw) / n / 10, (coded & 1).sum() / n, ((coded >> 1) & 1).sum() / n, len(index) / n,
        counts.max() / n if len(counts) else 0.0, 1 - len(set(lines)) / len(lines),
        np.log1p(max(n_chars or 0, 0)),
    ])
    return index, weights, stats


class Machine:
    """w0 + w x + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], through the logistic function."""

    def __init__(self, stats: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
        size = BUCKETS + stats.shape[1]
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factors = rng.normal(0, 0.05, (size, RANK))

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices, values and row starts: each row ends with its standardised statistics, which are never empty."""
        ids, values = [], []
        tail = np.arange(BUCKETS, BUCKETS + len(self.mean))
        for index, weights, stats in found:
            ids += [index, tail]
            values += [weights, np.clip((stats - self.mean) / self.scale, -4, 4) / 4]
        lengths = [len(ids[k]) + len(ids[k + 1]) for k in range(0, len(ids), 2)]
        return np.concatenate(ids), np.concatenate(values), np.cumsum([0, *lengths[:-1]])

    def sums(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[ids] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[ids] * x, starts) + pairs, total

    def score(self, found: list) -> np.ndarray:
        if not found:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.sums(*self.rows(found))[0], -30, 30)))

    def fit(self, found: list, labels: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.05, decay: float = 1e-4):
        """Adaptive gradient steps over shuffled mini-batches of the logistic loss."""
        rng = np.random.default_rng(2)
        g_linear, g_factors = np.full(len(self.linear), 1e-4), np.full(self.factors.shape, 1e-4)
        self.bias = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
        for _ in range(epochs):
            order = rng.permutation(len(found))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                ids, x, starts = self.rows([found[k] for k in part])
                z, total = self.sums(ids, x, starts)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
                per = np.repeat(np.arange(len(part)), np.diff([*starts, len(ids)]))
                e = (error / len(part))[per]
                unique, place = np.unique(ids, return_inverse=True)
                d_linear = np.bincount(place, e * x, len(unique)) + decay * self.linear[unique]
                each = (e * x)[:, None] * (total[per] - self.factors[ids] * x[:, None])
                d_factors = np.stack([np.bincount(place, each[:, f], len(unique)) for f in range(RANK)], axis=1)
                d_factors += decay * self.factors[unique]
                g_linear[unique] += d_linear**2
                g_factors[unique] += d_factors**2
                self.linear[unique] -= rate * d_linear / np.sqrt(g_linear[unique])
                self.factors[unique] -= rate * d_factors / np.sqrt(g_factors[unique])
                self.bias -= rate * float(error.mean())


def fold(doc_id, folds: int = FOLDS):
    """crc32 of the id's text, modulo ``folds``; ids that are null are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())),
             pa.array([f[1] for f in found], pa.list_(pa.float32())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
            names=["quality", "ids", "x", "stats"],
        )


def _n_chars(docs: DataFrame):
    return (docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, epochs: int = EPOCHS) -> Machine | None:
    """Fit on at most ``most`` labelled rows outside the held-out fold, chosen by a hash of the id.

    Only the features of those rows come to the driver. Without usable labels there is no model.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    known = known.filter("quality = _other").drop("_other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), _n_chars(docs))
    # At most ``most`` rows, so the broadcast is bounded by the parameter.
    chosen = texts.join(F.broadcast(written(known, "labels")), "doc_id").select("text", "n_chars", "quality")
    rows = chosen.mapInArrow(_featured, "quality int, ids array<int>, x array<float>, stats array<double>")
    rows = rows.orderBy(F.xxhash64("ids", "x"), "quality").limit(most).toPandas()
    if not len(rows):
        return None
    found = [(np.asarray(i, np.int64), np.asarray(x, float), np.asarray(s)) for i, x, s in zip(rows["ids"], rows["x"], rows["stats"])]
    machine = Machine(np.stack([f[2] for f in found]))
    machine.fit(found, rows["quality"].to_numpy(float), epochs)
    return machine


def _scored(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                scores.append(machine.score(found) if machine else np.full(len(found), 0.5))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document row.

    The score is the probability of label 1, from whole texts: hashed lower-case words, statistics of
    the text's structure and the table's ``n_chars`` as metadata (absent or null: 0). Labels,
    language, source and id never enter it. Null and empty texts are scored by their
    statistics. Rows that repeat are scored alike; ids may be null (not held out); labels that contradict
    each other, lie outside 0 and 1 or belong to no document are not learned from; without any usable label
    every score is 0.5. An empty table gives no rows. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), _n_chars(docs))
    scored = texts.mapInArrow(_scored(shared, threshold), "doc_id long, score double, predicted int")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
