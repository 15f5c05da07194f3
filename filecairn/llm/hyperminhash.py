"""Near-duplicate documents by HyperMinHash registers, banding and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.llm.common import slim
from filecairn.plans.cut import written
from filecairn.plans.skew import fits

SHINGLE = 5
PERCENT = 75
REGISTERS = 128
ROWS = 4  # registers in a band: 32 bands miss a pair of similarity 0.75 with probability 5e-6
MANTISSA = 11  # with 5 bits of leading zeros a register has 16 bits, and a band is one long
BLOCK = 1024
SLACK = 4.0  # standard deviations below the threshold at which an estimate drops a pair
MAX_BROADCAST_NODES = 200_000

_A = np.random.default_rng(20240607).integers(0, 1 << 32, (REGISTERS, 1), dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(20240608).integers(0, 1 << 32, (REGISTERS, 1), dtype=np.uint32)
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; remembers a bounded number of words."""

    def __init__(self, size: int = SHINGLE, remember: int = 150_000):
        import xxhash

        self.size, self.remember, self.known, self.hash = size, remember, {}, xxhash.xxh3_64_intdigest

    def words(self, text: str) -> np.ndarray:
        lower = text.lower() if text.isascii() else text.translate(_UPPER)
        found = [w for w in _SPLIT.split(lower) if w]
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            pass
        if len(known) > self.remember:
            known.clear()
        for word in found:
            if word not in known:
                known[word] = self.hash(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def shingles(self, text: str | None) -> np.ndarray:
        h = self.words(text) if text else np.empty(0, np.uint64)
        if not len(h):
            return h
        width = min(self.size, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of a set: leading zeros (5 bits) and the 11 bits after the first one of each minimum."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 8192):
        part = short[start : start + 8192]
        np.minimum(least, (part * _A + _B).min(axis=1), out=least)
    value = np.maximum(least, 1).astype(np.float64)
    zeros = 31 - (np.frexp(value)[1] - 1)
    mantissa = ((least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def _chance(sizes: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets agree, for each pair of set sizes."""
    mantissas = 1 << MANTISSA
    probabilities = []
    for n in sizes:
        cells = []
        for z in range(32):
            low = 2.0 ** -(z + 1)
            edges = low * (1 + np.arange(mantissas + 1) / mantissas)
            cells.append(-np.diff((1 - np.minimum(edges, 1.0)) ** n))
        probabilities.append(np.concatenate(cells))
    table = np.array(probabilities)
    return table @ table.T


class Estimator:
    """Jaccard similarity from the share of equal registers, less the share that agrees by chance."""

    def __init__(self):
        self.grid = np.arange(0, 33)
        self.chance = _chance(np.exp2(self.grid[:26]).astype(np.float64))

    def __call__(self, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        at = lambda x: np.minimum(np.round(np.log2(np.maximum(x, 1))).astype(int), 25)
        c = self.chance[at(n), at(m)]
        return np.clip((equal / REGISTERS - c) / (1 - c), 0, 1)


def _floor(percent: int) -> float:
    j = percent / 100
    return j - SLACK * (j * (1 - j) / REGISTERS) ** 0.5


SKETCH = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(1):
            s = shingler.shingles(text.as_py())
            if not len(s):
                rows.append((0, 0, 0, None))
                continue
            h1 = int(np.bitwise_xor.reduce(_mix(s + np.uint64(1))).astype(np.int64))
            h2 = int(np.add.reduce(_mix(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64))
            rows.append((len(s), h1, h2, registers(s).view("<i8")))
        n, h1, h2, r = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
             pa.array(r, pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands"],
        )


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, a 128-bit hash of the set and 32 bands of four registers, one long each."""
    return _keyed(docs).mapInArrow(slim(_sketches), SKETCH)


def text_hash(text: Column) -> Column:
    """What tells unlike texts of one id apart."""
    return F.xxhash64(text.cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
        text_hash(docs["text"]).alias("text_hash"),
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        sets = [shingler.shingles(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def _linked(percent: int):
    """Pairs ``a, b`` whose sets, read where Arrow holds them, are alike enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3))
            keep = [
                _is_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in sets
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(percent: int):
    """Pairs whose estimate does not rule them out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        estimate, least = Estimator(), _floor(percent)
        for batch in batches:
            if not len(batch):
                continue
            ra = np.stack(batch["bands_a"].to_numpy()).astype("<i8").view("<u2")
            rb = np.stack(batch["bands_b"].to_numpy()).astype("<i8").view("<u2")
            n, m = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            ok = (estimate((ra == rb).sum(axis=1), n, m) >= least) & _sizes_allow(n, m, percent)
            yield batch.loc[ok, ["a", "b"]]

    return run


def _sizes_allow(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_links(percent: int):
    """Within each sorted group of a block pair: links between components, confirmed on full sets, likeliest first.

    A pair whose components a link of this block has joined already is passed over.
    """
    def links(group: pd.DataFrame, estimate: Estimator, least: float) -> pd.DataFrame:
        left, right = group[group["first"]], group[group["second"]]
        rb = np.stack(right["bands"].to_numpy()).astype("<i8").view("<u2")
        nb, cb, ib, sb = (right[c].to_numpy() for c in ("n", "comp", "node", "set"))
        band, parent = group["band"].iloc[0], {}
        found_a, found_b = [], []

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for node, comp, n, bands, own in zip(left["node"], left["comp"], left["n"], left["bands"], left["set"]):
            can = np.flatnonzero((cb != comp) & _sizes_allow(nb, np.int64(n), percent))
            same = rb[can] == np.asarray(bands).astype("<i8").view("<u2")
            # A pair that shares several bands is looked at in the first of them only.
            first = same.reshape(len(can), REGISTERS // ROWS, ROWS).all(axis=2).argmax(axis=1) == band
            can, same = can[first], same[first]
            if not len(can):
                continue
            j = estimate(same.sum(axis=1), nb[can], np.full(len(can), n))
            order = np.lexsort((ib[can], -j))
            a = np.frombuffer(own, np.uint64)
            for k in can[order[j[order] >= least]]:
                x, y = root(int(comp)), root(int(cb[k]))
                if x != y and _is_link(a, np.frombuffer(sb[k], np.uint64), percent):
                    parent[max(x, y)] = min(x, y)
                    found_a.append(min(node, ib[k]))
                    found_b.append(max(node, ib[k]))
        return pd.DataFrame({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        estimate, least, rest = Estimator(), _floor(percent), None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rest):
                continue
            change = (rest[["band", "key", "i", "j"]] != rest[["band", "key", "i", "j"]].shift()).any(axis=1)
            cuts = np.flatnonzero(change.to_numpy())
            for start, end in zip(cuts[:-1], cuts[1:]):
                yield links(rest.iloc[start:end], estimate, least)
            rest = rest.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield links(rest, estimate, least)

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node with an edge: the least node that it can reach.

    Each round takes the least label among the neighbours and then the label of that label;
    every round is written, and rounds end when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("_near"))
        )
        step = labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("comp").alias("_jump"))
        following = written(
            step.join(jump, "_new", "left").select("node", "_old", F.least("_new", "_jump").alias("comp")), "labels"
        )
        changed = not following.filter("comp != _old").isEmpty()
        labels = following.select("node", "comp")
        if not changed:
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after more links; of the earlier links one edge per node, to its component, is enough."""
    if links.isEmpty():
        return labels
    if labels is not None:
        links = links.unionByName(labels.filter("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
    return components(links)


def _with_components(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return df.withColumn("comp", F.col("node"))
    return df.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document row; see ``near_groups``."""
    return near_groups(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one of least id, then of least text hash.

    Rows are known by id and text, so ids may repeat or be null; null ids come last. Of rows that share
    both, one stays. Rows without a word are copies of nothing and all stay.
    """
    found = near_groups(docs, percent).filter("group is not null")
    counted = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    name = F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", "text_hash", "rows")
    free = "_" * (1 + max(map(len, docs.columns)))
    first = counted.groupBy("group").agg(F.min(name).alias("first")).select(
        F.col("first.doc_id").alias(f"i{free}"), F.col("first.text_hash").alias(f"h{free}"), F.col("first.rows").alias(f"n{free}")
    )
    worded = F.coalesce(docs["text"].cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = docs["doc_id"].cast("long").eqNullSafe(first[f"i{free}"]) & (text_hash(docs["text"]) == first[f"h{free}"])
    chosen = docs.filter(worded).join(first, same)
    columns = [docs[f"`{c}`"] for c in docs.columns]
    single = chosen.filter(F.col(f"n{free}") == 1).select(*columns)
    several = chosen.filter(F.col(f"n{free}") > 1).dropDuplicates([f"i{free}", f"h{free}"]).select(*columns)
    return docs.filter(~worded).unionByName(single).unionByName(several)


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept, group`` for every document row.

    Words are runs without the six ASCII white-space characters, A-Z lower-cased; a document's
    set is its distinct five-word shingles, the whole sequence if it has fewer words. Documents
    are linked if 100 * intersection >= ``percent`` * union, on full sets of 64-bit hashes.

    Equal sets are one node, named by their least doc_id. Nodes that share a band are a bucket.
    First every bucket's pivot, the node that meets most others, is compared with the rest
    of the bucket. Buckets that still hold several components are then compared across those,
    block by block, in every pair that the estimate doesn't rule out. Pairs within a component need no link of their own, so the links are
    few even in a bucket of thousands of copies. Buckets over ``BLOCK`` nodes are compared block by block.
    Estimates drop a pair only when it lies four standard deviations below the threshold.

    ``group`` names the component whatever the ids are; it is null for a text without shingles.

    Null and empty texts have no shingles, no links, and are kept. Rows that repeat an id
    share a component if their texts are linked; rows with a null id are named by the
    least id of their component, null if it has none, and aren't kept unless they are all of it.
    An empty table gives no rows.
    """
    sketched = written(sketch(docs), "sketches")
    none = -(1 << 62)  # stands for a null id; it never names a component that has another id
    ident = F.coalesce("doc_id", F.lit(none).cast("long"))
    sets = sketched.filter("n_shingles > 0")
    nodes = written(
        sets.groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("_min"), F.first("bands").alias("bands"))
        .select(F.col("h1"), "h2", F.col("n_shingles").alias("n"), F.coalesce("_min", F.lit(none)).alias("_id"), "bands")
        .select("h1", "h2", "n", F.col("_id"), "bands", F.xxhash64("h1", "h2").alias("_tie")),
        "nodes",
    )
    # Where the table repeats an id, also one that names no set, the sets' own hashes name the nodes.
    unique = sets.groupBy(ident.alias("_id")).count().filter("count > 1").isEmpty()
    nodes = nodes.withColumn("node", F.col("_id") if unique else F.col("_tie"))
    labels = _labels(docs, nodes, sketched, percent, unique)
    placed = nodes.select("h1", "h2", F.col("n").alias("n_shingles"), "node", "_id")
    if labels is None:
        named = placed.withColumn("component_id", F.col("_id")).withColumn("comp", F.col("node"))
    else:
        joined = _with_components(placed, labels)
        if unique:
            named = joined.withColumn("component_id", F.col("comp"))
        else:
            real = F.when(F.col("_id") != none, F.col("_id"))
            least = joined.groupBy("comp").agg(F.coalesce(F.min(real), F.lit(none)).alias("component_id"))
            named = joined.join(least, "comp")
    named = named.select("h1", "h2", "n_shingles", "component_id", F.col("comp").alias("group"))
    found = sketched.drop("bands").join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.coalesce("component_id", ident)
    return found.select(
        "doc_id", "text_hash", "n_shingles", F.when(component != none, component).alias("component_id"),
        (ident == component).alias("kept"), "group",
    )


def _labels(docs: DataFrame, nodes: DataFrame, sketched: DataFrame, percent: int, unique: bool) -> DataFrame | None:
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(banded.join(sizes, ["band", "key"]), "members")
    meets = written(members.groupBy("node").agg(F.sum("size").alias("meets")), "meets")
    ranked = members.join(meets, "node")
    pivots = ranked.groupBy("band", "key").agg(F.max_by("node", F.struct("meets", F.xxhash64("node"))).alias("pivot"))
    pairs = members.join(pivots, ["band", "key"]).filter("node != pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    ).distinct()
    info = written(nodes.join(meets, "node").select("node", "n", "bands"), "registers")
    side = lambda c: info.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bands").alias(f"bands_{c}"))
    pairs = written(pairs, "pairs")
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(slim(_likely(percent)), "a long, b long"), "likely")
    if likely.isEmpty() and members.filter("size > 2").isEmpty():
        return None
    full = _full_sets(docs, sketched, nodes, meets, unique)
    labels = _merged(None, _verified(likely, full, percent))
    open_ = _with_components(members.filter("size > 2"), labels)
    several = open_.groupBy("band", "key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter("_x != _y")
    rows = open_.join(several.select("band", "key"), ["band", "key"])
    rows = rows.withColumn("_blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    # A large bucket is split into blocks; every pair of blocks meets once.
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")).select(
        "band", "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node", "comp", "_own"
    )
    rows = rows.withColumn("first", F.col("_own") == F.col("i")).withColumn("second", F.col("_own") == F.col("j")).drop("_own")
    rows = rows.join(info, "node").join(full, "node")
    grouped = rows.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    more = written(grouped.mapInPandas(slim(_block_links(percent)), "a long, b long").distinct(), "links")
    return _merged(labels, more)


def _full_sets(docs: DataFrame, sketched: DataFrame, nodes: DataFrame, meets: DataFrame, unique: bool) -> DataFrame:
    """``node, set`` for every node in a bucket: the shingle hashes, from a second reading of those texts only."""
    wanted = nodes.join(meets.select("node"), "node")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if unique:
        key = F.coalesce("doc_id", F.lit(-(1 << 62)).cast("long"))
        ids = wanted.select(F.col("_id").alias("node"))
        base = base.withColumn("node", key)
        small = fits(ids, MAX_BROADCAST_NODES)
        chosen = base.join(F.broadcast(ids) if small else ids, "node", "left_semi").select("node", "text")
        once = chosen.mapInArrow(slim(_sets), "node long, set binary")
        return written(once, "sets")
    every = _keyed(docs).mapInArrow(slim(_keyed_sets), "h1 long, h2 long, n long, set binary")
    chosen = every.join(wanted.select("h1", "h2", "n", "node"), ["h1", "h2", "n"])
    return written(chosen.groupBy("node").agg(F.first("set").alias("set")), "sets")


def _keyed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = next(_sketches(iter([batch])))
        sets = next(_sets(iter([batch])))
        yield pa.RecordBatch.from_arrays(
            [sketches.column(3), sketches.column(4), sketches.column(2), sets.column(1)], names=["h1", "h2", "n", "set"]
        )


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    side = lambda c: full.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return written(rows.mapInArrow(slim(_linked(percent)), "a long, b long"), "links")
