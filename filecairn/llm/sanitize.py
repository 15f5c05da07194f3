"""Personal data, and the terms that disclose it by their co-occurrence in the corpus."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from filecairn.llm.common import slim
from filecairn.plans.cut import written
from filecairn.plans.skew import fits, salted_join

KINDS = ("email", "ip", "card", "phone")
# Words on either side of a match by which copies of one passage are known.
CONTEXT_WORDS = 8
SUPPORT = 3
DISCLOSURE = 0.9
FILTER_BITS = 23
REMEMBER = 400_000
MAX_BROADCAST_TEXTS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: what fails there fails further on in the run too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANKED = re.compile(r"\S+")
_BARE = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at each @, the run of local characters before it, no further back than the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def find(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of the base matches, by kind, then start."""
    if not _ANY.search(text):
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _hash(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def terms(text: str) -> Iterator[tuple[str, int, int]]:
    """Lower-case words of letters, without the marks around them, and where they lie; none from a word with an @."""
    for word in _BLANKED.finditer(text):
        if "@" not in word[0]:
            for m in _BARE.finditer(word[0]):
                yield m[0].lower(), word.start() + m.start(), word.start() + m.end()


def broader(term: str) -> str:
    """The class a term generalises to: all that begin with its first half."""
    return term[: (len(term) + 1) // 2] + "*"


def word_terms(word: str) -> list[str]:
    """The terms of a word between blanks; most words are letters alone."""
    if word.isalpha():
        return [word.lower()]
    return [] if "@" in word else [t.lower() for t in _BARE.findall(word)]


def _asked(word: str, bits: bytes) -> tuple[int, ...]:
    """Hashes of a word's terms and of their classes, as far as they may be asked for."""
    hashes = [_hash(x) for t in word_terms(word) for x in (t, broader(t))]
    return tuple(h for h in hashes if bits[h & _SLOT])


def _entities(text: str, found: list[tuple[str, int, int]], width: int) -> list[dict]:
    """For each distinct value of a match the least hash of the words around it."""
    out: dict[int, int] = {}
    for kind, start, end in found:
        if kind == "email":
            value = text[start:end].lower()
        else:
            value = re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[start:end])
        before, after = _outward(text, start, width, -1), _outward(text, end, width, 1)
        around = [t for a, b in ((before, start), (end, after)) for t, _, _ in terms(text[a:b])]
        entity, context = _hash(f"{kind}:{value}"), _hash(" ".join(around))
        out[entity] = min(context, out.get(entity, context))
    return [{"e": e, "c": c} for e, c in out.items()]


def _term_hashes(text: str) -> list[int]:
    return list({_hash(x) for word in set(text.split()) for t in word_terms(word) for x in (t, broader(t))})


def _outward(text: str, at: int, width: int, step: int) -> int:
    """Where ``width`` words beyond ``at`` end."""
    if step > 0:
        for n, m in enumerate(_WORD.finditer(text, at), 1):
            if n >= width:
                return m.end()
        return len(text)
    seen, pos, inside = 0, at, False
    while pos > 0:
        blank = text[pos - 1] in " \t\n\x0b\x0c\r"
        if inside and blank:
            seen += 1
            if seen >= width:
                return pos
        inside = not blank
        pos -= 1
    return 0


def _spelled(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


FOUND = "array<struct<e: long, c: long>>"
SCANNED = (
    "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    f"base string, found {FOUND}, terms array<long>"
)
_FOUND_TYPE = pa.list_(pa.struct([("e", pa.int64()), ("c", pa.int64())]))


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(9)]
            for text in batch.column(1):
                text = text.as_py() or ""
                found = find(text)
                base = _spelled(found)
                kinds = [k for k, _, _ in found]
                row = [_hash(text), *[kinds.count(k) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), base,
                       _entities(text, found, width) if found else [], _term_hashes(text) if found else []]
                for column, value in zip(columns, row):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), _FOUND_TYPE, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", "text_hash", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "found", "terms"],
            )

    return run


def _bits(hashes: DataFrame, column: str) -> bytes:
    """Which low bits the hashes have, as a table of fixed size: at most 2**20 rows of eight slots are gathered."""
    slots = hashes.selectExpr(f"{column} & {(1 << FILTER_BITS) - 1} as slot")
    marks = slots.groupBy(F.expr("slot div 8").alias("b")).agg(F.expr("bit_or(shiftleft(1, cast(slot % 8 as int)))").alias("m"))
    packed = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in marks.toLocalIterator():
        packed[row["b"]] = row["m"]
    return np.unpackbits(packed, bitorder="little").tobytes()


_SLOT = (1 << FILTER_BITS) - 1


def _occurrences(shared):
    """How many texts hold each asked term: ``t, text_hash, n``, added up in the task.

    A text that may have copies is told by its hash, so that it can be counted once; the others have none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, copied = shared.value
        known: dict[str, tuple[int, ...]] = {}
        counts: Counter = Counter()

        def batch_of(rows) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t", "text_hash", "n"])

        for batch in batches:
            rows = []
            for text in batch.column(0):
                text = text.as_py()
                if not text:
                    continue
                hit: set[int] = set()
                if len(known) > REMEMBER:
                    known.clear()
                for word in set(text.split()):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = _asked(word, asked)
                    if got:
                        hit.update(got)
                whole = _hash(text)
                if copied[whole & _SLOT]:
                    rows += [(t, whole, 1) for t in hit]
                else:
                    counts.update(hit)
            yield batch_of(rows)
            if len(counts) > 500_000:
                yield batch_of([(t, None, n) for t, n in counts.items()])
                counts.clear()
        yield batch_of([(t, None, n) for t, n in counts.items()])

    return run


def scan(docs: DataFrame, width: int = CONTEXT_WORDS) -> DataFrame:
    """Base matches of every document row, the values found and, where there are any, the terms of the text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(slim(_scan(width)), SCANNED), "scanned")


def _texts_with(docs: DataFrame, scanned: DataFrame, wanted: DataFrame) -> DataFrame:
    """``t, n_t``: number of distinct texts of the corpus with each of the wanted terms, and perhaps some others."""
    copied = scanned.groupBy("text_hash").agg(F.count("*").alias("rows")).filter("rows > 1")
    shared = docs.sparkSession.sparkContext.broadcast((_bits(wanted, "t"), _bits(copied, "text_hash")))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    seen = texts.mapInArrow(slim(_occurrences(shared)), "t long, text_hash long, n long")
    # Copies of one text count once, whichever tasks they are in.
    once = seen.groupBy("t", "text_hash").agg(F.sum("n").alias("n"))
    return once.groupBy("t").agg(F.sum(F.when(F.col("text_hash").isNull(), F.col("n")).otherwise(1)).alias("n_t"))


def disclosing_terms(
    docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE
) -> DataFrame:
    """``e, t, share``: the terms that reveal an entity, and how much of its information they give away.

    Terms are those of whole texts. An entity is counted in distinct texts, of which those that
    have the same words around it, copies of one passage, are one. With N distinct texts, n_e of them
    with the entity, n_et with entity and term and n_t with the term, PMI = log2(N n_et / (n_e n_t)) and
    IC = log2(N / n_e). A term in at least ``support`` texts of the entity discloses it if
    PMI >= ``disclosure`` * IC. The class of a term (see ``broader``) is counted in the same way.
    """
    found = scanned.select("text_hash", F.explode("found").alias("f")).select("f.e", "f.c", "text_hash")
    units = found.groupBy("e", "c").agg(F.min("text_hash").alias("text_hash"))
    entities = units.groupBy("e").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    counted = entities.withColumnRenamed("n_e", "file_count")
    # An entity of very many texts is salted.
    units = salted_join(units, entities, "e", "inner", F.col("text_hash"), counted)
    units = units.select("e", "n_e", "text_hash").distinct()
    holding = scanned.filter(F.size("found") > 0).select("text_hash", "terms").dropDuplicates(["text_hash"])
    pairs = units.join(holding, "text_hash").select("e", "n_e", F.explode("terms").alias("t"))
    pairs = pairs.groupBy("e", "n_e", "t").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    pairs = written(pairs, "pairs")
    total = scanned.select("text_hash").distinct().count()
    # A term of very many entities is one row per entity here; counts are one row per term, and may be broadcast or not.
    known = pairs.join(_texts_with(docs, scanned, pairs), "t")
    whole = F.lit(float(max(total, 1)))
    ic = F.log2(whole / F.col("n_e"))
    pmi = F.log2(whole * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    return written(known.select("e", "t", share.alias("share")).filter(F.col("share") >= disclosure), "disclosing")


def _marked(shared):
    """Where terms that may disclose stand in whole texts, outside the base matches, with the hash of their class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = shared.value, {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                hit = False
                if len(known) > REMEMBER:
                    known.clear()
                for word in set(text.split()):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = any(asked[_hash(t) & _SLOT] for t in word_terms(word))
                    hit = hit or got
                if not hit:
                    continue
                taken, whole = find(text), _hash(text)
                for term, start, end in terms(text):
                    h = _hash(term)
                    if asked[h & _SLOT] and not any(a < end and start < b for _, a, b in taken):
                        rows.append((doc_id, whole, h, _hash(broader(term)), start, end))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "text_hash", "t", "g", "s", "x"]
            )

    return run


def _term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, terms``: spans of disclosing terms wherever they stand, in order.

    ``general`` says that the class of the term discloses nothing, so that it may stand for the term.
    """
    strength = written(found.groupBy("t").agg(F.max("share").alias("share")), "strength")
    shared = docs.sparkSession.sparkContext.broadcast(_bits(strength, "t"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    where = texts.mapInArrow(slim(_marked(shared)), "doc_id long, text_hash long, t long, g long, s long, x long")
    # Rows that share id and text have the same spans.
    hits = where.distinct().join(strength, "t").join(
        strength.select(F.col("t").alias("g"), F.lit(True).alias("_told")), "g", "left"
    )
    span = F.struct(
        F.col("s").cast("int").alias("s"), F.col("x").cast("int").alias("x"), "share", F.col("_told").isNull().alias("general")
    )
    spans = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("terms"))
    return written(spans, "terms")


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """Counts, digest and spans of every document row.

    Base matches are those of ``find``. The method adds spans of kind ``term``: every word of any document that
    discloses a value of the corpus (see ``disclosing_terms``). Null and empty texts have no
    spans; ids may be null; repeated rows give repeated results; an empty table gives no rows.
    """
    scanned = scan(docs)
    terms_of = _term_spans(docs, disclosing_terms(docs, scanned, **options)).withColumnRenamed("doc_id", "_id")
    terms_of = terms_of.withColumnRenamed("text_hash", "_hash").withColumnRenamed("terms", "_terms")
    same = scanned["doc_id"].eqNullSafe(terms_of["_id"]) & (scanned["text_hash"] == terms_of["_hash"])
    added = F.array_join(F.transform("_terms", lambda t: F.concat_ws(":", F.lit("term"), t["s"], t["x"])), ",")
    return scanned.drop("found", "terms").join(terms_of, same, "left").select(
        scanned["doc_id"], *[f"n_{k}" for k in KINDS], "base_sha256",
        F.array_join(F.array_compact(F.array(F.nullif("base", F.lit("")), added)), ",").alias("spans"),
    )


def masked(text: str, hidden: list[dict]) -> str:
    """The text with matches replaced by their kind, and disclosing terms by their class or by nothing."""
    spans = [(a, b, f"[{kind.upper()}]") for kind, a, b in find(text)]
    spans += [(t["s"], t["x"], broader(text[t["s"] : t["x"]]) if t["general"] else "") for t in hidden]
    out, at = [], 0
    for start, end, name in sorted(spans):
        if start >= at:
            out += [text[at:start], name]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitized(docs: DataFrame, **options) -> DataFrame:
    """The same rows and columns with personal data masked by kind and disclosing terms generalised or removed.

    A term gives way to its class where that discloses nothing, and is removed elsewhere. ``n_chars``, if
    there is one, follows the new text. Null texts stay null. Rows find their spans by id and whole text, so that ids
    may repeat or be null.
    """
    scanned = scan(docs)
    # Names that no column of the caller has.
    free = "_" * (1 + max(map(len, docs.columns)))
    of, terms_of = f"of{free}", f"terms{free}"
    hidden = _term_spans(docs, disclosing_terms(docs, scanned, **options)).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("terms").alias(terms_of)
    )
    if fits(hidden, MAX_BROADCAST_TEXTS):
        hidden = F.broadcast(hidden)
    position = docs.columns.index("text")
    # The hash that the spans carry is worked out again beside the text.
    cast = [F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*cast)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed = rows.mapInArrow(slim(_with_hash(position, of)), f"{kinds}, `{of}` long")
    same = keyed["doc_id"].cast("long").eqNullSafe(hidden["_id"]) & (keyed[of] == hidden["_hash"])
    joined = keyed.join(hidden, same, "left").select(*[keyed[f"`{c}`"] for c in docs.columns], hidden[terms_of])
    out = joined.mapInArrow(slim(_masking(position, docs.columns)), rows.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out


def _with_hash(position: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [_hash(text.as_py() or "") for text in batch.column(position)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], names=[*batch.schema.names, name])

    return run


def _masking(position: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hidden = batch.column(batch.num_columns - 1).to_pylist()
            clean = [None if t.as_py() is None else masked(t.as_py(), h or []) for t, h in zip(batch.column(position), hidden)]
            columns = [pa.array(clean, pa.string()) if k == position else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
