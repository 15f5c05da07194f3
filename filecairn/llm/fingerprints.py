"""Fingerprints by consistent weighted sampling over the words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.llm.common import running, text_of
from filecairn.plans.cut import written

SAMPLES = 64
_SCALE = float(1 << 42)
_TAG = (1 << 15) - 1
_PART = (1 << 21) - 1
# A text's least value lies beyond this by chance once in exp(24) samples; such texts are drawn again in full.
REACH = 24.0
_MARGIN = 1e-6
_MOST = 64.0  # c has 42 bits, so every a is less
SIDES = {"own": "fingerprint", "edited": "edited_fingerprint"}


def _bits(value: Column, shift: int, mask: int) -> Column:
    """A number in (0, 1] from some of 64 random bits."""
    part = F.shiftrightunsigned(value, shift) if shift else value
    return (part.bitwiseAND(F.lit(mask)).cast("double") + 1.0) * F.lit(1.0 / (mask + 1))


def signatures(
    pairs: DataFrame, keys: list[str], sides: list[str], samples: int = SAMPLES, reach: float | None = None
) -> DataFrame:
    """``keys`` and one fingerprint column per side for the texts in the columns ``sides``.

    A text's terms are its lower-cased words, weighted by their count S. For each sample a term
    draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) of its own from two hashes of term and sample; t = floor(ln S / r + b)
    and a = c / exp(r (t + 1 - b)). The term and t of the least a are the sample: two texts share it
    with probability equal to their generalised Jaccard similarity, and samples are independent. The
    fingerprint is four hexadecimal digits per sample. Rows must be partitioned by ``keys`` or will be.
    Texts without words give no row.

    The least a of a text of W words is an exponential variable of rate W. With ``reach`` a term for which
    a bound without logarithms shows that a is at least ``reach`` / W is not drawn any further. Column ``open``
    is then true in the rows in which a sample found no lesser a; all others are as without ``reach``,
    but for sides with words in which not one sample did: their fingerprint is null.
    """
    side = F.posexplode(F.array(*sides)).alias("_side", "_text")
    split = F.split(F.lower("_text"), r"[ \x09-\x0D]+").alias("_words")
    sized = pairs.select(*keys, side).select(*keys, "_side", split).select("*", F.size("_words").alias("_w"))
    words = sized.select(*keys, "_side", "_w", F.explode("_words").alias("_word")).filter("_word != ''")
    counts = words.groupBy(*keys, F.xxhash64("_word").alias("_term")).agg(
        *[F.count(F.when(F.col("_side") == n, 1)).alias(f"_n{n}") for n in range(len(sides))],
        *[F.max(F.when(F.col("_side") == n, F.col("_w"))).alias(f"_w{n}") for n in range(len(sides))],
    )
    numbers = range(len(sides))
    logs = [F.ln(F.when(F.col(f"_n{n}") > 0, F.col(f"_n{n}").cast("double"))).alias(f"_l{n}") for n in numbers]
    far = [F.least(F.lit(float(reach)) / F.col(f"_w{n}"), F.lit(_MOST)) for n in numbers] if reach else []
    limits = [
        F.greatest(F.lit(0.0), *[far[n] * F.col(f"_n{n}") for n in numbers]).alias("_limit"),
        F.expr(" and ".join(f"_n{n} < 2" for n in numbers)).alias("_single"),
        *[(far[n] * F.lit(_SCALE * (1 - _MARGIN))).cast("long").alias(f"_m{n}") for n in numbers],
    ] if reach else []
    # One row per term and sample: a wider row would outgrow what the JVM compiles at once.
    drawn = counts.select(*keys, "_term", *logs, *limits, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_i"))
    # The row number keeps the filter above the hashes, which it would otherwise compute once more for each use.
    drawn = drawn.select(
        "*", *[F.xxhash64("_term", "_i", F.lit(k)).alias(f"_h{k}") for k in (0, 1)],
        F.monotonically_increasing_id().alias("_row"),
    )
    drawn = drawn.select(
        "*",
        (_bits(F.col("_h0"), 32, 0xFFFFFFFF) * _bits(F.col("_h0"), 0, 0xFFFFFFFF)).alias("_p"),
        _bits(F.col("_h1"), 42, _PART).alias("_b"),
        (_bits(F.col("_h1"), 21, _PART) * _bits(F.col("_h1"), 0, _PART)).alias("_q"),
    )
    if reach:
        # exp(-r) is p and c = -ln q >= 2 (1 - q) / (1 + q). S a >= c p always; for S = 1 and b < 1,
        # a = c p^(1 - b) >= c p / (1 - b + b p).
        b, p, q = F.col("_b"), F.col("_p"), F.col("_q")
        spread = F.when(F.col("_single") & (b < 1.0), 1.0 - b + b * p).otherwise(1.0)
        drawn = drawn.filter((p * (2.0 - 2.0 * q) < F.col("_limit") * (1.0 + q) * spread) & (F.col("_row") >= 0))
    drawn = drawn.select("*", (-F.ln("_p")).alias("_r"), (-F.ln("_q")).alias("_c"))
    drawn = drawn.select("*", *[F.floor(F.col(f"_l{n}") / F.col("_r") + F.col("_b")).alias(f"_t{n}") for n in numbers])
    for n in numbers:
        t = F.col(f"_t{n}")
        a = F.col("_c") * F.exp(-F.col("_r") * (t + 1.0 - F.col("_b")))
        tag = F.col("_h0").bitwiseXOR(t).bitwiseAND(F.lit(_TAG))
        value = F.shiftleft((a * F.lit(_SCALE)).cast("long"), 15).bitwiseOR(tag)
        # Sides that agree in t agree in the sample.
        if n:
            value = F.when(t == F.col("_t0"), F.col("_v0")).otherwise(value)
        drawn = drawn.select("*", value.alias(f"_v{n}"))
    found = drawn.groupBy(*keys, "_i").agg(
        *[F.min(f"_v{n}").alias(f"_s{n}") for n in numbers], *([F.min(f"_m{n}").alias(f"_m{n}") for n in numbers] if reach else [])
    )
    digits = lambda c: F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(c), F.lit(65536)))), 4, "0")
    beyond = [F.coalesce(F.shiftright(f"_s{n}", 15) >= F.col(f"_m{n}"), F.lit(False)) for n in numbers] if reach else [F.lit(False)]
    part = found.select(
        *keys, "_i", *[F.when(F.col(f"_s{n}").isNotNull(), digits(f"_s{n}")).alias(f"_p{n}") for n in numbers],
        F.greatest(F.lit(False), *beyond).alias("_beyond"),
    )
    whole = part.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", *[f"_p{n}" for n in numbers]))).alias("_all"),
        F.max("_beyond").alias("_beyond"), *[F.count(f"_p{n}").alias(f"_c{n}") for n in numbers],
    )
    partly = [F.col(f"_c{n}").between(1, samples - 1) for n in numbers]
    return whole.select(*keys, *[
        F.when(F.col(f"_c{n}") > 0, F.array_join(F.col(f"_all._p{n}"), "")).alias(f"{name}_fingerprint")
        for n, name in enumerate(sides)
    ], *([F.greatest("_beyond", *partly).alias("open")] if reach else []))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree: estimates the generalised Jaccard similarity."""
    same = [(F.substring(a, 4 * i + 1, 4) == F.substring(b, 4 * i + 1, 4)).cast("int") for i in range(samples)]
    total = same[0]
    for one in same[1:]:
        total = total + one
    return total / F.lit(float(samples))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, reach: float = REACH) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    Documents stand in the order of doc_id (nulls first; equal ids by a hash of the text). The
    edited text replaces the last quarter, floor(n / 4) code points, by the first as many of the
    next document, or all it has; after the last comes the first. A single document is its own
    next. Null texts are empty. Texts without words carry the fingerprint of zeros: alike to
    each other (1), unlike any other. Rows that repeat both id and text are one place in
    the order, and come out as often as they came in. An empty table gives no rows. Whole texts
    move once, and the quarter that is needed of the next document once more. Terms beyond ``reach`` are
    not drawn to the end; texts in which that leaves a sample open are drawn again in full, so it changes no result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    base = base.withColumn("_hash", F.xxhash64("text"))
    ids = base.groupBy("doc_id", "_hash").agg(
        F.count("*").alias("_rows"), F.max(F.char_length("text")).cast("long").alias("n_chars")
    )
    placed = written(running(ids, [F.col("doc_id").asc_nulls_first(), F.col("_hash")], {}), "placed")
    info = placed.agg(F.count("*").alias("n"), F.max("_rows").alias("most")).first()
    count = max(info["n"], 1)
    after = placed.select(
        (F.col("position") % count + 1).alias("position"), F.col("doc_id").alias("_to"),
        F.col("_hash").alias("_to_hash"), F.floor(F.col("n_chars") / 4).cast("int").alias("_need"),
    )
    links = placed.select("doc_id", "_hash", "position").join(after, "position").drop("position")
    if (info["most"] or 1) > 1:
        base = base.dropDuplicates(["doc_id", "_hash"])
    keys = ["_id", "_hash"]
    # doc_id may be null, which a join key may not: ids are shifted into a key that is never null.
    as_key = lambda c: F.coalesce(c, F.lit(-(1 << 63)).cast("long"))
    base = base.select(as_key(F.col("doc_id")).alias("_id"), "_hash", "text")
    links = links.select(
        as_key(F.col("doc_id")).alias("_id"), "_hash", as_key(F.col("_to")).alias("_to"), "_to_hash", "_need"
    )
    pieces = base.join(links, keys).select(
        F.col("_to").alias("_id"), F.col("_to_hash").alias("_hash"), F.expr("left(text, _need)").alias("_piece")
    )
    cut = F.expr("left(text, char_length(text) - char_length(text) div 4)")
    texts = base.join(pieces, keys).select(*keys, F.col("text").alias("own"), F.concat(cut, "_piece").alias("edited"))
    worded = lambda c: F.col(c).rlike(r"[^ \x09-\x0D]")
    hashes = texts.select(
        *keys, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        worded("own").alias("_own"), worded("edited").alias("_edited"),
    )
    none = F.lit("0" * 4 * samples)
    placed = placed.withColumn("_id", as_key(F.col("doc_id")))
    prints = [F.coalesce(f"{side}_fingerprint", none).alias(name) for side, name in SIDES.items()]
    marks = signatures(texts, keys, [*SIDES], samples, reach)
    missing = [F.col(f"_{side}") & F.col(f"{side}_fingerprint").isNull() for side in SIDES]
    done = written(
        placed.join(hashes, keys).join(marks, keys, "left").select(
            "position", "doc_id", "_rows", "n_chars", "edited_sha256", *prints,
            F.greatest(F.coalesce("open", F.lit(False)), *missing).alias("_open"),
        ),
        "fingerprints",
    )
    opened = done.filter("_open")
    if not opened.isEmpty():
        named = placed.join(opened.select("position"), "position").select(*keys, "position")
        full = signatures(texts.join(named.select(*keys), keys, "left_semi"), keys, [*SIDES], samples)
        drawn = named.join(full, keys, "left").select("position", *prints)
        again = opened.drop(*SIDES.values()).join(drawn, "position").select(done.columns)
        done = written(done.filter("not _open").unionByName(again), "fingerprints")
    following = done.select(
        F.when(F.col("position") == 1, F.lit(count)).otherwise(F.col("position") - 1).cast("long").alias("position"),
        F.col("fingerprint").alias("_next"),
    )
    out = done.join(following, "position").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next"), samples).alias("near_next"), "_rows",
    )
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_again")
    return out.select("*", again).drop("_rows", "_again")
