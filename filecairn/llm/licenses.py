"""License notices found by MinHash bands over word windows, verified by exact containment."""

from __future__ import annotations

import math
import os
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.llm.common import text_of

SHINGLE = 5
CONTAINMENT = 0.75
ROWS = 2
MISS = 1e-3

# Wording of widely used license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "Apache-2.0-disclaimer": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted"
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def window_similarity(containment: float) -> float:
    """Least Jaccard similarity of a template and the window nearest to a stretch that contains so much of it.

    Window and template are of one length, so a share s in common is a similarity of s / (2 - s). The nearest
    window starts at most a sixteenth of its length beside the stretch and may lose that much of it.
    """
    shared = containment * (1 - 1 / 16)
    return shared / (2 - shared)


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` MinHash values that miss a pair of this similarity with probability ``miss`` at most."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - similarity**rows)))


def templates_in(folder: str) -> dict[str, str]:
    """The files of a folder of license texts as templates, by file name; those under five words are left out."""
    found = {}
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as handle:
                text = handle.read()
            if _ngrams(text):
                found[name] = text
    return found


def _words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Every run of ``SHINGLE`` words as one string."""
    starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def _minhash(hashes: Column, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed))))


def _band_keys(hashes: Column, bands: int) -> Column:
    """One 64-bit key per band of ``ROWS`` minima."""
    return F.array(*[
        F.xxhash64(F.lit(b), *[_minhash(hashes, b * ROWS + r) for r in range(ROWS)]) for b in range(bands)
    ])


def _ngrams(text: str) -> list[str]:
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def anchors(templates: dict[str, str]) -> list[str]:
    """Pairs of neighbouring words of which every shingle of every template holds one.

    A verified match shares a shingle with its template, so a text without any of these pairs
    has none. Each shingle may be met by either of its two longest pairs; the set is found greedily.
    """
    open_ = {}
    for shingle in {s for t in templates.values() for s in _ngrams(t)}:
        words = shingle.split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        open_[shingle] = set(sorted(pairs, key=lambda p: (-len(p), p))[:2])
    found = []
    while open_:
        gain = Counter(p for pairs in open_.values() for p in pairs)
        best = max(sorted(gain), key=lambda p: (gain[p], len(p)))
        found.append(best)
        open_ = {s: pairs for s, pairs in open_.items() if best not in pairs}
    return found


def template_table(docs: DataFrame, templates: dict[str, str], bands: int) -> DataFrame:
    """License, its distinct shingles, their number and band keys: one row per template."""
    for name, text in templates.items():
        if not _ngrams(text):
            raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
    table = docs.sparkSession.createDataFrame(sorted(templates.items()), "license string, _text string")
    hashes = F.transform(_shingles(_words(F.col("_text"))), lambda s: F.xxhash64(s))
    table = table.withColumn("_shingles", F.array_distinct(hashes))
    return table.select(
        "license", "_shingles", F.size("_shingles").alias("_m"), _band_keys(F.col("_shingles"), bands).alias("_keys")
    )


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
    miss: float = MISS,
) -> DataFrame:
    """``doc_id, license, containment, windows, first_word``: the notices that each document holds.

    Windows are as long as a template, in shingles of five words, one length per distinct
    template length, and overlap by seven eighths of it (short ones start at every word). The
    number of bands follows from ``miss`` and from the similarity that a window must have where a text
    contains so much of a template (``window_similarity``). A window that shares a band with
    a template of its length is verified on the shingles of the window and half its length on
    either side: matched over the template's distinct shingles, ``containment`` at least. One row per document
    row and license: the best containment, the number of verified windows and the word at which
    the first of them starts (from 0).

    Only windows that hold a pair of ``anchors`` are built: any other shares no shingle, and so no
    band, with a template. Null and empty texts, and those under five words, match nothing; ids
    may be null; repeated rows give repeated results; an empty table gives no rows. Templates are
    a short list given by the caller, so their table is broadcast.
    """
    bands = bands_for(window_similarity(containment), miss=miss)
    table = template_table(docs, templates, bands)
    lengths = sorted({len(set(_ngrams(t))) for t in templates.values()})
    marks = anchors(templates)
    wanted = "(^|[^a-z0-9])(" + "|".join(m.replace(" ", "[^a-z0-9]+") for m in marks) + ")([^a-z0-9]|$)"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("_text"))
    texts = texts.filter(F.lower("_text").rlike(wanted)).withColumn("_row", F.monotonically_increasing_id())
    # One row per text and window length; each step ends in an explode, so that arrays are made once.
    words = texts.select("doc_id", "_row", F.explode(F.array(_words(F.col("_text")))).alias("_w"))
    words = words.filter(F.size("_w") >= SHINGLE)
    near = F.filter(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.array_contains(
        F.array(*[F.lit(m) for m in marks]), F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1))))
    once = F.struct(F.transform(_shingles(F.col("_w")), lambda s: F.xxhash64(s)).alias("h"), near.alias("near"))
    hashed = words.select("doc_id", "_row", F.explode(F.array(once)).alias("_o"))
    sized = hashed.select("doc_id", "_row", "_o", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_n"))
    h, n = F.col("_o.h"), F.col("_n")
    step = F.greatest(F.floor(n / 8).cast("int"), F.lit(1))
    last = F.greatest(F.size(h) - n + 1, F.lit(1))

    def covering(p: Column) -> Column:
        """Window starts on the grid of ``step`` whose words hold the pair at ``p``."""
        low = F.ceil((F.greatest(p - n - (SHINGLE - 3), F.lit(1)) - 1) / step).cast("int")
        high = F.floor((F.least(p, last) - 1) / step).cast("int")
        grid = F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * step + 1)
        return F.when(low <= high, grid).otherwise(F.array().cast("array<int>"))

    def window(at: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        before = F.greatest(at - half, F.lit(1))
        return F.struct(
            at.alias("at"), F.slice(h, at, n).alias("part"), F.slice(h, before, at - before + n + half).alias("around")
        )

    starts = F.array_distinct(F.flatten(F.transform("_o.near", covering)))
    windows = sized.select("doc_id", "_row", "_n", F.explode(F.transform(starts, window)).alias("_win"))
    keyed = windows.select(
        "doc_id", "_row", "_n", F.col("_win.at").alias("_at"), F.col("_win.around").alias("_around"),
        F.posexplode(_band_keys(F.col("_win.part"), bands)).alias("_band", "_key"),
    )
    probes = table.select("license", "_shingles", F.col("_m").alias("_n"), F.posexplode("_keys").alias("_band", "_key"))
    retrieved = keyed.join(F.broadcast(probes), ["_n", "_band", "_key"])
    share = F.size(F.array_intersect("_around", "_shingles")) / F.col("_n")
    matches = retrieved.withColumn("_share", share).filter(F.col("_share") >= containment)
    return matches.groupBy("_row", "doc_id", "license").agg(
        F.max("_share").alias("containment"), F.count_distinct("_at").alias("windows"),
        (F.min("_at") - 1).cast("long").alias("first_word"),
    ).drop("_row")
