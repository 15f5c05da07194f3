"""Text columns used by the report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units in steps of 1024.
UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]

# Replacements for the plain report, applied in this order.
PLAIN_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#39;"),
]

# Replacements for the summary report, applied in this order.
TEMPLATE_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&#34;"),
    ("'", "&#39;"),
    ("+", "&#43;"),
]

TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"
RFC3339_PATTERN = "yyyy-MM-dd'T'HH:mm:ssXXX"


def format_bytes(size: Column) -> Column:
    """``N B`` below 1024, else one decimal (ties to even) and a unit."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS, start=1):
        scale = 1024**power
        tenths = F.rint(size.cast("double") / float(scale) * 10) / 10
        text = F.when(size >= scale, F.format_string(f"%.1f {unit}", tenths)).otherwise(text)
    return text


def truncate(text: Column, limit: int) -> Column:
    """Text of more than ``limit`` bytes cut to at most ``limit`` with ``...``, whole characters only."""
    fits = lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= limit - 3
    longest = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(limit - 3)), fits))
    cut = F.concat(F.substring(text, F.lit(1), longest), F.lit("..."))
    return F.when(F.octet_length(text) > limit, cut).otherwise(text)


def escape_html(text: Column, pairs: list[tuple[str, str]] = PLAIN_ESCAPES) -> Column:
    """HTML-escaped text."""
    return reduce(lambda col, pair: F.replace(col, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def time_text(ts: Column) -> Column:
    return F.date_format(ts, TIME_PATTERN)


def rfc3339_text(ts: Column) -> Column:
    return F.date_format(ts, RFC3339_PATTERN)


def hash_prefix(hash_value: Column) -> Column:
    """First 12 characters of a hash and ``...``."""
    return F.concat(F.substring(hash_value, 1, 12), F.lit("..."))


def megabytes(size: Column) -> Column:
    return size / F.lit(1024.0 * 1024.0)


def gigabytes(size: Column) -> Column:
    return size / F.lit(1024.0 * 1024.0 * 1024.0)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 for an empty whole."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def rate(count: Column, seconds: Column) -> Column:
    """Items per second; 0 before any time has passed."""
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def remaining_seconds(done: Column, total: Column, seconds: Column) -> Column:
    """Estimated time left at the rate so far; NULL before the first item."""
    return F.when(done > 0, (total - done) * seconds / done)
