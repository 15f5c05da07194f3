"""Timestamp text to timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms. A zone is optional after a space and required after "T".
WITH_ZONE = r"^\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
WITHOUT_ZONE = r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}([.,]\d+)?$"


def parse_time(text: Column) -> Column:
    """Timestamp of one of the accepted forms (no zone means UTC), else NULL."""
    trimmed = F.trim(text)
    dotted = F.replace(trimmed, F.lit(","), F.lit("."))
    zoned = (
        F.when(F.rlike(trimmed, F.lit(WITH_ZONE)), dotted)
        .when(F.rlike(trimmed, F.lit(WITHOUT_ZONE)), F.concat(dotted, F.lit("Z")))
    )
    return F.try_to_timestamp(zoned)


def first_seen_or(value: Column, now: Column) -> Column:
    """Value, or ``now`` where it is missing or does not parse."""
    return F.coalesce(value, now)
