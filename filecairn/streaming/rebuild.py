"""Restartable rebuild of duplicate groups by hash range, with a run ledger."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from filecairn.operators.duplicates import duplicate_groups, hashed_files
from filecairn.plans.cut import children, exists
from filecairn.schemas import DUPLICATE_RUNS

# Ranges of a rebuild: 256 for two digits of the hash.
RANGE_DIGITS = 2
PART_SCHEMA = "hash_value string, file_count bigint, total_size bigint, first_seen timestamp"


# A ledger is a table of events; each repeats the run's columns as they were then.
EVENTS = StructType([*DUPLICATE_RUNS.fields, StructField("recorded_at", TimestampType(), False)])


def ledger_event(spark: SparkSession, **values) -> DataFrame:
    """One ledger event, recorded now; columns not given are NULL."""
    values = {**values, "recorded_at": datetime.now(timezone.utc)}
    return spark.createDataFrame([tuple(values.get(c) for c in EVENTS.names)], EVENTS)


def latest_runs(events: DataFrame) -> DataFrame:
    """State of each run as of its last event."""
    columns = [c for c in events.columns if c not in ("id", "recorded_at")]
    last = F.max_by(F.struct(*columns), "recorded_at").alias("last")
    return events.groupBy("id").agg(last).select("id", "last.*")


def range_of(hash_value: Column, digits: int) -> Column:
    """Number of the range of the hash order that a hash lies in, of ``16 ** digits``."""
    if digits == 0:
        return F.lit(0)
    prefix = F.substring(hash_value, 1, digits)
    # Anything but hexadecimal digits goes where the order puts it.
    starts = F.array(*[F.lit(low) for low, _ in hash_ranges(digits)])
    placed = F.size(F.filter(starts, lambda low: low <= hash_value)) - 1
    return F.when(prefix.rlike(f"^[0-9a-f]{{{digits}}}$"), F.conv(prefix, 16, 10).cast("int")).otherwise(placed)


def hash_ranges(digits: int = 1) -> list[tuple[str, str | None]]:
    """Hash order cut into ``16 ** digits`` half-open ranges."""
    starts = [""] + [f"{n:0{digits}x}" for n in range(1, 16**digits)]
    return list(zip(starts, [*starts[1:], None]))


def _within(numbers: list[int], digits: int) -> Column:
    """Condition on the hash for some of the ranges; neighbours are one interval, which the scan can skip by."""
    ranges = hash_ranges(digits)
    hash_value, wanted, spans = F.col("hash_value"), F.lit(False), []
    for n in numbers:
        if spans and spans[-1][1] == n - 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    for first, last in spans:
        part = hash_value >= ranges[first][0]
        if ranges[last][1] is not None:
            part = part & (hash_value < ranges[last][1])
        wanted = wanted | part
    return wanted


def _manifest(hashed: DataFrame, from_hash: str, digits: int) -> str:
    """What a run is of: the hashed files by number and checksum, and its arguments."""
    row = hashed.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("hash_value", "size", "mtime").cast("decimal(20,0)")).alias("s")
    ).first()
    return f"files={row['n']} checksum={row['s']} from_hash={from_hash!r} digits={digits}"


def _same_input(spark: SparkSession, base: str, manifest: str) -> None:
    """Record what the run is of, or refuse a run folder of something else."""
    where = f"{base}/manifest"
    if not exists(spark, f"{where}/_SUCCESS"):
        spark.createDataFrame([(manifest,)], "manifest string").write.mode("overwrite").parquet(where)
        return
    found = spark.read.schema("manifest string").parquet(where).first()[0]
    if found != manifest:
        raise ValueError(f"{base} holds a run of another input ({found}, now {manifest}): use another run id")


def _committed(spark: SparkSession, path: str) -> set[int]:
    """Ranges that have their file: the folder of a range appears when its task is committed."""
    return {int(name.removeprefix("range=")) for name in children(spark, path) if name.startswith("range=")}


def written_ranges(spark: SparkSession, work: str, run_id: int) -> DataFrame:
    """What a run has written so far, also while it runs: groups, files, bytes and last hash of each finished range."""
    path = f"{work.rstrip('/')}/run={run_id}/groups"
    if not _committed(spark, path):
        return spark.createDataFrame([], "range int, groups long, files long, size long, last_hash_value string")
    rows = spark.read.schema(f"{PART_SCHEMA}, range int").parquet(path)
    return rows.groupBy("range").agg(
        F.count("hash_value").alias("groups"),
        F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("total_size"), F.lit(0)).alias("size"),
        F.max("hash_value").alias("last_hash_value"),
    )


def _totals(spark: SparkSession, work: str, run_id: int) -> dict:
    """Ledger columns from what a run has written."""
    row = written_ranges(spark, work, run_id).agg(
        F.coalesce(F.sum("groups"), F.lit(0)).alias("processed_groups"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("processed_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("processed_size"),
        F.max("last_hash_value").alias("last_hash_value"),
    ).first()
    return row.asDict()


def _write_ranges(hashed: DataFrame, missing: list[int], digits: int, now: Column, path: str) -> None:
    """One job over the missing ranges; each range is one task and one file, in place as soon as that task is done.

    A range without groups has a row without a hash, so that it is known to be done.
    """
    spark = hashed.sparkSession
    every = len(missing) == 16**digits
    part = hashed if every else hashed.filter(_within(missing, digits))
    groups = duplicate_groups(part, now=now).withColumn("range", range_of(F.col("hash_value"), digits))
    marks = spark.createDataFrame([(n,) for n in missing], "range int")
    (
        groups.unionByName(marks, allowMissingColumns=True)
        .repartitionById(16**digits, "range")
        .write.mode("append")
        .option("maxRecordsPerFile", 0)
        # A task's file is moved into place when the task ends, not when the job does.
        .option("mapreduce.fileoutputcommitter.algorithm.version", 2)
        .partitionBy("range")
        .parquet(path)
    )


def rebuild_groups(
    files: DataFrame,
    work: str,
    run_id: int,
    from_hash: str = "",
    digits: int = RANGE_DIGITS,
    now: Column | None = None,
    note: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Groups after ``from_hash`` by ranges of the hash order, and the ledger of the run.

    One job writes the groups of all ``16 ** digits`` ranges under ``work``, each range committed by its
    own task. Calling again with the same input and arguments after a failure writes, in one
    job too, only the ranges that are missing; anything else under the same id is refused. The
    ledger gets an event at the start and at the end, with the figures of what is written by then; in
    between ``written_ranges`` tells how far the run is.
    """
    spark = files.sparkSession
    now = F.current_timestamp() if now is None else now
    base = f"{work.rstrip('/')}/run={run_id}"
    ledger, parts = f"{base}/ledger", f"{base}/groups"
    started = datetime.now(timezone.utc)
    hashed = hashed_files(files, from_hash).select("hash_value", "size", "mtime")
    _same_input(spark, base, _manifest(hashed, from_hash, digits))
    state = dict(id=run_id, started_at=started, note=note)
    begun = state | dict(status="running") | _totals(spark, work, run_id)
    ledger_event(spark, **begun).write.mode("append").parquet(ledger)
    status = "failed"
    try:
        missing = sorted(set(range(16**digits)) - _committed(spark, parts))
        if missing:
            _write_ranges(hashed, missing, digits, now, parts)
        status = "done"
    finally:
        end = state | dict(status=status, finished_at=datetime.now(timezone.utc)) | _totals(spark, work, run_id)
        if status == "done":
            end["total_groups"] = end["processed_groups"]
        ledger_event(spark, **end).write.mode("append").parquet(ledger)
    groups = spark.read.schema(f"{PART_SCHEMA}, range int").parquet(parts)
    return groups.filter(F.col("hash_value").isNotNull()).drop("range"), latest_runs(spark.read.schema(EVENTS).parquet(ledger))
