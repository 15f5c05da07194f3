"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecairn.llm.common import running, text_of

SHARDS = 40
ROW_BYTES = 16


def shard_documents(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Shard and slot of every document: ``doc_id, size, text_crc32, shard, slot``.

    Documents are laid end to end in the order of doc_id (nulls first; equal ids by size,
    then checksum). The middle byte of a document decides its shard, so each shard is a
    contiguous run and strays from the equal share by less than one document at either end.
    Slots count from 0 without gaps. Sizes are UTF-8 bytes plus ``row_bytes``; a null text has
    no bytes. Repeated rows lie side by side and each has its own slot. An empty table gives
    no rows. Other columns are ignored.
    """
    text = text_of(docs)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed = running(sized, order, {"_end": F.col("size")})
    total = placed.agg(F.max("_end")).first()[0] or 1
    middle = (2 * F.col("_end") - F.col("size")).cast("decimal(30,0)")
    placed = placed.withColumn("_middle", middle)
    shard = F.least(F.expr(f"(_middle * {shards}) div {2 * total}"), F.lit(shards - 1).cast("long"))
    placed = placed.withColumn("shard", shard.cast("int"))
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("position").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents in folders ``shard=N``, placed by id; ids must be unique and not null."""
    placed = shard_documents(docs, shards).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
