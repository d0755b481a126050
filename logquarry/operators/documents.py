"""The document table: texts derived from log lines, ready for search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.functions import text
from logquarry.functions.chunking import chunk


def log_key(df: DataFrame) -> Column:
    """Identity of a line by its content and place; equal when the same line is read again."""
    place = [c for c in ("source_file", "line_number", "log_id") if c in df.columns]
    return text.document_key(
        *[F.col(c) for c in place], F.col("timestamp"), F.col("service_type"), F.col("level"),
        F.substring("message", 1, 100), F.col("instance_id"),
    )


def to_documents(df: DataFrame, chunking: bool = False, size: int = dims.CHUNK_SIZE,
                 overlap: int = dims.CHUNK_OVERLAP) -> DataFrame:
    """One document per line, or one per chunk for texts longer than the chunk size.

    Chunks cover the whole text; without chunking a document's text is cut (``text.truncate``).
    """
    body = text.log_text(F.col("service_type"), F.col("level"), F.col("message"), F.col("instance_id"))
    if not chunking:
        body = text.truncate(body)
    keyed = df.withColumn("log_hash", log_key(df)).withColumn("_text", body)
    optional = [c for c in ("request_id", "source_file") if c in df.columns]
    kept = ["log_id", "timestamp", "service_type", "level", "instance_id", *optional, "log_hash"]
    whole = keyed.select(
        F.concat(F.lit("log_"), F.col("log_hash")).alias("doc_id"),
        F.col("_text").alias("document"), *kept,
        F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit(False).alias("is_chunked"),
    )
    if not chunking:
        return whole
    is_long = F.length("_text") > size
    pieces = keyed.where(is_long).withColumn("_chunks", chunk(F.col("_text"), size, overlap))
    chunked = pieces.select("*", F.posexplode("_chunks").alias("_i", "_chunk")).select(
        F.concat(F.lit("log_"), F.col("log_hash"), F.lit("_chunk_"), F.col("_i").cast("string")).alias("doc_id"),
        F.col("_chunk").alias("document"), *kept,
        F.col("_i").alias("chunk_index"), F.size("_chunks").alias("total_chunks"),
        F.lit(True).alias("is_chunked"),
    )
    return whole.where(F.length("document") <= size).unionByName(chunked)


def new_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents that are not stored yet, each id once."""
    return incoming.dropDuplicates(["doc_id"]).join(stored.select("doc_id"), "doc_id", "left_anti")


def logs_from_documents(docs: DataFrame) -> DataFrame:
    """The log table back from stored documents, with defaults for missing fields."""
    return docs.select(
        "doc_id",
        docs["timestamp"].try_cast("timestamp_ntz").alias("timestamp"),
        F.coalesce("service_type", F.lit("unknown")).alias("service_type"),
        F.coalesce("level", F.lit("INFO")).alias("level"),
        F.col("document").alias("message"),
        "instance_id",
    )


def dedup_hits(hits: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """Best hit per (text, service, level, time), then the k best of each group."""
    group = group or []
    key = Window.partitionBy(*group, "document", "service_type", "level", "timestamp").orderBy(
        F.desc("similarity"), "doc_id"
    )
    unique = hits.withColumn("_copy", F.row_number().over(key)).where("_copy = 1").drop("_copy")
    order = [F.desc("similarity"), F.col("doc_id")]
    if group:
        best = Window.partitionBy(*group).orderBy(*order)
        return unique.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = unique.orderBy(*order).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
