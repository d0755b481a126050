"""Reading raw log files: discovery, numbered lines, parsed lines, file statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.functions import parsing

FILE_GLOB = "*.{log,txt}"


def _reader(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", FILE_GLOB)


def discover_files(spark: SparkSession, roots: str | list[str], name_contains: str | None = None) -> DataFrame:
    """Log files below the roots, once each, with size and time of last change.

    File contents are not read: only the listing columns of the binary source are selected.
    """
    files = _reader(spark).format("binaryFile").load(roots).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )
    if name_contains:
        name = F.element_at(F.split("path", "/"), -1)
        files = files.where(F.lower(name).contains(name_contains.lower()))
    return files.distinct()


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _reader(spark).text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_block_start").alias("_split"),
    )


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column last, as the output of a generator.

    A condition on it is tested after it was computed; one on a plain column would be pushed down with a copy of the
    column's expression for each of its uses.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-blank stripped lines with their number in the file, blank lines counted.

    Ids of rows grow along a split, so a line's number is its distance from the split's first
    id plus the lines of the earlier splits. Files are read twice, once to count. The counts, a row per
    split, are sent to the tasks while Spark finds them small enough; beyond that the lines are shuffled by split.
    """
    lines = read_text(spark, paths).withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("source_file", "_split").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first")
    )
    earlier = Window.partitionBy("source_file").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "source_file", "_split", "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    numbered = lines.join(offsets, ["source_file", "_split"]).withColumn(
        "line_number", F.col("_before") + F.col("_id") - F.col("_first") + 1)
    return (
        computed_once(numbered, "value", parsing.stripped(F.col("value")))
        .where(F.col("value") != "")
        .select("value", "source_file", "file_size", "mtime", "line_number")
    )


def explode_blobs(blobs: DataFrame, text: str = "text") -> DataFrame:
    """Numbered non-blank lines of texts held in a column."""
    others = [c for c in blobs.columns if c != text]
    return (
        blobs.select(*others, F.posexplode(F.split(text, "\n")).alias("_i", "value"))
        .withColumn("line_number", F.col("_i") + F.lit(1).cast("long"))
        .withColumn("value", parsing.stripped(F.col("value")))
        .where(F.col("value") != "")
        .drop("_i")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed columns of the lines that match the layout; other columns pass through."""
    others = [c for c in lines.columns if c != "value"]
    parts = computed_once(lines, "_parts", parsing.line_parts(F.col("value"))).where(
        F.col("_parts").isNotNull()
    )
    parsed = parts.select(
        *others,
        parsing.stripped(F.col("value")).alias("raw_log"),
        *[F.col("_parts")[i].alias(name) for i, name in enumerate(parsing.LINE_FIELDS)],
    )
    return parsed.withColumns({
        "timestamp": parsing.line_timestamp(F.col("timestamp_text")),
        "service_type": parsing.service_type(F.col("service")),
        "instance_id": parsing.instance_id(F.col("message")),
        "request_id": parsing.request_id(F.col("request_info")),
    }).drop("timestamp_text")


def rejected_lines(lines: DataFrame, keep_all: bool = False) -> DataFrame:
    """Non-blank lines that do not match the layout, or all lines with a flag."""
    flagged = (
        lines.withColumn("value", parsing.stripped(F.col("value")))
        .where(F.col("value") != "")
        .withColumn("rejected", ~parsing.line_matches(F.col("value")))
    )
    return flagged if keep_all else flagged.where("rejected").drop("rejected")


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parsed log table of all files below the paths, with ingest metadata and a stable id."""
    return (
        parse_lines(read_lines(spark, paths))
        .withColumn("ingestion_time", F.current_timestamp())
        .withColumn("log_id", F.xxhash64("source_file", "line_number"))
    )


def file_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines, bytes and last change per file."""
    return read_text(spark, paths).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max("file_size").alias("bytes"),
        F.max("mtime").alias("last_change"),
    )


