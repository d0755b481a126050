"""Structured Streaming forms of operators whose rules are bounded in time.

Event time must be an instant, so the naive ``timestamp`` is cast (session zone UTC).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from logquarry.functions.temporal import micros
from logquarry.operators.filters import is_severe
from logquarry.operators.sequence import error_burst, is_error, sequence_features
from logquarry.session import small_table
from logquarry.sources.files import FILE_GLOB, parse_lines

LATENESS = "10 minutes"
STATE = "id long, watermark long, columns string"


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parsed lines of files as they appear below a folder; same parsing as the batch reader."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", FILE_GLOB)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    return parse_lines(lines)


def with_event_time(logs: DataFrame, lateness: str = LATENESS, ts: str = "timestamp") -> DataFrame:
    return logs.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", lateness)


def dedup(logs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each line once, compared as a whole. Keys are kept for as long as copies may still arrive."""
    keyed = logs.withColumn("doc_id", F.md5(F.col("raw_log").cast("binary")))
    return with_event_time(keyed, lateness).dropDuplicatesWithinWatermark(["doc_id"])


def level_counts(logs: DataFrame, width: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Rows per window and level; a window is emitted once it is closed."""
    return with_event_time(logs, lateness).groupBy(F.window("event_time", width), "level").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "level", "n")


def error_rates(logs: DataFrame, width: str = "1 hour", slide: str = "30 minutes",
                lateness: str = LATENESS) -> DataFrame:
    """Share of severe rows per sliding window, in percent."""
    n = F.count(F.lit(1))
    return with_event_time(logs, lateness).groupBy(F.window("event_time", width, slide)).agg(
        n.alias("n"), F.count_if(is_severe()).alias("errors"),
        (F.count_if(is_severe()) * 100.0 / n).alias("error_percent"),
        F.percentile_approx(F.length("message"), 0.95, 10_000).alias("length_p95"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
             "n", "errors", "error_percent", "length_p95")


def instance_statistics(logs: DataFrame, period: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Running statistics per instance and period, for update mode.

    Rows are added up in each task before the shuffle, so a busy instance is no burden, and the
    state of a period is dropped when the watermark has passed it.
    """
    known = logs.where(F.col("instance_id").isNotNull())
    return with_event_time(known, lateness).groupBy(F.window("event_time", period), "instance_id").agg(
        F.sum(is_error()).alias("errors"), F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    ).select(F.col("window.start").alias("period_start"), "instance_id", "errors", "n", "first_seen", "last_seen")


class BurstDetector:
    """Error bursts over row frames of a stream whose rows arrive out of order.

    Rows wait until the watermark (the latest time seen less ``lateness``) has passed their time; then all
    rows up to it are put in order, behind the last rows released before, and get the frames they would have
    in one batch. Rows of equal time are released together. ``table`` gives the released rows and, with the
    frames known so far, the waiting ones; rows without a time come last in it, as in the batch order.

    Rows that arrive after the watermark has passed their time can't change what is already written: they are
    kept without frames (``late``). Everything is written per batch id and replaced when a batch is
    repeated, so a restart neither loses nor doubles rows. What a later batch no longer needs is deleted, so
    the folder holds the results and no more than ``lateness`` of rows twice.
    """

    HISTORY_ROWS = 19

    def __init__(self, path: str, tiebreak: tuple[str, ...] = ("source_file", "raw_log"), lateness: str = LATENESS):
        self.path, self.tiebreak, self.lateness = path.rstrip("/"), tiebreak, lateness

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, micros(F.col("timestamp"))
        state = self._state(spark, batch_id - 1)
        passed = F.lit(state["watermark"] if state else None).cast("long")
        kind = F.when(at.isNull(), "untimed").when(at <= passed, "late").otherwise("waiting")
        arrived = batch.withColumn("kind", kind)
        if state:
            arrived = arrived.unionByName(self._waiting(spark, state).withColumn("kind", F.lit("waiting")))
        arrived.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/arrived/batch={batch_id}")

        now = {"batch": batch_id, "watermark": None, "columns": batch.schema.json()}
        waiting = self._waiting(spark, now)
        latest = waiting.agg(micros(F.max("timestamp") - F.expr(f"INTERVAL {self.lateness}")).alias("at"))
        now["watermark"] = latest.select(F.greatest("at", passed)).first()[0]
        released = waiting.where(at <= F.lit(now["watermark"]).cast("long"))
        rows = self._behind(released, self._history(spark, state))
        self._framed(rows).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        order = [F.col("timestamp").desc(), *[F.desc(c) for c in self.tiebreak]]
        rows.drop("_new").orderBy(*order).limit(self.HISTORY_ROWS).write.mode("overwrite").parquet(
            f"{self.path}/history/batch={batch_id}")
        small_table(spark, [tuple(now.values())], STATE).write.mode("overwrite").parquet(
            f"{self.path}/state/batch={batch_id}")
        for done in (f"arrived/batch={batch_id - 2}/kind=waiting", f"history/batch={batch_id - 2}",
                     f"state/batch={batch_id - 2}"):
            files, where = self._files(spark, done)
            files.delete(where, True)

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows but the late ones, with their frames as of the last batch."""
        state = self._state(spark)
        if state is None:
            raise ValueError("no batch has been written yet")
        left = self._waiting(spark, state).unionByName(self._arrived(spark, state, "untimed"))
        rest = self._framed(self._behind(left, self._history(spark, state)))
        return spark.read.schema(rest.schema).parquet(f"{self.path}/rows").select(*rest.columns).unionByName(rest)

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that arrived after the watermark had passed their time."""
        state = self._state(spark)
        if state is None:
            raise ValueError("no batch has been written yet")
        return self._arrived(spark, state, "late")

    def _framed(self, rows: DataFrame) -> DataFrame:
        out = sequence_features(rows, error_burst, tiebreak=self.tiebreak)
        return out.where("_new").drop("_new", "log_sequence_id")

    @staticmethod
    def _behind(rows: DataFrame, earlier: DataFrame | None) -> DataFrame:
        rows = rows.withColumn("_new", F.lit(True))
        return rows if earlier is None else rows.unionByName(earlier.withColumn("_new", F.lit(False)))

    def _files(self, spark: SparkSession, name: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def _state(self, spark: SparkSession, batch_id: int | None = None) -> dict | None:
        """What a batch left behind, by default the last one."""
        name = "state" if batch_id is None else f"state/batch={batch_id}"
        files, where = self._files(spark, name)
        if not files.exists(where):
            return None
        last = spark.read.schema(STATE).parquet(f"{self.path}/{name}").orderBy(F.desc("id")).first()
        return None if last is None else {"batch": last["id"], "watermark": last["watermark"], "columns": last["columns"]}

    def _arrived(self, spark: SparkSession, state: dict, kind: str, folder: str = "arrived") -> DataFrame:
        columns = StructType.fromJson(json.loads(state["columns"]))
        tagged = StructType([*columns.fields, StructField("kind", StringType())])
        rows = spark.read.schema(tagged).parquet(f"{self.path}/{folder}")
        return rows.where(F.col("kind") == kind).select(*columns.names)

    def _waiting(self, spark: SparkSession, state: dict) -> DataFrame:
        rows = self._arrived(spark, state, "waiting", f"arrived/batch={state['batch']}")
        return rows if state["watermark"] is None else rows.where(micros(F.col("timestamp")) > state["watermark"])

    def _history(self, spark: SparkSession, state: dict | None) -> DataFrame | None:
        if state is None:
            return None
        columns = StructType.fromJson(json.loads(state["columns"]))
        return spark.read.schema(columns).parquet(f"{self.path}/history/batch={state['batch']}")

    def start(self, logs: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = logs.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_table(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to a parquet table."""
    writer = df.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
