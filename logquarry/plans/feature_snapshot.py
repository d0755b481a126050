"""The feature table kept up to date: after a refresh only the row frames near changed lines are computed again.

A frame looks at most WIDEST_BEFORE rows back and WIDEST_AFTER ahead in the order of time, file and line. Framed rows are
stored by span, an hour of log time, with their place in the span. Where files were added, changed or deleted, their old and
new lines name the touched spans. Those are framed anew, with the spans after and before them that hold the rows whose
frames reach a touched row; further spans on both sides are read as context only. A table of spans says which
version of a span counts and how many rows it has; it is written last, so a refresh that fails leaves the former state.

Numbers in the global order follow from the rows of the spans before, and statistics over instances, requests,
minutes and the whole table are aggregated when features are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.functions.temporal import micros
from logquarry.operators import keyed, sequence
from logquarry.operators.ordering import BLOCK_ROWS, WIDEST_AFTER, WIDEST_BEFORE, over_blocks, with_global_index
from logquarry.plans.features import complete, frames, with_length
from logquarry.session import stage
from logquarry.sources.snapshot import LogSnapshot, table_at

HOUR = 3_600_000_000
NO_TIME = 1 << 40  # the span of lines without a time, after all others
ORDER = ("source_file", "line_number")


def span_of(at: str) -> Column:
    return F.coalesce(F.expr(f"cast(floor({at} / {HOUR}) as bigint)"), F.lit(NO_TIME))


def around(touched: set[int], counts: dict[int, int]) -> tuple[set[int], set[int]]:
    """``(framed, context)``: spans to frame anew, and spans to read beside them.

    From a touched span on, spans are taken until they hold the rows that look back into it, and before it those that look
    ahead. Each of them in turn needs its own neighbours as context.
    """
    order = sorted({*touched, *counts})
    place = {s: i for i, s in enumerate(order)}

    def reach(span: int, step: int, rows: int) -> list[int]:
        out, i = [], place[span] + step
        while rows > 0 and 0 <= i < len(order):
            out.append(order[i])
            rows -= counts.get(order[i], 0)
            i += step
        return out

    framed = set(touched)
    for span in touched:
        framed |= {*reach(span, 1, WIDEST_BEFORE), *reach(span, -1, WIDEST_AFTER)}
    context = {s for span in framed for s in (*reach(span, -1, WIDEST_BEFORE), *reach(span, 1, WIDEST_AFTER))}
    return {s for s in framed if counts.get(s)}, context - framed


class FeatureSnapshot:
    """Lines under ``path/lines``, framed rows under ``path/frames``, versions of spans under ``path/spans``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.lines = LogSnapshot(spark, f"{self.path}/lines")

    def _table(self, name: str) -> DataFrame | None:
        return table_at(self.spark, f"{self.path}/{name}")

    def spans(self) -> DataFrame:
        """``(span, version, rows)`` of the spans that count."""
        entries = self._table("spans")
        if entries is None:
            return self.spark.createDataFrame([], "span long, version long, rows long")
        latest = entries.groupBy("span").agg(F.max_by(F.struct("version", "rows"), "version").alias("e"))
        return latest.select("span", "e.*").where("rows > 0")

    def refresh(self, roots: str | list[str], **options) -> dict[str, int]:
        """Take in what changed below the roots; returns the numbers of files loaded and of spans framed."""
        loaded = self.lines.refresh(roots, **options)
        every, now = self.lines.all_lines(), self.lines.loads()
        made = self._table("made_from")
        version = 0 if made is None else made.agg(F.max("version")).first()[0] + 1
        before = now.where("false") if made is None else made.where(F.col("version") == version - 1).drop("version")
        differs = now.exceptAll(before).unionByName(before.exceptAll(now))
        if every is None or differs.isEmpty():
            return {"loaded": loaded, "framed": 0}
        timed = every.withColumn("_at", micros(F.col("timestamp"))).withColumn("_span", span_of("_at")).drop("_at")
        current = timed.join(now, ["source_file", "loaded_at"], "left_semi")
        # one row per hour of log time
        touched = {r[0] for r in timed.join(differs, ["source_file", "loaded_at"], "left_semi").select("_span").distinct().collect()}
        counts = {r["_span"]: r["count"] for r in current.groupBy("_span").count().collect()}
        framed, context = around(touched, counts)
        if framed:
            rows = current.where(F.col("_span").isin(sorted(framed | context)))
            indexed = sequence.add_bucket_positions(with_global_index(with_length(rows), tiebreak=ORDER, keep_groups=True))
            first = indexed.groupBy("_span").agg(F.min("log_sequence_id").alias("_first"))
            placed = over_blocks(indexed, frames).where(F.col("_span").isin(sorted(framed))).join(first, "_span")
            rows = placed.withColumn("place", F.col("log_sequence_id") - F.col("_first")).drop(
                "log_sequence_id", "_first", "_minute_start", "_hour_start", "loaded_at").withColumnRenamed("_span", "span")
            # files follow spans; a busy hour is split into several, quiet ones share a task
            rows.withColumn("version", F.lit(version)).hint("rebalance", "span").write.mode("append").partitionBy("version", "span").parquet(f"{self.path}/frames")
        entries = [(s, version, counts.get(s, 0)) for s in sorted(framed | touched)]
        self.spark.createDataFrame(entries, "span long, version long, rows long").coalesce(1).write.mode("append").parquet(f"{self.path}/spans")
        now.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.path}/made_from")
        return {"loaded": loaded, "framed": len(framed)}

    def framed(self) -> DataFrame | None:
        """The rows with their frames and numbers in the global order."""
        rows = self._table("frames")
        if rows is None:
            return None
        spans = self.spans()
        before = F.sum("rows").over(Window.orderBy("span")) - F.col("rows")  # a row per hour of log time
        counted = stage(spans.select("span", "version", before.alias("_before")))
        return rows.join(counted, ["span", "version"]).withColumn("log_sequence_id", F.col("_before") + F.col("place")).drop(
            "span", "version", "_before", "place")

    def features(self) -> DataFrame | None:
        """All features of the current lines, as ``engineer_all`` gives them."""
        rows = self.framed()
        if rows is None:
            return None
        block = F.call_function("div", F.col("log_sequence_id"), F.lit(BLOCK_ROWS))
        return complete(stage(keyed.number_in_block(rows.withColumn("_block", block))))
