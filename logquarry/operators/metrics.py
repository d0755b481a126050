"""Operational metrics and alert rules over the table of analysis runs.

Sliding windows are built from per-minute sums: each minute is added to the windows that cover
it, so rows are reduced before they are multiplied. ``window_end`` is the evaluation time; a
window covers the ``width`` minutes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.operators.skew import spread_join
from logquarry.operators.topk import exact_percentiles

SKETCH_SIZE = 800  # about 0.4 % of the ranks; decides speed only

# Upper bounds of the duration histogram in seconds.
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def plus_minutes(ts: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return ts + F.make_dt_interval(mins=n)


def tumbling(ts: Column, minutes: int) -> Column:
    """Start of the ``minutes`` long interval (aligned to the epoch) that holds the time."""
    return F.window(ts, f"{minutes} minutes")["start"].cast("timestamp_ntz")


def sliding(per_minute: DataFrame, width: int, sums: list[str], minute: str = "minute") -> DataFrame:
    """Sums over the ``width`` minutes before every minute boundary they reach."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: plus_minutes(F.col(minute), i))
    return per_minute.withColumn("window_end", F.explode(ends)).groupBy("window_end").agg(
        *[F.sum(c).alias(c) for c in sums]
    )


def held(evaluated: DataFrame, minutes: int) -> DataFrame:
    """Adds ``firing``: the condition held at this and each of the last ``minutes`` evaluations.

    Every true evaluation is counted at the times it supports; no global order is needed.
    """
    reach = F.transform(
        F.sequence(F.lit(0), F.lit(minutes)), lambda i: plus_minutes(F.col("window_end"), i)
    )
    support = evaluated.where("breached").select(F.explode(reach).alias("window_end")).groupBy(
        "window_end").agg(F.count(F.lit(1)).alias("_support"))
    return evaluated.join(support, "window_end", "left").withColumn(
        "firing", F.coalesce(F.col("_support") == minutes + 1, F.lit(False)) & F.col("breached")
    ).drop("_support")


def run_log(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id", "ts", F.coalesce(F.left("issue", F.lit(100)), F.lit("Unknown")).alias("issue_description"),
        "status", F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("mode", F.lit("unknown")).alias("mode"),
        F.coalesce("relevant_logs", F.lit(0)).alias("relevant_logs"),
        F.coalesce("duration", F.lit(0.0)).alias("processing_time"),
    )


def last_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(k)


def runs_by_category(runs: DataFrame) -> DataFrame:
    counts = runs.groupBy("status", "category", "mode").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("n") * 100.0, total))


def duration_quantiles(runs: DataFrame, minutes: int = 5) -> DataFrame:
    """Median, 95th percentile and mean of the run time per interval.

    Times are added up as decimals (microseconds), so the mean does not depend on the order in
    which tasks finish.
    """
    timed = runs.select(tumbling(F.col("ts"), minutes).alias("window_start"), "duration")
    total = F.sum(F.col("duration").cast("decimal(18,6)")).cast("double")
    means = timed.groupBy("window_start").agg(
        F.try_divide(total, F.count("duration")).alias("mean"), F.count("duration").alias("runs"))
    return exact_percentiles(timed, "duration", {"p50": 0.5, "p95": 0.95}, ["window_start"]).join(
        means, "window_start")


def duration_histogram(runs: DataFrame) -> DataFrame:
    """Cumulative counts of runs per mode and upper bound; the last bound is infinite."""
    bounds = [F.count_if(F.col("duration") <= b).alias(f"b{i}") for i, b in enumerate(DURATION_BOUNDS)]
    per_mode = runs.groupBy("mode").agg(*bounds, F.count(F.lit(1)).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(DURATION_BOUNDS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return per_mode.select("mode", F.inline(F.array(*rows)))


def alert_error_rate(runs: DataFrame, width: int = 5, limit: float = 5.0, hold: int = 2) -> DataFrame:
    per_minute = runs.groupBy(minute_of(F.col("ts")).alias("minute")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "error").alias("errors"))
    rate = sliding(per_minute, width, ["runs", "errors"]).withColumn(
        "error_percent", F.try_divide(F.col("errors") * 100.0, F.col("runs")))
    return held(rate.withColumn("breached", F.col("error_percent") > limit), hold)


def sliding_percentile(runs: DataFrame, value: str, q: float, width: int, name: str, ts: str = "ts",
                       k: int = SKETCH_SIZE) -> DataFrame:
    """Interpolated percentile of the ``width`` minutes before every minute boundary they reach, exact.

    Each minute has a mergeable quantile sketch and only sketches are copied into the windows. A window's
    merged sketch brackets the percentile; then each minute counts, once per distinct value, what lies below the
    brackets of the ``width`` windows it belongs to, and only values inside a bracket go to their windows.
    The counts say whether the bracket held the percentile. A sketch may err, so windows where it
    did not (in practice none) are computed from all their values. Rows without a time or a value take no part; NaN
    counts as the largest value.
    """
    timed = runs.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(
        minute_of(F.col(ts)).alias("minute"), F.col(value).cast("double").alias("_v"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: plus_minutes(F.col("minute"), i))
    panes = timed.groupBy("minute").agg(
        F.kll_sketch_agg_double(F.when(~F.isnan("_v"), F.col("_v")), k).alias("_sketch"), F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.isnan("_v")).alias("_numbers"))
    margins = [4.0 / k, 16.0 / k, 1.0]
    ranks = [max(q - m, 0.0) for m in margins] + [min(q + m, 1.0) for m in margins]
    sketch = F.kll_merge_agg_double(F.when(F.col("_numbers") > 0, F.col("_sketch")))
    windows = panes.withColumn("window_end", F.explode(ends)).groupBy("window_end").agg(
        sketch.alias("_sketch"), F.sum("_n").alias("_n"), F.sum("_numbers").alias("_numbers"))
    cuts = F.when(F.col("_numbers") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, ranks))))
    # the narrowest margin of at least two ranks
    place = F.when(F.col("_n") * margins[0] >= 2, 0).when(F.col("_n") * margins[1] >= 2, 1).otherwise(2)
    brackets = windows.select(
        "window_end", "_n", F.get(cuts, place).alias("_low"), F.get(cuts, place + len(margins)).alias("_high"))
    start = plus_minutes(F.col("window_end"), -width)
    covered = brackets.withColumn("_b", F.struct("window_end", "_low", "_high")).withColumn(
        "minute", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: plus_minutes(start, i))))
    per_minute = covered.groupBy("minute").agg(F.collect_list("_b").alias("_brackets")).withColumn(
        "_lows", F.transform("_brackets", lambda b: b["_low"])).join(
        panes.select("minute", F.col("_n").alias("_rows")), "minute")
    counted = timed.groupBy("minute", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = spread_join(counted, per_minute, "minute", "_rows", F.col("_v"), "inner")

    # One row per minute and window with the number below, one per window and value inside.
    below = [F.sum(F.when(F.col("_v") < F.get("_lows", F.lit(i)), F.col("_c"))).alias(f"_below{i}")
             for i in range(width)]
    under = placed.groupBy("minute").agg(F.first("_brackets").alias("_brackets"), *below).select(F.inline(F.array(*[
        F.struct(F.get("_brackets", F.lit(i))["window_end"].alias("window_end"), F.col(f"_below{i}").alias("_c"))
        for i in range(width)]))).where(F.col("window_end").isNotNull())
    inside = placed.withColumn("_b", F.explode(F.filter(
        "_brackets", lambda b: F.col("_v").between(b["_low"], b["_high"])))).select("_b.window_end", "_v", "_c")
    folded = under.select("window_end", F.lit(None).cast("double").alias("_v"), F.coalesce("_c", F.lit(0)).alias("_c")).unionByName(
        inside).groupBy("window_end", "_v").agg(F.sum("_c").alias("_c"))
    upto = Window.partitionBy("window_end").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ordered = folded.withColumn("_upto", F.sum("_c").over(upto)).join(brackets.select("window_end", "_n"), "window_end")
    position = (F.col("_n") - 1) * F.lit(q)
    holds = lambda p: F.col("_v").isNotNull() & (F.col("_upto") > p) & (F.col("_upto") - F.col("_c") <= p)
    found = ordered.groupBy("window_end").agg(
        F.max(F.when(holds(F.floor(position)), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(F.ceil(position)), F.col("_v"))).alias("_hi"),
        F.max(position - F.floor(position)).alias("_part"))
    missed = brackets.select("window_end").join(found.where("_lo IS NOT NULL AND _hi IS NOT NULL"), "window_end", "left_anti")
    again = timed.withColumn("window_end", F.explode(ends)).join(missed, "window_end", "left_semi")
    return found.where("_lo IS NOT NULL AND _hi IS NOT NULL").select(
        "window_end", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(name)
    ).unionByName(exact_percentiles(again, "_v", {name: q}, ["window_end"]))


def alert_slow(runs: DataFrame, width: int = 5, limit: float = 30.0, hold: int = 5) -> DataFrame:
    """95th percentile of the run time of the last ``width`` minutes."""
    p95 = sliding_percentile(runs, "duration", 0.95, width, "p95")
    return held(p95.withColumn("breached", F.col("p95") > limit), hold)


def alert_rating(runs: DataFrame, width: int = 60, limit: float = 3.0, hold: int = 15) -> DataFrame:
    """Mean of the valid ratings (1 to 5) of an hour."""
    rated = runs.where(F.col("rating").between(1, 5))
    per_minute = rated.groupBy(minute_of(F.col("ts")).alias("minute")).agg(
        F.count(F.lit(1)).alias("ratings"), F.sum("rating").alias("total"))
    mean = sliding(per_minute, width, ["ratings", "total"]).withColumn(
        "mean_rating", F.try_divide(F.col("total"), F.col("ratings")))
    return held(mean.withColumn("breached", F.col("mean_rating") < limit), hold)


def rating_median(runs: DataFrame, minutes: int = 60) -> DataFrame:
    rated = runs.where(F.col("rating").between(1, 5)).select(
        tumbling(F.col("ts"), minutes).alias("window_start"), "rating")
    return exact_percentiles(rated, "rating", {"median": 0.5}, ["window_start"])


def alert_silence(runs: DataFrame, width: int = 10, hold: int = 10) -> DataFrame:
    """Every minute from the first run to ``width + hold`` minutes after the last: no run in the ``width``
    minutes before it (``breached``), and that for the last ``hold`` minutes (``firing``)."""
    busy = runs.where(F.col("ts").isNotNull()).groupBy(minute_of(F.col("ts")).alias("minute")).agg(F.count(F.lit(1)).alias("runs"))
    span = busy.agg(F.min("minute").alias("a"), F.max("minute").alias("b")).where(F.col("a").isNotNull())
    every = span.select(F.explode(F.sequence(
        plus_minutes(F.col("a"), 1), plus_minutes(F.col("b"), width + hold + 1), F.make_dt_interval(mins=F.lit(1)))).alias("window_end"))
    counts = every.join(sliding(busy, width, ["runs"]), "window_end", "left")
    return held(counts.select("window_end", F.coalesce("runs", F.lit(0)).alias("runs"), F.col("runs").isNull().alias("breached")), hold)


def alert_accuracy(training: DataFrame, limit: float = 0.8) -> DataFrame:
    return training.where(F.col("accuracy") < limit)


def success_rate(runs: DataFrame, minutes: int = 5) -> DataFrame:
    n = F.count(F.lit(1))
    return runs.groupBy(tumbling(F.col("ts"), minutes).alias("window_start")).agg(
        (F.count_if(F.col("status") == "success") * 100.0 / n).alias("success_percent"),
        (F.count_if(F.col("mode") == "hybrid") / F.lit(float(minutes))).alias("hybrid_per_minute"),
        (F.count_if(F.col("mode") == "fast") / F.lit(float(minutes))).alias("fast_per_minute"),
    )


def volume_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy(minute_of(F.col("timestamp")).alias("minute"), "level").agg(F.count(F.lit(1)).alias("n"))


def training_history(training: DataFrame) -> DataFrame:
    return training.select("ts", "run_id", "accuracy", "precision", "recall").orderBy("ts", "run_id")


def active_users(runs: DataFrame, minutes: int = 60) -> DataFrame:
    return runs.groupBy(tumbling(F.col("ts"), minutes).alias("window_start")).agg(
        F.count_distinct("user_id").alias("active_users"))


def stage_timings(runs: DataFrame, stages: list[str]) -> DataFrame:
    """Mean and total time per stage column."""
    long = runs.unpivot([], stages, "stage", "seconds")
    return long.groupBy("stage").agg(F.avg("seconds").alias("mean_seconds"), F.sum("seconds").alias("total_seconds"))
