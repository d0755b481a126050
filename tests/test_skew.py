"""Keys that hold a third of all rows, with adaptive execution and broadcasts off."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logquarry.catalog.views import logs
from logquarry.operators.keyed import add_request_stats, instance_positions
from logquarry.operators.ordering import with_global_index
from logquarry.operators.skew import spread_join

SETTINGS = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def plain(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(plain):
    """A third of the rows in one minute, of one request and of one instance; a third without any of them."""
    third = F.col("log_id") % 3
    minute = F.lit("2024-01-05 00:00:01").cast("timestamp_ntz")
    df = logs(plain, "/root/testdata/sf0.01")
    return df.withColumns({
        "timestamp": F.when(third == 0, None).when(third == 1, minute).otherwise(F.col("timestamp")),
        "request_id": F.when(third == 0, None).when(third == 1, "busy").otherwise(F.col("request_id")),
        "instance_id": F.when(third == 0, None).when(third == 1, "busy").otherwise(F.col("instance_id")),
    }).cache()


def largest_share(df):
    """Rows of the fullest task over all rows."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


def test_busy_request(skewed):
    rows = skewed.where("request_id IS NOT NULL")
    got = add_request_stats(skewed)
    w = Window.partitionBy("request_id")
    want = skewed.select(
        "log_id", F.when(F.col("request_id").isNull(), 0).otherwise(F.sum((F.col("level") == "ERROR").cast("int")).over(w)).alias("e"),
        F.when(F.col("request_id").isNull(), 1).otherwise(F.count("message").over(w)).alias("n"))
    assert got.count() == skewed.count()
    assert got.join(want, "log_id").where("request_error_count <> e OR request_log_count <> n").count() == 0
    assert "_rows" not in got.columns and "_piece" not in got.columns
    assert largest_share(got.where("request_id IS NOT NULL")) < 0.25
    whole = rows.join(rows.groupBy("request_id").count(), "request_id")
    assert largest_share(whole) > 0.5


def test_busy_minute_and_rows_without_a_time(skewed):
    got = with_global_index(skewed, keep_groups=True, piece_rows=100)
    w = Window.orderBy(F.col("timestamp").asc_nulls_last(), "log_id")
    want = skewed.select("log_id", "timestamp", (F.row_number().over(w) - 1).alias("n")).select(
        "log_id", F.min("n").over(Window.partitionBy(F.date_trunc("minute", "timestamp"))).alias("minute"),
        F.min("n").over(Window.partitionBy(F.date_trunc("hour", "timestamp"))).alias("hour"),
        F.count("*").over(Window.partitionBy(F.date_trunc("minute", "timestamp"))).alias("rows"))
    joined = got.join(want, "log_id")
    assert joined.count() == skewed.count()
    assert joined.where("_minute_start <> minute OR _hour_start <> hour OR _minute_rows <> rows").count() == 0
    assert largest_share(got) < 0.25


@pytest.mark.parametrize("spans", [1, 7, 1_000])
def test_busy_instance(skewed, spans):
    """Positions and statistics over spans of blocks equal those of one window."""
    got = instance_positions(skewed, block_rows=97, blocks_per_span=spans)
    whole = Window.partitionBy("instance_id")
    order = whole.orderBy(F.col("timestamp").asc_nulls_last(), "log_id")
    want = skewed.where("instance_id IS NOT NULL").select(
        "log_id", F.row_number().over(order).alias("p"), F.count("message").over(whole).alias("n"),
        F.min("timestamp").over(whole).alias("a"), F.max("timestamp").over(whole).alias("b"))
    joined = got.join(want, "log_id")
    assert got.count() == skewed.count() and joined.count() == want.count()
    assert joined.where("instance_log_position <> p OR instance_log_count <> n OR NOT instance_first_seen <=> a "
                        "OR NOT instance_last_seen <=> b").count() == 0


def test_spread_join_of_odd_keys(plain):
    """Null keys, keys without a statistic, a key with a null weight, repeated rows, no rows at all."""
    rows = plain.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "c")], "id long, k string")
    stats = plain.createDataFrame([("a", 2), ("b", None), (None, 1)], "k string, w long")
    for parts in (1, 2, 1_000):
        got = spread_join(rows, stats, "k", "w", F.col("id"), parts=parts).orderBy("id").collect()
        assert [(r.id, r.k, r.w) for r in got] == [(1, "a", 2), (1, "a", 2), (2, "b", None), (3, None, None), (4, "c", None)]
        inner = spread_join(rows, stats, "k", "w", F.col("id"), "inner", parts)
        assert inner.count() == 3
        assert spread_join(rows, stats.limit(0), "k", "w", F.col("id"), parts=parts).count() == 5
        assert spread_join(rows.limit(0), stats, "k", "w", F.col("id"), parts=parts).count() == 0
