import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logquarry.catalog.views import logs
from logquarry.operators import sequence
from logquarry.operators.keyed import instance_positions
from logquarry.operators.ordering import (
    numbered_by_hash,
    over_blocks,
    with_global_index,
)



def total_order():
    return Window.orderBy(F.col("timestamp").asc_nulls_last(), "log_id")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows without a time, a third at one instant, one busy instance."""
    df = logs(spark, "/root/testdata/sf0.01")
    third = F.col("log_id") % 3
    instant = F.lit("2024-01-05 00:00:01").cast("timestamp_ntz")
    return df.withColumn(
        "timestamp", F.when(third == 0, None).when(third == 1, instant).otherwise(F.col("timestamp"))
    ).withColumn("instance_id", F.when(third == 1, "busy").otherwise(F.col("instance_id"))).cache()


def test_index_of_skewed_times(skewed):
    want = skewed.select("log_id", (F.row_number().over(total_order()) - 1).alias("want"))
    got = with_global_index(skewed).select("log_id", "log_sequence_id")
    assert got.join(want, "log_id").where("want <> log_sequence_id").count() == 0
    assert got.count() == skewed.count()


def test_minute_facts(skewed):
    got = with_global_index(skewed, keep_groups=True)
    minute = Window.partitionBy(F.date_trunc("minute", "timestamp"))
    want = skewed.select("log_id", "timestamp", (F.row_number().over(total_order()) - 1).alias("n")).select(
        "log_id", F.min("n").over(minute).alias("first"), F.count("*").over(minute).alias("rows"))
    assert got.join(want, "log_id").where("_minute_start <> first or _minute_rows <> rows").count() == 0


@pytest.mark.parametrize("block_rows", [24, 61, 997])
def test_blocks_equal_one_window(skewed, block_rows):
    indexed = with_global_index(skewed)

    def frames(w):
        out = {}
        for build in (sequence.level_transitions, sequence.error_burst, sequence.context_instances):
            out.update(build(w))
        return out

    got = over_blocks(indexed, frames, block_rows=block_rows)
    whole = indexed.select("*", *[c.alias(n) for n, c in frames(Window.orderBy("log_sequence_id")).items()])
    assert got.exceptAll(whole).count() == 0 and got.count() == whole.count()


def test_narrow_blocks_are_refused(skewed):
    with pytest.raises(ValueError):
        over_blocks(skewed, lambda w: {}, block_rows=23)


@pytest.mark.parametrize("block_rows", [50, 100_000])
def test_instance_positions_of_a_busy_instance(skewed, block_rows):
    per = Window.partitionBy("instance_id").orderBy(F.col("timestamp").asc_nulls_last(), "log_id")
    want = skewed.where("instance_id is not null").select("log_id", F.row_number().over(per).alias("want"))
    got = instance_positions(skewed, block_rows=block_rows)
    assert got.join(want, "log_id").where("want <> instance_log_position").count() == 0
    assert got.where("instance_id is null and (instance_log_position is not null or is_new_instance)").count() == 0
    assert got.count() == skewed.count()


def test_bucket_positions_without_time(skewed):
    out = sequence.bucket_positions(skewed)
    assert out.where("timestamp is null and logs_in_last_minute is not null").count() == 0
    per = Window.partitionBy(F.date_trunc("minute", "timestamp")).orderBy("timestamp", "log_id")
    want = skewed.where("timestamp is not null").select("log_id", F.row_number().over(per).alias("want"))
    assert out.join(want, "log_id").where("want <> logs_in_last_minute").count() == 0


def test_numbering_by_hash(spark):
    rows = numbered_by_hash(spark.range(1000).withColumnRenamed("id", "k"), "k", 7, "n").select("k", "n").collect()
    assert sorted(r.n for r in rows) == list(range(1000))
    assert [r.k for r in sorted(rows, key=lambda r: r.n)] != list(range(1000))
