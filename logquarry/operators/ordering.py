"""One global order over all rows without sorting them in one task.

``numbered`` deals the rows out by ranges of the order, sorts each range in its task and writes the
result once; every task's row count then gives the ranges their first numbers. Ranges follow the
whole sort key, so neither a busy minute nor rows without a time gather in one task.

``over_blocks`` evaluates row frames on that order. Each row goes to its block of consecutive
numbers and, near a block edge, also to the neighbour that needs it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.temporal import micros
from logquarry.session import stage

LAST = 9223372036854775807  # position of rows without a timestamp
MINUTE = 60_000_000

MINUTE_FACTS = ["_minute_start", "_hour_start", "_minute_rows"]
BLOCK_ROWS = 5_000  # a block is one unit of work; the copied rows are about 0.5 % of it
PIECE_ROWS = 200_000  # most rows of a minute that share a join key
WIDEST_BEFORE = 19
WIDEST_AFTER = 4


def numbered(df: DataFrame, order: list[Column], index: str) -> DataFrame:
    """``df`` with column ``index``: each row's number from 0 in the given order.

    The order must identify a row. The sorted rows are written to the shared folder, so the counts and
    the numbers come from the same ranges.
    """
    dealt = stage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_place", F.monotonically_increasing_id()))  # task number, then place in the task
    task = F.shiftright("_place", 33)
    counts = dealt.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")
    firsts = counts.select("_task", before.alias("_before"))
    # a row per task of one shuffle, whose number is a setting of the session: safe to send to all tasks
    return dealt.withColumn("_task", task).join(F.broadcast(firsts), "_task").withColumn(
        index, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_task", "_before")


def with_global_index(
    df: DataFrame,
    ts: str = "timestamp",
    tiebreak: tuple[str, ...] = ("log_id",),
    index: str = "log_sequence_id",
    keep_groups: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Row number from 0 in (timestamp, tiebreak) order, null timestamps last.

    ``tiebreak`` must identify a row. With ``keep_groups`` the row's ``_minute_start``,
    ``_hour_start`` (first number of its minute and hour) and ``_minute_rows`` are added. Rows are counted
    and joined per minute and ``piece_rows`` consecutive numbers, so neither a busy minute nor the rows
    without a time meet in one task. Ranges, and with them minutes, are written to tables at call time.
    """
    rows = df.withColumn("_at", F.coalesce(micros(F.col(ts)), F.lit(LAST)))
    rows = numbered(rows, [F.col("_at"), *map(F.col, tiebreak)], index)
    if not keep_groups:
        return rows.drop("_at")
    rows = rows.withColumns({
        "_minute": F.expr(f"_at div {MINUTE}"), "_piece": F.call_function("div", F.col(index), F.lit(piece_rows))})
    pieces = rows.groupBy("_minute", "_piece").agg(F.min(index).alias("_first"), F.count(F.lit(1)).alias("_n"))
    minute, hour = Window.partitionBy("_minute"), Window.partitionBy(F.expr("_minute div 60"))
    facts = stage(pieces.select(
        "_minute", "_piece", F.min("_first").over(minute).alias("_minute_start"),
        F.sum("_n").over(minute).alias("_minute_rows"), F.min("_first").over(hour).alias("_hour_start")))
    return rows.join(facts, ["_minute", "_piece"]).drop("_at", "_minute", "_piece")


def over_blocks(
    indexed: DataFrame,
    frames: Callable[[Window], dict[str, Column]],
    index: str = "log_sequence_id",
    before: int = WIDEST_BEFORE,
    after: int = WIDEST_AFTER,
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Adds window columns whose frames reach at most ``before`` rows back and ``after`` ahead.

    ``frames`` receives the ordered window and returns the columns; one shuffle serves all.
    With ``keep_block`` the block number ``_block`` stays; the rows are partitioned by it.
    """
    if block_rows <= before + after:
        raise ValueError("block_rows must exceed the widest frame")

    def block_of(position: Column) -> Column:
        return F.call_function("div", position, F.lit(block_rows))

    number = F.col(index)
    seen_by = F.array_distinct(
        F.array(block_of(number), block_of(number + before), block_of(F.greatest(number - after, F.lit(0))))
    )
    spread = indexed.withColumn("_home", block_of(number)).withColumn("_block", F.explode(seen_by))
    window = Window.partitionBy("_block").orderBy(index)
    out = spread.select("*", *[c.alias(n) for n, c in frames(window).items()])
    home = out.where(F.col("_block") == F.col("_home")).drop("_home")
    return home if keep_block else home.drop("_block")


def sort_logs(df: DataFrame, *tiebreak: str) -> DataFrame:
    """Total order by time, null timestamps last; a range-partitioned sort."""
    return df.orderBy(F.col("timestamp").asc_nulls_last(), *[F.col(c) for c in tiebreak])


def numbered_by_hash(df: DataFrame, key: str, seed: int, index: str) -> DataFrame:
    """Rows numbered from 0 in a random but repeatable order, that of a hash of the key."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), key))
    return numbered(hashed, [F.col("_h"), F.col(key)], index).drop("_h")
