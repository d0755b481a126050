"""Joins of rows to one statistic per key in which no key is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1_000


def spread_join(
    rows: DataFrame, stats: DataFrame, key: str, weight: str, salt: Column, how: str = "left", parts: int = PARTS
) -> DataFrame:
    """``rows`` with the columns of ``stats``, which has one row per ``key`` and in ``weight`` how many rows hold it.

    A key with more than one ``parts``-th of all rows is cut into as many pieces as it holds ``parts``-ths: its rows
    are dealt out by ``salt``, its statistic is repeated for every piece. There are at most ``parts`` such keys and
    at most twice as many pieces, whatever the size of the tables. The pieces come from exact counts, so
    the join is even without adaptive execution. ``salt`` must give a row the same value each time it
    is computed. Rows whose key is null find no statistic.
    """
    total = stats.agg(F.sum(weight)).scalar()
    pieces = F.ceil(F.try_divide(F.col(weight) * F.lit(float(parts)), total)).cast("int")
    hot = stats.where((F.col(weight) * F.lit(float(parts)) > total) & F.col(key).isNotNull()).select(
        F.struct(F.col(key).alias("key"), pieces.alias("value")).alias("e")
    ).agg(F.map_from_entries(F.collect_list("e"))).scalar()
    mine = F.coalesce(F.try_element_at(hot, F.col(key)), F.lit(1))
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(salt), mine).cast("int"))
    every = F.sequence(F.lit(0), F.greatest(F.coalesce(pieces, F.lit(1)), F.lit(1)) - 1)
    return dealt.join(stats.withColumn("_piece", F.explode(every)), [key, "_piece"], how).drop("_piece")
