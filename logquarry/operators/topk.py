"""Best rows per group and exact percentiles, without collecting a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark keeps only k rows per task before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def exact_percentiles(
    df: DataFrame,
    value: str,
    quantiles: dict[str, float],
    keys: list[str] | None = None,
    accuracy: int = 100_000,
) -> DataFrame:
    """Interpolated percentiles per key, one column per entry of ``quantiles``.

    A bounded sketch brackets each quantile; only the distinct values inside a bracket are
    counted and put in order, so neither a hot key nor a long list of distinct values ends up
    in the memory of one task. A bracket reaches a few errors of the sketch, and at least two
    ranks, to either side; the sketch is asked for several widths at once and the rows' number
    says which one serves.
    """
    keys = keys or []
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margins = [4.0 / accuracy]
    while margins[-1] < 1.0:
        margins.append(min(4 * margins[-1], 1.0))
    names = list(quantiles)
    low = F.percentile_approx("_v", [max(quantiles[n] - m, 0.0) for n in names for m in margins], accuracy)
    high = F.percentile_approx("_v", [min(quantiles[n] + m, 1.0) for n in names for m in margins], accuracy)
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), low.alias("_low"), high.alias("_high"))
    narrow = F.size(F.filter(F.array(*[F.lit(m) for m in margins]), lambda m: m < 2 / F.col("_n")))
    width = F.least(narrow, F.lit(len(margins) - 1))
    brackets = sketch.select(
        *keys, "_n",
        F.explode(F.array(*[
            F.struct(
                F.lit(n).alias("name"),
                F.lit(float(quantiles[n])).alias("q"),
                F.get("_low", width + i * len(margins)).alias("low"),
                F.get("_high", width + i * len(margins)).alias("high"),
            )
            for i, n in enumerate(names)
        ])).alias("b"),
    ).select(*keys, "_n", "b.*")
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    if keys:
        joined = counted.alias("c").join(brackets.alias("b"), on, "inner")
    else:
        packed = brackets.agg(F.collect_list(F.struct("_n", "name", "q", "low", "high"))).scalar()
        joined = counted.withColumn("_b", F.explode(packed)).select("_v", "_c", "_b.*").alias("b")
    value_column = F.col("_v")
    # Values below the bracket only matter by their number.
    folded = joined.where(value_column <= F.col("high")).groupBy(
        *[F.col(f"b.{k}").alias(k) for k in keys], "name", "q", "_n",
        F.when(value_column >= F.col("low"), value_column).alias("v"),
    ).agg(F.sum("_c").alias("c"))
    w = Window.partitionBy(*keys, "name").orderBy(F.col("v").asc_nulls_first())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = folded.withColumn("upto", F.sum("c").over(upto)).withColumn(
        "position", (F.col("_n") - 1) * F.col("q")
    )
    below, above = F.floor("position"), F.ceil("position")
    holds = lambda p: (F.col("upto") > p) & (F.col("upto") - F.col("c") <= p)
    fraction = F.col("position") - below
    per_name = placed.groupBy(*keys, "name").agg(
        F.max(F.when(holds(below), F.col("v"))).alias("lo"),
        F.max(F.when(holds(above), F.col("v"))).alias("hi"),
        F.max(fraction).alias("f"),
    ).withColumn("result", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f"))
    picked = [F.max(F.when(F.col("name") == n, F.col("result"))).alias(n) for n in names]
    return per_name.groupBy(*keys).agg(*picked)


def percentile_of_few(df: DataFrame, value: str, q: float) -> Column:
    """Interpolated percentile, as a one-row subquery, of a column with few distinct values.

    Values are counted first, so the memory of the last step is bounded by their number (at
    most a million and one for scores within 0..1 kept to six digits).
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.percentile(F.col(value).cast("double"), q, F.col("_n"))).scalar()


def at_least_percentile(df: DataFrame, value: str, q: float, few_values: bool = False) -> DataFrame:
    """Rows whose value reaches the whole table's interpolated percentile; ties stay."""
    if few_values:
        threshold = percentile_of_few(df, value, q)
    else:
        threshold = exact_percentiles(df, value, {"p": q}).select("p").scalar()
    return df.where(F.col(value) >= threshold)
