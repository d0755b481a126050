"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Among all document rates between 0 and ``most`` that meet the
targets, the ones closest to 1 in relative entropy are wanted. The problem's dual is convex with one
multiplier per source, and its solution is an exponential tilt: a document of s words gets the rate
min(most, exp(lambda s / mean)), where mean is the mean size of its source. Newton's method, kept inside a
bracket, finds the multipliers; each step is one aggregate over the counts of documents by source and
size (rates depend on nothing else), with exact sums, so reruns agree to the last bit.

Rates become whole copies by size, large documents first: what a size's documents miss or exceed is
carried to the smaller sizes, so a source ends within about half its smallest document of its target.
Within a size, the documents with the smallest hashes of their ids get the extra copy.

A source's target is its weight's share of all words, but at most ``most`` times its own words; the
excess is shared out again by weight. Sources are weighed in code point order, null last.

Null and empty texts have 0 words and get one copy. Rows with the same id and size are treated alike.
A table without rows or words has targets of 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.llm.common import words
from logquarry.session import stage

EXACT = "decimal(38,9)"
PART = 10_000  # documents of one source and size that are ordered in one task
OWN = ("_source", "_size", "_draw")


def with_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` (``_row``), with the source as a key that isn't null, the number of words, and a number
    in [0, 1) drawn from the id."""
    return docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("~")).alias("_source"),  # "~" sorts last
        F.size(words(F.col(text_column))).cast("long").alias("_size"),
        (F.xxhash64(F.col(id_column)) / F.lit(2.0**64) + F.lit(0.5)).alias("_draw"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, the number of sources before it; dealt by range, so no task sees them all."""
    ranged = stage(sources.repartitionByRange("_source").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = sizes.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_source")) - 1
    return ranged.join(before, "_range").select(*sources.columns, (F.col("before") + inside).alias("place"))


def targets(hist: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Per source: source_size, documents, target. ``hist`` counts documents by source and size."""
    sources = hist.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    weighed = stage(_ranked(sources).withColumn("weight", weight).drop("place"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    full = lambda level: F.col("weight") * F.lit(level) > F.lit(most) * F.col("source_size")
    level = 0.0
    while total:
        held, free = weighed.agg(  # one row
            F.coalesce(F.sum(F.when(full(level), F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full(level), F.col("weight").cast(EXACT))), F.lit(0))).first()
        new = (total - most * held) / float(free) if free else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), F.lit(most) * F.col("source_size"))).drop("weight")


def multipliers(hist: DataFrame, sources: DataFrame, most: float, tolerance: float = 1e-10, steps: int = 80) -> DataFrame:
    """Per source the multiplier that meets its target, by safeguarded Newton steps on the dual.

    ``full`` marks sources whose target is all they can give: their rate is ``most`` for every document.
    """
    mean = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-300))
    least = hist.where("_size > 0").groupBy("_source").agg(F.min("_size").alias("least"))
    state = stage(sources.join(least, "_source", "left").select(
        "_source", "source_size", "target", mean.alias("mean"),
        (F.col("target") >= F.lit(most) * F.col("source_size")).alias("full"), F.lit(0.0).alias("lambda"),
        F.lit(None).cast("double").alias("low"), (F.log(F.lit(most)) * mean / F.col("least") * 1.01).alias("high")))
    for _ in range(steps):
        x = F.col("_size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lambda") * x, F.lit(700.0)))
        words_of = F.col("n") * F.col("_size")
        met = hist.where("_size > 0").join(state.where("not full"), "_source").groupBy("_source").agg(
            F.sum((words_of * F.least(tilt, F.lit(most))).cast(EXACT)).cast("double").alias("value"),
            F.sum(F.when(tilt < most, words_of * x * tilt).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        moved = state.join(met, "_source", "left").withColumns({
            "high": F.when(F.col("value") >= F.col("target"), F.least("high", "lambda")).otherwise(F.col("high")),
            "low": F.when(F.col("value") <= F.col("target"), F.greatest("low", "lambda")).otherwise(F.col("low")),
            "newton": F.col("lambda") - (F.col("value") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope")),
        })
        inside = F.coalesce((F.col("newton") < F.col("high")) & (F.col("low").isNull() | (F.col("newton") > F.col("low"))), F.lit(False))
        halved = F.when(F.col("low").isNull(), 2 * F.col("high") - 1.0).otherwise((F.col("low") + F.col("high")) / 2)
        near = F.coalesce(F.abs(F.col("value") - F.col("target")) <= tolerance * F.col("target") + 1e-7, F.lit(True))
        state = stage(moved.select(
            "_source", "source_size", "target", "mean", "full", "low", "high", near.alias("near"),
            F.when(near, F.col("lambda")).when(inside, F.col("newton")).otherwise(halved).alias("lambda")))
        if state.where("not near").isEmpty():
            break
    return state


def copies_by_size(hist: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """Per source and size: every document's ``base`` copies, and how many of its n get one more (``extra``).

    A group is the distinct sizes of one source, at most as many as the words of its longest document.
    """
    rate = F.when(F.col("_size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(most))).otherwise(
        F.least(F.exp(F.least(F.col("lambda") * F.col("_size") / F.col("mean"), F.lit(700.0))), F.lit(float(most))))
    rated = hist.join(state, "_source").select("_source", "_size", "n", "source_size", "target", rate.alias("rate"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size", ascending=False)
        sizes, ns, rates = pdf["_size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy()
        missing, out = float(pdf["target"].iloc[0] - np.sum(sizes * ns * rates)), []
        for size, n, r in zip(sizes.tolist(), ns.tolist(), rates.tolist()):
            k = int(min(max(round(n * r + (missing / size if size else 0.0)), 0), int(most) * n))
            missing += (n * r - k) * size
            out.append(k)
        k = np.asarray(out, np.int64)
        return pd.DataFrame({"_source": pdf["_source"], "_size": sizes, "n": ns, "source_size": pdf["source_size"],
                             "target": pdf["target"], "base": k // ns, "extra": k % ns})

    return rated.groupBy("_source").applyInPandas(
        whole, "_source string, _size long, n long, source_size long, target double, base long, extra long")


def _last_drawn(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Per source and size with extra copies: the draw of the last document that gets one.

    Documents are cut into parts by their draw; counts find the part where the extras end.
    """
    open_ = classes.where("extra > 0").select("_source", "_size", "extra", F.ceil(F.col("n") / PART).alias("parts"))
    drawn = keyed.select("_source", "_size", "_draw").join(open_, ["_source", "_size"])
    drawn = drawn.withColumn("part", F.floor(F.col("_draw") * F.col("parts")))
    counts = drawn.groupBy("_source", "_size", "part").agg(F.count(F.lit(1)).alias("here"), F.max("extra").alias("extra"))
    before = F.sum("here").over(W.partitionBy("_source", "_size").orderBy("part")) - F.col("here")
    ends = stage(counts.withColumn("before", before).where("before < extra and extra <= before + here").select(
        "_source", "_size", "part", (F.col("extra") - F.col("before")).alias("wanted")))
    rank = F.row_number().over(W.partitionBy("_source", "_size").orderBy("_draw"))
    return (drawn.join(ends, ["_source", "_size", "part"]).withColumn("rank", rank).where("rank = wanted")
            .select("_source", "_size", F.col("_draw").alias("last")))


def plan(docs: DataFrame, weights: list[float], most: float = 3.0, **columns) -> tuple[DataFrame, DataFrame]:
    """The keyed documents (id, keys) and the plan: per source and size base copies, last draw, source_size, target."""
    keyed = stage(with_keys(docs, **columns).select(f"_row.{columns.get('id_column', 'doc_id')}", *OWN))
    hist = stage(keyed.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("n")))
    state = multipliers(hist, stage(targets(hist, weights, most)), most)
    classes = stage(copies_by_size(hist, state, most))
    last = _last_drawn(keyed, classes)
    return keyed, stage(classes.join(last, ["_source", "_size"], "left").drop("n", "extra"))


COPIES = "base + case when _draw <= last then 1 else 0 end"


def mix(docs: DataFrame, weights: list[float], most: float = 3.0, **columns) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    _, by_size = plan(docs, weights, most, **columns)
    found = with_keys(docs, **columns).join(by_size.select("_source", "_size", "base", "last"), ["_source", "_size"])
    return found.withColumn("_copies", F.expr(COPIES)).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
