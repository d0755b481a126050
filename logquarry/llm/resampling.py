"""Importance resampling towards a target distribution.

Features are all runs of one and two words, hashed into ``buckets`` places. How often each place occurs in the
corpus and in the target texts gives it a gain, the scaled logarithm of the ratio of its smoothed shares. The
gains form one array, and a document's weight is the floored mean of the gains that its features look up there.
With Gumbel noise drawn from its id added, the highest scores are a draw without replacement in proportion to
the exponentiated weights.

The cutoff is found without a sort of all scores: a quantile sketch proposes brackets of growing width around the
wanted rank, exact counts above and inside them show which is the first to hold that rank (the widest reaches
from the smallest to the largest score), and only the rows of that bracket are put in order. The drawn rows alone
are then numbered.

Words are what the word pattern finds after A-Z are lowered; whole texts count. Null and empty texts have no
features and weight 0. Documents with fewer than ``least_words`` words count in the corpus but are never drawn.
A null id draws its noise as an empty one and comes last among ties. Rows with one id have the same noise; rows
equal in all that decides take their ranks in any order. Empty tables give an empty result; without target texts
every gain compares with an even distribution. Only the id and the text column are read, so other names can't
clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.operators.ordering import numbered
from logquarry.session import stage

#: Everything but digits, a-z and characters beyond ASCII separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCURACY = 10_000


@dataclass(frozen=True)
class Draw:
    """What is drawn: ``percent`` of the documents with at least ``least_words`` words."""

    percent: int = 25
    least_words: int = 20
    buckets: int = 10_000
    seed: str = "7:"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN), "")


def feature_buckets(found: Column, buckets: int) -> Column:
    """The bucket of every word and of every two words in a row, repeats included."""
    number = lambda f: (F.crc32(f) % buckets).cast("int")
    singles = F.transform(found, number)
    pairs = F.zip_with(found, F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda a, b: number(F.concat(a, F.lit(" "), b)))
    return F.concat(singles, F.array_compact(pairs))  # the last word has no successor


def with_buckets(texts: DataFrame, text_column: str, buckets: int, *keep: Column) -> DataFrame:
    """The ``keep`` columns with n_words and the array of buckets, written to the shared folder: texts are cut once."""
    cut = texts.select(*keep, words(F.col(text_column)).alias("_words"))
    return stage(cut.select(*[c for c in cut.columns if c != "_words"], F.size("_words").cast("long").alias("n_words"),
                            feature_buckets(F.col("_words"), buckets).alias("_buckets")))


def bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row: the array of gains by bucket, at most ``buckets`` long whatever the input."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_counts(corpus, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").select(
        "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    packed = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("c"), F.sum("s").alias("S"), F.sum("t").alias("T"))
    ratio = lambda c: ((c["t"] + 1).cast("double") * (F.col("S") + buckets).cast("double")) / (
        (c["s"] + 1).cast("double") * (F.col("T") + buckets).cast("double"))
    return packed.select(F.transform("c", lambda c: F.floor(F.lit(1000.0) * F.ln(ratio(c)))).alias("gains"))


def noise(id_column: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of the id."""
    key = F.concat(F.lit(seed), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def weighted(rows: DataFrame, gain_row: DataFrame) -> DataFrame:
    """Adds n_features and weight, the floored mean of the gains the row's buckets look up.

    The array of gains, as long as there are buckets, travels as a constant of the plan.
    """
    values = gain_row.first()["gains"]
    table = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # folded into one constant
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    n = F.size("_buckets").cast("long")
    summed = rows.withColumn("n_features", n).withColumn("_sum", total)
    mean = F.expr("(_sum - pmod(_sum, n_features)) div n_features")
    return summed.withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(0)).drop("_sum", "_buckets")


def bracket(rows: DataFrame, score: str, wanted: int, n: int) -> tuple[int, int, int]:
    """``(low, high, above)``: the ``wanted``-th highest of ``n`` scores lies in [low, high], with exactly ``above`` rows above it.

    One pass builds the sketch and one counts; all widths are proposed and counted together.
    """
    at, margins = 1 - (wanted - 0.5) / n, [2.0 / ACCURACY]
    while margins[-1] < 1:
        margins.append(min(4 * margins[-1], 1.0))
    value = F.col(score)
    ends = [F.percentile_approx(value, [max(at - m, 0.0) for m in margins], ACCURACY),
            F.percentile_approx(value, [min(at + m, 1.0) for m in margins], ACCURACY), F.min(value), F.max(value)]
    low, high, smallest, largest = rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    pairs = [*zip(low, high), (smallest, largest)]
    counts = rows.agg(*[F.count_if(value > h).alias(f"a{i}") for i, (_, h) in enumerate(pairs)],
                      *[F.count_if(value >= lo).alias(f"b{i}") for i, (lo, _) in enumerate(pairs)]).first()
    for (lo, hi), above, down_to in zip(pairs, counts[:len(pairs)], counts[len(pairs):]):
        if above < wanted <= down_to:
            return lo, hi, above
    raise AssertionError("the bracket of all scores holds every rank")


def ranked(scored: DataFrame, eligible: Column, percent: int, id_column: str) -> DataFrame:
    """Adds ``rank`` from 1 to the floor(percent * eligible / 100) highest scores, ties to smaller ids; null elsewhere."""
    rows = scored.where(eligible)
    n = rows.count()
    wanted = percent * n // 100
    nothing = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", nothing)
    order = [F.desc("score"), F.col(id_column).asc_nulls_last(), F.col("n_features"), F.col("weight")]
    low, high, above = bracket(rows, "score", wanted, n)
    inside = rows.where(F.col("score").between(low, high))
    last = numbered(inside.select("score", id_column, "n_features", "weight"), order, "_at").where(F.col("_at") == wanted - above - 1).first()
    after_null = F.lit(last[id_column] is None)
    same = (F.col("score") == last["score"]) & (F.col(id_column).isNotNull() & (after_null | (F.col(id_column) <= F.lit(last[id_column])))
                                                 | F.col(id_column).isNull() & after_null)
    reached = F.coalesce(eligible & ((F.col("score") > last["score"]) | same), F.lit(False))
    # rows that equal the last one in score and id may go beyond the wanted number; their rank says which
    placed = numbered(scored.where(reached), order, "_at")
    drawn = placed.select(*scored.columns, F.when(F.col("_at") < wanted, F.col("_at") + 1).alias("rank"))
    return drawn.union(scored.where(~reached).select("*", nothing))


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score and rank of the drawn ones."""
    corpus = with_buckets(docs, text_column, draw.buckets, F.col(id_column).alias("_id"))
    wanted = with_buckets(target, text_column, draw.buckets)
    scored = stage(weighted(corpus, gains(corpus, wanted, draw.buckets)).withColumn("score", F.col("weight") + noise(F.col("_id"), draw.seed)))
    found = ranked(scored, F.col("n_words") >= draw.least_words, draw.percent, "_id")
    return found.select(F.col("_id").alias(id_column), "n_words", "n_features", "weight", "score", "rank")
