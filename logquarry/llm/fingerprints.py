"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every five-word shingle is hashed once. The hash's top bits name one of BINS bins, the rest is its
value; a bin keeps its smallest value. An empty bin takes the value of a full one: it draws bins by hash
until it meets a full one, and after TRIES draws goes round all bins in a cycle of its own, so it always
ends and any two documents make the same choices wherever the same bins are full. The lowest BITS bits of each bin are packed into the
fingerprint, a lowercase hex string. Different values share their low bits with probability 2^-BITS;
``likeness`` corrects for that, so it estimates the Jaccard similarity of the shingle sets.

Only DataFrame expressions run here. Texts of fewer than five words are one shingle. Null texts count
as empty; a text without words has the fingerprint "", like only to "". Equal texts have equal
fingerprints. Rows stay as they are, repeated ones too.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.llm.common import words

BINS, BITS, SHINGLE = 128, 4, 5
TRIES = 8  # draws of an empty bin before it goes round
SHIFT = 64 - BINS.bit_length() + 1  # a hash's bits below its bin
EMPTY = (1 << SHIFT) - 1  # the value of a bin without shingles


def _drawn(i: int, salt: str) -> int:
    return zlib.crc32(f"{salt} {i}".encode())


def with_fingerprint(docs: DataFrame, text_column: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with column ``into``."""
    w, h, s, m = (f"_{into}_{k}" for k in ("words", "hashes", "sorted", "mins"))
    rest = docs.drop(into, w, h, s, m)
    cut = rest.withColumn(w, words(F.lower(F.coalesce(F.col(text_column), F.lit("")))))
    hashed = cut.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    hc = F.col(h)
    shingles = F.when(F.size(hc) >= SHINGLE, F.transform(
        F.slice(hc, F.lit(1), F.size(hc) - SHINGLE + 1),
        lambda x, i: F.xxhash64(x, *[F.get(hc, i + k) for k in range(1, SHINGLE)]))
    ).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    # every bin gets its largest possible value, so that it appears, and in order, once hashes are sorted
    bounds = F.array(*[F.lit(((b - BINS // 2) << SHIFT) | EMPTY).cast("bigint") for b in range(BINS)])
    ordered = hashed.withColumn(s, F.sort_array(F.concat(shingles, bounds)))
    sc = F.col(s)
    firsts = F.concat(F.slice(sc, 1, 1), F.filter(  # a bin's smallest value is the first one with its top bits
        sc, lambda x, i: F.shiftright(x.bitwiseXOR(F.get(sc, i - 1)), SHIFT) != 0))
    # the low bits of full bins; null: empty
    low = F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(EMPTY)) != EMPTY, x.bitwiseAND((1 << BITS) - 1).cast("int")))
    minima = ordered.withColumn(m, low)
    mc = F.col(m)
    drawn = F.array(*[F.array(*[F.lit(_drawn(i, f"try {t}") % BINS) for i in range(BINS)]) for t in range(TRIES)])
    filled = F.aggregate(drawn, mc, lambda bins, tried: F.when(F.exists(bins, lambda x: x.isNull()), F.transform(
        bins, lambda x, i: F.when(x.isNotNull(), x).otherwise(F.get(mc, F.get(tried, i))))).otherwise(bins))
    # then a bin goes round in a cycle of its own: the full bin with the fewest steps to it
    cycles = F.array(*[F.array(F.lit(pow(2 * _drawn(i, "step") + 1, -1, BINS)), F.lit(_drawn(i, "start") % BINS))
                       for i in range(BINS)])
    full = F.filter(F.transform(mc, lambda x, j: F.when(x.isNotNull(), F.struct(j.alias("bin"), x.alias("value")))),
                    lambda y: y.isNotNull())
    nearest = lambda c: F.array_min(F.transform(full, lambda y: F.struct(
        F.pmod((y["bin"] - F.get(c, F.lit(1))) * F.get(c, F.lit(0)), F.lit(BINS)).alias("steps"), y["value"].alias("value"))))
    bins = F.transform(filled, lambda x, i: F.when(x.isNotNull(), x).otherwise(nearest(F.get(cycles, i))["value"]))
    text = F.array_join(F.transform(bins, lambda d: F.substring(F.lit("0123456789abcdef"), d + 1, F.lit(1))), "")
    return minima.withColumn(into, F.when(F.size(w) > 0, text).otherwise("")).drop(w, h, s, m)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    number = lambda x, i: F.conv(F.substring(x, 8 * i + 1, F.lit(8)), 16, 10).cast("bigint")  # noqa: E731  eight bins
    unlike = F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda i: number(a, i).bitwiseXOR(number(b, i)))
    differing = F.aggregate(unlike, F.lit(0), lambda n, x: n + F.bit_count(
        x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        .bitwiseAND(F.lit(0x11111111).cast("bigint"))))
    chance = 1.0 / (1 << BITS)
    corrected = ((F.lit(BINS) - differing) / F.lit(float(BINS)) - chance) / (1 - chance)
    return (F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), corrected))))


def next_ids(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, next_id) of every distinct id: the next smaller one; the smallest is followed by the largest.

    Ids are dealt by range; each range only needs the largest id of the ranges below it.
    """
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ranged = ids.repartitionByRange("doc_id").withColumn("_range", F.spark_partition_id())
    inside = W.partitionBy("_range").orderBy("doc_id")
    linked = ranged.withColumn("_low", F.lag("doc_id").over(inside))
    tops = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"), F.min("doc_id").alias("_bottom"))  # a row a range
    whole = W.orderBy("_bottom").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tops = tops.select("_bottom", F.coalesce(F.lag("_top").over(W.orderBy("_bottom")), F.max("_top").over(whole)).alias("_before"))
    return linked.join(tops, F.col("doc_id") == F.col("_bottom"), "left").select(
        "doc_id", F.coalesce("_low", "_before").alias("next_id"))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, in which the next document's start replaces the second half.

    Of the next document only as much text moves as is needed. Where rows share an id, the next
    document of others is the one of them with the smallest text. Rows with a null id have no next one.
    """
    # ids of the right name and type stay bare columns: an alias that only one side of a join needs would keep the
    # two sides' exchanges apart
    plain = id_column == "doc_id" and dict(docs.dtypes)["doc_id"] == "bigint"
    rows = docs.select(F.col("doc_id") if plain else F.col(id_column).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    lengths = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    need = lengths.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    asked = next_ids(docs, id_column).join(need, "doc_id").select(
        F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), F.floor(F.col("n_chars") / 2).alias("half"))
    marked = with_fingerprint(rows.where("doc_id is not null"))
    given = marked.join(asked, "doc_id").select("for_id", F.struct(
        F.expr("left(text, cast(half as int))").alias("start"), F.col("fingerprint").alias("next_fingerprint")).alias("given"))
    given = given.groupBy("for_id").agg(F.min("given").alias("given")).select(F.col("for_id").alias("doc_id"), "given.*")
    half = F.expr("cast(floor(n_chars / 2) as int)")
    # both joins read the same columns of the same rows, so the texts are shingled and dealt out once
    both = marked.join(given, "doc_id", "left")
    unnamed = with_fingerprint(rows.where("doc_id is null"))
    both = both.union(unnamed.select(*marked.columns, F.lit(None).cast("string"), F.lit(None).cast("string")))
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"),
                           F.coalesce(F.substring("start", F.lit(1), half), F.lit(""))))
    done = with_fingerprint(both.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited"), "edited",
                            "edited_fingerprint")
    return done.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", F.lit(""))).alias("near_next"))
