"""TF-IDF over words and neighbouring word pairs, fitted once and reused."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.functions import text
from logquarry.session import small_table


def frequent_words(df: DataFrame, column: str, most: int, stop_words: list[str] | None = None,
                   pattern: str = text.TERM_PATTERN) -> list[str] | None:
    """The words that the ``most`` most frequent terms can be made of, at most twice as many; None for all words.

    A pair occurs at most as often as either of its words. The ``most`` most frequent words are terms themselves, so no
    term with a rarer word can be among the most frequent ones. Where too many words are as frequent as
    the last of them, or there are too few, nothing is ruled out.
    """
    if most < 1:
        return None
    totals = df.select(F.explode(text.words(F.col(column), stop_words, pattern)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("total"))
    first = totals.orderBy(F.desc("total"), "word").limit(2 * most + 1).collect()
    if len(first) < most:
        return None
    kept = [r["word"] for r in first if r["total"] >= first[most - 1]["total"]]
    return kept if len(kept) <= 2 * most else None


def term_counts(df: DataFrame, column: str, stop_words: list[str] | None = None, among: list[str] | None = None,
                pattern: str = text.TERM_PATTERN) -> DataFrame:
    """``(term, total, documents)``; the null term counts the rows themselves. With ``among``, of terms made of its words.

    Occurrences and documents are counted in one pass with partial sums per task.
    """
    words = df.select(text.terms(F.col(column), stop_words, among, pattern).alias("words"))
    each = F.transform("words", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    once = F.transform(
        F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))
    )
    row = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("n"), F.lit(1).alias("d")))
    return (
        words.select(F.inline(F.concat(each, once, row)))
        .groupBy("term")
        .agg(F.sum("n").alias("total"), F.sum("d").alias("documents"))
    )


def unit_length(raw: Column) -> Column:
    """The array scaled to unit length. Array and length are lambda variables, so each is computed once a row, not once a place."""
    def scaled(values: Column) -> Column:
        length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(length), lambda n: F.transform(values, lambda x: x / n))[0]

    return F.transform(F.array(raw), scaled)[0]


@dataclass
class TfidfModel:
    """Most frequent terms of a corpus with their weights; at most ``max_features`` of them."""

    vocabulary: list[str]
    idf: list[float]
    stop_words: list[str] | None = None
    pattern: str = text.TERM_PATTERN

    @classmethod
    def fit(cls, df: DataFrame, column: str, max_features: int = dims.VOCABULARY_SIZE,
            stop_words: list[str] | None = None, pattern: str = text.TERM_PATTERN) -> "TfidfModel":
        among = frequent_words(df, column, max_features, stop_words, pattern)
        best = term_counts(df, column, stop_words, among, pattern).orderBy(
            F.col("term").isNotNull(), F.desc("total"), "term"
        ).limit(max_features + 1).collect()
        if not best or best[0]["term"] is not None:
            return cls([], [], stop_words, pattern)
        rows = best[0]["documents"]
        kept = sorted((r["term"], r["documents"]) for r in best[1:])
        idf = [math.log((1 + rows) / (1 + documents)) + 1 for _, documents in kept]
        return cls([term for term, _ in kept], idf, stop_words, pattern)

    def counts(self, df: DataFrame, column: str, indices: str = "indices", values: str = "counts") -> DataFrame:
        """Adds the numbers of the vocabulary terms in the text and how often each occurs."""
        if not self.vocabulary:
            empty = F.array()
            return df.withColumn(indices, empty.cast("array<int>")).withColumn(values, empty.cast("array<double>"))
        worded = df.withColumn("_words", text.terms(F.col(column), self.stop_words, pattern=self.pattern))
        counter = CountVectorizerModel.from_vocabulary(self.vocabulary, "_words", "_counts")
        return (
            counter.transform(worded)
            .withColumn("_counts", F.unwrap_udt("_counts"))
            .withColumn(indices, F.col("_counts.indices"))
            .withColumn(values, F.col("_counts.values"))
            .drop("_words", "_counts")
        )

    def transform(self, df: DataFrame, column: str, indices: str = "indices", weights: str = "weights") -> DataFrame:
        """Adds term numbers and their weights, scaled to unit length; no shuffle."""
        idf = F.array(*[F.lit(x) for x in self.idf or [0.0]])
        weighted = F.zip_with(
            F.col("_values"), F.transform(F.col(indices), lambda i: F.get(idf, i)), lambda tf, w: tf * w
        )
        return (
            self.counts(df, column, indices, "_values")
            .withColumn(weights, unit_length(weighted))
            .drop("_values")
        )

    def term_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.vocabulary, self.idf))]
        return small_table(spark, rows, "index int, term string, idf double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.term_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, stop_words: list[str] | None = None) -> "TfidfModel":
        rows = spark.read.parquet(path).orderBy("index").collect()
        return cls([r["term"] for r in rows], [r["idf"] for r in rows], stop_words)


def tfidf_terms(df: DataFrame, key: str, column: str, model: TfidfModel) -> DataFrame:
    """``(key, term, weight)`` of every vocabulary term in every text."""
    terms = F.array(*[F.lit(t) for t in model.vocabulary or [""]])
    return model.transform(df.select(key, column), column).select(
        key, F.inline(F.arrays_zip(F.transform("indices", lambda i: F.get(terms, i)), "weights")).alias("term", "weight"))
