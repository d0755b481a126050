"""Documents to training tokens in five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the
columns of documents, the last one the encoded documents. ``run`` applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import lexicon_bpe, mixing, ngram_join, pii, quality_rules
from logquarry.llm.common import table
from logquarry.llm.queries import MOST, WEIGHTS, vocabulary
from logquarry.session import scratch_path, shuffles_dropped, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    stats = stage(quality_rules.with_stats(docs).select("doc_id", "lang", *quality_rules.GRID))
    cutoffs = stage(quality_rules.select_cutoffs(stats, table(spark, sf_dir, "labels")))
    return quality_rules.judge(quality_rules.with_stats(docs), cutoffs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 stays, the one with the smallest id.

    Rows with a null id link with nothing and stay. Of rows with one id the smallest stays.
    """
    found = stage(ngram_join.ngram_join(docs, n=5, num=80, den=100))
    times = found.where("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.expr("component_id = doc_id")).alias("_times"))
    with shuffles_dropped(spark):  # most texts stay as they are; only rows that a filter of the other ids lets pass are shuffled
        others = stage(times.where("_times <> 1"))
        words = stage(ngram_join.member_words(others, "doc_id"))
    marked = ngram_join.marked(docs, words, "doc_id")
    rest = [c for c in docs.columns if c != "doc_id"]
    repeated = (marked.where("_member").join(others.where("_times > 1"), "doc_id").groupBy("doc_id")
                .agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", "_row.*"))
    return (marked.where("not _member or doc_id is null").select(*docs.columns)
            .union(marked.where("_member").where("doc_id is not null").join(others, "doc_id", "left_anti").select(*docs.columns))
            .union(repeated.select(*docs.columns)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; rows repeat as often as the mix takes them."""
    return mixing.mix(docs, WEIGHTS, MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with what they decode to as a digest."""
    path = vocabulary("word_bpe_49k.json")
    return lexicon_bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path).select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data),
          ("mixing", mix), ("BPE", encode)]

#: No SQL says entropy balancing or BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
