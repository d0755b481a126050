"""Queries of the importance model, trained on the labelled documents. Rows only: the results
of an optimizer and of random draws have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.catalog.registry import query
from logquarry.catalog.views import table
from logquarry.functions import text
from logquarry.operators.model import (
    ImportanceModel,
    linear_probability,
    permutation_importance,
    stratified_split,
    train_on_columns,
)
from logquarry.session import scratch_path, stage


def labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", "quality")


def split(spark, sf):
    return stratified_split(labelled(spark, sf), "doc_id", "quality")


@query("train_importance")
def train_importance(spark, sf):
    """Scores of both models on the held-out documents."""
    rows = stage(split(spark, sf))
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    out, kinds = None, ["logistic", "layers"]
    for kind, model in zip(kinds, ImportanceModel.train_kinds(train, "text", "quality", kinds, max_iter=30)):
        scored = model.evaluate(test, "text", "quality").withColumn("model", F.lit(kind))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("score_importance")
def score_importance(spark, sf):
    """All documents scored by a model trained on the labelled ones."""
    model = ImportanceModel.train(stage(labelled(spark, sf)), "text", "quality", max_iter=30)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return model.score(docs, "text").select("doc_id", "importance", "prediction")


@query("stratified_split", """
  SELECT quality, count(*) AS rows, count(*) FILTER (WHERE
    CAST('0x' || substr(md5('42 ' || quality || ' ' || doc_id), 1, 8) AS BIGINT) % 1000000 < 200000) AS test_rows
  FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def stratified(spark, sf):
    return split(spark, sf).groupBy("quality").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


@query("perm_importance")
def perm_importance(spark, sf):
    counts = text.counts(F.col("text"))
    names = ["message_length", "word_count", "number_count", "uppercase_count", "special_char_count"]
    # counted once; the fit and the two orders of the rows read only the numbers
    rows = stage(labelled(spark, sf).select("doc_id", "quality", *[(counts[c] / 1000.0).alias(c) for c in names]))
    weights, intercept = train_on_columns(rows, names, "quality")
    return permutation_importance(rows, "doc_id", names, linear_probability(weights, intercept))


@query("model_round_trip", "SELECT true AS same, count(*) AS rows FROM documents JOIN labels USING (doc_id)")
def model_round_trip(spark, sf):
    """A model saved and loaded again scores every labelled document as before."""
    rows = stage(labelled(spark, sf))
    model, path = ImportanceModel.train(rows, "text", "quality", max_iter=5), scratch_path(spark, "model")
    model.save(path)
    first = model.score(rows, "text").select("doc_id", F.round("importance", 9).alias("p"))
    second = ImportanceModel.load(path).score(rows, "text").select("doc_id", F.round("importance", 9).alias("q"))
    return first.join(second, "doc_id").agg(F.every(F.col("p") == F.col("q")).alias("same"), F.count(F.lit(1)).alias("rows"))
