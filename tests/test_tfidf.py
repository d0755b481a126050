"""Fitting of term vocabularies and models: rare pairs stay out of the count, texts are read a bounded number of times."""

from pyspark.sql import functions as F

from logquarry.catalog import models
from logquarry.functions import text
from logquarry.operators import model as model_module
from logquarry.operators.model import ImportanceModel
from logquarry.operators.tfidf import TfidfModel, frequent_words, term_counts, tfidf_terms


def corpus(spark):
    texts = ["cat dog cat dog rare" + str(i) for i in range(30)] + ["Cat, DOG fish!", "fish fish fish", "", None, "zebra"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_pairs_of_rare_words_are_not_counted(spark):
    rows = corpus(spark)
    among = frequent_words(rows, "text", 2)
    assert sorted(among) == ["cat", "dog"]
    counted = {r.term for r in term_counts(rows, "text", among=among).collect()}
    assert counted == {None, "cat", "dog", "cat dog", "dog cat"}


def test_pruned_vocabulary_is_the_whole_counts_first(spark):
    rows = corpus(spark)
    whole = term_counts(rows, "text").where("term is not null").orderBy(F.desc("total"), "term").collect()
    for most in (1, 2, 3, 4, 5, 8, 100):
        assert TfidfModel.fit(rows, "text", most).vocabulary == sorted(r.term for r in whole[:most])


def test_nothing_is_ruled_out_by_long_ties_or_few_words(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20)),)], "text string")
    assert frequent_words(rows, "text", 3) is None
    assert frequent_words(rows, "text", 21) is None
    assert TfidfModel.fit(rows, "text", 3).vocabulary == ["w0", "w0 w1", "w1"]


def test_terms_of_a_text_have_unit_length(spark):
    rows = corpus(spark)
    got = tfidf_terms(rows, "doc_id", "text", TfidfModel.fit(rows, "text", 5))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    lengths = got.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 9).alias("n")).collect()
    assert {r.n for r in lengths} == {1.0} and len(lengths) == 32


def test_letter_words_are_those_of_the_cleaned_text(spark):
    texts = ["A1b ab_cd x9y99zz", "Grüße İstanbul ẞ ſtop, e-mail me@x.org", "", None, "\nTwo  words\t3", "K elvin ÀÉ aé"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select(text.terms(F.col("text"), pattern=text.LETTER_PATTERN).alias("a"), text.terms(text.clean(F.col("text"))).alias("b")).collect():
        assert r.a == r.b


def test_classifiers_read_a_table_of_features(spark, monkeypatch):
    staged = []

    def spy(df):
        staged.append(df.columns)
        return df

    monkeypatch.setattr(model_module, "stage", spy)
    rows = corpus(spark).withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    made = ImportanceModel.train_kinds(rows, "text", "quality", ["logistic", "layers"], features=3, max_iter=2)
    assert len(made) == 2 and staged == [["features", "label"]]


def test_permutation_reads_counted_numbers(spark, tmp_path, monkeypatch):
    docs = corpus(spark).withColumn("text", F.coalesce("text", F.lit("x")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    plans, fit = [], models.train_on_columns

    def spy(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(df, *args)

    monkeypatch.setattr(models, "train_on_columns", spy)
    assert models.perm_importance(spark, str(tmp_path)).count() == 5
    assert "regexp" not in plans[0]
