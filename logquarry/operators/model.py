"""The learned importance model: TF-IDF features, a classifier, its evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import text
from logquarry.operators import evaluation
from logquarry.operators.ordering import numbered_by_hash
from logquarry.operators.tfidf import TfidfModel
from logquarry.session import stage

FEATURES = 100
HIDDEN = [128, 128, 64, 32]


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: about the given share of every class, drawn by a hash of the key.

    Which rows are drawn depends on key, class and seed alone, so a rerun splits the same way,
    and no class has to be sorted in one place.
    """
    name = F.concat_ws(" ", F.lit(str(seed)), F.col(label).cast("string"), F.col(key).cast("string"))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint") % 1_000_000
    return df.withColumn("is_test", draw < F.lit(round(test_share * 1_000_000)))


def with_terms(df: DataFrame, column: str) -> DataFrame:
    """The terms of the cleaned text, found without cleaning it first."""
    return df.withColumn("_terms", text.terms(F.col(column), pattern=text.LETTER_PATTERN))


@dataclass
class ImportanceModel:
    """A fitted pipeline on one text column; the vocabulary is fixed when it is trained."""

    pipeline: PipelineModel

    @classmethod
    def train(cls, df: DataFrame, column: str, label: str, kind: str = "logistic",
              features: int = FEATURES, seed: int = 42, max_iter: int = 50) -> "ImportanceModel":
        """``kind`` is ``logistic`` or ``layers`` (dense 128-128-64-32-2)."""
        return cls.train_kinds(df, column, label, [kind], features, seed, max_iter)[0]

    @classmethod
    def train_kinds(cls, df: DataFrame, column: str, label: str, kinds: list[str],
                    features: int = FEATURES, seed: int = 42, max_iter: int = 50) -> list["ImportanceModel"]:
        """One model of each kind on the same vocabulary and features.

        Texts are read twice for the vocabulary and once for the features, which are written to a table: at most
        ``features`` numbers a row, which the classifiers then pass over as often as they need.
        """
        for kind in kinds:
            if kind not in ("logistic", "layers"):
                raise ValueError(f"unknown model: {kind}")
        terms = TfidfModel.fit(df, column, features, pattern=text.LETTER_PATTERN)
        if not terms.vocabulary:
            raise ValueError("no terms to train on")
        counter = CountVectorizerModel.from_vocabulary(terms.vocabulary, "_terms", "_counts")
        counted = counter.transform(with_terms(df, column))
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(terms.idf), inputCol="_counts", outputCol="_weighted")
        unit = Normalizer(inputCol="_weighted", outputCol="features")
        weighted = unit.transform(weigh.transform(counted))
        rows = stage(weighted.select("features", F.col(label).cast("double").alias("label")))
        made = []
        for kind in kinds:
            if kind == "logistic":
                classifier = LogisticRegression(maxIter=max_iter, regParam=0.01)
            else:
                classifier = MultilayerPerceptronClassifier(
                    layers=[len(terms.vocabulary), *HIDDEN, 2], maxIter=max_iter, seed=seed)
            made.append(cls(PipelineModel([counter, weigh, unit, classifier.fit(rows)])))
        return made

    def score(self, df: DataFrame, column: str) -> DataFrame:
        """Adds ``importance`` (probability of the positive class) and ``prediction`` at 0.5."""
        out = self.pipeline.transform(with_terms(df, column))
        return out.withColumn("importance", vector_to_array("probability")[1]).withColumn(
            "prediction", (F.col("importance") > 0.5).cast("int")
        ).select(*df.columns, "importance", "prediction")

    def evaluate(self, df: DataFrame, column: str, label: str) -> DataFrame:
        return evaluation.scores(self.score(df, column), label, "prediction")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "ImportanceModel":
        return cls(PipelineModel.load(path))


def permutation_importance(
    df: DataFrame, key: str, columns: list[str], predict, seed: int = 42
) -> DataFrame:
    """Absolute change of the mean prediction when one column is shuffled, per column.

    ``predict(columns) -> Column`` turns a mapping of column expressions into a prediction.
    Each column gets the values of a random other row: rows are numbered twice, by the order of
    two hashes, and joined on the numbers. All columns are shuffled by the same join, since each
    is looked at alone.
    """
    rows = numbered_by_hash(df.select(key, *columns), key, seed, "_a")
    other = numbered_by_hash(df.select(key, *columns), key, seed + 1, "_b").select(
        F.col("_b"), *[F.col(c).alias(f"_{c}") for c in columns])
    paired = rows.join(other, F.col("_a") == F.col("_b"))
    own = {c: F.col(c) for c in columns}
    measures = [F.avg(predict(own)).alias("_base")]
    for c in columns:
        measures.append(F.avg(predict({**own, c: F.col(f"_{c}")})).alias(f"_m_{c}"))
    means = paired.agg(*measures)
    long = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.abs(F.col(f"_m_{c}") - F.col("_base")).alias("importance"))
        for c in columns])
    return means.select(F.inline(long)).orderBy(F.desc("importance"), "feature")


def linear_probability(weights: dict[str, float], intercept: float):
    """A logistic predictor over named columns, for ``permutation_importance``."""

    def predict(values: dict[str, Column]) -> Column:
        z = F.lit(float(intercept))
        for name, weight in weights.items():
            z = z + values[name].cast("double") * F.lit(float(weight))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    return predict


def train_on_columns(df: DataFrame, columns: list[str], label: str, max_iter: int = 50):
    """Logistic model over numeric columns; returns its weights and intercept by name."""
    assembled = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("label")))
    model = LogisticRegression(maxIter=max_iter, regParam=0.01).fit(assembled.select("features", "label"))
    return dict(zip(columns, [float(w) for w in model.coefficients])), float(model.intercept)
