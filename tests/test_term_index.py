import random
from math import sqrt

import pytest
from pyspark.sql import functions as F

from logquarry.operators.term_index import Asked, TermIndex
from logquarry.operators.tfidf import TfidfModel

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda1"]


@pytest.fixture(scope="module")
def lines(spark):
    random.seed(8)
    rows = [(i, " ".join(random.choices(WORDS, weights=[40, 30, 9, 8, 5, 4, 3, 1], k=random.randint(0, 7)))) for i in range(3_000)]
    rows += [(3_000 + i, "alpha beta") for i in range(1_500)]  # a third of all lines are one text
    rows += [(None, "alpha"), (9_000, None), (9_001, ""), (9_002, "unknown words only")]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "log_id long, message string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["alpha beta", "sigma kappa", "lambda1", "omega omega delta", "nothing known", "", None, "alpha", "kappa alpha beta gamma"]
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "issue_id string, description string")


def by_hand(model, rows, queries, k, threshold):
    weight = dict(zip(model.vocabulary, model.idf))

    def vector(text):
        words = [w for w in (text or "").lower().split()]
        x = {}
        for term in [*words, *map(" ".join, zip(words, words[1:]))]:
            if term in weight:
                x[term] = x.get(term, 0) + weight[term]
        length = sqrt(sum(v * v for v in x.values()))
        return {t: v / length for t, v in x.items()}

    lines, out = [(i, vector(t)) for i, t in rows if i is not None], {}
    for q, text in queries:
        asks = vector(text)
        scored = [(-round(sum(v * x.get(t, 0) for t, v in asks.items()), 6), i) for i, x in lines]
        best = sorted(s for s in scored if -s[0] >= threshold and s[0] < 0)[:k]
        out |= {(q, i): (rank, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block,k,threshold", [(64, 5, 0.1), (64, 700, 0.1), (1_000, 20, 0.6), (16_384, 20, 0.0)])
def test_search_equals_brute_force(spark, lines, asked, block, k, threshold):
    rows, df = lines
    model = TfidfModel.fit(df.where("message not like '%words%'"), "message", stop_words=[])
    index = TermIndex.build(df, model, block=block)
    got = {(r.issue_id, r.log_id): (r["rank"], r.similarity) for r in index.search(asked, k, threshold).collect()}
    want = by_hand(model, rows, [tuple(r) for r in asked.collect()], k, threshold)
    assert {key: rank for key, (rank, _) in got.items()} == {key: rank for key, (rank, _) in want.items()}
    assert all(abs(got[key][1] - want[key][1]) < 2e-6 for key in want)


def test_few_blocks_are_scored(spark, lines, asked):
    """Once the first blocks set the floor, most others can't pass it."""
    _, df = lines
    model = TfidfModel.fit(df, "message", stop_words=[])
    index = TermIndex.build(df.repartitionByRange(5, "log_id").sortWithinPartitions("log_id"), model, block=64)
    one = index.queries(asked.where("issue_id = 'q7'"), "description", "issue_id").first()
    pack = Asked([{"q": one.issue_id, "terms": one.terms, "weights": one.weights}], 3, 0.1)
    scored = [pack.meet(b.asDict()) for b in index.blocks.orderBy("least").collect()]
    assert len(scored) > 60 and sum(scored) < 20 and not any(scored[20:])
    assert len(pack.rows()[0]) == 3 and set(pack.rows()[2]) == {1.0}


def test_no_lines_and_no_queries(spark, lines, asked):
    _, df = lines
    model = TfidfModel.fit(df, "message", stop_words=[])
    assert TermIndex.build(df.where("false"), model).search(asked, 5).count() == 0
    assert TermIndex.build(df, model).search(asked.where("false"), 5).count() == 0
    assert TermIndex.build(df, TfidfModel([], [])).search(asked, 5).count() == 0
    many = spark.range(1_500).select(F.col("id").alias("issue_id"), F.lit("sigma kappa").alias("description"))
    assert TermIndex.build(df, model).search(many, 3).count() == 4_500
