import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.operators import search
from logquarry.operators.ann import VectorIndex, recall
from logquarry.operators.topk import at_least_percentile, exact_percentiles


@pytest.mark.parametrize("accuracy", [1_000, 100_000])
@pytest.mark.parametrize("n", [1, 2, 3, 10, 2001])
def test_percentiles(spark, n, accuracy):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.normal(size=n - n // 3), np.full(n // 3, 0.25)])
    rows = [(int(i % 2), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, v double")
    wanted = {"a": 0.3, "b": 0.5, "c": 0.95}
    got = exact_percentiles(df, "v", wanted, accuracy=accuracy).first()
    for name, q in wanted.items():
        assert got[name] == pytest.approx(np.quantile(values, q), abs=1e-12)
    for row in exact_percentiles(df, "v", wanted, ["k"], accuracy=accuracy).collect():
        part = np.array([v for k, v in rows if k == row.k])
        for name, q in wanted.items():
            assert row[name] == pytest.approx(np.quantile(part, q), abs=1e-12)


def test_percentile_filter_keeps_ties(spark):
    df = spark.createDataFrame([(i, float(min(i, 5))) for i in range(10)], "id long, s double")
    for few in (True, False):
        assert at_least_percentile(df, "s", 0.9, few_values=few).count() == 5


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    docs = rng.normal(size=(800, 16))
    docs[::3] = docs[0]  # a third of all documents are copies
    queries = rng.normal(size=(9, 16))
    queries[4] = 0
    make = lambda m, key: spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{key} long, embedding array<double>")
    return docs, queries, make(docs, "log_id").repartition(7), make(queries, "issue_id")


def brute(docs, queries, k):
    d = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    length = np.linalg.norm(queries, axis=1, keepdims=True)
    q = np.divide(queries, length, out=np.zeros_like(queries), where=length > 0)
    s = np.round(q @ d.T, 6)
    return {(j, int(i)): r + 1 for j in range(len(q)) for r, i in enumerate(np.lexsort((np.arange(len(d)), -s[j]))[:k])}


@pytest.mark.parametrize("block", [1, 10_000_000])
def test_search_equals_brute_force(spark, space, monkeypatch, block):
    docs, queries, d, q = space
    monkeypatch.setattr(search, "BLOCK_BYTES", block * 8 * 16)
    monkeypatch.setattr(search, "WIDEST", 4 * 16)
    rows = search.top_by_similarity(d, q, 30).collect()
    assert {(r.issue_id, r.log_id): r.rank for r in rows} == brute(docs, queries, 30)


def test_threshold_and_no_queries(spark, space):
    _, _, d, q = space
    assert search.top_by_similarity(d, q, 30, threshold=0.9).where("similarity < 0.9").count() == 0
    assert search.top_by_similarity(d, q.where(F.lit(False)), 30).count() == 0


def test_all_cells_probed_is_exact(spark, space, tmp_path):
    docs, queries, d, q = space
    index = VectorIndex.build(d, str(tmp_path / "index"), "log_id", cells=5)
    rows = index.search(q, 10, probe=5, rerank=None).collect()
    assert {(r.issue_id, r.log_id): r.rank for r in rows} == brute(docs, queries, 10)


def test_index_is_stored_and_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    hubs = rng.normal(size=(30, 24))
    rows = [(i, [float(x) for x in hubs[i % 30] + rng.normal(0, 0.3, 24)], "a" if i % 50 else "rare", i) for i in range(6_000)]
    rows += [(6_000 + i, [0.1] * 24, "copy", i) for i in range(3_000)] + [(9_000, None, "a", 1), (9_001, [0.0] * 24, "zero", 1)]
    d = spark.createDataFrame(rows, "log_id long, embedding array<double>, kind string, code int").drop("code").repartition(4)
    path = str(tmp_path / "index")
    VectorIndex.build(d, path, "log_id", meta=("kind",), sample=4_000)
    index = VectorIndex(spark, path)
    assert index.about.rows == 9_001 and index.rows().count() == 9_001
    q = spark.createDataFrame([(i, [float(x) for x in hubs[i]]) for i in range(12)] + [(99, [0.0] * 24)], "issue_id long, embedding array<double>")
    exact = search.top_by_similarity(d, q, 15)
    found = index.search(q, 15, carry=("kind",))
    assert all(r.recall >= 0.9 for r in recall(found, exact, "issue_id", "log_id").where("issue_id < 99").collect())
    plan = index.rows().where("cell in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    rare = index.search(q, 15, probe=1, where=F.col("kind") == "rare", carry=("kind",)).collect()
    assert {r.kind for r in rare} == {"rare"} and len(rare) == 13 * 15
    few = index.search(q, 15, where=F.col("kind") == "zero").collect()
    assert [r.log_id for r in few] == [9_001] * 13
    assert index.search(q, 15, where=F.col("kind") == "none").count() == 0
    assert index.search(q.where("false"), 15).count() == 0


def test_index_of_nothing(spark, space, tmp_path):
    _, _, d, q = space
    index = VectorIndex.build(d.where("false"), str(tmp_path / "index"), "log_id")
    assert index.about.rows == 0 and index.rows().count() == 0


def test_nearest_cells_are_found_in_bounded_memory():
    from logquarry.operators.ann import nearest_cell

    rng = np.random.default_rng(3)
    vectors, centres = rng.normal(size=(20_000, 8)), rng.normal(size=(1_000, 8))
    distances = [((v - centres) ** 2).sum(axis=1) for v in vectors[:500]]
    tracemalloc.start()
    found = nearest_cell(vectors, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # not all 20 million scores at once
    assert found.shape == (20_000,) and found[:500].tolist() == [int(d.argmin()) for d in distances]
    assert nearest_cell(vectors[:0], centres).shape == (0,) and set(nearest_cell(vectors, centres[:1])) == {0}
