"""Entropy balancing: targets by the rule, words taken near them, rates that are the dual's solution."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logquarry.llm import mixing
from logquarry.llm.common import table
from logquarry.llm.queries import QUERIES, WEIGHTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, most=3.0):
    """Per source, by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        more = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not more:
            return out
        capped |= more


def test_query(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op2_mixing"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    sizes, taken, least = defaultdict(int), defaultdict(int), defaultdict(lambda: 1 << 60)
    for d in docs:
        n = len(WORD.findall(d.text or ""))
        assert rows[d.doc_id].size == n and 0 <= rows[d.doc_id].taken <= 3 * n
        sizes[d.source] += n
        taken[d.source] += rows[d.doc_id].taken
        least[d.source] = min(least[d.source], n)
    want = targets(sizes, WEIGHTS)
    for d in docs:
        assert rows[d.doc_id].source_size == sizes[d.source]
        assert rows[d.doc_id].target == pytest.approx(want[d.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(least[s], 0.01 * want[s])
    again = {r.doc_id: r.taken for r in QUERIES["op2_mixing"](spark, sf).collect()}
    assert again == {i: r.taken for i, r in rows.items()}


def test_a_hot_source_and_capped_ones(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "hot" if i % 3 else f"s{i % 11:02}") for i in range(1, 3000)] + [(5000, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed, plan = mixing.plan(df, [1.0, 2.0, 3.0], 3.0)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = targets(sizes, [1.0, 2.0, 3.0])
    taken = defaultdict(int)
    for r in keyed.join(plan, ["_source", "_size"]).withColumn("k", F.expr(mixing.COPIES)).collect():
        source = None if r._source == "~" else r._source[1:]
        assert r.target == pytest.approx(want[source]) and 0 <= r.k <= 3
        taken[source] += r.k * r._size
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)


def test_multipliers_solve_the_dual(spark):
    """The words that the tilted rates give are the targets, and larger multipliers give more."""
    rows = [(s, size, 3 + size % 4) for s in ("=a", "=b") for size in (1, 5, 20, 100, 700)]
    hist = spark.createDataFrame(rows, "_source string, _size long, n long")
    total = sum(size * n for s, size, n in rows if s == "=a")
    count = sum(n for s, _, n in rows if s == "=a")
    for share in (0.02, 0.5, 1.0, 1.7, 2.9):
        sources = spark.createDataFrame([("=a", total, count, share * total), ("=b", total, count, 3.0 * total)],
                                        "_source string, source_size long, documents long, target double")
        state = {r._source: r for r in mixing.multipliers(hist, sources, 3.0).collect()}
        lam, mean = state["=a"]["lambda"], total / count
        got = sum(n * size * min(3.0, 2.718281828459045 ** (lam * size / mean)) for s, size, n in rows if s == "=a")
        assert got == pytest.approx(share * total, rel=1e-6) and state["=b"].full


def test_copies_and_odd_documents(odd_documents, no_documents):
    out = mixing.mix(odd_documents, [1.0, 2.0], 3.0)
    assert out.columns == odd_documents.columns
    keyed, plan = mixing.plan(odd_documents, [1.0, 2.0], 3.0)
    assert out.count() == keyed.join(plan, ["_source", "_size"]).agg(F.sum(F.expr(mixing.COPIES))).first()[0]
    assert out.where("doc_id in (1, 2, 3)").count() == 3
    assert mixing.mix(no_documents, [1.0]).count() == 0
    empty = odd_documents.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(empty, [1.0]).count() == empty.count()
