"""What Python tasks hold: rows of a common score, chunks of a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logquarry.functions import chunking
from logquarry.functions.vectors import hashing_encoder
from logquarry.operators import search


def test_rows_of_a_common_score_are_not_all_taken_in(monkeypatch):
    taken, keep_best = [], search.keep_best

    def spy(found, id_column, k):
        taken.append(found.num_rows)
        return keep_best(found, id_column, k)

    monkeypatch.setattr(search, "keep_best", spy)
    scorer = search.BatchScorer(np.eye(2), 3, "id", None)
    rng = np.random.default_rng(1)
    ids = rng.permutation(400)
    scores = np.zeros((400, 2))
    scores[ids == 77, 1] = 0.5
    for at in (0, 200):
        part = slice(at, at + 200)
        scorer.keep(pa.table({"id": ids[part]}), np.arange(2), scores[part])
    got = [(r["_query"], r["id"]) for r in scorer.best.to_pylist()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 77), (1, 0), (1, 1)]
    assert max(taken) <= 2 * 2 * 3


def test_ties_keep_a_threshold():
    scorer = search.BatchScorer(np.eye(1), 2, "id", 0.5)
    scorer.keep(pa.table({"id": [4, 3, 2, 1]}), np.arange(1), np.array([[0.5], [0.4], [0.5], [0.4]]))
    assert [r["id"] for r in scorer.best.to_pylist()] == [2, 4]


def test_chunks_are_packed_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PACK_CHARS", 10)
    sizes, array = [], pa.array

    def spy(values, kind):
        if kind == pa.string():
            sizes.append(sum(map(len, values)))
        return array(values, kind)

    monkeypatch.setattr(chunking.pa, "array", spy)
    texts = ["ab cd ef gh", None, "", "x" * 25, "   ", " " * 12, "é ü ß 你好 " * 5]
    got = chunking.chunker(8, 2).func(array(texts, pa.string()))
    want = [[] if t is None else [t] if len(t) <= 8 else
            [p for a, b in chunking.chunk_bounds(t, 8, 2) if (p := t[a:b].strip())] for t in texts]
    assert got.to_pylist() == want
    assert max(sizes) < 10 + 8 and len(sizes) > 5


def test_encoder_of_nulls_repeats_and_empty_batches(spark):
    encode = hashing_encoder(8)
    assert encode.func(pa.array([], pa.string())).to_pylist() == []
    rows = spark.createDataFrame([("disk full",), (None,), ("",), ("disk full",), ("Disk FULL disk",)], "t string")
    got = [r[0] for r in rows.select(encode(F.col("t"))).collect()]
    assert got[0] == got[3] and got[1] == got[2] == [0.0] * 8 and abs(sum(x * x for x in got[4]) - 1) < 1e-12
