"""Top-k similarity of many queries against a large table of vectors.

The queries are few and travel to the tasks in blocks of bounded size; every task scores its
batch of documents with one matrix product and keeps its own k best per query. Only those
rows are shuffled, so neither all pairs nor any whole group is ever materialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.operators.topk import top_per_group
from logquarry.session import small_table

BLOCK_BYTES = 32 << 20
WIDEST = 4096
SCORES = 1 << 22  # similarities a task holds at a time
DIGITS = 6


def dense_rows(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size != len(column) * width:
        raise ValueError(f"vectors must have {width} dimensions")
    return flat.reshape(len(column), width)


def sparse_rows(indices: pa.Array, weights: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(indices), width))
    lengths = pc.list_value_length(indices).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(indices)), lengths)
    out[row, indices.flatten().to_numpy(zero_copy_only=False)] = weights.flatten().to_numpy(zero_copy_only=False)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def keep_best(found: pa.Table, id_column: str, k: int) -> pa.Table:
    order = pc.sort_indices(found, sort_keys=[
        ("_query", "ascending"), ("similarity", "descending"), (id_column, "ascending")])
    found = found.take(order)
    query = found.column("_query").to_numpy()
    first = np.searchsorted(query, query, side="left")
    return found.filter(pa.array(np.arange(len(query)) - first < k))


class BatchScorer:
    """Keeps the k best documents per query over the batches of one task."""

    def __init__(self, queries: np.ndarray, k: int, id_column: str, threshold: float | None):
        self.queries, self.k, self.id_column = queries, k, id_column
        self.floor = np.full(len(queries), -np.inf if threshold is None else threshold)
        self.best: pa.Table | None = None

    def add(self, batch: pa.Table, vectors: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """Score all rows against the chosen queries (all of them by default), as many at a time as SCORES allows."""
        which = np.arange(len(self.queries)) if chosen is None else chosen
        if not batch.num_rows:
            return
        step = max(1, SCORES // batch.num_rows)
        for at in range(0, len(which), step):
            part = which[at: at + step]
            self.keep(batch, part, np.round(vectors @ self.queries[part].T, DIGITS) + 0.0)

    def keep(self, batch: pa.Table, which: np.ndarray, scores: np.ndarray) -> None:
        """Take in the rows' scores (rows, queries) for the queries ``which``."""
        wanted = scores >= self.floor[which]
        if batch.num_rows > self.k:
            # of the rows as good as the k-th only those with the first ids, or a common score would take in the whole batch
            order = pc.sort_indices(batch.column(self.id_column)).to_numpy()
            batch, scores, wanted = batch.take(pa.array(order)), scores[order], wanted[order]
            kth = np.partition(scores, batch.num_rows - self.k, axis=0)[batch.num_rows - self.k]
            above, tied = scores > kth, scores == kth
            room = self.k - above.sum(axis=0)
            wanted &= above | (tied & (np.cumsum(tied, axis=0, dtype=np.int32) <= room))
        row, col = np.nonzero(wanted)
        if not len(row):
            return
        found = batch.take(pa.array(row)).append_column("_query", pa.array(which[col].astype(np.int64)))
        found = found.append_column("similarity", pa.array(scores[row, col]))
        merged = found if self.best is None else pa.concat_tables([self.best, found])
        self.best = keep_best(merged, self.id_column, self.k)
        query = self.best.column("_query").to_numpy()
        score = self.best.column("similarity").to_numpy()
        full = np.bincount(query, minlength=len(self.queries)) >= self.k
        worst = np.full(len(self.queries), -np.inf)
        worst[query] = score  # sorted best first, so the last write is the worst kept
        self.floor = np.where(full, np.maximum(self.floor, worst), self.floor)


def query_blocks(queries: DataFrame, query_id: str, vector: str | tuple[str, str], width: int | None,
                 factors: np.ndarray | float = 1.0):
    """Blocks of (ids, unit matrix), each at most BLOCK_BYTES large."""
    columns = [vector] if isinstance(vector, str) else list(vector)
    asked = queries.select(query_id, *columns)
    most = max(1, BLOCK_BYTES // (8 * (width or WIDEST)))
    first = asked.limit(most + 1).collect()
    # One small job serves the usual case; a longer table is read partition by partition.
    rows = first if len(first) <= most else asked.toLocalIterator()

    def as_row(r):
        if isinstance(vector, str):
            return np.asarray(r[vector], dtype=np.float64)
        row = np.zeros(width)
        row[list(r[columns[0]])] = list(r[columns[1]])
        return row

    rows = iter(rows)
    while block := list(islice(rows, most)):
        yield [r[query_id] for r in block], unit_rows(np.stack([as_row(r) for r in block]) * factors)


def top_by_similarity(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    doc_id: str = "log_id",
    query_id: str = "issue_id",
    vector: str | tuple[str, str] = "embedding",
    width: int | None = None,
    scale: list[float] | None = None,
    threshold: float | None = None,
    carry: tuple[str, ...] = (),
    cell: str | None = None,
    probes=None,
) -> DataFrame:
    """``(query_id, doc_id, *carry, similarity, rank)`` with cosine similarity to six digits.

    ``vector`` names a dense array column, or an (indices, weights) pair with ``width`` places;
    ``scale`` multiplies the places of both sides before vectors are scaled to unit length.
    Equal similarities are ranked by ``doc_id``. More queries than one block holds are scored in
    further passes. ``cell`` and ``probes(matrix) -> bool[query, cell]`` restrict each query to
    the cells it probes (approximate search).
    """
    spark = docs.sparkSession
    columns = [vector] if isinstance(vector, str) else list(vector)
    kept = [doc_id, *[c for c in carry if c != doc_id]]
    source = docs.where(F.col(columns[0]).isNotNull()).select(*kept, *columns, *([cell] if cell else []))
    id_type = queries.schema[query_id].dataType
    out_schema = T.StructType(
        [source.schema[c] for c in kept]
        + [T.StructField("_query", T.LongType()), T.StructField("similarity", T.DoubleType())]
    )
    factors = 1.0 if scale is None else np.asarray(scale)
    passes = []
    for ids, matrix in query_blocks(queries, query_id, vector, width, factors):
        shared = spark.sparkContext.broadcast((matrix, factors, None if probes is None else probes(matrix)))
        dense = isinstance(vector, str)

        def score(batches: Iterator[pa.RecordBatch], shared=shared, dense=dense) -> Iterator[pa.RecordBatch]:
            q, factors, allowed = shared.value
            scorer = BatchScorer(q, k, doc_id, threshold)
            for batch in batches:
                table = pa.Table.from_batches([batch])
                if dense:
                    vectors = dense_rows(batch.column(columns[0]), q.shape[1])
                else:
                    vectors = sparse_rows(batch.column(columns[0]), batch.column(columns[1]), q.shape[1])
                vectors = unit_rows(vectors * factors)
                payload = table.select(kept)
                if allowed is None:
                    scorer.add(payload, vectors)
                    continue
                cells = batch.column(cell).to_numpy(zero_copy_only=False)
                for c in np.unique(cells):
                    rows = np.nonzero(cells == c)[0]
                    scorer.add(payload.take(pa.array(rows)), vectors[rows], np.nonzero(allowed[:, c])[0])
            if scorer.best is not None:
                yield from scorer.best.combine_chunks().to_batches()

        found = source.mapInArrow(score, out_schema)
        names = small_table(spark, list(enumerate(ids)), f"_query long, `{query_id}` {id_type.simpleString()}")
        passes.append(found.join(names, "_query").drop("_query"))
    if not passes:
        shape = T.StructType([T.StructField(query_id, id_type), *out_schema.fields[:-2],
                              T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], shape)
    hits = reduce(DataFrame.unionByName, passes)
    ranked = top_per_group(hits, [query_id], [F.desc("similarity"), F.col(doc_id)], k)
    return ranked.select(query_id, *kept, "similarity", "rank")
