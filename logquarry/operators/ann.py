"""Approximate search over an inverted file of product-quantised vectors.

``VectorIndex.build`` writes the index once. A bounded sample of the unit vectors is fitted: k-means gives the cells,
and for every part of the dimensions a codebook of up to 256 residuals. Drawn queries against the sample tell how many
cells a search has to probe so that nearly all queries find nearly all of their neighbours. Every row is then stored under its cell, with
one byte a part as its code and with its vector. Beside the rows lie the centres, the codebooks, how many rows of
each combination of metadata a cell holds, and a manifest.

``search`` sends queries to the tasks in blocks of bounded size. The cells that some query of a block probes become a
partition filter, so other cells' files are not opened. The first pass reads ids and codes only and keeps, per query,
the best by the codes; the vectors of those alone are read for exact scores. A search with a condition on metadata
opens as many cells as its counts say it needs to reach k rows, and no cell without such a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions.vectors import cosine, norm
from logquarry.operators.search import DIGITS, BatchScorer, dense_rows, query_blocks, top_by_similarity, unit_rows
from logquarry.operators.topk import top_per_group
from logquarry.session import small_table, stage

SAMPLE = 65_536  # rows, about, that cells and codebooks are fitted on
MOST_CELLS = 4_096
CODES = 256
CACHED_SCORES = 1 << 18  # scores of rows and centres formed at once
LEAST_ROWS = 2_048  # rows of a condition that a search has in reach before it stops at the probed cells
QUERIES_AT_ONCE = 256  # whose code tables a task holds


def lloyd(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means on a bounded sample; cells that run empty keep their centre."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        nearest = nearest_cell(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_cell(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; as many rows at a time as keep their scores in the processor's cache."""
    half, turned = (centres**2).sum(axis=1) / 2, np.ascontiguousarray(centres.T)
    out = np.empty(len(vectors), np.int64)
    step = max(1, CACHED_SCORES // len(centres))
    scores = np.empty((min(step, len(vectors)), len(centres)))
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        found = np.matmul(part, turned, out=scores[: len(part)])
        found -= half
        out[at : at + step] = found.argmax(axis=1)
    return out


def fit_codebooks(sample: DataFrame, centres: np.ndarray, parts: int, seed: int) -> list[np.ndarray]:
    """One codebook a part, each fitted in a task of its own on that part of the sample's residuals."""
    width = centres.shape[1]
    cuts = np.array_split(np.arange(width), parts)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = dense_rows(batch.column(0), width)
            rest = vectors - centres[nearest_cell(vectors, centres)]
            yield pa.RecordBatch.from_pydict({
                "part": np.repeat(np.arange(parts, dtype=np.int32), len(rest)),
                "x": pa.array([list(row) for cut in cuts for row in rest[:, cut]], pa.list_(pa.float64()))})

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        book = lloyd(np.stack(group["x"].to_list()), CODES, seed)
        return pd.DataFrame({"part": group["part"].iloc[0], "code": np.arange(len(book)), "x": list(map(list, book))})

    rows = sample.mapInArrow(residuals, "part int, x array<double>").groupBy("part").applyInPandas(
        fitted, "part int, code int, x array<double>")
    books: list[list] = [[] for _ in range(parts)]
    for r in sorted(rows.collect(), key=lambda r: (r.part, r.code)):  # at most parts * 256 rows
        books[r.part].append(r.x)
    return [np.array(book) for book in books]


def cell_order(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per query the cells from the nearest on."""
    return np.argsort(-(matrix @ centres.T - (centres**2).sum(axis=1) / 2), axis=1, kind="stable")


def fit_probe(sample: DataFrame, centres: np.ndarray, seed: int, typical: DataFrame | None = None, queries: int = 256, k: int = 20,
              share: float = 0.95) -> int:
    """Cells to probe so that ``share`` of the queries find ``share`` of their ``k`` nearest rows of the sample.

    ``queries`` of the ``typical`` vectors ask, or else rows of the sample. A sample is thinner than the table, so
    neighbours lie further off in it than they do there.
    """
    width = centres.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest_cell(dense_rows(batch.column("x"), width), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    rows = stage(sample.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(placed, "x array<double>, _row long, cell int"))
    source = rows if typical is None else typical.withColumn("_row", -1 - F.monotonically_increasing_id())
    asked = source.orderBy(F.xxhash64(F.lit(seed), "_row"), "_row").limit(queries).select(F.col("_row").alias("_asks"), "x")
    asked = {r["_asks"]: r.x for r in asked.collect()}  # at most ``queries`` rows
    table = sample.sparkSession.createDataFrame(list(asked.items()), "_asks long, x array<double>")
    order = dict(zip(asked, cell_order(np.array(list(asked.values())), centres)))
    needed: dict[int, list[int]] = {key: [] for key in asked}
    for r in top_by_similarity(rows, table, k + 1, doc_id="_row", query_id="_asks", vector="x", width=width, carry=("cell",)).collect():
        if r["_row"] != r["_asks"]:
            needed[r["_asks"]].append(int(np.flatnonzero(order[r["_asks"]] == r.cell)[0]) + 1)
    per_query = [sorted(n)[int(np.ceil(share * len(n))) - 1] for n in needed.values() if n]
    return sorted(per_query)[int(np.ceil(share * len(per_query))) - 1] if per_query else 1


class VectorIndex:
    """The index stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.about = spark.read.parquet(f"{self.path}/manifest").first()
        centres = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        books = spark.read.parquet(f"{self.path}/codebooks").orderBy("part", "code").collect()
        self.centres = np.array([r.x for r in centres]).reshape(len(centres), -1)
        self.books = [np.array([r.x for r in books if r.part == p]) for p in range(self.about.parts)]

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_column: str = "doc_id", column: str = "embedding", meta: tuple[str, ...] = (),
              carry: tuple[str, ...] = (), cells: int | None = None, parts: int = 16, sample: int = SAMPLE, seed: int = 42,
              typical: DataFrame | None = None) -> "VectorIndex":
        """Fit on about ``sample`` rows and store all rows that have a vector.

        By default there are as many cells as the root of the number of rows, at most MOST_CELLS. ``meta`` names the
        columns that searches may filter by, ``carry`` others that results should have. ``typical`` queries, in the same
        column, should be given where queries are unlike the rows.
        """
        spark = docs.sparkSession
        kept = list(dict.fromkeys([id_column, *meta, *carry]))
        rows = docs.where(F.col(column).isNotNull()).select(*kept, column)
        n = rows.count()
        unit = F.transform(column, lambda x: x.cast("double") / F.nullif(norm(F.col(column)), F.lit(0.0))).alias("x")
        typical = None if typical is None else typical.select(unit).where("x[0] is not null")
        drawn = stage(rows.sample(min(1.0, sample / max(n, 1)), seed).select(unit).where("x[0] is not null"))
        size = drawn.count()
        first = rows.select(F.size(column).alias("width")).first()
        width = first.width if first else 1
        cells = max(1, min(cells or round(n**0.5), MOST_CELLS, size))
        parts = min(parts, width)
        if size:
            model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="x").fit(drawn.select(array_to_vector("x").alias("x")))
            centres = np.stack(model.clusterCenters())
            books, probe = fit_codebooks(drawn, centres, parts, seed), fit_probe(drawn, centres, seed, typical)
        else:
            probe, centres, books = 1, np.zeros((1, width)), [np.zeros((1, len(c))) for c in np.array_split(np.arange(width), parts)]
        cuts = np.array_split(np.arange(width), parts)
        shared = spark.sparkContext.broadcast((centres, books))  # at most MOST_CELLS + 256 vectors

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = shared.value
            for batch in batches:
                vectors = unit_rows(dense_rows(batch.column(column), width))
                cell = nearest_cell(vectors, centres)
                rest = vectors - centres[cell]
                code = np.stack([nearest_cell(rest[:, cut], book) for cut, book in zip(cuts, books)], axis=1).astype(np.uint8)
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(cell.astype(np.int32))],
                                                 names=[*batch.schema.names, "code", "cell"])

        shape = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])
        # files follow cells; a large cell is split into several, small ones share a task
        rows.mapInArrow(placed, shape).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
        stored = spark.read.schema(shape).parquet(f"{path}/rows")
        stored.groupBy("cell", *meta).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
        centre_rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        book_rows = [(p, i, x.tolist()) for p, book in enumerate(books) for i, x in enumerate(book)]
        spark.createDataFrame(centre_rows, "cell int, x array<double>").coalesce(1).write.parquet(f"{path}/centres")
        spark.createDataFrame(book_rows, "part int, code int, x array<double>").coalesce(1).write.parquet(f"{path}/codebooks")
        manifest = [(id_column, column, list(meta), n, size, width, len(centres), parts, probe, shape.json())]
        spark.createDataFrame(manifest, "id_column string, column string, meta array<string>, rows long, sample long, width int, "
                              "cells int, parts int, probe int, shape string").coalesce(1).write.parquet(f"{path}/manifest")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self.about["shape"]))).parquet(f"{self.path}/rows")

    def opened(self, matrix: np.ndarray, k: int, probe: int, where: Column | None) -> np.ndarray:
        """bool[query, cell]: the ``probe`` nearest cells, and further ones until ``k`` rows of the condition are in reach."""
        order = cell_order(matrix, self.centres)
        if where is None:
            counts = np.ones(len(self.centres))
            reached = np.broadcast_to(np.arange(len(self.centres)), order.shape) < probe
        else:
            counts = np.zeros(len(self.centres))
            found = self.spark.read.parquet(f"{self.path}/counts").where(where).groupBy("cell").agg(F.sum("n").alias("n"))
            for r in found.collect():  # a row per cell
                counts[r.cell] = r.n
            held = counts[order]
            before = held.cumsum(axis=1) - held
            # an opened cell counts only if it has such rows: ``probe`` of them at least, more while k is out of reach
            reached = ((held > 0).cumsum(axis=1) <= probe) | (before < k)
        allowed = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(allowed, order, reached, axis=1)
        return allowed & (counts > 0)

    def search(self, queries: DataFrame, k: int, probe: int | None = None, rerank: int | None = 10, where: Column | None = None,
               query_id: str = "issue_id", carry: tuple[str, ...] = ()) -> DataFrame:
        """``(query_id, id, *carry, similarity, rank)``: the best ``k`` rows of the probed cells that satisfy ``where``.

        By default as many cells are probed as the build found necessary. The codes choose ``rerank * k`` rows a query, whose exact
        cosine decides; without ``rerank`` all rows of the probed cells are scored exactly.
        """
        about, spark = self.about, self.spark
        key, column = about.id_column, about.column
        probe = min(probe or about.probe, about.cells)
        passes = []
        for ids, matrix in query_blocks(queries, query_id, column, about.width):
            allowed = self.opened(matrix, max(k * (rerank or 1), LEAST_ROWS), probe, where)
            cells = [int(c) for c in np.nonzero(allowed.any(axis=0))[0]]
            rows = self.rows().where(F.col("cell").isin(cells) if cells else F.lit(False))
            rows = rows if where is None else rows.where(where)
            names = small_table(spark, list(enumerate(ids)), f"_query long, `{query_id}` {queries.schema[query_id].dataType.simpleString()}")
            if rerank is None:
                placed = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], f"_place long, `{column}` array<double>")
                hits = top_by_similarity(rows, placed, k, doc_id=key, query_id="_place", vector=column, width=about.width, carry=carry, cell="cell",
                                         probes=lambda _, allowed=allowed: allowed).drop("rank").withColumnRenamed("_place", "_query")
            else:
                hits = self._by_codes(rows, matrix, allowed, k, rerank, key, column, carry)
            passes.append(hits.join(names, "_query").drop("_query"))
        if not passes:
            empty = queries.select(query_id).where("false").join(self.rows().select(key, *carry).where("false"), F.lit(True))
            return empty.withColumn("similarity", F.lit(0.0)).withColumn("rank", F.lit(0))
        found = reduce(DataFrame.unionByName, passes)
        ranked = top_per_group(found, [query_id], [F.desc("similarity"), F.col(key)], k)
        return ranked.select(query_id, key, *carry, "similarity", "rank")

    def _by_codes(self, rows: DataFrame, matrix: np.ndarray, allowed: np.ndarray, k: int, rerank: int, key: str, column: str,
                  carry: tuple[str, ...]) -> DataFrame:
        spark, parts = self.spark, self.about.parts
        cuts = np.array_split(np.arange(self.about.width), parts)
        shared = spark.sparkContext.broadcast((matrix, allowed, self.centres, self.books))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, allowed, centres, books = shared.value
            scorer = BatchScorer(q, k * rerank, key, None)
            for batch in batches:
                table = pa.Table.from_batches([batch]).select([key, "cell"])
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                for c in np.unique(cell):
                    mine, asked = np.nonzero(cell == c)[0], np.nonzero(allowed[:, c])[0]
                    for at in range(0, len(asked), QUERIES_AT_ONCE):
                        which = asked[at: at + QUERIES_AT_ONCE]
                        scores = np.repeat((q[which] @ centres[c])[None, :], len(mine), axis=0)
                        for p, (cut, book) in enumerate(zip(cuts, books)):
                            scores += (book @ q[which][:, cut].T)[code[mine, p]]
                        scorer.keep(table.take(pa.array(mine)), which, np.round(scores, DIGITS) + 0.0)
            if scorer.best is not None:
                yield from scorer.best.combine_chunks().to_batches()

        shape = T.StructType([rows.schema[key], rows.schema["cell"], T.StructField("_query", T.LongType()), T.StructField("similarity", T.DoubleType())])
        near = rows.select(key, "cell", "code").mapInArrow(scored, shape)
        best = top_per_group(near, ["_query"], [F.desc("similarity"), F.col(key)], k * rerank).select("_query", key, "cell").distinct()
        asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "_query long, _q array<double>")
        exact = rows.select(key, "cell", column, *[c for c in carry if c != key]).join(best, [key, "cell"]).join(asked, "_query")
        scored_rows = exact.withColumn("similarity", F.round(cosine(F.col(column), F.col("_q")), DIGITS))
        return scored_rows.select("_query", key, *[c for c in carry if c != key], "similarity")


def recall(found: DataFrame, exact: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Per query: share of the exact hits that the approximate search also found."""
    hit = found.select(query_id, doc_id, F.lit(1).alias("hit"))
    return exact.join(hit, [query_id, doc_id], "left").groupBy(query_id).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"),
    )


def recall_by_score(found: DataFrame, exact: DataFrame, query_id: str) -> DataFrame:
    """The same where rows tie: a hit counts that is as similar as the last exact one."""
    last = exact.groupBy(query_id).agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("expected"))
    good = found.join(last, query_id).groupBy(query_id).agg(F.count_if(F.col("similarity") >= F.col("least")).alias("found"))
    return last.join(good, query_id, "left").select(
        query_id, "expected", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) / F.col("expected")).alias("recall"))
