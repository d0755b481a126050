"""Top-k search by TF-IDF over an inverted index with block maxima.

Lines are packed in blocks in the order they are read. A block holds, term by term, the numbers of its lines that
contain the term, their weights (unit length per line) and the largest of them. What a query can score in a block is at
most the sum of its weights times those maxima, and, as lines have unit length, at most the length of what it shares
with the block's terms.

Queries stay a table. They are packed a few hundred to a row, and every such row meets every block once, in a join
by cells of blocks. A task keeps the k best lines of each query it has seen; they are a floor, and a block is scored for
those queries only whose bound passes the floor, or can tie with it by a smaller id. Within a block only postings of
the query's terms are touched, so lines without such a term are never scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.operators.tfidf import TfidfModel
from logquarry.operators.topk import top_per_group
from logquarry.session import stage

BLOCK = 16_384  # lines
CELL = 64  # blocks, about, that meet the queries under one join key
TOGETHER = 256  # queries, about, that meet a block in one row
KEPT = 1 << 20  # lines that a task keeps for its queries before it hands them on
DIGITS = 6

BLOCKS = "block string, n int, least long, ids binary, terms binary, starts binary, lines binary, weights binary, top binary"


class Asked:
    """A pack of queries with the best ``k`` lines seen so far of each."""

    def __init__(self, pack: list[dict], k: int, threshold: float):
        self.pack, self.k = pack, k
        self.terms = np.concatenate([a["terms"] for a in pack]).astype(np.int64)
        self.weights = np.concatenate([a["weights"] for a in pack]).astype(np.float64)
        self.starts = np.cumsum([0, *[len(a["terms"]) for a in pack[:-1]]])
        self.floor = np.full(len(pack), float(threshold))
        self.last = np.full(len(pack), np.iinfo(np.int64).max)
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(pack)

    def bounds(self, terms: np.ndarray, top: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        held = terms[at] == self.terms
        sums = np.add.reduceat(np.where(held, self.weights * top[at], 0.0), self.starts)
        shared = np.sqrt(np.add.reduceat(np.where(held, self.weights**2, 0.0), self.starts))
        return np.round(np.minimum(sums, shared) + 1e-9, DIGITS)

    def meet(self, block: dict) -> int:
        """Score the block for the queries it can matter to; returns their number."""
        terms, top = np.frombuffer(block["terms"], np.int32), np.frombuffer(block["top"])
        if not len(terms):
            return 0
        bound = self.bounds(terms, top)
        open_ = np.flatnonzero((bound > 0) & ((bound > self.floor) | ((bound == self.floor) & (block["least"] < self.last))))
        ids, starts = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["starts"], np.int64)
        lines, weights = np.frombuffer(block["lines"], np.int32), np.frombuffer(block["weights"])
        for q in open_:
            total, ask = np.zeros(block["n"]), self.pack[q]
            for place, term, weight in zip(np.searchsorted(terms, ask["terms"]), ask["terms"], ask["weights"]):
                if place < len(terms) and terms[place] == term:
                    span = slice(starts[place], starts[place + 1])
                    total[lines[span]] += weight * weights[span]
            total = np.round(total, DIGITS)
            hit = np.flatnonzero((total >= self.floor[q]) & (total > 0))
            line, score = np.concatenate([self.best[q][0], ids[hit]]), np.concatenate([self.best[q][1], total[hit]])
            order = np.lexsort((line, -score))[: self.k]
            self.best[q] = line[order], score[order]
            if len(order) == self.k:
                self.floor[q], self.last[q] = score[order[-1]], line[order[-1]]
        return len(open_)

    def rows(self) -> tuple[list, np.ndarray, np.ndarray]:
        names = [a["q"] for a, (line, _) in zip(self.pack, self.best) for _ in line]
        return names, np.concatenate([b[0] for b in self.best]), np.concatenate([b[1] for b in self.best])


@dataclass
class TermIndex:
    """The blocks of the lines, with the model whose terms they name."""

    model: TfidfModel
    blocks: DataFrame
    size: int
    id_column: str

    @classmethod
    def build(cls, rows: DataFrame, model: TfidfModel, column: str = "message", id_column: str = "log_id",
              block: int = BLOCK) -> "TermIndex":
        """Index all ``rows`` whose id isn't null; written to the shared folder, no shuffle."""
        counted = model.counts(rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("_id"), column), column)
        idf = np.asarray(model.idf or [0.0])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import uuid

            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    part = batch.slice(at, block)
                    lists = part.column("indices")
                    term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                    weight = part.column("counts").flatten().to_numpy(zero_copy_only=False) * idf[term] if len(term) else np.zeros(0)
                    line = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
                    length = np.sqrt(np.bincount(line, weight**2, minlength=part.num_rows))
                    weight = weight / length[line]
                    order = np.argsort(term, kind="stable")
                    term, line, weight = term[order], line[order], weight[order]
                    terms, starts = np.unique(term, return_index=True)
                    top = np.maximum.reduceat(weight, starts) if len(term) else weight
                    ids = part.column("_id").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_pydict({
                        "block": [uuid.uuid4().hex], "n": pa.array([len(ids)], pa.int32()), "least": [int(ids.min())], "ids": [ids.tobytes()],
                        "terms": [terms.astype(np.int32).tobytes()], "starts": [np.append(starts, len(term)).astype(np.int64).tobytes()],
                        "lines": [line.tobytes()], "weights": [weight.tobytes()], "top": [top.tobytes()]})

        blocks = stage(counted.select("_id", "indices", "counts").mapInArrow(packed, BLOCKS))
        return cls(model, blocks, blocks.count(), id_column)

    def queries(self, asked: DataFrame, column: str, query_id: str) -> DataFrame:
        """``(query_id, terms, weights)``, weights of unit length; queries without a known term fall away."""
        vectors = self.model.transform(asked.select(query_id, column), column, "terms", "weights")
        return vectors.select(query_id, "terms", "weights").where(F.size("terms") > 0)

    def search(self, asked: DataFrame, k: int, threshold: float = 0.0, column: str = "description", query_id: str = "issue_id") -> DataFrame:
        """``(query_id, id, similarity, rank)`` of the lines at or above the threshold; ties go to the smaller id."""
        parts, cells = max(1, asked.count() // TOGETHER), max(1, self.size // CELL)
        pack = F.collect_list(F.struct(F.col(query_id).alias("q"), "terms", "weights")).alias("pack")
        packs = self.queries(asked, column, query_id).groupBy(F.pmod(F.xxhash64(query_id), F.lit(parts)).alias("part")).agg(pack)
        every = packs.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")))
        met = self.blocks.withColumn("_cell", F.pmod(F.xxhash64("block"), F.lit(cells))).join(every, "_cell")
        kind = asked.schema[query_id].dataType
        names = [query_id, "_id", "similarity"]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, Asked] = {}

            def handed_on():
                for pack in seen.values():
                    query, line, score = pack.rows()
                    yield pa.RecordBatch.from_arrays([pa.array(query, arrow_kind(kind)), pa.array(line), pa.array(score)], names=names)
                seen.clear()

            for batch in batches:
                block = [n for n in batch.schema.names if n not in ("part", "pack")]
                for i, part in enumerate(batch.column("part").to_pylist()):
                    if part not in seen:
                        if sum(len(p.pack) for p in seen.values()) * k > KEPT:
                            yield from handed_on()
                        seen[part] = Asked(batch.column("pack")[i].as_py(), k, threshold)
                    seen[part].meet({n: batch.column(n)[i].as_py() for n in block})
            yield from handed_on()

        shape = T.StructType([T.StructField(query_id, kind), T.StructField("_id", T.LongType()), T.StructField("similarity", T.DoubleType())])
        found = top_per_group(met.drop("_cell", "block").mapInArrow(scored, shape), [query_id], [F.desc("similarity"), F.col("_id")], k)
        return found.withColumnRenamed("_id", self.id_column)


def arrow_kind(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
