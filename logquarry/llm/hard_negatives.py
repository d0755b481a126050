"""Hard negatives by exact scores from subset-sum tables (the method of the four Russians).

Components become the integers floor(scale * x). Candidates are packed into bit planes: for every bit of the
two's complement and every group of eight dimensions, one byte holds that bit of the eight components. For an
anchor, a table of 256 sums per group says what any such byte adds to the inner product, so a plane's share is one
lookup per group, and planes are joined by shifts and adds from the sign plane down. Scores are exact integers.

Candidates and anchors are packed into blocks of bounded size. Blocks of candidates form cells, every block of
anchors goes to every cell once, and the pair of an anchor block and a candidate block is one row of work: the anchors
are the stated query set, and no pair of vectors is ever a row. Whether anchors travel by broadcast is up to
Spark's own size check. A task keeps, per anchor, the few best rows of what it has seen; only these are shuffled.

Two passes are made. The first scores an anchor against rows of its own label and finds its positives; the second
scores rows of other labels and keeps, for each positive's score p, the best within [low % of p, high % of p].

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as
filled up with zeros; an empty one scores 0. Other rows are those with another id: rows that repeat an id are
candidates each by itself, never positives of their own id, and each repeated anchor row gives its own result rows.
A table without anchors gives an empty result. Inner products that might leave 55 bits are refused with an error.
Only the three named columns are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import small_batches
from logquarry.operators.topk import top_per_group
from logquarry.session import stage

GROUP = 8  # dimensions that share a table of 256 sums
BLOCK = 4_096  # candidates of a packed block
ANCHORS = 512  # anchors of a packed block
CELL = 64  # candidate blocks that meet the anchors under one join key
TILE = 1_024  # candidates, and
WIDE = 128  # anchors, scored at a time, so that tables and sums stay in the processor's cache
MOST_BITS = 55
NONE = -(1 << 62)

PACKED = "_ids binary, _labels binary, _planes binary, _n int"
PACKED_ANCHORS = "_keys binary, _anchor_ids binary, _anchor_labels binary, _vectors binary, _bounds binary, _a int"


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, label: Column, scale: int) -> DataFrame:
    """``(_id, _label, _x)`` of the rows that take part, components as integers."""
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), label.cast("long").alias("_label"),
                          F.col(vector_column).cast("array<double>").alias("_v"))
    kept = rows.where("_id is not null and _label is not null and _v is not null").where(finite)
    return kept.select("_id", "_label", F.transform("_v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("_x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (bits, groups, rows) of the two's complement of ``x`` (rows, groups * 8), lowest plane first."""
    planes = [np.packbits(((x >> b) & 1).astype(np.uint8).reshape(len(x), -1, GROUP), axis=2, bitorder="little")[:, :, 0].T for b in range(bits)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """Tables (groups, 256, anchors): for every byte the sum of the components whose bits it has."""
    groups = anchors.shape[1] // GROUP
    parts = anchors.reshape(len(anchors), groups, GROUP).astype(dtype)
    out = np.zeros((groups, 1 << GROUP, len(anchors)), dtype=dtype)
    for i in range(GROUP):
        out[:, 1 << i: 2 << i] = out[:, : 1 << i] + parts[:, :, i].T[:, None, :]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) from tables (groups, 256, anchors) and planes (bits, groups, rows)."""
    bits, groups, rows = planes.shape
    out = np.zeros((rows, tables.shape[2]), dtype=tables.dtype)
    found = np.empty_like(out)
    for b in range(bits - 1, -1, -1):
        out <<= 1
        for g in range(groups):
            np.take(tables[g], planes[b, g], axis=0, out=found, mode="clip")
            if b == bits - 1:
                out -= found  # the sign plane
            else:
                out += found
    return out


class Best:
    """The ``k`` best (score, smaller id) rows per query seen so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.last = k, [], 0, {}

    def add(self, block: int, score: np.ndarray, query: np.ndarray, ids: np.ndarray) -> None:
        """``score`` (rows, queries), NONE where a row doesn't count; ``query`` are the queries' numbers, each in one ``block`` only."""
        floor = self.last.get(block, np.full(len(query), NONE, dtype=np.int64))
        if len(score) > self.k:
            floor = np.maximum(floor, np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k])
            self.last[block] = floor
        row, col = np.nonzero((score >= floor) & (score > NONE))
        self.parts.append((query[col], score[row, col].astype(np.int64), ids[row]))
        self.size += len(row)
        if self.size > 1 << 18:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        query, score, ids = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.parts = [(query[kept], score[kept], ids[kept])]
        self.size = int(kept.sum())
        return self.parts[0]


def pack(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """Candidates in packed blocks, those of one label next to each other."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_label"))
                order = np.lexsort((ids, labels))
                planes = bit_planes(matrix(part.column("_x"), width)[order], bits)
                yield pa.RecordBatch.from_pydict({
                    "_ids": [ids[order].tobytes()], "_labels": [labels[order].tobytes()], "_planes": [planes.tobytes()],
                    "_n": pa.array([len(ids)], pa.int32())})

    return rows.mapInArrow(packed, PACKED)


def pack_anchors(rows: DataFrame, width: int) -> DataFrame:
    """Anchors in packed blocks; ``_bounds`` holds up to ``k`` scores of positives each, filled up with NONE."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(at, ANCHORS)
                most = max(1, int(np.diff(part.column("_p").offsets.to_numpy()).max()))
                bounds = np.where(np.arange(most)[None, :] < np.diff(part.column("_p").offsets.to_numpy())[:, None], matrix(part.column("_p"), most), NONE)
                numbers = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("_key", "_id", "_label")]
                yield pa.RecordBatch.from_pydict({
                    "_keys": [numbers[0]], "_anchor_ids": [numbers[1]], "_anchor_labels": [numbers[2]],
                    "_vectors": [matrix(part.column("_x"), width).tobytes()], "_bounds": [bounds.tobytes()],
                    "_a": pa.array([part.num_rows], pa.int32())})

    return rows.mapInArrow(packed, PACKED_ANCHORS)


def met(candidates: DataFrame, anchors: DataFrame, cells: int) -> DataFrame:
    """Every block of candidates with every block of anchors, dealt out by cells of candidates."""
    cell = F.pmod(F.xxhash64("_ids", "_n"), F.lit(cells))
    every = anchors.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")))
    return candidates.withColumn("_cell", cell).join(every, "_cell").drop("_cell")


def unpacked(batch: pa.RecordBatch, width: int):
    """Per row: anchor keys, ids, labels, vectors and bounds; candidate ids, labels and planes."""
    for row in batch.to_pylist():
        keys, own, group = (np.frombuffer(row[c], np.int64) for c in ("_keys", "_anchor_ids", "_anchor_labels"))
        vectors = np.frombuffer(row["_vectors"], np.int64).reshape(row["_a"], width)
        bounds = np.frombuffer(row["_bounds"], np.int64).reshape(row["_a"], -1)
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("_ids", "_labels"))
        planes = np.frombuffer(row["_planes"], np.uint8).reshape(-1, width // GROUP, row["_n"])
        yield keys, own, group, vectors, bounds, ids, labels, planes


def find_positives(pairs: DataFrame, width: int, dtype, k: int) -> DataFrame:
    """``(_key, _score, _other)``: per task the best ``k`` rows of each anchor's own label, other ids only."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for keys, own, group, vectors, _, ids, labels, planes in unpacked(batch, width):
                for label in np.intersect1d(group, labels):
                    lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
                    asked = np.nonzero(group == label)[0]
                    for a in range(0, len(asked), WIDE):
                        mine = asked[a: a + WIDE]
                        tables = subset_sums(vectors[mine], dtype)
                        for t in range(lo, hi, TILE):
                            part = slice(t, min(t + TILE, hi))
                            score = scores(tables, planes[:, :, part]).astype(np.int64)
                            score[ids[part][:, None] == own[mine][None, :]] = NONE
                            best.add(int(keys[mine[0]]), score, keys[mine], ids[part])
        key, score, other = best.settle()
        yield pa.RecordBatch.from_pydict({"_key": key, "_score": score, "_other": other})

    return pairs.mapInArrow(found, "_key long, _score long, _other long")


def find_negatives(pairs: DataFrame, width: int, dtype, k: int, low: int, high: int) -> DataFrame:
    """``(_key, _bound, _score, _other)``: per task the best ``k`` rows of other labels within each bound's window."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for keys, _, group, vectors, bounds, ids, labels, planes in unpacked(batch, width):
                for a in range(0, len(keys), WIDE):
                    mine = slice(a, a + WIDE)
                    tables = subset_sums(vectors[mine], dtype)
                    for t in range(0, len(ids), TILE):
                        part = slice(t, t + TILE)
                        score = scores(tables, planes[:, :, part]).astype(np.int64)
                        score[labels[part][:, None] == group[mine][None, :]] = NONE
                        for place in range(bounds.shape[1]):
                            top = bounds[mine, place]
                            inside = (100 * score >= low * top) & (100 * score <= high * top) & (top > NONE) & (score > NONE)
                            best.setdefault(place, Best(k)).add(int(keys[a]), np.where(inside, score, NONE), keys[mine], ids[part])
        for place, kept in best.items():
            key, score, other = kept.settle()
            yield pa.RecordBatch.from_pydict({"_key": key, "_place": np.full(len(key), place, np.int32), "_score": score, "_other": other})

    return pairs.mapInArrow(found, "_key long, _place int, _score long, _other long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on ``vectors``, as is ``label`` (default: the column of that name).
    """
    small_batches(vectors.sparkSession, BLOCK)
    label = F.col("label") if label is None else label
    named = vectors.select(F.col(id_column).alias("_i"), F.col(vector_column).alias("_v"), label.alias("_l"),
                           F.coalesce(is_anchor, F.lit(False)).alias("_asks"))
    rows = stage(integer_vectors(named, "_i", "_v", F.col("_l"), scale))
    asked = integer_vectors(named.where("_asks"), "_i", "_v", F.col("_l"), scale)
    largest = F.greatest(F.max(F.array_max("_x")), -F.min(F.array_min("_x")) - 1)
    n, longest, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("_x")), largest).first()
    width = max(GROUP, -(-(longest or 0) // GROUP) * GROUP)
    bits = (largest or 0).bit_length() + 1
    needed = 2 * bits + width.bit_length()
    if needed > MOST_BITS:
        raise ValueError(f"inner products of {width} components of {bits} bits may need {needed} bits; at most {MOST_BITS} are exact")
    dtype = np.int32 if needed < 31 else np.int64

    candidates = stage(pack(rows, width, bits))
    cells = max(1, candidates.count() // CELL)
    anchors = stage(asked.withColumn("_key", F.monotonically_increasing_id()))
    blocks = max(1, anchors.count() // ANCHORS)
    bare = stage(pack_anchors(anchors.withColumn("_p", F.array().cast("array<bigint>")).repartition(blocks), width))
    best = top_per_group(find_positives(met(candidates, bare, cells), width, dtype, positives), ["_key"], [F.desc("_score"), F.col("_other")], positives)
    best = stage(best)
    bounds = best.groupBy("_key").agg(F.array_sort(F.collect_set("_score")).alias("_p"))
    asking = stage(pack_anchors(anchors.join(bounds, "_key").repartition(blocks), width))
    near = top_per_group(find_negatives(met(candidates, asking, cells), width, dtype, negatives, low, high), ["_key", "_place"],
                         [F.desc("_score"), F.col("_other")], negatives)
    pairs = best.join(bounds, "_key").join(anchors.select("_key", "_id"), "_key").select(
        "_key", F.col("_id").alias("anchor_id"), F.col("_other").alias("positive_id"), F.col("_score").alias("positive_score"),
        (F.array_position("_p", F.col("_score")) - 1).cast("int").alias("_place"))
    return pairs.join(near, ["_key", "_place"]).select(
        "anchor_id", "positive_id", "rank", F.col("_other").alias("negative_id"), "positive_score", F.col("_score").alias("negative_score"))
