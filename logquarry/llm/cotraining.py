"""A quality classifier by co-training on two views of a document.

One view is the text's content (hashed words, and shares of capitals, marks, symbols, digits, distinct words),
the other is the page's metadata (source, language, length). Each view has a logistic regression, fitted first on
labelled rows. In every round both score all unlabelled documents, in tasks; what a view, once calibrated, is
confident about joins the training rows of the other view with that label, all of it. A document keeps the label of
the first round in which a view was confident. Counts by source and language set the weights: the documents of a
round that one view hands over with one label in one source and language weigh together at most ``added`` times the
labelled rows' share of that label, and one of them at most as much as a labelled row; if a view's documents of a
round would outweigh the labelled rows together, all their weights shrink by one factor. At the end both views are
calibrated on labelled rows held out from all training, and a regression on the two calibrated log-odds, fitted on
the same rows, combines them. All documents are scored, in tasks.

The labelled part of the fit is at most ``max_labelled`` documents, those with the smallest hashes of their ids; every
fifth one is held out. These are the only rows the driver sees, as the distinct buckets of all their words with
counts, at most BUCKETS a document: models are trained, calibrated and applied on the same features of whole texts.
Unlabelled documents stay in the tasks: each step of their fit (L-BFGS over both views at once) is one pass over their
features that sums the gradient. A document is good if its quality is 1 and it isn't toxic. Rows without a label, or with a null one, are
unlabelled; of several labels of one id the smallest counts. Null texts count as empty. If the labelled rows
lack one of the classes, nothing can be learnt: every score is the share of good ones, or null without any.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import small_batches
from logquarry.llm.ngram_join import text_bytes, word_hashes
from logquarry.session import stage

BUCKETS, FACTS, SHAPES, STRATA = 1 << 17, 1 << 12, 7, 1 << 12
CONFIDENT = 0.97
#: Passes over the unlabelled documents in a round's fit, and the pieces a gradient is summed in.
PASSES, PIECES = 10, 16
ROW = "doc_id long, facts binary, words binary, counts binary, shape binary"


def _views(docs: DataFrame) -> DataFrame:
    """doc_id, facts (hashed metadata) and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fact = lambda name, value: F.pmod(F.xxhash64(F.lit(name), F.coalesce(value, F.lit("-"))), F.lit(FACTS)).cast("int")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array(fact("source", F.col("source").cast("string")), fact("lang", F.col("lang").cast("string")),
                fact("length", F.floor(2 * F.log2(F.length(text) + 1)).cast("string"))).alias("facts"),
        text.alias("text"))


def text_features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each text: the distinct buckets of its words, how many words each has, and SHAPES numbers between 0 and about 1."""
    data, offsets = text_bytes(texts)
    hashes, places = word_hashes(data, offsets)
    borders = np.searchsorted(places, offsets)
    buckets = (hashes >> np.uint64(47)).astype(np.int32)
    kinds = np.zeros(256, np.uint8)
    for k, letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"#*$%&|<>", b"0123456789"), 1):
        kinds[list(letters)] = k
    found, shape = kinds[data], np.zeros((len(texts), SHAPES))
    words, counts = [], []
    for i in range(len(texts)):
        a, b = offsets[i], offsets[i + 1]
        w = buckets[borders[i] : borders[i + 1]]
        distinct, times = np.unique(w, return_counts=True)
        words.append(distinct)
        counts.append(times.astype(np.int32))
        if len(w):
            shape[i, :4] = np.bincount(found[a:b], minlength=5)[1:] / (b - a)
            shape[i, 4] = len(distinct) / len(w)
            shape[i, 5] = min((b - a) / len(w) / 20, 2)
            shape[i, 6] = math.log1p(len(w)) / 10
    return words, counts, shape


class Rows:
    """Sparse rows: row i has at each of its indices that one's count (1 without counts) over the root of all its
    counts, then dense columns."""

    def __init__(self, indices: list[np.ndarray], dense: np.ndarray, columns: int, counts: list[np.ndarray] | None = None):
        self.lengths = np.fromiter(map(len, indices), np.int64, len(indices))
        self.indices = np.concatenate([*indices, np.zeros(0, np.int32)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(indices)), self.lengths)
        self.counts = np.concatenate([*counts, np.zeros(0)]) if counts is not None else np.ones(len(self.row))
        totals = np.bincount(self.row, self.counts, len(indices))
        self.values = self.counts / np.sqrt(np.maximum(totals, 1))[self.row]
        self.dense = np.hstack([dense, np.ones((len(indices), 1))])
        self.columns = columns

    def margin(self, model: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, model[self.indices] * self.values, len(self.lengths)) + self.dense @ model[self.columns :]

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.indices, residual[self.row] * self.values, self.columns)
        return np.concatenate([sparse, self.dense.T @ residual])

    def take(self, rows: np.ndarray) -> Rows:
        ends = np.cumsum(self.lengths)
        parts = [slice(ends[i] - self.lengths[i], ends[i]) for i in rows]
        return Rows([self.indices[p] for p in parts], self.dense[rows, :-1], self.columns, [self.counts[p] for p in parts])


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: Rows, good: np.ndarray, steps: int = 120, decay: float = 1e-5, rate: float = 0.1) -> np.ndarray:
    """Logistic regression by Adam over all rows."""
    model = np.zeros(rows.columns + rows.dense.shape[1])
    first, second = np.zeros_like(model), np.zeros_like(model)
    for t in range(1, steps + 1):
        g = rows.gradient((_chance(rows.margin(model)) - good) / len(good)) + decay * model
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        model = model - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return model


def calibrate(good: np.ndarray, *margins: np.ndarray) -> np.ndarray:
    """Weights of the margins, then the intercept, of a regression of ``good`` on them (Newton steps)."""
    x = np.column_stack([*margins, np.ones(len(good))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _chance(x @ w)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - good) + 1e-3 * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
    return w


def handed(margin: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """1 where a calibrated view is sure of good, 0 where it is of bad, else NaN."""
    p = _chance(curve[0] * margin + curve[1])
    return np.where(p >= CONFIDENT, 1.0, np.where(p <= 1 - CONFIDENT, 0.0, np.nan))


def _taught(views: tuple[Rows, Rows], strata: np.ndarray, history: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the labels that the other one has given the rows (NaN: none), and their weights.

    ``history`` has of each round the models, their curves and the weights by view, label and stratum."""
    out = []
    for other in (1, 0):
        labels, weights = np.full(len(strata), np.nan), np.zeros(len(strata))
        for models, curves, by_stratum in history:
            new = np.where(np.isnan(labels), handed(views[other].margin(models[other]), curves[other]), np.nan)
            rows = np.flatnonzero(~np.isnan(new))
            labels[rows] = new[rows]
            weights[rows] = by_stratum[other][new[rows].astype(int), strata[rows]]
        out.append((labels, weights))
    return out


def _counted(views: tuple[Rows, Rows], strata: np.ndarray, history: list, models: list, curves: list) -> np.ndarray:
    """How many rows each view hands over now and not before, by view, label and stratum."""
    counts = np.zeros((2, 2, STRATA))
    for view, (before, _) in zip((1, 0), _taught(views, strata, history)):
        new = np.where(np.isnan(before), handed(views[view].margin(models[view]), curves[view]), np.nan)
        rows = np.flatnonzero(~np.isnan(new))
        np.add.at(counts[view], (new[rows].astype(int), strata[rows]), 1)
    return counts.ravel()


def _loss(rows: Rows, good: np.ndarray, weights: np.ndarray, model: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted logistic loss and its gradient."""
    m = rows.margin(model)
    return float(weights @ (np.logaddexp(0, m) - good * m)), rows.gradient(weights * (_chance(m) - good))


def _losses(views: tuple[Rows, Rows], strata: np.ndarray, history: list, models: list) -> np.ndarray:
    """Both views' losses over the rows that were handed to them, and the gradients, end to end."""
    parts = []
    for v, m, (labels, weights) in zip(views, models, _taught(views, strata, history)):
        parts.append(_loss(v, np.nan_to_num(labels), weights, m))
    return np.concatenate([[sum(p[0] for p in parts)], *(p[1] for p in parts)])


def descend(objective, x: np.ndarray, passes: int) -> np.ndarray:
    """L-BFGS with at most ``passes`` evaluations; returns the best point seen."""
    value, slope = objective(x)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    reach, used = 1.0, 1
    while used < passes and np.abs(slope).max() > 1e-6:
        step, alphas = slope.copy(), []
        for s, y in reversed(memory):
            alphas.append(s @ step / (s @ y))
            step -= alphas[-1] * y
        step *= memory[-1][0] @ memory[-1][1] / (memory[-1][1] @ memory[-1][1]) if memory else 1 / np.sqrt(slope @ slope)
        for (s, y), a in zip(memory, reversed(alphas)):
            step += (a - y @ step / (s @ y)) * s
        to = x - reach * step
        new, turned = objective(to)
        used += 1
        if new > value - 1e-4 * reach * (slope @ step):
            reach /= 4
            continue
        s, y = to - x, turned - slope
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y)]
        x, value, slope, reach = to, new, turned, 1.0
    return x


def teach(views: tuple[Rows, Rows], good: np.ndarray, held: np.ndarray, rounds: int, added: int, total, passes: int = PASSES):
    """The two models, their calibrations and the combination, from labelled rows (``held``: held out) and a pool.

    ``total(f, *args)`` is the sum of f(views, strata, *args) over the unlabelled rows, wherever they are."""
    train, kept = np.flatnonzero(~held), np.flatnonzero(held)
    share, first = good[train].mean(), [v.take(train) for v in views]
    tests, history, fixed = [v.take(kept) for v in views], [], np.ones(len(train))
    models = [fit(v, good[train]) for v in first]
    curves = [calibrate(good[kept], t.margin(m)) for t, m in zip(tests, models)]
    cut = len(models[0])
    for _ in range(rounds):
        counts = total(_counted, history, models, curves).reshape(2, 2, STRATA)
        if not counts.any():
            break
        weights = np.minimum(1, added * np.array([1 - share, share])[None, :, None] / np.maximum(counts, 1))
        together = (counts * weights).sum((1, 2))
        weights *= np.minimum(1, len(train) / np.maximum(together, 1))[:, None, None]
        history = [*history, (models, curves, weights)]

        def objective(z):
            both = z[:cut], z[cut:]
            sums = total(_losses, history, list(both))
            value, slopes, at = sums[0], [], 1
            own = [_loss(v, good[train], fixed, m) for v, m in zip(first, both)]
            for m, (v, g) in zip(both, own):
                value += v
                slopes.append(g + sums[at : at + len(m)])
                at += len(m)
            value = value / len(train) + 5e-6 * float(z @ z)
            return value, np.concatenate(slopes) / len(train) + 1e-5 * z

        z = descend(objective, np.concatenate(models), passes)
        models = [z[:cut], z[cut:]]
        curves = [calibrate(good[kept], t.margin(m)) for t, m in zip(tests, models)]
    odds = [c[0] * t.margin(m) + c[1] for t, m, c in zip(tests, models, curves)]
    return models, curves, calibrate(good[kept], *odds)


def cotrain(views: tuple[Rows, Rows], good: np.ndarray, held: np.ndarray, rounds: int, added: int):
    """``teach`` with all rows at hand, as one stratum; ``good`` is NaN for the pool."""
    known, pool = np.flatnonzero(~np.isnan(good)), np.flatnonzero(np.isnan(good))
    unlabelled, strata = tuple(v.take(pool) for v in views), np.zeros(len(pool), np.int64)
    return teach(tuple(v.take(known) for v in views), good[known], held[known], rounds, added,
                 lambda f, *args: f(unlabelled, strata, *args))


def _unpacked(batch: pa.RecordBatch) -> tuple[tuple[Rows, Rows], np.ndarray]:
    """The two views of rows with ROW's columns, and their strata."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    shape = np.array(read("shape", np.float64)).reshape(-1, SHAPES)
    facts = np.array(read("facts", np.int32)).reshape(-1, 3).astype(np.int64)
    views = (Rows(read("words", np.int32), shape, BUCKETS, read("counts", np.int32)), Rows(list(facts), np.zeros((len(facts), 0)), FACTS))
    return views, (facts[:, 0] * 31 + facts[:, 1]) % STRATA


def _total(pool: DataFrame):
    """``total`` of ``teach`` over a table with ROW's columns: a task sums its rows, then the pieces of the tasks' sums add up."""
    spread = pool.coalesce(max(1, pool.sparkSession.sparkContext.defaultParallelism))

    def total(f, *args) -> np.ndarray:
        def summed(batches):
            sums = None
            for batch in batches:
                if batch.num_rows:
                    found = f(*_unpacked(batch), *args)
                    sums = found if sums is None else sums + found
            if sums is not None:
                parts = np.array_split(sums, PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
                                                 names=["piece", "sums"])

        def joined(key, rows):
            parts = sorted(rows.column("sums").to_pylist())  # in one order, so that reruns agree
            return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sum(np.frombuffer(x) for x in parts).tobytes()], pa.binary())})

        found = spread.mapInArrow(summed, "piece int, sums binary").groupBy("piece").applyInArrow(joined, "piece int, sums binary").toArrow().sort_by("piece")
        if found.num_rows:
            return np.concatenate([np.frombuffer(x) for x in found.column("sums").to_pylist()])
        lengths = {_counted: 4 * STRATA, _losses: 1 + BUCKETS + SHAPES + 1 + FACTS + 1}
        return np.zeros(lengths[f])

    return total


def score(docs: DataFrame, labels: DataFrame, rounds: int = 2, max_labelled: int = 10_000, added: int = 1_000) -> DataFrame:
    """doc_id, text_score, metadata_score, score and good (score >= 0.5) of every document.

    In each round what a view hands to the other one counts at most as ``added`` documents per source and language.
    """
    small_batches(docs.sparkSession)
    draw = F.xxhash64("doc_id")
    good = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("double"))
    every = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).dropna()
    labelled = every.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(draw, "doc_id").limit(max_labelled)
    chosen = stage(labelled.withColumn("held", F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(5)) == 0))

    def features(batches):
        for batch in batches:
            words, counts, shape = text_features(batch.column(2))
            facts = batch.column(1).to_pylist()
            packed = ([np.array(x, np.int32).tobytes() for x in facts], *([x.tobytes() for x in c] for c in (words, counts, shape)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in packed)],
                                             names=["doc_id", "facts", "words", "counts", "shape"])

    sample = (_views(docs.join(chosen.select("doc_id"), "doc_id", "left_semi")).mapInArrow(features, ROW)
              .join(chosen, "doc_id").toArrow().sort_by("doc_id"))
    y = sample.column("good").to_numpy()
    held = sample.column("held").to_numpy()
    if any(len(set(y[part].tolist())) < 2 for part in (held, ~held)):
        even = F.lit(float(y.mean()) if len(y) else None).cast("double")
        return docs.select("doc_id", even.alias("text_score"), even.alias("metadata_score"), even.alias("score"), (even >= 0.5).alias("good"))
    ids = every.select("doc_id").distinct()
    known, nameless = (_views(docs).where(f"doc_id is {x}null").mapInArrow(features, ROW) for x in ("not ", ""))
    # merged at every size, so that what is shuffled grows with the input
    pool = stage(known.join(ids.hint("merge"), "doc_id", "left_anti").unionByName(nameless).drop("doc_id"))
    views, _ = _unpacked(sample)
    models, curves, both = teach(views, y, held, rounds, added, _total(pool))

    def scored(batches):
        for batch in batches:
            words, counts, shape = text_features(batch.column(2))
            t = curves[0][0] * Rows(words, shape, BUCKETS, counts).margin(models[0]) + curves[0][1]
            facts = [x.values.to_numpy() for x in batch.column(1)]
            m = curves[1][0] * Rows(facts, np.zeros((len(facts), 0)), FACTS).margin(models[1]) + curves[1][1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (_chance(t), _chance(m), _chance(both[0] * t + both[1] * m + both[2])))],
                names=["doc_id", "text_score", "metadata_score", "score"])

    found = _views(docs).mapInArrow(scored, "doc_id long, text_score double, metadata_score double, score double")
    return found.withColumn("good", F.col("score") >= 0.5)
