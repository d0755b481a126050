"""Exact Jaccard join of documents on word n-grams, by a blocked sparse matrix product.

The incidence matrix has a row per document and a column per n-gram. The product of the matrix with
its transpose would hold the overlap of every two documents; only entries that can reach the threshold
are formed:

1. *Columns in order of rarity.* A sketch of fixed size counts all n-grams of all documents (one
   counter may serve several n-grams; that changes the order only, not the result). Each row keeps
   the first n - ceil(t n) + 1 of its columns in that order: two rows that reach Jaccard t share
   one of them whatever the order is. Common passages come last and drop out.
2. *Blocks.* Rows that share a kept column form a block. A block's product is taken between its
   pivots and its other rows; an entry is dropped if the sizes of the two sets, or their places in
   the column order, bound the overlap below what t asks for. So do the sizes of the rows' parts in
   PARTS column ranges: the overlap is at most the sum of the smaller ones. The blocks that stay
   open apply that bound with fewer, wider ranges before a pair is formed.
3. *Overlap counts* of the remaining entries are accumulated over the whole rows, exactly.
4. Entries that reach t link their documents. Blocks whose rows have all become linked are finished;
   the others go on with more pivots, until every two rows of a block are linked or were compared.
   So a group of thousands of near copies costs a few pivots, not all its pairs, and no link is lost.
5. A block with many rows left is split by how they differ from its first row: two rows are as far apart as
   their two differences are, and differences of near copies are short and rare where the rows are long and
   common. Rows within the threshold share one of the first columns of their differences, or both differences
   are so short that the rows are near that first row. The parts go on like blocks.

Documents with the same set are one row of the matrix. Blocks of very frequent columns are cut into
parts, joined again through their pivots. Each round's tables are written to the shared folder.

Words are what lies between ASCII white space, with A-Z lowered. Fewer words than n are one n-gram;
texts without words, and null texts, have none and link with nothing. Rows with a null id get a null
component. Rows that share an id count as linked to each other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.llm.common import small_batches
from logquarry.session import shuffles_dropped, stage

COUNTERS, SLICES, PARTS = 1 << 20, 16, 256
MEMBER_BITS = 1 << 23
WIDE = "wide"  # the sizes of a row's parts in 8 column ranges, a byte each; -1: no bound
WINDOW_BYTES = 1 << 20  # text bytes hashed at once
FEW = 64  # rows left in a block up to which it is not split by differences
HOT = 20_000  # rows of a column beyond which its block is cut into parts
FIRST = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; arithmetic wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTER = mix(np.arange(1, 257, dtype=np.uint64) * FIRST)  # a random number for each byte


def _powers(n: int) -> np.ndarray:
    """FIRST to the power 0 .. n-1, modulo 2^64."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, FIRST)]), dtype=np.uint64)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; ``ends`` are the offsets where one text ends and the next begins."""
    hashes, places, at, powers = [], [], 0, _powers(256)
    while at < len(data):
        to = min(at + WINDOW_BYTES, len(data))
        if to < len(data):  # cut at white space, or where a text begins
            space = np.flatnonzero((data[at:to] == 32) | ((data[at:to] >= 9) & (data[at:to] <= 13)))
            border = ends[np.searchsorted(ends, to, "right") - 1] if len(ends) else 0
            cut = max(at + space[-1] + 1 if len(space) else 0, border)
            while cut <= at and to < len(data):  # one word fills the window: take all of it
                to = min(to + WINDOW_BYTES, len(data))
                space = np.flatnonzero((data[at:to] == 32) | ((data[at:to] >= 9) & (data[at:to] <= 13)))
                border = ends[np.searchsorted(ends, to, "right") - 1] if len(ends) else 0
                cut = max(at + space[0] + 1 if len(space) else 0, border if border <= to else 0)
            to = cut if cut > at else to
        part = data[at:to]
        solid = ~((part == 32) | ((part >= 9) & (part <= 13)))
        begins = np.zeros(len(part) + 1, bool)  # a text begins
        inside = ends[np.searchsorted(ends, at) : np.searchsorted(ends, to, "right")] - at
        begins[inside] = True
        begins[0] = True
        first = solid & (begins[:-1] | ~np.concatenate([[False], solid[:-1]]))
        starts = np.flatnonzero(first)
        if len(starts):
            letters = np.where((part >= 65) & (part <= 90), part + 32, part)
            word = np.cumsum(first) - 1
            place = np.arange(len(part)) - starts[np.maximum(word, 0)]
            place[~solid] = 0
            if place.max() >= len(powers):
                powers = _powers(int(place.max()) * 2)
            values = LETTER[letters] * powers[place]
            values[~solid] = 0
            hashes.append(mix(np.add.reduceat(values, starts)))
            places.append(starts + at)
        at = to
    none = np.zeros(0, np.uint64)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (none, none.astype(np.int64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins and the last one ends."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, offsets = text_bytes(texts)
    words, places = word_hashes(data, offsets)
    borders = np.searchsorted(places, offsets)  # words of text i: borders[i] to borders[i + 1]
    grams = np.zeros(0, np.uint64)
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            grams = mix(grams * SECOND + words[j : len(words) - n + 1 + j])
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64) * FIRST
            for w in words[a:b]:
                whole = mix(whole * SECOND + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _count_columns(rows: DataFrame, n: int) -> np.ndarray:
    """How often the n-grams of each counter occur, over all documents; COUNTERS numbers whatever the input."""

    def counted(batches):
        from pyspark import TaskContext

        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for grams in shingle_sets(batch.column(1), n):
                np.add.at(counts, (grams >> np.uint64(44)).astype(np.int64), 1)
        pid = TaskContext.get().partitionId()
        parts = np.split(counts, SLICES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([pid // 1024] * SLICES, pa.int32()),
             pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "part", "counts"])

    def added(pdf):
        total = np.zeros(COUNTERS // SLICES, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        pdf = pdf.head(1).copy()
        pdf["counts"] = [zlib.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)]
        return pdf

    shape = "slice int, part int, counts binary"
    sums = rows.mapInArrow(counted, shape).groupBy("slice", "part").applyInPandas(added, shape)
    found = sums.groupBy("slice").applyInPandas(added, shape).collect()  # SLICES rows
    counts = np.zeros(COUNTERS, np.uint32)
    for r in found:
        counts[r.slice * (COUNTERS // SLICES) : (r.slice + 1) * (COUNTERS // SLICES)] = np.frombuffer(
            zlib.decompress(r.counts), np.uint32)
    return counts


def _row_sets(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per document the size and a 128-bit hash of its set, and the columns it keeps, rarest first.

    ``fan`` is the number of further parts a kept column's block is cut into.
    """
    counts = _count_columns(rows, n)
    usual = int(counts.mean() * 1.5)
    sent = rows.sparkSession.sparkContext.broadcast(counts)  # 4 MB

    def kept(batches):
        counts = sent.value
        for batch in batches:
            sizes, one, two, keys, fans, parts, wide = [], [], [], [], [], [], []
            for grams in shingle_sets(batch.column(1), n):
                size = len(grams)
                often = counts[(grams >> np.uint64(44)).astype(np.int64)]
                keep = size - -(-num * size // den) + 1 if size else 0
                order = np.lexsort((grams, often))[:keep]
                few = np.bincount((grams & np.uint64(7)).astype(np.int64), minlength=8)
                wide.append(int(few.astype(np.uint8).view(np.int64)[0]) if few.max() < 255 else -1)
                sizes.append(size)
                part = np.bincount((grams & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
                parts.append(part.astype(np.uint8).tobytes() if part.max() < 256 else b"")  # b"": no bound
                one.append(int(mix(grams ^ FIRST).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(grams ^ SECOND).sum(dtype=np.uint64).view(np.int64)))
                keys.append(grams[order].view(np.int64))
                fans.append(np.maximum(0, (often[order].astype(np.int64) - usual) // HOT).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(fans, pa.list_(pa.int32())), pa.array(parts, pa.binary()),
                 pa.array(wide, pa.int64())], names=["doc_id", "n", "h1", "h2", "keys", "fan", "parts", WIDE])

    return rows.mapInArrow(kept, "doc_id long, n long, h1 long, h2 long, keys array<long>, fan array<int>, parts binary, wide long")


def member_words(wanted: DataFrame, column: str) -> DataFrame:
    """A filter of MEMBER_BITS bits of the numbers in ``column``, as (_word, _bits): at most MEMBER_BITS / 64 rows."""
    place = wanted.select(F.pmod(F.xxhash64(column), F.lit(MEMBER_BITS)).alias("h"))
    return place.groupBy(F.call_function("div", F.col("h"), F.lit(64)).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("h") % 64).cast("int"))).alias("_bits"))


def marked(rows: DataFrame, words: DataFrame, column: str) -> DataFrame:
    """``rows`` with the flag ``_member``: false where ``column`` is surely not among the filter's numbers. Rows don't move."""
    h = F.pmod(F.xxhash64(column), F.lit(MEMBER_BITS))
    bit = F.call_function("shiftright", F.col("_bits"), (h % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    flagged = rows.withColumn("_word", F.call_function("div", h, F.lit(64))).join(F.broadcast(words), "_word", "left")
    return flagged.withColumn("_member", F.coalesce(bit == 1, F.lit(False))).drop("_word", "_bits")


def _whole_sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The sets of the documents in ``wanted``; texts don't move, only the sets of what a filter lets pass."""

    def sets(batches):
        for batch in batches:
            found = [g.view(np.int64) for g in shingle_sets(batch.column(1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "grams"])

    named = marked(rows.where("doc_id is not null"), stage(member_words(wanted, "doc_id")), "doc_id")
    asked = named.where("_member").select("doc_id", "text").mapInArrow(sets, "node long, grams array<long>")
    return asked.join(wanted.select(F.col("doc_id").alias("node")), "node", "left_semi")


def _within_bounds(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose parts' sizes leave room for the threshold."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("parts").alias(f"{side}_parts"))

    def bounded(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                keep.append(not len(x) or not len(y) or int(np.minimum(x, y).sum()) * (num + den) >= num * (int(x.sum()) + int(y.sum())))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_parts", "b_parts")
    return joined.mapInArrow(bounded, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of ``links`` (a, b) reaches. Labels spread and jump by rounds."""
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                   .select("node", F.least("node", "b").alias("label")))
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("label").alias("seen"))
        step = stage(labels.join(seen, "node").select("node", F.least("label", "seen").alias("label"),
                                                      F.col("label").alias("old")))
        jumped = stage(step.join(step.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
                       .select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved")))
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels


def _possible(num: int, den: int):
    """Whether sizes and places leave room for Jaccard num/den between (n, pos) and (other_n, other_pos)."""
    n, m = F.col("n"), F.col("other_n")
    most = 1 + F.least("pos", "other_pos") + F.least(n - F.col("pos") - 1, m - F.col("other_pos") - 1)
    most = F.least(most, F.least(n, m) - (n == m).cast("int"))  # copies are one row, so equally large sets differ
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (most * (num + den) >= num * (n + m))


def _wide_enough(num: int, den: int):
    """Whether the sizes of the parts in WIDE leave room for the threshold."""
    room = F.lit(0).cast("long")
    for byte in range(0, 64, 8):
        a, b = (F.shiftrightunsigned(c, byte).bitwiseAND(F.lit(255).cast("long")) for c in (WIDE, f"other_{WIDE}"))
        room = room + F.least(a, b)
    unknown = (F.col(WIDE) == -1) | (F.col(f"other_{WIDE}") == -1)
    return unknown | (room * (num + den) >= num * (F.col("n") + F.col("other_n")))


def _farthest(num: int, den: int):
    """How many columns a row of size n and any other one that reaches the threshold differ in at most."""
    return F.call_function("div", (den - num) * F.col("n"), F.lit(num))


def _close_enough(num: int, den: int):
    """Whether rows whose differences from one row share their column at pos, and none before, may reach the threshold.

    What comes before pos isn't shared, and what follows differs by the difference of its lengths at least.
    """
    n, m = F.col("n"), F.col("other_n")
    apart = F.col("pos") + F.col("other_pos") + F.abs(F.col("after") - F.col("other_after"))
    return apart <= n + m - 2 * F.call_function("div", num * (n + m) + (num + den - 1), F.lit(num + den))


def _by_difference(rows: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Parts in place of the blocks of ``rows`` (key, node, n, pos, ref, ref_n), and the rows too far from ref for them.

    Any two rows of a block that reach the threshold are both in one of the parts or both too far. A part holds the
    rows that have a column among the first of their difference from ref, rarest first, or the rows near ref.
    """
    asked = rows.select("ref", "ref_n", "node", "n").distinct()
    row_sets = sets.select("node", "grams", F.size("grams").cast("long").alias("n"))
    ref_sets = row_sets.select(F.col("node").alias("ref"), F.col("n").alias("ref_n"), F.col("grams").alias("ref_grams"))
    both = asked.join(row_sets, ["node", "n"]).join(ref_sets, ["ref", "ref_n"])
    reach = 4 * F.call_function("div", (den - num) * F.col("ref_n"), F.lit(num))
    diff = F.array_union(F.array_except("grams", "ref_grams"), F.array_except("ref_grams", "grams"))
    apart = both.select("ref", "ref_n", "node", "n", F.xxhash64("ref", "ref_grams").alias("group"), diff.alias("diff")) \
        .withColumn("apart", F.size("diff").cast("long"))
    # those a little beyond reach take part on both sides, as they may be near rows of both
    apart = stage(apart.withColumn("diff", F.when(F.col("apart") <= reach + _farthest(num, den), F.col("diff")))
                  .withColumn("row", F.monotonically_increasing_id()))
    far = rows.join(apart.where(F.col("apart") > reach).select("ref", "ref_n", "node", "n").distinct(), ["ref", "ref_n", "node", "n"])
    close = apart.where("diff is not null").withColumn("most", _farthest(num, den))
    columns = close.select("group", "row", "node", "n", "apart", "most", F.explode("diff").alias("gram"))
    times = columns.groupBy("group", "gram").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(W.partitionBy("row").orderBy("times", "gram")).cast("long") - 1
    placed = columns.join(times, ["group", "gram"]).withColumn("pos", place).where("times > 1 and pos <= most").select(
        F.xxhash64("group", "gram").alias("key"), "node", "n", "pos", (F.col("apart") - F.col("pos") - 1).alias("after"))
    near = close.where("apart <= most").select(
        F.xxhash64("group").alias("key"), "node", "n", F.col("apart").alias("pos"), F.lit(0).cast("long").alias("after"))
    return placed.union(near), far.select("key", "node", "n", "pos", F.lit(None).cast("long").alias("after"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole rows reach the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("a_grams"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("b_grams"))
    overlap = F.size(F.array_intersect("a_grams", "b_grams"))
    return pairs.join(a, "a").join(b, "b").where(
        den * overlap >= num * (F.size("a_grams") + F.size("b_grams") - overlap)).select("a", "b")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of columns node and other."""
    return rows.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a < b").distinct()


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles and component_id; linked where Jaccard >= num / den."""
    with shuffles_dropped(docs.sparkSession):
        return _joined(docs, n, num, den, id_column, text_column)


def _joined(docs: DataFrame, n: int, num: int, den: int, id_column: str, text_column: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sets = stage(_row_sets(rows, n, num, den))
    full = sets.where("n > 0 and doc_id is not null")
    # one row of the matrix per distinct set, named by its smallest document
    copies = stage(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times"))
                   .where("times > 1").drop("times"))
    single = full.join(copies, ["h1", "h2"], "left").where("rep is null or rep = doc_id")
    # smaller sets than that reach the threshold with no other one
    kept = single.where((den - num) * F.col("n") >= num).select(F.col("doc_id").alias("node"), "n", F.posexplode(F.arrays_zip("keys", "fan")).alias("pos", "kept"))
    part = F.pmod(F.xxhash64("node"), F.col("kept.fan") + 1)
    kept = kept.select(
        F.when(F.col("kept.fan") == 0, F.col("kept.keys")).otherwise(F.xxhash64("kept.keys", part)).alias("block"),
        F.when(F.col("kept.fan") > 0, F.col("kept.keys")).alias("cut_key"), "node", "n", "pos")
    # a pivot is the row with the fewest rare columns: in a group of near copies, the one they copy.
    # a row stays if the next smaller or the next larger set of its block may reach the threshold with its own
    by_size = W.partitionBy("block").orderBy("n", "node")
    blocks = kept.select("*", F.min(F.struct("pos", "node", "n")).over(W.partitionBy("block")).alias("pivot"),
                         F.lag("n").over(by_size).alias("smaller"), F.lead("n").over(by_size).alias("larger"))
    fits = (den * F.col("smaller") >= num * F.col("n")) | (den * F.col("n") >= num * F.col("larger"))
    shared = stage(blocks.where(fits | F.col("cut_key").isNotNull()).select(
        F.coalesce("cut_key", "block").alias("key"), "cut_key", "node", "n", "pos",
        F.col("pivot.node").alias("other"), F.col("pivot.n").alias("other_n"), F.col("pivot.pos").alias("other_pos")))
    possible, wide = _possible(num, den), _wide_enough(num, den)
    heads = shared.where("cut_key is not null and node = other").drop("other", "other_n", "other_pos")
    first = F.first(F.struct("node", "n", "pos")).over(W.partitionBy("cut_key").orderBy("pos", "node"))
    heads = heads.withColumn("head", first).select("node", "n", "pos", F.col("head.node").alias("other"),
                                                   F.col("head.n").alias("other_n"), F.col("head.pos").alias("other_pos"))
    narrow = ["node", "n", "pos", "other", "other_n", "other_pos"]
    pairs = _pairs(shared.select(*narrow).union(heads.select(*narrow)).where(possible))
    whole = None  # the sets of all documents that were in a pair

    def with_sets(wanted: DataFrame) -> DataFrame:
        """The sets of the documents in ``wanted`` (doc_id), others left where they lie."""
        nonlocal whole
        wanted = stage(wanted)
        if whole is None:
            whole = stage(_whole_sets(rows, wanted, n))
            return whole
        new = stage(wanted.join(whole.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"))
        if not new.isEmpty():
            whole = whole.union(stage(_whole_sets(rows, new, n)))
        return whole.join(wanted.select(F.col("doc_id").alias("node")), "node", "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stage(_within_bounds(pairs, full, num, den))
        return stage(_verified(pairs, with_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()), num, den))

    links = verified(pairs)
    labels = components(links)
    # pivots of whole blocks have met every row of theirs; the rows that are left need the other pairs
    open_rows, pivots = shared.where("cut_key is not null or node <> other").select(
        "key", "node", "n", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("long").alias("after")), 16
    possible = F.when(F.col("after").isNull(), possible).otherwise(_close_enough(num, den))
    while True:
        named = open_rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # blocks with the same rows are one block: the number of rows and two sums of hashes tell them apart
        mixed = named.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"),
            F.min("pos").alias("least"), F.when(F.count("after") > 0, F.col("key")).alias("part"),
            *[F.sum(F.shiftright(F.xxhash64(F.lit(salt), "node"), 24)).alias(f"sum_{salt}") for salt in (1, 2)]).where("low <> high")
        mixed = mixed.groupBy("rows", "sum_1", "sum_2", "part").agg(F.min("key").alias("key"), F.min("least").alias("least"))
        # in a part, a row as far along as this meets no other one in time
        open_rows = stage(named.join(stage(mixed.select("key", "least")), "key").where(
            F.col("after").isNull() | (F.col("pos") + F.col("least") <= _farthest(num, den))).drop("least"))
        if open_rows.isEmpty():
            break
        named = open_rows.join(full.select(F.col("doc_id").alias("node"), WIDE).dropDuplicates(["node"]), "node")
        ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("pos", "node")))
        ranked = stage(ranked)
        heads = ranked.where(F.col("rank") <= pivots).select(
            "key", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"),
            F.col("after").alias("other_after"), F.col("label").alias("other_label"), F.col("rank").alias("other_rank"),
            F.col(WIDE).alias(f"other_{WIDE}"))
        pairs = _pairs(ranked.join(heads, "key").where((F.col("rank") > F.col("other_rank")) &
                                                       (F.col("label") != F.col("other_label")) & possible & wide))
        found = verified(pairs)
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
        left = ranked.where(F.col("rank") > pivots).select("key", "node", "n", "pos", "after")
        sizes = ranked.groupBy("key").agg(F.max("rank").alias("rows"), F.max("after").alias("part"))
        large = stage(sizes.where((F.col("rows") > pivots + FEW) & F.col("part").isNull()).select("key"))
        if not large.isEmpty():
            refs = ranked.where("rank = 1").join(large, "key").select("key", F.col("node").alias("ref"), F.col("n").alias("ref_n"))
            split = stage(left.drop("after").join(refs, "key"))
            parts, far = _by_difference(split, with_sets(split.select(F.col("node").alias("doc_id")).union(split.select("ref")).distinct()), num, den)
            left = left.join(large, "key", "left_anti").unionByName(parts).unionByName(far)
        open_rows, pivots = left, pivots * 16
    member = sets.select("doc_id", "n", "h1", "h2").join(copies, ["h1", "h2"], "left").withColumn(
        "node", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")))
    out = member.join(labels, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node", "doc_id").alias("component_id"))
    return out
