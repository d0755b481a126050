"""Token-id files: one compressed frame per document, a shared zstandard dictionary, offset indexes.

A store is a folder with

* ``dictionary``: one row (dict_hash, dictionary), the zstandard dictionary, trained on serialized
  id arrays of ``sample_docs`` documents (those with the smallest hash of their id; it changes the
  size of the frames only, never their content);
* ``blocks``: one row per block of consecutive documents in ascending id order. ``payload`` is the
  documents' frames end to end, ``doc_ids``, ``offsets`` and ``counts`` are the index, as packed
  little-endian int64. Every block names the hash of the dictionary it needs;
* ``shards``: per shard (one task's blocks) its first id, token count and global token offset.

Blocks are rows of a parquet table because Spark's committer then makes a retried or lost task
harmless on any store; ``lookup`` reads single documents by the index without unpacking the rest.

Ids are serialized little-endian, two bytes each if the tokenizer has at most 65,536 ids.
Null texts count as empty. A null doc_id sorts first; rows with equal ids are kept, ordered by text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.llm.common import process_store, small_batches

BLOCKS = ("shard int, block int, first_doc long, last_doc long, null_ids int, n_docs int, n_tokens long, "
          "start_in_shard long, width int, dict_hash string, doc_ids binary, offsets binary, counts binary, "
          "payload binary")
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
NO_DICTIONARY = "none"
SPACE_LETTER = "Ġ"  # stands for a space in the tokens of byte-level tokenizers
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A run of Latin letters with the space before it, where the pre-tokenizer surely cuts on both sides: an ASCII
#: character that is no letter (or the end) follows; without a space of its own, the text begins, or a digit, a sign other
#: than the apostrophe, or a single line feed comes before.
RUN = re.compile(rf"((?: |\A|(?<=[!-&(-@\[-`{{-~])|(?<=\S\n))[{LETTERS}]++(?=[\t-\r -@\[-`{{-~]|\Z))")
LETTER_RUN = re.compile(f" ?[{LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """What byte-level tokenizers write for a space and the letters beyond ASCII: a character for each UTF-8 byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in [32, *range(0xC0, 0x250)]}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """``tokenizers`` encoding through a bounded cache of units: runs of letters and what lies between them.

    The usual byte-level pre-tokenizer cuts around every such run (RUN), and merges never cross its cuts, so the ids
    of a text are those of its units end to end. Texts that hold an added token, and all texts of tokenizers
    with another pre-tokenizer or a normalizer, are encoded whole.
    """

    def __init__(self, path: str, width: int = 4, cache_units: int = 800_000, long_unit: int = 64):
        from tokenizers import Tokenizer

        store = process_store(f"tokenizer {path} {width}")
        if "tokenizer" not in store:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            made = json.loads(tokenizer.to_str())
            cut = made["pre_tokenizer"] or {}
            plain = (made["normalizer"] is None and made["post_processor"] is None and cut.get("type") == "ByteLevel"
                     and cut.get("use_regex", True) and not cut.get("add_prefix_space", True))
            store.update(tokenizer=tokenizer, units={}, plain=plain,
                         added=[t["content"] for t in made["added_tokens"]])
        self.tokenizer, self.units = store["tokenizer"], store["units"]
        self.plain, self.added = store["plain"], store["added"]
        self.width, self.kind, self.code = width, f"<u{width}", "H" if width == 2 else "I"
        self.cache_units, self.long_unit = cache_units, long_unit

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, self.kind).tobytes() for e in found]

    def _learn(self, units: set[str]) -> None:
        """Take in units. A run of letters is one piece to the pre-tokenizer, so the model alone gives its ids."""
        if len(self.units) + len(units) > self.cache_units:
            self.units.clear()
        model, others = self.tokenizer.model.tokenize, []
        for u in units:
            if self.plain and u.isascii() and u[1:].isalpha() and (u[0] == " " or u[0].isalpha()):
                piece = SPACE_LETTER + u[1:] if u[0] == " " else u
            elif self.plain and LETTER_RUN.fullmatch(u):
                piece = u.translate(BYTE_LETTERS)
            else:
                others.append(u)
                continue
            self.units[u] = array(self.code, [t.id for t in model(piece)]).tobytes()
        for at in range(0, len(others), 2_000):
            part = others[at : at + 2_000]
            self.units.update(zip(part, self._encode(part)))

    def __call__(self, texts: list[str], group: int = 16) -> list[bytes]:
        """The ids of each text, little-endian, ``width`` bytes each.

        A few texts at a time, so that their units are still in the processor's cache when the ids are looked up.
        """
        return [ids for at in range(0, len(texts), group) for ids in self._ids(texts[at : at + group])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        split = [RUN.split(t) if self.plain and not any(a in t for a in self.added) else [t] for t in texts]
        seen = set().union(*split)
        unseen = {u for u in seen.difference(self.units) if len(u) <= self.long_unit}
        if len(self.units) + len(unseen) > self.cache_units:
            unseen = {u for u in seen if len(u) <= self.long_unit}
        if unseen:
            self._learn(unseen)
        get, out = self.units.get, []
        for parts in split:
            try:
                out.append(b"".join(map(get, parts)))
            except TypeError:  # a long unit is no part of the cache
                found = iter(self._encode([u for u in parts if u not in self.units]))
                out.append(b"".join(self.units[u] if u in self.units else next(found) for u in parts))
        return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few ids to train on: their own bytes serve
        return b"".join(samples)[-size:]


def _hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest() if dictionary else NO_DICTIONARY


def _loaded(dictionary: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_column: str = "doc_id",
    text_column: str = "text", level: int = 3, block_bytes: int = 1 << 20, dictionary_bytes: int = 1 << 16,
    sample_docs: int = 500, sample_chars: int = 20_000,
) -> None:
    """Encode every document with the ``tokenizers`` file and write the store at ``path``.

    ``end_id`` is appended to each document. Documents of more than ``sample_chars`` characters
    aren't drawn for the dictionary, so the driver holds sample_docs x sample_chars at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    drawn = (rows.where(F.length("text") <= sample_chars)
             .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs).select("text").collect())
    size = Encoder(tokenizer_path).tokenizer.get_vocab_size()
    width = 2 if size <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
    encode = Encoder(tokenizer_path, width)
    ended = np.asarray([] if end_id is None else [end_id], encode.kind).tobytes()
    dictionary = _dictionary([x + ended for x in encode([r.text for r in drawn])], dictionary_bytes)
    dict_hash = _hash(dictionary)
    shape = spark.createDataFrame([], BLOCKS).schema

    def blocks(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        encode, arrow = Encoder(tokenizer_path, width), to_arrow_schema(shape)
        compress = zstandard.ZstdCompressor(level=level, write_content_size=True, **_loaded(dictionary)).compress
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, held = [], [], [], 0

        def flush():
            nonlocal block, start, ids, counts, frames, held
            known = [i for i in ids if i is not None]
            nulls = len(ids) - len(known)
            n = sum(counts)
            row = (shard, block, known[0] if known else None, known[-1] if known else None, nulls, len(ids), n, start,
                   width, dict_hash, np.asarray([0] * nulls + known, "<i8").tobytes(),
                   np.cumsum([0, *map(len, frames)], dtype="<i8").tobytes(), np.asarray(counts, "<i8").tobytes(),
                   b"".join(frames))
            block, start, ids, counts, frames, held = block + 1, start + n, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, coded in zip(names, encode(texts)):
                coded += ended
                ids.append(doc_id)
                counts.append(len(coded) // width)
                frames.append(compress(coded))
                held += len(frames[-1])
                if held >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(blocks, shape)
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    shards = (spark.read.schema(shape).parquet(f"{path}/blocks").groupBy("shard")
              .agg(F.min("first_doc").alias("first_doc"), F.max("null_ids").alias("null_ids"),
                   F.sum("n_tokens").alias("n_tokens")))
    # one row per shard, so one task may order them; shards with null ids come first
    order = W.orderBy(F.desc(F.col("null_ids") > 0), F.col("first_doc").asc_nulls_first())
    (shards.withColumn("start", F.sum("n_tokens").over(order) - F.col("n_tokens"))
     .coalesce(1).write.parquet(f"{path}/shards"))


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if _hash(dictionary) != row.dict_hash:
        raise ValueError(f"{path}: the dictionary does not have its recorded hash")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    starts = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    return blocks.join(starts, "shard"), row.dict_hash, dictionary


def _unpacked(blocks: DataFrame, dict_hash: str, dictionary: bytes, only: frozenset | None = None) -> DataFrame:
    shape = blocks.sparkSession.createDataFrame([], DOCUMENTS).schema

    def documents(batches):
        unpack = zstandard.ZstdDecompressor(**_loaded(dictionary)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != dict_hash:
                    raise ValueError("a block needs another dictionary")
                names = np.frombuffer(row["doc_ids"], "<i8").tolist()
                names = [None] * row["null_ids"] + names[row["null_ids"]:]
                offsets = np.frombuffer(row["offsets"], "<i8").tolist()
                counts = np.frombuffer(row["counts"], "<i8")
                starts = row["shard_start"] + row["start_in_shard"] + np.cumsum(counts) - counts
                take = [i for i in range(len(names)) if only is None or names[i] in only]
                ids = []
                for i in take:
                    found = unpack(row["payload"][offsets[i] : offsets[i + 1]])
                    ids.append(found if row["width"] == 4 else np.frombuffer(found, "<u2").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in take], pa.int64()), pa.array(starts[take], pa.int64()),
                     pa.array(counts[take], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    columns = ["shard_start", "start_in_shard", "null_ids", "width", "dict_hash", "doc_ids", "offsets", "counts",
               "payload"]
    return blocks.select(*columns).mapInArrow(documents, shape)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (tokens before it), n_tokens, ids (uint32, little-endian)."""
    small_batches(spark)
    return _unpacked(*_open(spark, path))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """A few documents: only blocks whose id range holds one are read, only their frames unpacked."""
    wanted = frozenset(doc_ids)
    blocks, dict_hash, dictionary = _open(spark, path)
    near = F.lit(False)
    for i in sorted(wanted):
        near = near | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
    return _unpacked(blocks.where(near), dict_hash, dictionary, wanted)
