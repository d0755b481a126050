"""BPE encoding and decoding through a minimal acyclic lexicon.

The words that are frequent in the corpus are compiled, with their ids, into a minimal acyclic
automaton (equal suffixes share states). Every arc carries the number of words that sort before
it, so the sum along a path is the word's ordinal, and the ordinal gives its ids. The compiled
lexicon is one file: tasks map it into memory, so the Python workers of a machine share its pages.
Words it lacks are merged exactly, lowest rank first, leftmost first. The lexicon changes the speed
only; ids are the same with any lexicon, or none.

The tokenizer is of the ``tokenizers`` library's word-end kind: NFC, white space dropped, lower case,
byte-level letters, a mark on each word's last letter. Null texts count as empty; ids without a
token and tables without rows are fine; rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

import heapq
import json
import mmap
import struct
import unicodedata
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import process_store, small_batches
from logquarry.session import scratch_path, stage

END = "</w>"
NEVER = 1 << 40  # the rank of two symbols that no rule merges
LAST = b"\xff"  # ends every word of the automaton
UNICODE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merger:
    """The tokenizer's rules, read from its file; ``word_ids`` is exact for any word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.known: set[str] = set()  # letters that Python's Unicode tables have
        self.path, self.library, self.byte_of = path, None, {c: b for b, c in enumerate(letters)}
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + END) for c in letters]
        self.merges, self.merged = {}, []  # two symbols to their rank, a rank to what they become
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.specials.items()]}
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{UNICODE_SPACE}\p{{L}}\p{{N}}]+")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            if not self.known.issuperset(text):
                if any(unicodedata.category(c) == "Cn" for c in text):
                    return self._newer_words(text)
                self.known.update(text)
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # letter by letter: no final form
        return self.word.findall(text.lower())

    def _newer_words(self, text: str) -> list[str]:
        """Where letters are newer than Python's Unicode tables, the library itself cuts the text."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode("utf-8", "surrogatepass") for p, _ in parts]

    def parts(self, unit: str) -> list[str | int]:
        """The words of a text, and the ids of its special tokens."""
        if unit.isascii() and unit.isalpha():
            return [unit.lower()]
        parts, at = [], 0
        if "<" in unit:
            for m in self.special.finditer(unit):
                parts += [*self.words(unit[at : m.start()]), self.specials[m.group()]]
                at = m.end()
        return parts + self.words(unit[at:])

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        symbols = [s for s in symbols if s is not None]
        n, rank_of, merged = len(symbols), self.merges.get, self.merged
        if n < 2:
            return symbols
        if n <= 24:  # ranks[i]: of symbols i and i + 1; a merge changes those beside it only
            ranks = list(map(rank_of, zip(symbols, symbols[1:]), repeat(NEVER)))
            while ranks and (best := min(ranks)) != NEVER:
                at = ranks.index(best)
                symbols[at : at + 2] = [merged[best]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank_of((symbols[at - 1], symbols[at]), NEVER)
                if at < len(ranks):
                    ranks[at] = rank_of((symbols[at], symbols[at + 1]), NEVER)
            return symbols
        after, before, queue = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (rank := rank_of((symbols[i], symbols[after[i]]))) is not None:
                heapq.heappush(queue, (rank, i))

        for i in range(n - 1):
            offer(i)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j < 0 or rank_of((symbols[i], symbols[j])) != rank:
                continue
            symbols[i], symbols[j], after[i] = merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]


# ---- the automaton ---------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes padded with zeros, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=1))
    packed = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
    return packed.reshape(len(words), width), lengths


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file: an int64 header (arcs, words, ids, root), arc keys, targets, skips, id offsets; the ids as uint32.

    Built from the sorted words level by level, longest prefixes first: prefixes with the same
    continuations get one state, which makes the automaton minimal. Words end with a byte that no
    UTF-8 text holds, so no word is a prefix of another.
    """
    names = sorted(w + LAST for w in entries)
    ids = [entries[w[:-1]] for w in names]
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    flat = np.asarray([i for x in ids for i in x], "<u4")
    keys, targets, skips, root = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    if names:
        letters, lengths = _matrix(names)
        n, depth = letters.shape
        fresh = np.zeros(n, bool)
        fresh[0] = True
        starts = [fresh]  # starts[d]: rows that begin a new prefix of length d
        for d in range(depth):
            fresh = fresh.copy()
            fresh[1:] |= letters[1:, d] != letters[:-1, d]
            starts.append(fresh)
        state_of: dict[tuple[int, int], int] = {}
        below = np.zeros(0, np.int64)
        for d in range(depth, -1, -1):
            node, first_row = np.cumsum(starts[d]) - 1, np.flatnonzero(starts[d])
            live = lengths[first_row] >= d
            one, two = np.ones(len(first_row), np.uint64), np.ones(len(first_row), np.uint64)
            if d < depth:
                rows = np.flatnonzero(starts[d + 1] & (lengths > d))
                parent, label = node[rows], letters[rows, d].astype(np.int64)
                target = below[(np.cumsum(starts[d + 1]) - 1)[rows]]
                mixed = _mix((target * 256 + label + 1).astype(np.uint64))
                np.add.at(one, parent, mixed)
                np.add.at(two, parent, _mix(mixed ^ np.uint64(0xA0761D6478BD642F)))
            state, new = np.full(len(first_row), -1, np.int64), np.zeros(len(first_row), bool)
            for at, pair in zip(np.flatnonzero(live).tolist(), zip(one[live].tolist(), two[live].tolist())):
                new[at] = pair not in state_of
                state[at] = state_of.setdefault(pair, len(state_of))
            if d < depth:
                keep = new[parent]
                keys.append((state[parent] * 256 + label)[keep])
                targets.append(target[keep])
                skips.append((rows - first_row[parent])[keep])
            below = state
        root = int(below[0])
    key, target, skip = np.concatenate(keys), np.concatenate(targets), np.concatenate(skips)
    order = np.argsort(key)
    header = np.asarray([len(key), len(names), len(flat), root], np.int64)
    return b"".join(x.tobytes() for x in (header, key[order], target[order], skip[order], offsets, flat))


class Lexicon:
    """A compiled lexicon in memory-mapped pages (or any buffer); ``find`` walks many words at once."""

    def __init__(self, buffer):
        arcs, self.size, _, self.root = np.frombuffer(buffer, np.int64, 4).tolist()
        at, parts = 32, []
        for length in (arcs, arcs, arcs, self.size + 1):
            parts.append(np.frombuffer(buffer, np.int64, length, at))
            at += 8 * length
        self.key, self.target, self.skip, self.offsets = parts
        self.buffer, self.ids_at = buffer, at

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 for those the lexicon lacks."""
        ordinal = np.full(len(words), -1, np.int64)
        if not words or not self.size:
            return ordinal
        letters, lengths = _matrix([w + LAST for w in words])
        total, state = np.zeros(len(words), np.int64), np.full(len(words), self.root, np.int64)
        alive = np.arange(len(words))
        for d in range(letters.shape[1]):
            wanted = state[alive] * 256 + letters[alive, d]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[at] == wanted
            alive, at = alive[hit], at[hit]
            state[alive] = self.target[at]
            total[alive] += self.skip[at]
            ended = lengths[alive] == d + 1
            ordinal[alive[ended]] = total[alive[ended]]
            alive = alive[~ended]
            if not len(alive):
                break
        return ordinal

    def ids(self, ordinals: np.ndarray) -> list[bytes]:
        """The ids of each ordinal as uint32, little-endian."""
        starts = (self.offsets[ordinals] * 4 + self.ids_at).tolist()
        ends = (self.offsets[ordinals + 1] * 4 + self.ids_at).tolist()
        return [self.buffer[a:b] for a, b in zip(starts, ends)]


# ---- on Spark --------------------------------------------------------------------------------


PIECE = 4 << 20  # bytes of a lexicon's file that pass through the driver at once


def frequent_words(docs: DataFrame, tokenizer_path: str, size: int, text_column: str = "text",
                   longest: int = 40) -> DataFrame:
    """At most ``size`` words (word) of up to ``longest`` bytes, the most frequent over all documents; equal counts stay together."""
    small_batches(docs.sparkSession)

    def counted(batches):
        rules, units = Merger(tokenizer_path), Counter()

        def rows():
            found = Counter()
            for unit, n in units.items():
                for word in rules.parts(unit):
                    found[word] += n
            units.clear()
            kept = [(w, n) for w, n in found.items() if isinstance(w, str) and len(w.encode("utf-8", "surrogatepass")) <= longest]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()),
                                               pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                units.update(text.split(" "))
            if len(units) > 200_000:
                yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counts = stage(texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # counts by steps of a sixteenth of a doubling, some hundred rows, tell which count leaves at most ``size`` words
    step = F.floor(F.log2("n") * 16)
    least, total = None, 0
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > size:
            break
        least = row.step
    return counts.where(step >= least if least is not None else F.lit(False)).select("word")


def publish_lexicon(spark: SparkSession, words: DataFrame, tokenizer_path: str) -> str:
    """Compile the words, put the file into the shared folder and have Spark hand it to every executor.

    A task compiles them (they are bounded in number), the driver holds PIECE bytes of the file at a time.
    Returns its name for ``SparkFiles``; executors that start later fetch it too.
    """

    def compiled(batches):
        rules = Merger(tokenizer_path)
        content = compile_lexicon({w.encode(): rules.word_ids(w) for batch in batches for w in batch.column(0).to_pylist()})
        for at in range(0, len(content), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([content[at : at + PIECE]], pa.binary())],
                                             names=["at", "piece"])

    pieces = stage(words.repartition(1).mapInArrow(compiled, "at long, piece binary"))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "lexicon"), name)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        starts = sorted(r.at for r in pieces.select("at").collect())
        for at in starts:
            out.write(bytearray(pieces.where(F.col("at") == at).first().piece))
        if not starts:  # no task ran
            out.write(bytearray(compile_lexicon({})))
    finally:
        out.close()
    spark.sparkContext.addFile(target.toString())
    return name


UNIT_BYTES = 160  # what a cached unit takes besides its letters and ids


class WordEncoder:
    """Texts to ids: space-separated units are cached, new words go through the lexicon.

    The cache holds at most ``cache_bytes`` in two generations: a full young one becomes the old one, and what is
    asked for again moves back, so frequent units stay. The worker keeps it for later tasks.
    """

    def __init__(self, tokenizer_path: str, lexicon: Lexicon, key: str, cache_bytes: int = 128 << 20):
        self.store = process_store("lexicon units")
        if self.store.get("key") != key:
            self.store.clear()
            self.store.update(key=key, rules=Merger(tokenizer_path), lexicon=lexicon, young={}, old={}, used=0)
        self.rules, self.lexicon = self.store["rules"], self.store["lexicon"]
        self.cache_bytes = cache_bytes

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        rules = self.rules
        parsed = list(map(rules.parts, units))
        names = list(set().union(*parsed))
        words = [w for w in names if isinstance(w, str)]
        ordinals = self.lexicon.find([w.encode("utf-8", "surrogatepass") for w in words])
        listed = ordinals >= 0
        ids = {w: struct.pack("<I", w) for w in names if not isinstance(w, str)}
        ids.update(zip((w for w, hit in zip(words, listed.tolist()) if hit), self.lexicon.ids(ordinals[listed])))
        for w, hit in zip(words, listed.tolist()):
            if not hit:
                own = rules.word_ids(w)
                ids[w] = struct.pack(f"<{len(own)}I", *own)
        return {unit: ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts)) for unit, parts in zip(units, parsed)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        store = self.store
        if store["used"] > self.cache_bytes // 2:
            store.update(old=store["young"], young={}, used=0)
        young, old = store["young"], store["old"]
        split = [text.split(" ") for text in texts]
        seen = set().union(*split) if split else set()
        unseen = []
        for unit in seen.difference(young):
            ids = old.get(unit)
            if ids is None:
                unseen.append(unit)
            else:
                young[unit] = ids
                store["used"] += UNIT_BYTES + len(unit) + len(ids)
        for at in range(0, len(unseen), 20_000):
            new = self._learn(unseen[at : at + 20_000])
            store["used"] += sum(map(len, new)) + sum(map(len, new.values())) + UNIT_BYTES * len(new)
            young.update(new)
        out = [b"".join(map(young.__getitem__, parts)) for parts in split]
        for unit in unseen:
            if len(unit) > 64:  # long ones aren't kept
                store["used"] -= UNIT_BYTES + len(unit) + len(young.pop(unit))
        return out


class TokenDecoder:
    """Ids to the text of their tokens, with a space between them."""

    def __init__(self, tokens: dict[int, str]):
        self.known = np.zeros(max(tokens) + 2, bool)  # the last one stands for all ids beyond
        self.known[list(tokens)] = True
        self.token = pa.array([tokens.get(i) for i in range(len(self.known))], pa.string())

    def __call__(self, raws: list[bytes | None]) -> pa.Array:
        """The text of each row's ids (uint32, little-endian); those without a token are left out."""
        parts = [np.frombuffer(raw or b"", "<u4") for raw in raws]
        ids = np.concatenate([np.zeros(0, "<u4"), *parts])
        ends = np.cumsum([0, *map(len, parts)])
        known = self.known[np.minimum(ids, len(self.known) - 1)]
        if not known.all():
            ends = np.concatenate([[0], np.cumsum(known)])[ends]
            ids = ids[known]
        rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.token.take(pa.array(ids)))
        return pc.binary_join(rows, " ")


STEP_CHARS = 1 << 22  # characters of texts that are widened at a time


def parts_of(batch: pa.RecordBatch, column: int):
    """The batch in slices of at most STEP_CHARS bytes of text, or single rows beyond that."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_CHARS, side="right"))
        done = max(done, at + 1)
        yield batch.slice(at, done - at)
        at = done


def encode(docs: DataFrame, tokenizer_path: str, lexicon_words: int = 300_000, text_column: str = "text",
           into: str = "ids") -> DataFrame:
    """``docs`` with column ``into``: the text's ids as uint32, little-endian (binary).

    One pass counts words over all documents for the lexicon (``lexicon_words`` of them go through
    the driver), a second one encodes.
    """
    spark = docs.sparkSession
    name = publish_lexicon(spark, frequent_words(docs, tokenizer_path, lexicon_words, text_column), tokenizer_path)
    return encode_with(docs, tokenizer_path, name, text_column, into)


def encode_with(docs: DataFrame, tokenizer_path: str, lexicon: str, text_column: str = "text", into: str = "ids",
                decoded: str | None = None) -> DataFrame:
    """The encoding pass alone, with a published lexicon; ``decoded`` names a column for what the ids decode to."""
    small_batches(docs.sparkSession)
    added = [into, *([decoded] if decoded else [])]
    rest = docs.drop(*added)
    types = [T.StructField(into, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    shape = T.StructType([*rest.schema.fields, *types])
    at = rest.columns.index(text_column)

    def encoded(batches):
        coder = WordEncoder(tokenizer_path, Lexicon.mapped(SparkFiles.get(lexicon)), lexicon)
        back = TokenDecoder(coder.rules.tokens) if decoded else None
        for batch in batches:
            for part in parts_of(batch, at):
                ids = coder([t or "" for t in part.column(at).to_pylist()])
                new = [pa.array(ids, pa.binary()), *([back(ids)] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added])

    return rest.mapInArrow(encoded, shape)


def encode_decode(docs: DataFrame, tokenizer_path: str, lexicon_words: int = 300_000, text_column: str = "text",
                  into: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text's ids and what they decode to, in one pass of one worker a task."""
    name = publish_lexicon(docs.sparkSession, frequent_words(docs, tokenizer_path, lexicon_words, text_column), tokenizer_path)
    return encode_with(docs, tokenizer_path, name, text_column, into, decoded)


def decode(docs: DataFrame, tokenizer_path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with column ``into``: the ids' tokens with a space between them; special tokens stay.

    Ids without a token are left out. The words' end marks stay, as the tokenizer's file names no decoder.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(into)
    shape = T.StructType([*rest.schema.fields, T.StructField(into, T.StringType())])
    at = rest.columns.index(ids_column)

    def decoded(batches):
        back = TokenDecoder(Merger(tokenizer_path).tokens)
        for batch in batches:
            for part in parts_of(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, back(part.column(at).to_pylist())], names=[*part.schema.names, into])

    return rest.mapInArrow(decoded, shape)
