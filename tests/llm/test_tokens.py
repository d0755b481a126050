"""Token store and lexicon BPE against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logquarry.llm import lexicon_bpe, token_store
from logquarry.llm.common import table


def odd_texts(n=400):
    random.seed(4)
    alphabet = " \n\t\r  abcdeÀ'ß1²½σΣ<|​　日本😀́\x00\x1c\x85\xa0.,!"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(n)]
    return texts + ["<|startoftext|>x <|endoftext|>y<|endoftext|><|x", " ", "", "don't WE'LL 'S", "a" * 3000, "thth" * 2000,
                    "a" * 100 + " " + "b" * 70 + "  c \n" + "d" * 80 + "\n " + "e" * 90 + " x", "ՠᲉ՘a֌"]


@pytest.mark.parametrize("width", [2, 4])
def test_units_equal_whole_texts(byte_bpe, width):
    texts = odd_texts()
    wanted = Tokenizer.from_file(byte_bpe).encode_batch(texts, add_special_tokens=False)
    encode = token_store.Encoder(byte_bpe, width, cache_units=500)
    for _ in range(2):
        for text, ids, want in zip(texts, encode(texts), wanted):
            assert np.frombuffer(ids, f"<u{width}").tolist() == want.ids, repr(text)


def test_runs_of_letters_go_to_the_model_alone(byte_bpe):
    encode, sent = token_store.Encoder(byte_bpe, 2), []
    library = encode.tokenizer
    encode.units.clear()

    class Watched:
        model = library.model

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encode.tokenizer = Watched()
    text = "Plain words, déjà vu; Ā ɏ unplainwordly 12 x"
    assert np.frombuffer(encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sent and not any(c.isalpha() for t in sent for c in t)


def test_words_equal_the_library(word_bpe):
    texts = odd_texts()
    rules = lexicon_bpe.Merger(word_bpe)
    words = sorted({w.encode() for t in texts for w in rules.words(t)})
    some = lexicon_bpe.Lexicon(lexicon_bpe.compile_lexicon({w: rules.word_ids(w.decode()) for w in words[::2]}))
    ordinals = some.find(words)
    assert (ordinals[::2] >= 0).all() and (ordinals[1::2] < 0).all()
    for key, lexicon in (("half", some), ("none", lexicon_bpe.Lexicon(lexicon_bpe.compile_lexicon({})))):
        encode = lexicon_bpe.WordEncoder(word_bpe, lexicon, key, cache_bytes=50_000)
        wanted = Tokenizer.from_file(word_bpe).encode_batch(texts, add_special_tokens=False)
        for text, ids, want in zip(texts, encode(texts), wanted):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


def test_merging_asks_for_changed_pairs_only(word_bpe):
    rules, asked = lexicon_bpe.Merger(word_bpe), []

    class Counted(dict):
        def get(self, *args):
            asked.append(args[0])
            return super().get(*args)

    rules.merges = Counted(rules.merges)
    words = ["internationalization", "antidisestablishment", "thththththththththththth", "qzxjkvwpqzxjkvwp", "a", "ab"]
    library = Tokenizer.from_file(word_bpe)
    for word in words:
        asked.clear()
        assert rules.word_ids(word) == library.encode(word, add_special_tokens=False).ids
        assert len(asked) <= 3 * len(word)


def test_lexicon_is_compiled_in_a_task(spark, word_bpe, monkeypatch):
    rules = lexicon_bpe.Merger(word_bpe)
    names = ["walking", "talking", "größer", "x"]
    monkeypatch.setattr(lexicon_bpe, "PIECE", 100)  # several pieces
    wanted = lexicon_bpe.compile_lexicon({w.encode(): rules.word_ids(w) for w in names})
    for given, content in ((names, wanted), ([], lexicon_bpe.compile_lexicon({}))):
        words = spark.createDataFrame([(w,) for w in given], "word string")
        with open(SparkFiles.get(lexicon_bpe.publish_lexicon(spark, words, word_bpe)), "rb") as f:
            assert f.read() == content


def test_decoded_rows_leave_unknown_ids_out():
    back = lexicon_bpe.TokenDecoder({0: "a", 2: "b</w>"})
    raws = [np.asarray(x, "<u4").tobytes() for x in ([0, 2, 0], [], [1, 3, 2**32 - 1], [1, 2, 9, 0])]
    assert back([*raws, None]).to_pylist() == ["a b</w> a", "", "", "b</w> a", ""]
    assert back([]).to_pylist() == []


def test_equal_suffixes_share_states():
    words = {w.encode(): [1] for w in ("walking", "talking", "walked", "talked")}
    arcs = np.frombuffer(lexicon_bpe.compile_lexicon(words), np.int64)[0]
    assert arcs == 2 + len("alk") + len("ing") + len("ed") + 1  # w or t, what they share, and the end mark's arc
    found = lexicon_bpe.Lexicon(lexicon_bpe.compile_lexicon(words)).find([b"talk", b"talked", b"", b"walkings", b"walking"])
    assert found.tolist() == [-1, 0, -1, -1, 3]


def test_store_round_trip(spark, odd_documents, byte_bpe, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_tokens(odd_documents, path, byte_bpe, end_id=2, block_bytes=2_000, sample_docs=4)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    given = sorted(((r.doc_id, r.text or "") for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    library, start = Tokenizer.from_file(byte_bpe), 0
    assert len(rows) == len(given)
    for row, (doc_id, text) in zip(rows, given):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)
    few = token_store.lookup(spark, path, [6, 10, 99]).collect()
    assert sorted(r.doc_id for r in few) == [6, 6, 10]
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "dict_hash string, dictionary binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_store.read_tokens(spark, path)


def test_empty_store(spark, no_documents, byte_bpe, tmp_path):
    path = str(tmp_path / "empty")
    token_store.write_tokens(no_documents, path, byte_bpe)
    assert token_store.read_tokens(spark, path).count() == 0


def test_encode_and_decode(odd_documents, no_documents, word_bpe):
    given = odd_documents.withColumn("ids", F.lit(1))
    coded = lexicon_bpe.decode(lexicon_bpe.encode(given, word_bpe), word_bpe)
    assert coded.exceptAll(lexicon_bpe.encode_decode(given, word_bpe)).count() == 0
    library = Tokenizer.from_file(word_bpe)
    rows = coded.collect()
    assert len(rows) == odd_documents.count() and coded.columns[:4] == odd_documents.columns[:4]
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert lexicon_bpe.decode(lexicon_bpe.encode(no_documents, word_bpe), word_bpe).count() == 0


def test_lexicon_does_not_change_ids(spark, sf, word_bpe):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    few, many = (lexicon_bpe.encode(docs, word_bpe, lexicon_words=n).select("doc_id", "ids") for n in (10, 100_000))
    assert few.exceptAll(many).count() == 0


def test_parts_keep_every_row(monkeypatch):
    monkeypatch.setattr(lexicon_bpe, "STEP_CHARS", 10)
    texts = ["", "a" * 30, "b" * 10, None, "cc", "dd" * 4, "e", "f" * 11, ""]
    parts = list(lexicon_bpe.parts_of(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), 0))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(map(len, filter(None, p.column(0).to_pylist()))) <= 10 for p in parts)
