"""The pipeline's stages, each against brute force on what the stage before kept."""

import re

import numpy as np
import pytest
from compare import TABLES
from test_ngram_join import brute
from test_text_operators import stats
from tokenizers import Tokenizer

import corpus_pipeline
from logquarry.llm import pii
from logquarry.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    docs, found = table(spark, sf, "documents"), []
    for i, (_, apply) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        apply(spark, docs, sf).write.parquet(path)
        found.append((docs, spark.read.parquet(path)))
        docs = found[-1][1]
    return found


def test_columns(spark, sf, outputs):
    assert len(outputs) == len(corpus_pipeline.STAGES)
    for docs, out in outputs[:-1]:
        assert out.columns == docs.columns


def test_rules(outputs):
    docs, out = outputs[0]
    failed = {r.doc_id for r in docs.collect() if (s := stats(r.text or ""))[0] < 20 or 100 * s[4] > 30 * s[0]}
    kept = {r.doc_id for r in out.collect()}
    assert not kept & failed and len(kept) >= 0.95 * (docs.count() - len(failed))


def test_one_document_of_each_group(outputs):
    docs, out = outputs[1]
    groups = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)


def test_no_personal_data(outputs):
    docs, out = outputs[2]
    automaton, before = pii.anchors(), {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        spans = pii.find_spans(before[r.doc_id], automaton)
        assert r.text == pii.redacted(before[r.doc_id], spans) and r.n_chars == len(r.text)
        assert not pii.find_spans(r.text, automaton)


def test_mix_and_tokens(outputs, word_bpe):
    docs, mixed = outputs[3]
    given, counts = {r.doc_id: r for r in docs.collect()}, {}
    for r in mixed.collect():
        assert r == given[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3 and len(counts) < len(given) * 1.0 + 1
    words = lambda ids: sum(len(WORD.findall(given[i].text)) * n for i, n in ids)
    assert abs(words(counts.items()) / words((i, 1) for i in given) - 1) < 0.02
    library = Tokenizer.from_file(word_bpe)
    coded = outputs[4][1].collect()
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed.select("doc_id").collect())
    for r in coded:
        ids = library.encode(given[r.doc_id].text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


def test_odd_and_no_documents(spark, sf, odd_documents, no_documents, tmp_path):
    for number, docs in enumerate((odd_documents.select("doc_id", "text", "lang", "source", "n_chars", "label"), no_documents)):
        for i, (_, apply) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"input{number}-stage{i}")
            apply(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() >= 0


def test_near_duplicate_stage_on_odd_rows(spark, sf, odd_documents):
    rows = corpus_pipeline.near_duplicates(spark, odd_documents, sf).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 3, 4, 6, 8, 9, 10] and sum(r.doc_id is None for r in rows) == 1
    assert TABLES


def test_repeated_ids_and_copies(spark, sf):
    """Rows with a null id and rows without a copy stay, copies go; of rows with one id that are heads the smallest stays."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text + " "), (3, "a text of its own"), (None, text), (None, text), (4, "b"), (4, "c"), (5, None), (6, text.upper())]
    rows += [(i, f"w{i} x{i} y{i} z{i} q{i}") for i in range(10, 300)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, member int").repartition(4)
    found = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    gone = {(2, text + " "), (6, text.upper()), (4, "c")}
    assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(str(r) for r in rows if r not in gone)


def test_texts_without_copies_are_not_shuffled(spark, sf):
    rows = [(i, f"w{i} x{i} y{i} z{i} q{i} " * 50) for i in range(400)] + [(1000, "w1 x1 y1 z1 q1 " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus_pipeline.near_duplicates(spark, docs, sf)._jdf.queryExecution().optimizedPlan()
        joins = [plan.children().apply(i).toString() for i in range(plan.children().size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("Join" not in line or "broadcast" in line for line in joins[0].splitlines()), joins[0]
