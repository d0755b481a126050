"""The Jaccard join against all pairs."""

import glob
import random
import time
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from logquarry.llm import ngram_join as nj
from logquarry.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(docs, n, num, den):
    sets, holders, overlap = {d: shingles(t, n) for d, t in docs}, defaultdict(list), defaultdict(int)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                overlap[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), o in overlap.items():
        if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def joined(df, n, num, den=100):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(df, n=n, num=num, den=den).collect()}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_documents(spark, sf, n, num):
    docs = table(spark, sf, "documents")
    assert joined(docs, n, num) == brute([(r.doc_id, r.text) for r in docs.collect()], n, num, 100)


@pytest.mark.parametrize("hot", [20_000, 5])
def test_groups_of_near_copies_and_shared_passages(spark, monkeypatch, hot):
    """Copies around a base, chains at the threshold, and unlike texts that share most of their words."""
    monkeypatch.setattr(nj, "HOT", hot)
    random.seed(1)
    word = lambda: f"w{random.randint(0, 5000)}"
    base, passage, texts = [word() for _ in range(60)], [word() for _ in range(55)], []
    for _ in range(60):
        copy = list(base)
        for _ in range(random.randint(0, 3)):
            copy[random.randrange(60)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    for i in range(40):
        texts.append(" ".join(chain))
        chain[random.randrange(60)] = word()
    texts += [" ".join(passage + [word() for _ in range(random.randint(2, 25))]) for _ in range(60)]
    texts += texts[:30]
    docs = [(100 + i, t) for i, t in enumerate(random.sample(texts, len(texts)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for n, num in ((3, 90), (5, 80), (1, 70)):
        assert joined(df, n, num) == brute(docs, n, num, 100)


def near_copies(count, words=150):
    """Copies of one text with two or three words changed, most of them below 90 %, some of them linked, a few short ones."""
    random.seed(2)
    word = lambda: f"w{random.randint(0, 100_000)}"
    base, texts = [word() for _ in range(words)], []
    for i in range(count):
        copy = list(base[: words - i % 3])
        for _ in range(random.choice((2, 2, 3))):
            copy[random.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(base), " ".join(base[: words // 2]), " ".join(base[: words // 2 - 1]), *texts[:9]]
    return list(enumerate(texts))


@pytest.mark.parametrize("few", [64, 0])
def test_blocks_are_split_by_differences(spark, monkeypatch, few):
    """Links stay whole where many rows share rare columns and few of them reach the threshold."""
    monkeypatch.setattr(nj, "FEW", few)
    formed, bounded = [], nj._within_bounds
    monkeypatch.setattr(nj, "_within_bounds", lambda pairs, *rest: formed.append(pairs.count()) or bounded(pairs, *rest))
    docs = near_copies(400)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = joined(df, 3, 90)
    assert found == brute(docs, 3, 90, 100)
    assert len({c for _, c in found.values()}) > 100  # many are linked with nothing
    assert sum(formed[2:]) < 3_000, formed  # of 80,000 pairs
    if not few:
        for n, num in ((1, 85), (2, 100)):
            assert joined(df, n, num) == brute(docs, n, num, 100)


def test_rounds_join_the_sets_they_ask_for(spark, monkeypatch):
    seen, verified = [], nj._verified

    def watched(pairs, sets, *rest):
        asked = pairs.select("a").union(pairs.select("b")).distinct().count()
        seen.append((asked, sets.count()))
        return verified(pairs, sets, *rest)

    monkeypatch.setattr(nj, "_verified", watched)
    docs = near_copies(400)
    assert joined(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90) == brute(docs, 3, 90, 100)
    assert len(seen) > 1 and all(asked == held for asked, held in seen), seen


def test_shuffle_files_go_with_their_query(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    nj.ngram_join(spark.createDataFrame(near_copies(100), "doc_id long, text string").repartition(3), 3, 90)
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before


def test_filter_lets_all_members_pass(spark):
    ids = spark.range(0, 1_000_000, 997)
    words = nj.member_words(ids, "id")
    found = nj.marked(spark.range(1_000_000).union(spark.sql("SELECT CAST(NULL AS LONG)")), words, "id").where("_member")
    assert found.join(ids, "id").count() == ids.count()
    assert found.count() < 2 * ids.count()


def test_odd_documents(odd_documents, no_documents):
    rows = nj.ngram_join(odd_documents, n=3, num=90).collect()
    assert len(rows) == odd_documents.count()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[4][1] == found[5][1] == 4 and found[6] == (5, 6) and found[7] == (5, 6)
    assert found[None] == (3, None)
    assert nj.ngram_join(no_documents).count() == 0


def test_windows_of_bytes_do_not_matter(monkeypatch):
    texts = pa.array(["zz", "A b C d", "", " \n", "x" * 500, "é " * 300, "one two  three", "p", "q r"])[1:]
    whole = nj.shingle_sets(texts, 3)
    assert [len(g) for g in whole] == [len(shingles(t.as_py(), 3)) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(nj, "WINDOW_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(nj.shingle_sets(texts, 3), whole))
