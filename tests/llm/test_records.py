"""WARC revisits, chat repair and the classifier."""

import random
import re
from datetime import datetime, timedelta
from functools import lru_cache

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from logquarry.llm import chat, cotraining, warc
from logquarry.llm.common import table
from logquarry.llm.queries import CHECKS, QUERIES

RECORD = "record_id long, kind string, url string, time timestamp, digest string, headers array<struct<name:string,value:string>>"
T0 = datetime(2024, 1, 1)


def test_warc_query(spark, sf):
    ok, rows, _, note = compare(spark, duck(sf), "op6_warc_revisits", sf, QUERIES, CHECKS)
    assert ok and rows, note


def test_canonical_urls(spark):
    pairs = [("HTTP://WWW.Example.org:80/a/?b=2&a=1&utm_source=x#top", "example.org/a?a=1&b=2"), ("https://example.org", "example.org"),
             ("https://example.org/A//", "example.org/A"), (None, None), ("", "")]
    df = spark.createDataFrame([(u,) for u, _ in pairs], "u string").select(warc.canonical_url(F.col("u")))
    assert [r[0] for r in df.collect()] == [k for _, k in pairs]


def test_revisits_of_a_hot_url_against_brute_force(spark):
    random.seed(2)
    rows = []
    for i in range(600):
        url = "http://hot.example/x" if i % 3 else f"http://example.org/{i % 7}?utm_x=1"
        headers = [h for h in (("ETag", random.choice(['"1"', 'W/"1"', '"2"', None])), ("Last-Modified", random.choice(["a", "b", None])),
                               ("X-Own", str(i)), ("Date", f"d{i}"), ("date", f"D{i}")) if h[1]]
        rows.append((i, random.choice(["response", "revisit", "request"]), url, T0 + timedelta(hours=random.randint(0, 200)),
                     random.choice(["p", "q", None]), headers))
    rows += rows[:20]
    rows += [(900, "revisit", None, T0, None, None), (901, "revisit", "http://hot.example/x", None, None, None), (902, "response", None, None, None, None)]
    low = lambda h: dict((n.lower(), v) for n, v in h or [])
    key = lambda u: u and re.sub(r"\?.*", "", u.split("//")[1])
    want = []
    for i, kind, url, at, digest, headers in rows:
        if kind != "revisit":
            continue
        found = [r for r in rows if r[1] == "response" and url and at and r[2] and r[3] and key(r[2]) == key(url) and r[3] <= at]
        best = max(found, key=lambda r: (r[3], r[0])) if found else None
        status = "no_url" if not url else "no_time" if not at else "no_response"
        merged = None
        if best:
            old, new = low(best[5]), low(headers)
            pairs = [(old.get("etag"), new.get("etag")), (old.get("last-modified"), new.get("last-modified")), (best[4], digest)]
            both = [(a.removeprefix("W/"), b.removeprefix("W/")) for a, b in pairs if a is not None and b is not None]
            status = "unchecked" if not both else "resolved" if both[0][0] == both[0][1] else "mismatch"
            if status != "mismatch":
                merged = tuple(sorted({**old, **{k: v for k, v in new.items() if k in warc.PERMITTED}}.items()))
        want.append((i, best[0] if merged is not None else None, status, merged))
    for seconds in (86_400, 7_200, 10_000_000):
        got = [(r.record_id, r.resolved_id, r.status, tuple(map(tuple, r.headers)) if r.headers is not None else None)
               for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD), seconds).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def cheapest(roles):
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    roles = [chat._known(r) for r in roles]

    @lru_cache(None)
    def go(i, s):
        if i == len(roles):
            return {0: 0, 1: 6, 2: 3, 3: 0}[s]
        best = 10**9
        for q in (1, 2, 3):
            c = 0 if chat.ROLES[q - 1] == roles[i] else 2
            best = min([best, *[c + go(i + 1, q)] * (q in legal[s]), *[c + 1 + go(i + 1, s)] * (s == q),
                        *[c + 3 + go(i + 1, q) for x in (2, 3) if x in legal[s] and q in legal[x]]])
        return best

    return go(0, 0)


@pytest.mark.parametrize("segment", [2_048, 3])
def test_repairs_are_legal_and_cheapest(spark, segment):
    random.seed(5)
    roles = ["system", "user", "assistant", "User ", None, "tool"]
    rows = [(c, t, random.choice(roles), random.choice(["a", "b<|x", None, ""])) for c in range(80) for t in range(random.randint(1, 7))]
    rows += [(1000, t, random.choice(roles), "z") for t in range(300)] + [(None, 1, "user", "x"), (None, None, "user", "x"), (1, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    order = lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "")
    found = {}
    out = chat.repair(df, segment=segment).collect()
    assert len(out) == len(rows)
    for r in sorted(out, key=lambda r: (r.part, r.place)):
        found.setdefault(r.conv_id, []).append(r)
    for conv, got in found.items():
        given = [r[2] for r in sorted((x for x in rows if x[0] == conv), key=order)]
        assert [r.role for r in got] == given and sum(r.cost for r in got) == cheapest(tuple(given))
        text = "".join(r.piece for r in got)
        turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", text, re.S)
        assert "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in turns) == text
        names = [a for a, _ in turns][turns[0][0] == "system" :]
        assert names and len(names) % 2 == 0 and all(a == ("user", "assistant")[i % 2] for i, a in enumerate(names))
    assert chat.repair(df.where("false")).count() == 0


def test_legal_conversations_stay(spark, sf):
    rows = QUERIES["op9_chat_repair"](spark, sf).collect()
    assert len(rows) == table(spark, sf, "conversations").count()
    assert all(r.cost >= 0 and r.new_role in chat.ROLES for r in rows)


def test_held_out_accuracy(spark, odd_documents):
    """Labels that follow the text are learnt; documents that were never labelled are scored right."""
    random.seed(7)
    good, bad = [f"fine{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    shared = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(random.choices(shared, k=30) + random.choices(good if i % 4 else bad, k=6)), "en", f"s{i % 5}") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.where("doc_id < 1200").select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    scored = cotraining.score(docs, labels).where("doc_id >= 1200")
    right = scored.where(F.col("good") == (F.col("doc_id") % 4 != 0)).count()
    assert right / scored.count() > 0.97
    columns = odd_documents.select("doc_id", "text", "lang", "source")
    assert cotraining.score(columns, labels.where("false")).where("score is null").count() == columns.count()
    assert cotraining.score(columns.where("false"), labels).count() == 0
    mixed = labels.withColumn("quality", F.when(F.col("doc_id") < 900, F.col("quality")))
    assert cotraining.score(columns.union(docs), mixed).count() == columns.count() + 2500


def test_pseudo_labels_reach_the_other_view():
    """A view that is sure teaches the other one: with metadata alone the pool's truth gets into the text model."""
    import numpy as np

    rng = np.random.default_rng(0)
    n = 900
    truth = rng.random(n) < 0.5
    text = cotraining.Rows([np.array([int(t) * 50 + rng.integers(0, 50)], np.int32) for t in truth], np.zeros((n, 1)), 100)
    facts = cotraining.Rows([np.array([int(t)], np.int32) for t in truth], np.zeros((n, 0)), 2)
    good = np.where(np.arange(n) < 100, truth.astype(float), np.nan)
    held = np.arange(n) % 5 == 0
    (model, _), _, _ = cotraining.cotrain((text, facts), good, held, rounds=2, added=500)
    assert ((text.margin(model) > 0) == truth)[100:].mean() > 0.95


def test_long_texts_are_learnt_whole(spark):
    """One passage in thousands of words decides: the fit must see every word of the documents it learns from."""
    rows = []
    for i in range(800):
        filler = [f"w{(i * 31 + k) % 97}" for k in range(4000)]
        filler[1 + 2 * (i % 1900)] = "poison" if i % 2 else "plain"
        rows.append((i, " ".join(filler), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.where("doc_id < 500").select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    found = cotraining.score(docs, labels).where("doc_id >= 500")
    assert found.where(F.col("good") == (F.col("doc_id") % 2 == 0)).count() > 290


def test_all_unlabelled_documents_teach(spark):
    """A source with few documents among many, all junk by their texts and none labelled, is known to the metadata view."""
    word = F.concat(F.when(F.col("id") % 4 == 0, F.lit("junk")).otherwise(F.lit("fine")), F.lit(" w"), (F.col("id") % 50).cast("string"))
    common = spark.range(31_000).select(F.col("id").alias("doc_id"), word.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rare = spark.range(31_000, 31_030).select(F.col("id").alias("doc_id"), F.concat(F.lit("junk v"), F.col("id")).alias("text"),
                                              F.lit("en").alias("lang"), F.lit("rare").alias("source"))
    labels = common.where("doc_id < 1000").select("doc_id", F.col("text").startswith("fine").cast("int").alias("quality"), F.lit(0).alias("toxic"))
    views = cotraining.score(common.union(rare), labels).groupBy("doc_id").agg(F.avg("metadata_score").alias("m")).where("doc_id in (5000, 31000)")
    seen = {r.doc_id: r.m for r in views.collect()}
    assert seen[5000] > 0.5 > seen[31000]
