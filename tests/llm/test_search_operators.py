"""Secret scan, resampling and hard negatives against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from logquarry.llm import hard_negatives, resampling, secret_scan
from logquarry.llm.queries import CHECKS, QUERIES
from logquarry.llm.resampling import Draw
from logquarry.llm.secret_scan import BASE, RULES, Rule


@pytest.mark.parametrize("name", ["op11_secret_scan", "op12_resampling", "op13_hard_negatives"])
def test_queries(spark, sf, name):
    ok, rows, _, note = compare(spark, duck(sf), name, sf, QUERIES, CHECKS)
    assert ok and rows, note


# --- secrets -----------------------------------------------------------------------------


def spans_by_hand(text, rules=RULES):
    out = []
    for place, rule in enumerate(rules):
        out += [(m.start(), place, m.end(), rule.kind) for m in re.finditer(rule.pattern, text or "")
                if len(m.group(rule.group)) >= rule.least]
    return sorted(out)


def test_queries_of_patterns():
    query = secret_scan.trigram_query
    assert query("abc") == "abc" and query("AbCd") == ("and", frozenset(["abc", "bcd"]))
    assert query("[0-9a-f]{24,}") is True and query("ab") is True and query("x*") is True and query("(?:abc|.)") is True
    assert query("AKIA[A-Z0-9]+") == ("and", frozenset(["aki", "kia"]))
    assert query("abc|abcd|xyz") == ("or", frozenset(["abc", "xyz"]))
    assert query("(?:abc)+d?") == "abc" and query("(?:abc)*xyz") == "xyz"
    assert query("a[bc]d") == ("or", frozenset(["abd", "acd"]))
    assert secret_scan.trigrams(query(RULES[0].pattern)) >= {"tok", "oke", "ken", "pas"}


def test_no_match_without_its_trigrams():
    """Whatever a pattern matches satisfies its query."""
    random.seed(5)

    def holds(query, text):
        if query is True:
            return True
        if isinstance(query, str):
            return query in text
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    pieces = ["ab", "[ab]c", "(?:abc|cab|b)", "a?b", "c+", "(?:ab){2}", "[^a]", ".", "x*", "(?i:aBc)", "[a-z]", r"\d", "^", "(?:a|bc)?"]
    for _ in range(400):
        pattern = "".join(random.choices(pieces, k=random.randint(1, 6)))
        query = secret_scan.trigram_query(pattern)
        for _ in range(20):
            text = "".join(random.choices("aAbBc1x", k=12))
            if re.search(pattern, text):
                assert holds(query, text.lower()), (pattern, text, query)


def test_spans_against_brute_force(spark):
    random.seed(3)
    parts = ["token", "SECRET", "password", "passwd", "api_key", "apiKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3,
             "0a", "ghp_" + "a1" * 18, "xoxb-1234567890", "sk_live_" + "Z" * 16, "AIza" + "b" * 35, "Bearer " + "t" * 20, "eyJ", "é😀", "abc", "\n",
             "-----BEGIN RSA PRIVATE KEY-----", "token=token", "hex=", "KKI", "secret=ab "]
    rows = [(i, "".join(random.choices(parts, k=random.randint(0, 30)))) for i in range(400)]
    rows += [(7, "x token=abcdef" * 700), (7, "x token=abcdef" * 700), (None, "token: abcdef1"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((str(i), t or "", spans_by_hand(t)) for i, t in rows)
    for grams in (False, True):
        index = secret_scan.build_index(df) if grams else None
        got = sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.spans]) for r in secret_scan.find(df, index=index).collect())
        assert got == want


def test_index_holds_every_trigram(spark):
    rows = [(1, "abcdé"), (2, "xABC"), (3, "ab"), (4, None), (2, "xABC")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = secret_scan.build_index(df).groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()
    assert {r.gram: r.n for r in index} == {"abc": 2, "bcd": 1, "cdé": 1, "xab": 1}
    own = [Rule("own", "Abc"), Rule("any", "d.")]
    found = secret_scan.find(df, own, index=secret_scan.build_index(df))
    assert sorted(len(r.spans) for r in found.collect()) == [0, 0, 0, 0, 1]  # 'dé'; 'Abc' itself occurs nowhere


def test_secrets_of_odd_documents(odd_documents, no_documents):
    found = secret_scan.find(odd_documents)
    assert found.columns == ["doc_id", "text", "spans"]
    assert found.count() == odd_documents.count() and found.where("size(spans) > 0").count() == 0
    assert secret_scan.find(no_documents).count() == 0
    assert secret_scan.find(odd_documents, BASE[2:]).count() == odd_documents.count()  # no rule has a query


# --- resampling --------------------------------------------------------------------------


def by_hand(docs, target, draw):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(f.encode()) % draw.buckets for f in [*w, *map(" ".join, zip(w, w[1:]))]]

    cut = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in cut for b in f), Counter(b for x in target for b in features(x)[1])
    big = draw.buckets
    ratio = lambda b: (t[b] + 1) * (sum(s.values()) + big) / ((s[b] + 1) * (sum(t.values()) + big))
    rows = []
    for i, n, f in cut:
        h = int(hashlib.sha256(f"{draw.seed}{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(math.floor(1000 * math.log(ratio(b))) for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= draw.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[: draw.percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_resampling_against_brute_force(spark, percent):
    random.seed(percent)
    vocabulary = ["alpha", "Beta", "gamma", "é1", "delta9", "x"]
    docs = [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 40)))) for i in range(300)]
    docs += [(5, "one two " * 15)] * 60 + [(None, "one two " * 15)] * 7 + [(400, None), (401, "")]
    target = ["alpha gamma " * 20, None, "Beta x"]
    draw = Draw(percent=percent, least_words=20, buckets=50)
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                                spark.createDataFrame([(t,) for t in target], "text string"), draw)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()) == by_hand(docs, target, draw)


def test_bracket_widens(spark):
    """Half of all scores are one value: the first brackets that hold the rank are found by exact counts."""
    rows = spark.createDataFrame([(v,) for v in [5] * 500 + list(range(1000, 1500))], "score long")
    values = sorted([5] * 500 + list(range(1000, 1500)), reverse=True)
    for wanted in (1, 250, 499, 500, 501, 999, 1000):
        low, high, above = resampling.bracket(rows, "score", wanted, 1000)
        assert low <= values[wanted - 1] <= high and above == sum(v > high for v in values) < wanted


def test_resampling_of_odd_documents(odd_documents, no_documents):
    found = resampling.resample(odd_documents, no_documents)
    assert found.count() == odd_documents.count() and found.where("rank is not null").count() == 0  # two rows have 20 words
    assert resampling.resample(no_documents, odd_documents).count() == 0


# --- hard negatives ----------------------------------------------------------------------


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for bits, dtype in ((9, np.int32), (20, np.int64)):
        x = rng.integers(-(1 << bits - 1), 1 << bits - 1, (300, 24))
        a = rng.integers(-(1 << bits - 1), 1 << bits - 1, (7, 24))
        tables = hard_negatives.subset_sums(a, dtype)
        assert (hard_negatives.scores(tables, hard_negatives.bit_planes(x, bits)) == x @ a.T).all()


def negatives_by_hand(rows, k=5):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in kept:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, lab == other) for j, other, w in kept]
        for s, j, _ in sorted(x for x in scored if x[2] and x[1] != i)[:k]:
            near = sorted(x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(near, 1)]
    return Counter(out)


@pytest.mark.parametrize("width,scale", [(3, 1.0), (16, 0.2), (20, 300.0)])
def test_negatives_against_brute_force(spark, width, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "CELL", 2)
    rng = np.random.default_rng(width)
    rows = [(i, [float(x) for x in rng.normal(0, scale, width)], int(rng.choice([0, 0, 0, 1, 2, 9]))) for i in range(0, 1500, 5)]
    rows += [(rows[20][0], rows[20][1], 0)] * 30  # an anchor whose row repeats
    rows += [(2, [0.5] * width, 1)] * 90 + [(3, [0.5] * width, 0)] * 90  # ties
    rows += [(10_000, None, 1), (10_100, [None] * width, 1), (10_200, [float("nan")] * width, 1), (10_300, [float("inf")] * width, 1),
             (None, [1.0] * width, 1), (10_400, [1.0] * width, None), (10_500, [], 1), (10_600, [1.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, _id string, _key int").repartition(7)
    found = hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()
    assert Counter(tuple(r) for r in found) == negatives_by_hand(rows)


def test_no_vectors_and_too_wide_ones(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    wide = spark.createDataFrame([(100, [1e8], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="bits"):
        hard_negatives.mine(wide, F.col("vec_id") % 100 == 0)
