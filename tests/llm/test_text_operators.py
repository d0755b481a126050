"""Personal data, quality rules and fingerprints against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logquarry.llm import fingerprints, pii, quality_rules
from logquarry.llm.common import table
from logquarry.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_spans_equal_the_patterns():
    random.seed(3)
    automaton = pii.anchors()
    for _ in range(20_000):
        text = "".join(random.choice("0123456789..  --@@+aB%()12é\n") for _ in range(random.randint(0, 40)))
        assert [s for s in pii.find_spans(text, automaton) if s[0] in pii.BASE] == base_spans(text), repr(text)


def test_added_kinds_and_redaction():
    text = "see ftp://joe:pw@host.example/x, IBAN DE89 3704 0044 0532 0130 00 and Account no: 1234-5678 AND more; iban DE00 1111 2222"
    spans = pii.find_spans(text, pii.anchors())
    kinds = {k: text[a:b] for k, a, b in spans}
    assert kinds["url"] == "ftp://joe:pw@host.example" and "1234-5678" in [text[a:b] for k, a, b in spans if k == "account"]
    assert "DE89 3704 0044 0532 0130 00" in [text[a:b] for k, a, b in spans if k == "account"]
    assert "joe" not in pii.redacted(text, spans) and "DE89" not in pii.redacted(text, spans)


def test_long_runs_stay_linear():
    automaton = pii.anchors()
    for text in ("1" * 100_000, "1.1." * 30_000, "account " + "1" * 100_000 + "a", "a" * 100_000 + "@", "+1" + "(" * 100_000):
        pii.find_spans(text, automaton)


def test_redact_rows(odd_documents, no_documents):
    rows = pii.redact(odd_documents).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert len(rows) == odd_documents.count() and texts[8] == "mail [EMAIL] or call [PHONE] now" and texts[1] is None
    assert pii.find(no_documents).count() == 0
    assert pii.find(odd_documents).where("doc_id = 1").first().spans == []


def test_query_digest(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op7_pii"](spark, sf).collect():
        spans = base_spans(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def stats(text):
    words, lines, repeated = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)], set()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_statistics(spark, sf, odd_documents):
    for docs in (table(spark, sf, "documents"), odd_documents.withColumn("n_words", F.lit("clash"))):
        for r in quality_rules.with_stats(docs).collect():
            want = stats(r.text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


@pytest.mark.parametrize("n,p", [(50, 0.1), (4000, 0.01), (200_000, 0.002)])
def test_binomial_tail(spark, n, p):
    ks = sorted({0, 1, 5, int(n * p * 0.5), int(n * p * 0.9)})
    df = spark.createDataFrame([(n, k) for k in ks], "n long, k long").select("k", quality_rules.tail_probability(F.col("n"), F.col("k"), p).alias("x"))
    for r in df.collect():
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(r.k + 1)]
        top = max(logs)
        assert r.x == pytest.approx(math.exp(top) * sum(math.exp(x - top) for x in logs), rel=1e-6) or r.k >= n * p


def test_cutoffs_keep_false_rejections_low(spark):
    """Junk in capitals, good documents without; a stratum with too few labels gets no cutoff."""
    body = " ".join(f"word{i}" for i in range(30))
    rows = [(i, body.upper() if i % 5 == 0 else body, "en" if i < 9000 else "fr") for i in range(9100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    measured = quality_rules.with_stats(docs)
    cutoffs = quality_rules.select_cutoffs(measured, labels)
    assert [r.stratum for r in cutoffs.collect()] == ["en"]
    kept = quality_rules.judge(measured, cutoffs).select("doc_id", "lang", "kept").collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in kept if r.lang == "en") and all(r.kept for r in kept if r.lang == "fr")
    nothing = quality_rules.select_cutoffs(measured, labels.where("false"))
    assert nothing.count() == 0 and quality_rules.judge(measured, nothing).where("not kept").count() == 0


def by_hand(rows, labels, alpha=0.01, delta=0.05):
    """Cutoffs per stratum in plain Python: order from the documents not tested, one exact test per step."""
    from math import comb

    grid = [(m, i, c) for m, cs in quality_rules.GRID.items() for i, c in enumerate(cs, 1)]
    good = {s: [r for r in rows if r.lang == s and labels.get(r.doc_id) == 1] for s in {r.lang for r in rows}}
    strata = [s for s in good if good[s]]
    pool = [s for s in strata if (1 - alpha) ** len(good[s]) > delta / len(strata)]
    out = {}
    for part in [[s] for s in strata if s not in pool] + ([pool] if pool else []):
        held = [r for s in part for r in good[s]]
        bad = [r for r in rows if r.lang in part and labels.get(r.doc_id) == 0]
        other = [r for r in rows if r.lang in part and r.doc_id not in labels]
        n = len(held)

        def cost(m, i):
            at = [(sum(r[m] > c for r in other) / len(other) if other else 0.0) - sum(r[m] > c for r in bad) / (n + len(bad))
                  for c in quality_rules.GRID[m][:i]]
            return max(round(x / (n / (n + len(bad))), 12) for x in at)

        now, fell = {}, set()
        for m, _, c in sorted(grid, key=lambda g: (cost(g[0], g[1]), g[1], g[0])):
            fell |= {r.doc_id for r in held if r[m] > c}
            if sum(comb(n, k) * alpha ** k * (1 - alpha) ** (n - k) for k in range(len(fell) + 1)) > delta / len(strata):
                break
            now[m] = c
        if now:
            out.update({s: {m: now.get(m, float("inf")) for m in quality_rules.GRID} for s in part})
    return out


def test_cutoffs_against_plain_python(spark):
    """A large stratum, one just large enough, two small ones that are pooled, one without labels."""
    import random

    draw, rows, labels = random.Random(5), [], {}
    for lang, size in (("en", 1500), ("de", 700), ("fr", 420), ("es", 330), ("it", 60)):
        for _ in range(size):
            i, junk = len(rows), draw.random() < 0.2
            text = " ".join(f"word{draw.randrange(10**6)}" for _ in range(30))
            if junk or draw.random() < 0.004:
                text = draw.choice([text.upper(), text + " $$$$ ####" * 9, text.replace(" ", "! "), (text[:60] + "\n") * 6])
            rows.append((i, text, lang))
            if lang != "it" and draw.random() < 0.8:
                labels[i] = 0 if junk else 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    measured = quality_rules.with_stats(docs).drop("text").persist()
    found = {r.stratum: {m: r[f"{m}_cutoff"] for m in quality_rules.GRID} for r in quality_rules.select_cutoffs(measured, marks).collect()}
    assert found == by_hand(measured.collect(), labels) and set(found) == {"en", "de", "fr", "es"}
    assert any(c < float("inf") for c in found["en"].values())
    measured.unpersist()


def test_rules_on_odd_and_no_documents(odd_documents, no_documents):
    labels = odd_documents.select("doc_id", F.lit(None).cast("int").alias("quality"))
    for docs in (odd_documents, no_documents):
        measured = quality_rules.with_stats(docs)
        assert quality_rules.judge(measured, quality_rules.select_cutoffs(measured, labels)).count() == docs.count()


def five_word_sets(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def test_fingerprints(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect()), reverse=True)
    found = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, sf).collect()}
    errors, by_text = [], {}
    for i, (doc_id, text) in enumerate(docs):
        after, r, half = docs[(i + 1) % len(docs)][1], found[doc_id], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
        a, b = five_word_sets(text), five_word_sets(edited)
        errors.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(sum(errors) / len(errors)) < 0.03 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.1


def test_fingerprints_of_odd_and_no_documents(odd_documents, no_documents):
    rows = fingerprints.edited_fingerprints(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == ""
    assert by_id[4].fingerprint == by_id[5].fingerprint and len(by_id[9].fingerprint) == fingerprints.BINS
    assert by_id[6].fingerprint == by_id[7].fingerprint  # equal in lower case
    assert fingerprints.edited_fingerprints(no_documents).count() == 0
