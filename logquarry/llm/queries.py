"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import (
    chat, cotraining, fingerprints, hard_negatives, lexicon_bpe, mixing, ngram_join, pii, quality_rules, resampling, secret_scan,
    token_store, warc)
from logquarry.llm.common import table
from logquarry.session import scratch_path, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_store")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """All documents encoded, written as a token store and read back from it."""
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    found = token_store.read_tokens(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_lexicon_bpe")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """All documents encoded through the lexicon and decoded again."""
    path = vocabulary("word_bpe_49k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lexicon_bpe.encode_decode(docs, path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op7_pii")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    spans = F.col("spans")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.digest(spans, True).cast("binary"), 256).alias("base_sha256"),
                        pii.digest(spans, False).alias("spans"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics and verdict for all documents; cutoffs from the labelled ones."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    stats = stage(quality_rules.with_stats(docs).drop("text"))
    cutoffs = stage(quality_rules.select_cutoffs(stats, table(spark, sf, "labels")))
    return quality_rules.judge(stats, cutoffs).select("doc_id", *quality_rules.STATS, "base_failed", "kept")


@query("op4_ngram_join")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Documents linked by 3-word shingles at Jaccard 0.9."""
    return ngram_join.ngram_join(table(spark, sf, "documents"), n=3, num=90, den=100)


@query("op5_fingerprints")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


#: Weights of the mix's sources in order, repeating; a document is taken at most MOST times.
WEIGHTS, MOST = [1.0, 2.0, 3.0], 3.0


@query("op2_mixing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """How many words the mix takes of every document."""
    keyed, by_size = mixing.plan(table(spark, sf, "documents"), WEIGHTS, MOST)
    return keyed.join(by_size, ["_source", "_size"]).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.expr(mixing.COPIES) * F.col("_size")).alias("taken"))


def archive(pages: DataFrame) -> DataFrame:
    """WARC records of the pages: a full response of each, and a later or earlier revisit under a variant of its URL."""
    base = pages.select("page_id", "url", F.sha1("html").alias("digest"), F.substring(F.md5("html"), 1, 16).alias("tag"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    i = F.col("page_id")
    etag = F.when(i % 3 != 0, F.concat(F.lit('"'), F.col("tag"), F.lit('"')))
    changed = F.when(i % 7 == 0, F.lit("W/\"changed\"")).otherwise(F.concat(F.lit("W/"), etag))
    modified = F.when(i % 4 != 0, F.concat(F.lit("day "), (i % 28).cast("string")))
    present = lambda *h: F.filter(F.array(*h), lambda x: x["value"].isNotNull())
    full = base.select(
        (i * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.timestamp_seconds(i * 60).alias("time"), "digest",
        present(pair("Content-Type", F.lit("text/html")), pair("ETag", etag), pair("Last-Modified", modified),
                pair("Date", i.cast("string"))).alias("headers"))
    later = base.select(
        (i * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#seen")).alias("url"),
        F.timestamp_seconds(i * 60 + F.when(i % 11 == 0, -90).otherwise(3600)).alias("time"),
        F.when(i % 5 != 0, F.col("digest")).alias("digest"),
        present(pair("content-type", F.lit("message/http")), pair("etag", F.when(i % 3 != 0, changed)),
                pair("last-modified", modified), pair("date", F.concat(F.lit("later "), i.cast("string")))).alias("headers"))
    return full.union(later)


OP6_SQL = r"""
WITH base AS (
  SELECT page_id AS i, url, sha1(html) AS digest, left(md5(html), 16) AS tag,
    regexp_replace(trim(url), '#.*$', '') AS plain FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(plain, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)$', '') AS host,
    regexp_replace(plain, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*', '') AS rest FROM base),
keyed AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS query,
    regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path FROM parts),
full_ AS (
  SELECT i * 2 AS id, i * 60 AS at, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key,
    digest, CASE WHEN i % 3 <> 0 THEN '"' || tag || '"' END AS etag,
    CASE WHEN i % 4 <> 0 THEN 'day ' || (i % 28) END AS modified FROM keyed),
later AS (
  SELECT i * 2 + 1 AS id, i, i * 60 + CASE WHEN i % 11 = 0 THEN -90 ELSE 3600 END AS at,
    host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key,
    CASE WHEN i % 5 <> 0 THEN digest END AS digest,
    CASE WHEN i % 3 <> 0 THEN CASE WHEN i % 7 = 0 THEN '"changed"' ELSE '"' || tag || '"' END END AS etag,
    CASE WHEN i % 4 <> 0 THEN 'day ' || (i % 28) END AS modified FROM keyed),
paired AS (
  SELECT l.*, f.id AS stored, coalesce(f.etag = l.etag, f.modified = l.modified, f.digest = l.digest) AS agree,
    f.etag AS stored_etag, f.modified AS stored_modified,
    row_number() OVER (PARTITION BY l.id ORDER BY f.at DESC, f.id DESC) AS place
  FROM later l LEFT JOIN full_ f ON f.url_key = l.url_key AND f.at <= l.at),
judged AS (
  SELECT *, CASE WHEN stored IS NULL THEN 'no_response' WHEN agree IS NULL THEN 'unchecked'
    WHEN agree THEN 'resolved' ELSE 'mismatch' END AS status FROM paired WHERE place = 1)
SELECT id AS record_id, url_key, CASE WHEN status IN ('resolved', 'unchecked') THEN stored END AS resolved_id, status,
  CASE WHEN status IN ('resolved', 'unchecked') THEN concat_ws(chr(10), 'content-type: text/html', 'date: later ' || i,
    'etag: ' || coalesce('W/' || etag, stored_etag), 'last-modified: ' || coalesce(modified, stored_modified)) END AS headers
FROM judged"""


@query("op6_warc_revisits", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """All revisit records of the pages' archive, resolved."""
    found = warc.resolve_revisits(archive(table(spark, sf, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.withColumn("headers", lines)


@query("op9_chat_repair")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations repaired and formatted, one row per turn that was given."""
    found = chat.repair(table(spark, sf, "conversations"))
    return found.select("conv_id", "turn", "role", "new_role", "action", "cost", "piece")


@query("op3_cotraining")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by the co-trained classifier."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return cotraining.score(docs, table(spark, sf, "labels"))


def secret_sql(rules: list[secret_scan.Rule]) -> str:
    """Spans as sums over what lies between the matches of each rule; every rule reads every text."""
    found = "\nUNION ALL ".join(
        f"""SELECT rowid AS r, doc_id, {place} AS place, '{r.kind}' AS kind, {r.least} AS least,
          [len(x) FOR x IN string_split_regex(t, '{p}')] AS gaps, [len(x) FOR x IN regexp_extract_all(t, '{p}')] AS widths,
          [len(x) FOR x IN regexp_extract_all(t, '{p}', {r.group})] AS sizes FROM texts"""
        for place, r in enumerate(rules) for p in [r.pattern.replace("'", "''")])
    kinds = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({found}),
    numbered AS (SELECT *, unnest(range(1, len(widths) + 1)) AS i FROM found),
    placed AS (SELECT r, place, kind, sizes[i] AS size, least, widths[i] AS width,
        CAST(list_sum(gaps[1:i]) + coalesce(list_sum(widths[1:i - 1]), 0) AS BIGINT) AS pos FROM numbered),
    kept AS (SELECT r, pos, place, kind, concat(kind, ':', pos, ':', pos + width) AS span FROM placed WHERE size >= least),
    by_row AS (SELECT r, string_agg(span, ',' ORDER BY pos, place) AS spans,
        string_agg(span, ',' ORDER BY pos, place) FILTER (WHERE kind IN ({kinds})) AS base,
        {", ".join(f"count(*) FILTER (WHERE kind = '{b.kind}') AS n_{b.kind}" for b in secret_scan.BASE)} FROM kept GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{b.kind}, 0) AS n_{b.kind}" for b in secret_scan.BASE)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN by_row ON rowid = r"""


@query("op11_secret_scan", secret_sql(secret_scan.RULES))
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = secret_scan.find(table(spark, sf, "documents"))
    spans, base = F.col("spans"), [r.kind for r in secret_scan.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(secret_scan.digest(spans, base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.digest(spans).alias("spans"))


OP12_SQL = r"""
WITH rest AS (SELECT list(list_reduce(list_concat([i], [0 FOR z IN range(8)]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_features AS (SELECT r, unnest(list_concat(w, [concat(w[i], ' ', w[i + 1]) FOR i IN range(1, len(w))])) AS f FROM docs),
goal_features AS (SELECT unnest(list_concat(w, [concat(w[i], ' ', w[i + 1]) FOR i IN range(1, len(w))])) AS f FROM goal),
known AS (SELECT DISTINCT f FROM (SELECT f FROM doc_features UNION ALL SELECT f FROM goal_features)),
bytes AS (SELECT f, list_concat([4294967295], [CAST('0x' || substring(hex(encode(f)), 2 * i - 1, 2) AS BIGINT)
    FOR i IN range(1, octet_length(encode(f)) + 1)]) AS b FROM known),
placed AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, rest),
s AS (SELECT bucket, count(*) AS s FROM doc_features JOIN placed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal_features JOIN placed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
summed AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM doc_features JOIN placed USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
    FROM docs LEFT JOIN summed USING (r)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank FROM ordered"""


@query("op12_resampling", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """All documents weighed towards the benchmark's texts, and the draw's ranks."""
    found = resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
negatives AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.r, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM positives p JOIN scored s ON p.r = s.r AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors; every seventh label is shifted."""
    i, label = F.col("vec_id"), F.col("label")
    return hard_negatives.mine(table(spark, sf, "embeddings"), i % 100 == 0, F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
