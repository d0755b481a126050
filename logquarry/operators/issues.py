"""Operators on a table of issues: category, advice, relevant lines, timeline, patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.functions import importance as rules
from logquarry.functions.text import mentions
from logquarry.operators.filters import is_severe
from logquarry.operators.search import top_by_similarity
from logquarry.operators.term_index import TermIndex
from logquarry.operators.tfidf import TfidfModel
from logquarry.operators.topk import at_least_percentile, top_per_group
from logquarry.session import small_table

SCORE_DIGITS = 6
PAYLOAD = ("timestamp", "level", "service_type", "message", "importance")


# --- category and advice ---------------------------------------------------------------


def category(description: Column) -> Column:
    """First category, by priority, of which a keyword occurs; else general."""
    chain = None
    for name, keywords in dims.CATEGORY_KEYWORDS:
        hit = mentions(description, keywords)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(dims.DEFAULT_CATEGORY)


def categorize(issues: DataFrame) -> DataFrame:
    return issues.withColumn("category", category(F.col("description")))


def category_table(spark) -> DataFrame:
    rows = [(c, p, k) for p, (c, words) in enumerate(dims.CATEGORY_KEYWORDS) for k in words]
    return small_table(spark, rows, "category string, priority int, keyword string")


def advice(category_column: Column) -> Column:
    """Recommendations of a category as an array, in order."""
    def texts(items):
        return F.array(*[F.lit(t) for t in items])

    chain = F.when(category_column == dims.UNKNOWN_CATEGORY, texts(dims.FAILED_ADVICE))
    for name, items in dims.ADVICE.items():
        if name:
            chain = chain.when(category_column == name, texts(items))
    return chain.otherwise(texts(dims.ADVICE[""]))


def recommendations(issues: DataFrame) -> DataFrame:
    """One row per issue and recommendation, numbered from 1."""
    with_category = issues if "category" in issues.columns else categorize(issues)
    return with_category.select(
        "issue_id", "category", F.posexplode(advice(F.col("category"))).alias("_i", "recommendation")
    ).select("issue_id", "category", (F.col("_i") + 1).alias("ord"), "recommendation")


# --- relevant lines --------------------------------------------------------------------


def with_importance(logs: DataFrame, score: Column | None = None) -> DataFrame:
    """Adds ``importance``: the given score, the one already there, or the rule score."""
    if score is None and "importance" in logs.columns:
        return logs
    if score is None:
        score = rules.rule_score(F.col("level"), F.col("message"))
    return logs.withColumn("importance", F.round(score, SCORE_DIGITS))


def importance_filter(logs: DataFrame, score: Column | None = None,
                      q: float = dims.IMPORTANCE_PERCENTILE) -> DataFrame:
    """Lines at or above the importance percentile. Scored once, shared by all issues.

    Scores lie within 0..1 and are kept to six digits, which bounds their distinct values.
    """
    return at_least_percentile(with_importance(logs, score), "importance", q, few_values=True)


def most_important(survivors: DataFrame, k: int) -> Column:
    """The k most important lines as one array value; bounded by k."""
    best = survivors.select("log_id", *PAYLOAD).orderBy(F.desc("importance"), "log_id").limit(k)
    return best.agg(F.collect_list(F.struct("log_id", *PAYLOAD))).scalar()


def spare_lines(issues: DataFrame, survivors: DataFrame, k: int) -> DataFrame:
    """The k most important lines once per issue, as candidates without similarity."""
    return issues.select("issue_id", F.inline(most_important(survivors, k))).withColumn(
        "similarity", F.lit(0.0)
    )


def fast_filter(
    logs: DataFrame,
    issues: DataFrame,
    model: TfidfModel | None = None,
    k: int = dims.TOP_RELEVANT,
    threshold: float = dims.TFIDF_THRESHOLD,
    survivors: DataFrame | None = None,
    index: TermIndex | None = None,
) -> DataFrame:
    """Per issue the k important lines most similar to it by TF-IDF.

    Lines below the threshold do not count; an issue left without lines gets the most
    important ones. ``index`` is one of the surviving lines' messages; without it one is built.
    ``log_id`` identifies a line. Columns: issue_id, log_id, the line's fields, similarity, score, rank.
    """
    kept = importance_filter(logs) if survivors is None else survivors
    if index is None:
        index = TermIndex.build(kept, model or TfidfModel.fit(kept, "message"))
    found = index.search(issues, k, threshold).drop("rank")
    known = logs if "importance" in logs.columns else kept  # the hits are survivors, so the filter needn't run again
    hits = known.select("log_id", *PAYLOAD).join(found, "log_id").withColumn("_hit", F.lit(1))
    spare = spare_lines(issues, kept, k).withColumn("_hit", F.lit(0))
    has_hits = F.max("_hit").over(Window.partitionBy("issue_id"))
    chosen = hits.unionByName(spare).withColumn("_any", has_hits).where("_hit = _any")
    # Hits are ranked by similarity, stand-ins (all with similarity 0) by importance.
    order = [F.desc("similarity"), F.when(F.col("_hit") == 0, -F.col("importance")), F.col("log_id")]
    ranked = top_per_group(chosen.withColumn("score", F.col("importance")), ["issue_id"], order, k)
    return ranked.drop("_hit", "_any")


def hybrid_rank(
    logs: DataFrame,
    issues: DataFrame,
    encoder: Callable[[Column], Column],
    k: int = dims.TOP_RELEVANT,
    weight_importance: float = dims.WEIGHT_IMPORTANCE,
    weight_similarity: float = dims.WEIGHT_SIMILARITY,
    survivors: DataFrame | None = None,
    text: Column | None = None,
    embedding: str | None = None,
) -> DataFrame:
    """Per issue the k important lines with the best mix of importance and similarity.

    The search returns the k most similar lines of each issue; every other line has
    similarity 0, so among those only the 2k most important can reach the first k places.
    The result is the ranking over all lines without pairing them with every issue.
    """
    kept = importance_filter(logs) if survivors is None else survivors
    if embedding is None:
        body = F.col("message") if text is None else text
        documents, vector = kept.withColumn("_vector", encoder(body)), "_vector"
    else:
        documents, vector = kept, embedding
    encoded_issues = issues.select("issue_id", encoder(F.col("description")).alias(vector))
    hits = top_by_similarity(documents, encoded_issues, k, vector=vector, carry=PAYLOAD).drop("rank")
    candidates = hits.unionByName(spare_lines(issues, kept, 2 * k))
    both = candidates.groupBy("issue_id", "log_id", *PAYLOAD).agg(
        F.greatest(F.max("similarity"), F.lit(0.0)).alias("similarity")
    )
    scored = both.withColumn(
        "score",
        F.round(F.col("importance") * weight_importance + F.col("similarity") * weight_similarity, 6),
    )
    return top_per_group(scored, ["issue_id"], [F.desc("score"), F.col("log_id")], k)


# --- what the relevant lines say -------------------------------------------------------


def event_type(message: Column) -> Column:
    lowered = F.lower(message)
    chain = None
    for pattern, name in dims.EVENT_PATTERNS:
        hit = lowered.rlike(pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def timeline(logs: DataFrame) -> DataFrame:
    """Lines that mark an event, with its name; keeps the other columns."""
    return logs.withColumn("event_type", event_type(F.col("message"))).where(F.col("event_type").isNotNull())


def counters(patterns: list[tuple[str, str]]) -> list[Column]:
    return [F.count_if(F.col("message").rlike(f"(?i){p}")).alias(name) for name, p in patterns]


def resource_patterns(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys).agg(*counters(dims.RESOURCE_COUNTERS))


def network_patterns(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys).agg(*counters(dims.NETWORK_COUNTERS))


def issue_patterns(relevant: DataFrame, issues: DataFrame) -> DataFrame:
    """Long table ``(issue_id, pattern, key, n)`` of counts per issue.

    Errors and distributions always; the resource or network counters where the category
    calls for them.
    """
    categories = categorize(issues).select("issue_id", "category")
    lines = relevant.join(categories, "issue_id")
    level = lines.groupBy("issue_id", F.lit("level_distribution").alias("pattern"), F.col("level").alias("key"))
    service = lines.groupBy(
        "issue_id", F.lit("service_distribution").alias("pattern"), F.col("service_type").alias("key"))
    n = F.count(F.lit(1)).alias("n")
    all_counters = dims.RESOURCE_COUNTERS + dims.NETWORK_COUNTERS
    totals = lines.groupBy("issue_id", "category").agg(
        F.count_if(is_severe()).alias("error_count"),
        *[F.count_if(F.col("message").rlike(f"(?i){p}")).alias(f"_c{i}") for i, (_, p) in enumerate(all_counters)],
    )
    entry = [F.struct(F.lit("error_count").alias("pattern"), F.lit("").alias("key"), F.col("error_count").alias("n"))]
    for i, (name, _) in enumerate(all_counters):
        resource = i < len(dims.RESOURCE_COUNTERS)
        wanted = dims.RESOURCE_COUNTER_CATEGORIES if resource else dims.NETWORK_COUNTER_CATEGORIES
        part = F.struct(
            F.lit("resource_patterns" if resource else "network_patterns").alias("pattern"),
            F.lit(name).alias("key"), F.col(f"_c{i}").alias("n"))
        entry.append(F.when(F.col("category").isin(wanted), part))
    long = totals.select("issue_id", F.inline(F.filter(F.array(*entry), lambda x: x.isNotNull())))
    return long.unionByName(level.agg(n)).unionByName(service.agg(n))


def first_events(relevant: DataFrame, k: int) -> DataFrame:
    events = timeline(relevant)
    return top_per_group(
        events, ["issue_id"], [F.col("timestamp").asc_nulls_last(), F.col("log_id")], k, rank="ord")


