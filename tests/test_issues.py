import pytest

from logquarry.catalog.views import ISSUES, issues
from logquarry.functions.vectors import hashing_encoder
from logquarry.operators import issues as ops
from logquarry.operators.tfidf import TfidfModel
from logquarry.plans.analysis import analyze_issues, history_hits
from logquarry.operators.reports import history_context

CATEGORIES = [
    "network_issues", "resource_shortage", "timeout_issues", "instance_issues", "resource_shortage",
    "general", "service_failure", "resource_shortage", "timeout_issues", "service_failure",
    "authentication", "resource_shortage", "service_failure", "general", "instance_issues",
    "storage", "network_issues",
]

# One sentence per category.
SENTENCES = {
    "timeout_issues": "The call timed out after a minute.",
    "resource_shortage": "The node has insufficient disk left.",
    "network_issues": "The gateway is unreachable.",
    "service_failure": "Glance raises an exception at start.",
    "authentication": "The credential was refused.",
    "instance_issues": "It never finishes the spawn.",
    "database": "Every query of mysql is slow.",
    "storage": "A volume stays in the wrong place.",
    "general": "It was a quiet night.",
}
TROUBLE = "I'm having trouble: No valid host was found, there are insufficient resources."


@pytest.fixture(scope="module")
def five(spark):
    rows = [
        (1, "ERROR", "nova-compute", "No valid host was found for instance launch", "test-instance-1"),
        (2, "INFO", "nova-api", "GET /v2/servers/detail HTTP/1.1 status: 200", None),
        (3, "ERROR", "nova-scheduler", "Failed to schedule instance: insufficient resources", "test-instance-2"),
        (4, "WARNING", "nova-compute", "High memory usage detected on compute node", None),
        (5, "INFO", "nova-compute", "Instance spawned successfully", "test-instance-3"),
    ]
    df = spark.createDataFrame(rows, "log_id long, level string, service_type string, message string, instance_id string")
    return df.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as timestamp")


def test_categories(spark):
    got = [r.category for r in ops.categorize(issues(spark)).orderBy("issue_id").collect()]
    assert got == CATEGORIES and len(got) == len(ISSUES)


def test_a_sentence_of_every_category(spark):
    rows = [(i, text, name) for i, (name, text) in enumerate(SENTENCES.items())]
    got = ops.categorize(spark.createDataFrame(rows, "issue_id long, description string, wanted string")).collect()
    assert [r.category for r in got] == [r.wanted for r in got]


def test_advice_by_category(spark):
    rows = ops.recommendations(issues(spark)).collect()
    assert len([r for r in rows if r.issue_id == 3]) == 7
    assert [r.recommendation for r in sorted((r for r in rows if r.issue_id == 14), key=lambda r: r.ord)][0].startswith(
        "Review system logs")


@pytest.mark.parametrize("mode", ["fast", "hybrid"])
def test_five_lines(spark, five, mode):
    asked = issues(spark).union(spark.createDataFrame([(18, TROUBLE)], "issue_id long, description string"))
    out = analyze_issues(five, asked, mode=mode, encoder=hashing_encoder(32)).collect()
    assert len(out) == 18
    row = {r.issue_id: r for r in out}[18]
    assert row.issue_category == "resource_shortage" and row.analysis_mode == mode
    assert {x.level for x in row.lines} >= {"ERROR"}
    assert row.relevant_logs_count == len(row.lines) <= 5
    assert "No Valid Host Found" in [e.event_type for e in row.timeline]
    assert row.root_cause_analysis.startswith("Root Cause Analysis for resource_shortage issue:")
    assert row.context.startswith("Issue Description: I'm having trouble")


def test_no_lines(spark, five):
    out = analyze_issues(five.where("false"), issues(spark)).collect()
    assert len(out) == 17 and {r.issue_category for r in out} == {"unknown"}
    assert all(r.analysis_mode == "fallback" and len(r.recommendations) == 3 for r in out)


def test_issue_without_hits_gets_the_most_important_lines(spark, five):
    asked = spark.createDataFrame([(1, "zebra giraffe"), (2, "memory usage")], "issue_id long, description string")
    rows = ops.fast_filter(five, asked, k=2).orderBy("issue_id", "rank").collect()
    first = [r for r in rows if r.issue_id == 1]
    assert [r.importance for r in first] == sorted((r.importance for r in first), reverse=True) and len(first) == 2
    assert [r.log_id for r in rows if r.issue_id == 2] == [4]


def test_model_is_saved_with_its_terms(spark, five, tmp_path):
    model = TfidfModel.fit(five, "message", 10)
    model.save(spark, str(tmp_path / "terms"))
    again = TfidfModel.load(spark, str(tmp_path / "terms"))
    assert again.vocabulary == model.vocabulary and again.idf == model.idf


def test_history_is_cut(spark, five):
    docs = five.withColumnRenamed("message", "document")
    hits = history_hits(docs, issues(spark), hashing_encoder(32))
    for row in history_context(hits, max_chars=80).collect():
        assert len(row.history) <= 80 and row.history.startswith("Historical Log 1 (Similarity: ")
