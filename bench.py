"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logquarry.catalog import QUERIES  # noqa: E402
from logquarry.catalog.sources import written_files  # noqa: E402
from logquarry.catalog.views import ISSUES, logs  # noqa: E402
from logquarry.functions.vectors import hashing_encoder  # noqa: E402
from logquarry.operators import issues as ops  # noqa: E402
from logquarry.operators.tfidf import TfidfModel  # noqa: E402
from logquarry.plans.analysis import LINE_COLUMNS, analyze_issues  # noqa: E402
from logquarry.plans.features import engineer_all  # noqa: E402
from logquarry.session import build_session, small_table, stage  # noqa: E402
from logquarry.sources.files import read_logs  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def many_issues(spark, n):
    """The issue texts repeated with a number until there are n."""
    rows = [(i + 1, ISSUES[i % len(ISSUES)] + f" case {i}") for i in range(n)]
    return small_table(spark, rows, "issue_id long, description string")


def main():
    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    lines = stage(logs(spark, SF).repartition(int(CPUS)))  # the given file is one row group
    rows = lines.count()
    scored = stage(ops.with_importance(lines).select(*LINE_COLUMNS))
    kept = ops.importance_filter(scored)
    model = TfidfModel.fit(kept, "message")
    folder = written_files(spark, SF)
    five, hundreds = many_issues(spark, 5), many_issues(spark, 500)
    work = {
        "read_logs": lambda: sink(read_logs(spark, folder)),
        "engineer_all": lambda: sink(engineer_all(lines, materialize=stage)),
        "importance_filter": lambda: sink(ops.importance_filter(scored)),
        "fast_filter": lambda: sink(ops.fast_filter(scored, five, model, survivors=kept)),
        "hybrid_rank": lambda: sink(ops.hybrid_rank(scored, five, hashing_encoder(64), survivors=kept)),
        "analyze_issues_5": lambda: sink(analyze_issues(scored, five, model=model)),
        "analyze_issues_500": lambda: sink(analyze_issues(scored, hundreds, model=model)),
        "analyze_end_to_end": lambda: sink(QUERIES["analyze_issues"](spark, SF)),
        **{name: (lambda name=name: sink(QUERIES[name](spark, SF))) for name in (
            "hourly_level", "instance_stats", "level_transitions", "rolling_rates", "timeline",
            "duration_quantiles", "alert_error_rate", "tfidf_terms", "vector_topk", "chunk_text", "log_kpis")},
    }
    sink(lines.select(F.length("message")))
    seconds, first_run = {}, {}
    for name, run in work.items():
        for times in (first_run, seconds):  # the second run is the measurement
            start = time.time()
            run()
            times[name] = round(time.time() - start, 3)
        print(name, first_run[name], seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first_run": first_run, "sf": SF.rstrip("/").split("sf")[-1], "log_rows": rows,
        "rows_per_sec": {n: round(rows / seconds[n]) for n in (
            "engineer_all", "fast_filter", "hybrid_rank", "analyze_issues_5", "analyze_issues_500")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
