"""Queries of file sources and sinks. The raw layout of the log table is written to the shared
folder as several files and read back."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.catalog.registry import query
from logquarry.catalog.vectors import SQL_LOG_TEXT
from logquarry.catalog.views import SQL_RAW, logs, raw_lines, runs, table, with_logs, with_runs
from logquarry.operators.filters import is_severe
from logquarry.operators.metrics import run_log
from logquarry.plans.feature_snapshot import FeatureSnapshot
from logquarry.plans.features import engineer_all
from logquarry.session import scratch_path, stage
from logquarry.sources import snapshot
from logquarry.sources.files import (
    discover_files,
    explode_blobs,
    file_stats,
    read_lines,
    read_logs,
)
from logquarry.sources.store import DocumentStore, export_documents, export_rows, load_logs, read_rows, save_logs
from logquarry.operators.documents import to_documents


def written_files(spark, sf) -> str:
    """Raw lines as text files, one folder per service; every task writes its own, no service is one task's work."""
    root = scratch_path(spark, "raw-logs")
    rows = raw_lines(spark, sf)
    service = F.regexp_extract("file", "^(.*)-[0-9]+$", 1)
    rows.select(F.col("line").alias("value"), service.alias("service")).write.partitionBy("service").text(root)
    return root


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns of a row, in their order; nulls differ from empty texts, and -0.0 equals 0.0."""
    def written(name, kind):
        if kind == "double":
            return (F.col(name) + 0.0).cast("string")
        return F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")

    return F.sha2(F.to_json(F.array(*[written(n, t) for n, t in df.dtypes])), 256)


FOLDER = r"service=([^/]+)"


@query("src_discover", with_logs("""
  SELECT service_type AS folder, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes
  FROM raw JOIN logs USING (log_id) GROUP BY service_type""", ("raw", SQL_RAW)))
def src_discover(spark, sf):
    found = discover_files(spark, written_files(spark, sf))
    return found.groupBy(F.regexp_extract("path", FOLDER, 1).alias("folder")).agg(F.sum("size").alias("bytes"))


@query("src_lines", with_logs("""
  SELECT service_type AS folder, count(*) AS lines, true AS dense,
    CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS value_hash
  FROM raw JOIN logs USING (log_id) GROUP BY service_type""", ("raw", SQL_RAW)))
def src_lines(spark, sf):
    """Per folder the lines, a hash of their values, and whether each file's numbers run from 1 without gaps."""
    lines = read_lines(spark, written_files(spark, sf))
    value = F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 8), 16, 10).cast("bigint")
    files = lines.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(value).alias("value_hash"),
        ((F.min("line_number") == 1) & (F.max("line_number") == F.count(F.lit(1)))
         & (F.sum("line_number") * 2 == F.count(F.lit(1)) * (F.count(F.lit(1)) + 1))).alias("dense"))
    return files.groupBy(F.regexp_extract("source_file", FOLDER, 1).alias("folder")).agg(
        F.sum("lines").alias("lines"), F.min("dense").alias("dense"), F.sum("value_hash").alias("value_hash"))


@query("src_multi", with_logs("""
  SELECT timestamp, level, message, service_type, instance_id, request_id FROM logs"""))
def src_multi(spark, sf):
    return read_logs(spark, written_files(spark, sf)).orderBy("timestamp", "source_file", "line_number").select(
        "timestamp", "level", "message", "service_type", "instance_id", "request_id")


@query("src_file_stats", with_logs("""
  SELECT service_type AS service, count(*) AS lines FROM logs GROUP BY service_type"""))
def src_file_stats(spark, sf):
    return file_stats(spark, written_files(spark, sf)).groupBy(
        F.regexp_extract("source_file", "service=([^/]+)", 1).alias("service")
    ).agg(F.sum("lines").alias("lines"))


@query("src_file_sizes", with_logs("""
  SELECT service_type AS service, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, true AS just_written
  FROM raw JOIN logs USING (log_id) GROUP BY service_type""", ("raw", SQL_RAW)))
def src_file_sizes(spark, sf):
    """All columns of the file statistics; the files' last change lies between their writing and now."""
    start = spark.sql("SELECT current_timestamp() - INTERVAL 5 SECONDS AS t").first().t
    stats = file_stats(spark, written_files(spark, sf))
    return stats.groupBy(F.regexp_extract("source_file", FOLDER, 1).alias("service")).agg(
        F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"),
        F.bool_and(F.col("last_change").between(F.lit(start), F.current_timestamp() + F.expr("INTERVAL 5 SECONDS"))).alias("just_written"))


@query("src_blob", r"""
  SELECT doc_id, line_number, line FROM (
    SELECT doc_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_number,
      regexp_replace(replace(unnest(l), chr(65533), ''), '^\s+|\s+$', '', 'g') AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''""")
def src_blob(spark, sf):
    return explode_blobs(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "line_number", F.col("value").alias("line"))


@query("sink_roundtrip", with_logs("""
  SELECT kind, log_id, timestamp, level, service_type, instance_id, request_id, message
  FROM logs, (SELECT unnest(['csv', 'parquet']) AS kind)"""))
def sink_roundtrip(spark, sf):
    df = logs(spark, sf)
    root = scratch_path(spark, "saved")
    save_logs(df, f"{root}/logs.parquet", by_date=True)
    save_logs(df, f"{root}/logs.csv")
    stored = load_logs(spark, f"{root}/logs.parquet").drop("date")
    text = load_logs(spark, f"{root}/logs.csv", df.schema)
    names = ["log_id", "timestamp", "level", "service_type", "instance_id", "request_id", "message"]
    return stored.select(F.lit("parquet").alias("kind"), *names).unionByName(
        text.select(F.lit("csv").alias("kind"), *names))


@query("export_documents", with_logs("""
  SELECT CAST(log_id AS VARCHAR) AS original_index, level, service_type, instance_id FROM logs"""))
def exported(spark, sf):
    path = scratch_path(spark, "export")
    export_documents(to_documents(logs(spark, sf)), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("original_index", "level", "service_type", "instance_id")


@query("export_documents_whole", with_logs(f"""
  SELECT {SQL_LOG_TEXT} AS document, 'log_' || md5(concat(log_id, '_', strftime(timestamp, '%Y-%m-%d %H:%M:%S.'),
      rtrim(strftime(timestamp, '%f'), '0'), '_', service_type, '_', level, '_', substring(message, 1, 100), '_',
      coalesce(instance_id, ''))) AS id,
    timestamp, service_type, level, instance_id, log_id AS original_index FROM logs"""))
def exported_whole(spark, sf):
    """All seven columns of the export, as read from its files."""
    path = scratch_path(spark, "export-whole")
    export_documents(to_documents(logs(spark, sf)), path)
    return read_rows(spark, path, "document string, id string, timestamp timestamp_ntz, service_type string, level string, "
                     "instance_id string, original_index long")


@query("export_logs", with_logs("""
  SELECT timestamp, level, service_type, message, instance_id, log_id FROM logs
  WHERE level IN ('ERROR', 'CRITICAL') AND service_type <> 'unknown'"""))
def exported_logs(spark, sf):
    """Severe lines of known services, through the files of their export."""
    path = scratch_path(spark, "export-logs")
    names = ["timestamp", "level", "service_type", "message", "instance_id", "log_id"]
    kept = logs(spark, sf).where(is_severe() & (F.col("service_type") != "unknown")).select(*names)
    export_rows(kept, path)
    return read_rows(spark, path, kept.schema)


@query("export_runs", with_runs("""
  SELECT run_id, ts, issue[:100] AS issue_description, status, category, mode, CAST(relevant_logs AS INT) AS relevant_logs,
    duration AS processing_time FROM runs"""))
def exported_runs(spark, sf):
    """The history of runs, through the files of its export."""
    path = scratch_path(spark, "export-runs")
    history = run_log(runs(spark, sf))
    export_rows(history, path)
    return read_rows(spark, path, history.schema)


@query("src_incremental", with_logs(
    " SELECT true AS loaded_all, CAST(0 AS BIGINT) AS loaded_again, count(*) AS rows FROM logs"))
def src_incremental(spark, sf):
    """Two refreshes of a snapshot; the second finds nothing new."""
    root = written_files(spark, sf)
    kept = snapshot.LogSnapshot(spark, scratch_path(spark, "snapshot"))
    first = kept.refresh(root)
    second = kept.refresh(root)
    return snapshot.inventory(kept.manifest()).select(
        (F.lit(first) == F.col("entries")).alias("loaded_all"), F.lit(second).cast("long").alias("loaded_again"), "rows")


@query("src_incremental_features", with_logs("""
  SELECT true AS same, true AS fewer, CAST(0 AS BIGINT) AS framed_again, count(*) AS rows FROM logs
  WHERE CAST(timestamp AS DATE) > (SELECT min(CAST(timestamp AS DATE)) FROM logs)"""))
def src_incremental_features(spark, sf):
    """The feature snapshot after a day of files came and another went: equal to all features made anew, with fewer spans framed."""
    root = scratch_path(spark, "daily-logs")
    day = F.regexp_extract("line", " ([0-9]{4}-[0-9]{2}-[0-9]{2}) ", 1)
    lines = raw_lines(spark, sf).select(F.col("line").alias("value"), day.alias("day"))
    days = lines.agg(F.min("day"), F.max("day")).first()
    lines.where(F.col("day") < days[1]).write.partitionBy("day").text(root)
    kept = FeatureSnapshot(spark, scratch_path(spark, "features"))
    first = kept.refresh(root)
    lines.where(F.col("day") == days[1]).write.mode("append").partitionBy("day").text(root)
    if days[0] != days[1]:
        oldest = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/day={days[0]}")
        oldest.getFileSystem(spark._jsc.hadoopConfiguration()).delete(oldest, True)
    second, third = kept.refresh(root), kept.refresh(root)
    full = engineer_all(read_logs(spark, root), tiebreak=("source_file", "line_number"), materialize=stage)
    # means and deviations are sums of doubles, whose last digits depend on the order of addition
    names = [F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in full.dtypes if n != "ingestion_time"]
    now, anew = (stage(rows.select(names).select(row_digest(rows.select(names)).alias("row"))) for rows in (kept.features(), full))
    same = now.count() == anew.count() and now.exceptAll(anew).isEmpty()
    return now.agg(F.lit(same).alias("same"), F.lit(second["framed"] < first["framed"]).alias("fewer"),
                   F.lit(third["framed"]).cast("long").alias("framed_again"), F.count(F.lit(1)).alias("rows"))


@query("src_named", with_logs("""
  SELECT service_type AS folder, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS others
  FROM raw JOIN logs USING (log_id) GROUP BY service_type""", ("raw", SQL_RAW)))
def src_named(spark, sf):
    """Two roots of which one lies in the other, files chosen by name: each file counts once."""
    root = written_files(spark, sf)
    roots = [root, f"{root}/service=nova-scheduler"]
    others = discover_files(spark, roots, "no-such-name").count()
    return discover_files(spark, roots, "PART-").groupBy(F.regexp_extract("path", FOLDER, 1).alias("folder")).agg(
        F.sum("size").alias("bytes"), F.lit(others).cast("long").alias("others"))


@query("src_metadata", with_logs("SELECT service_type AS folder, count(*) AS lines, true AS complete FROM logs GROUP BY service_type"))
def src_metadata(spark, sf):
    """What ingest adds to a line: file, its size and last change, line number, time of ingest, id."""
    lines = read_logs(spark, written_files(spark, sf))
    known = [F.col(c).isNotNull() for c in ("source_file", "line_number", "ingestion_time", "log_id")]
    sane = reduce(and_, [*known, F.col("line_number") >= 1, F.col("ingestion_time") <= F.current_timestamp(),
                         F.regexp_extract("source_file", FOLDER, 1) == F.col("service_type")])
    return lines.groupBy(F.regexp_extract("source_file", FOLDER, 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("lines"), F.every(sane).alias("complete"))


@query("snapshot_levels", with_logs("SELECT level, count(*) AS n, CAST(0 AS BIGINT) AS young FROM logs GROUP BY level"))
def snapshot_levels(spark, sf):
    """Levels of the lines a snapshot holds, and how many of its entries are younger than no hours."""
    kept = snapshot.LogSnapshot(spark, scratch_path(spark, "snapshot"))
    kept.refresh(written_files(spark, sf))
    young = snapshot.expire(kept.manifest(), 0).count()
    return snapshot.level_inventory(kept.read()).groupBy("level").agg(
        F.sum("n").alias("n"), F.lit(young).cast("long").alias("young"))


@query("src_priority", with_logs("""
  SELECT step, source, (SELECT count(*) FROM logs) AS rows
  FROM (VALUES (1, 'files'), (2, 'snapshot'), (3, 'documents')) AS v(step, source)"""))
def src_priority(spark, sf):
    """Which source serves: the files at first, the snapshot once there is one, then the stored documents."""
    root, kept, stored = written_files(spark, sf), scratch_path(spark, "snapshot"), scratch_path(spark, "documents")

    def served(step):
        found = snapshot.load_first_available(snapshot.default_order(spark, stored, kept, [root]))
        source = "documents" if "doc_id" in found.columns else "snapshot" if "loaded_at" in found.columns else "files"
        return found.agg(F.lit(step).alias("step"), F.lit(source).alias("source"), F.count(F.lit(1)).alias("rows"))

    first = served(1)
    snapshot.LogSnapshot(spark, kept).refresh(root)
    second = served(2)
    DocumentStore(spark, stored).add(to_documents(read_logs(spark, root)))
    return first.union(second).union(served(3))


@query("clear_documents", with_logs("""
  SELECT count(*) AS stored, CAST(0 AS BIGINT) AS cleared, count(*) FILTER (WHERE level = 'CRITICAL') AS stored_again FROM logs"""))
def clear_documents(spark, sf):
    """A document store filled twice with the same lines, cleared, and filled with a part of them."""
    store, docs = DocumentStore(spark, scratch_path(spark, "documents")), stage(to_documents(logs(spark, sf)))
    store.add(docs)
    store.add(docs)
    stored = store.read().count()
    store.clear()
    cleared = store.read().count()
    store.add(docs.where("level = 'CRITICAL'"))
    return store.read().agg(F.lit(stored).cast("long").alias("stored"), F.lit(cleared).cast("long").alias("cleared"),
                            F.count(F.lit(1)).alias("stored_again"))
