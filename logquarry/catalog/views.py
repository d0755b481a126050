"""The library's tables as views over the given ones: logs, raw lines, runs, issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.session import small_table, use_utc

# Messages by event_id modulo their number.
MESSAGES = [
    "No valid host was found. There are not enough hosts available.",
    "Instance spawned successfully.",
    "Instance destroyed successfully.",
    "VM Started (Lifecycle Event)",
    "VM Stopped (Lifecycle Event)",
    "Attempting claim: memory 2048 MB, disk 20 GB, vcpus 1 CPU",
    "Claim successful",
    "Terminating instance",
    "Error: lost connection to 10.11.10.1",
    "Messaging timeout waiting for reply",
    "nova-conductor connection timeout after 60 s",
    "Connection timed out",
    "Failed to update instance state in the database",
    "GET /v2/servers/detail HTTP/1.1 status: 200",
    "Quota exceeded for volume on https://cinder.example/v1",
    "Token denied: authentication rejected",
    "DNS hostname lookup failed",
    "Network unreachable",
    "High memory usage detected on compute node",
    "image cache pass complete",
    "Update of instance state failed",
]

# Issue descriptions; together they touch every category but the database one.
ISSUES = [
    "New virtual machines stop during boot because the network does not answer.",
    "The scheduler reports too little memory for every larger flavor.",
    "Several services fail from time to time and requests run into a timeout.",
    "An instance cannot be launched on any host.",
    "There is a shortage of disk and cpu resources in one zone.",
    "Connectivity between compute nodes is lost at night.",
    "Users see authentication errors after logging in.",
    "Memory runs out while images are converted.",
    "The network answers with a timeout under load.",
    "An expired token is still presented to the identity service.",
    "Permission denied although the credentials are valid.",
    "Allocation of a resource is refused: quota exceeded.",
    "The compute service does not start after an upgrade.",
    "What happened in the cloud last night?",
    "Which launches of an instance were refused?",
    "Volumes cannot be attached, the storage backend is slow.",
    "The database connection drops, so state changes are not saved and the machines stay in the same "
    "state for hours.",
]


def files(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return files(spark, sf, name)


def logs(spark: SparkSession, sf: str) -> DataFrame:
    e = files(spark, sf, "events")
    event_id, user = F.col("event_id"), F.col("user_id")
    text = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (event_id % len(MESSAGES) + 1).cast("int"))
    number = F.regexp_extract("props", "[0-9]+", 0)
    padded_user = F.lpad(user.cast("string"), 8, "0")
    kind = F.col("event_type")
    rows = e.select(
        event_id.alias("log_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.when((kind == "error") & (event_id % 10 == 3), "CRITICAL")
        .when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARNING")
        .when(kind == "view", "DEBUG")
        .otherwise("INFO")
        .alias("level"),
        F.when(user % 4 == 0, "nova-api")
        .when(user % 4 == 1, "nova-compute")
        .when(user % 4 == 2, "nova-scheduler")
        .otherwise("unknown")
        .alias("service_type"),
        F.when(event_id % 5 != 0, padded_user).alias("instance_id"),
        F.when(number.cast("int") % 3 != 0, F.lpad(number, 8, "0")).alias("request_id"),
        F.when(event_id % 5 == 0, text)
        .otherwise(F.concat(F.lit("[instance: "), padded_user, F.lit("] "), text))
        .alias("message"),
    )
    return rows


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The log table printed in the raw layout, one line per row, with the file it belongs to."""
    rows = logs(spark, sf)
    return rows.select(
        "log_id",
        F.concat(F.col("service_type"), F.lit("-"), F.date_format("timestamp", "yyyyMMdd")).alias("file"),
        F.concat(
            F.col("service_type"), F.lit(".log.1."), F.date_format("timestamp", "yyyy-MM-dd_HH:mm:ss"),
            F.lit(" "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            F.lit(" "), (F.col("log_id") % 7 + 1000).cast("string"),
            F.lit(" "), F.col("level"), F.lit(" nova.compute.manager "),
            F.coalesce(F.concat(F.lit("[req-"), F.col("request_id"), F.lit("]")), F.lit("[-]")),
            F.lit(" "), F.col("message"),
        ).alias("line"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis runs derived from the events."""
    e = table(spark, sf, "events")
    event_id, user = F.col("event_id"), F.col("user_id")
    names = ["resource_shortage", "network_issues", "authentication", "service_failure",
             "instance_issues", "database", "storage", "timeout_issues"]
    return e.select(
        event_id.alias("run_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("issue "), F.col("event_type"), F.lit(" of user "), user.cast("string"),
                 F.lit(" "), F.repeat(F.lit("x"), (event_id % 120).cast("int"))).alias("issue"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (user % 8 + 1).cast("int")).alias("category"),
        F.when(event_id % 2 == 0, "hybrid").otherwise("fast").alias("mode"),
        (event_id % 51).cast("int").alias("relevant_logs"),
        (F.col("value") / 10).alias("duration"),
        (event_id % 5 + 1).cast("int").alias("rating"),
        user.alias("user_id"),
    )


def issues(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(enumerate(ISSUES, start=1)), "issue_id long, description string")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    """Rows of Python values as a SQL VALUES list."""
    return ", ".join(
        "(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )


SQL_LOGS = f"""
SELECT e.event_id AS log_id, e.ts AS timestamp,
  CASE WHEN e.event_type = 'error' AND e.event_id % 10 = 3 THEN 'CRITICAL'
       WHEN e.event_type = 'error' THEN 'ERROR'
       WHEN e.event_type = 'purchase' THEN 'WARNING'
       WHEN e.event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  CASE e.user_id % 4 WHEN 0 THEN 'nova-api' WHEN 1 THEN 'nova-compute'
                     WHEN 2 THEN 'nova-scheduler' ELSE 'unknown' END AS service_type,
  CASE WHEN e.event_id % 5 = 0 THEN NULL
       ELSE lpad(CAST(e.user_id AS VARCHAR), 8, '0') END AS instance_id,
  CASE WHEN CAST(regexp_extract(e.props, '[0-9]+', 0) AS INT) % 3 = 0 THEN NULL
       ELSE lpad(regexp_extract(e.props, '[0-9]+', 0), 8, '0') END AS request_id,
  CASE WHEN e.event_id % 5 = 0 THEN t.message
       ELSE concat('[instance: ', lpad(CAST(e.user_id AS VARCHAR), 8, '0'), '] ', t.message) END AS message
FROM events e
JOIN (SELECT * FROM (VALUES {values(enumerate(MESSAGES))}) AS v(k, message)) t
  ON e.event_id % {len(MESSAGES)} = t.k"""

SQL_RAW = """
SELECT log_id, concat(service_type, '-', strftime(timestamp, '%Y%m%d')) AS file,
  concat(service_type, '.log.1.', strftime(timestamp, '%Y-%m-%d_%H:%M:%S'), ' ',
    strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'), ' ', CAST(1000 + log_id % 7 AS VARCHAR), ' ', level,
    ' nova.compute.manager ', coalesce('[req-' || request_id || ']', '[-]'), ' ', message) AS line
FROM logs"""

SQL_RUNS = """
SELECT event_id AS run_id, ts,
  concat('issue ', event_type, ' of user ', CAST(user_id AS VARCHAR), ' ',
         repeat('x', CAST(event_id % 120 AS INT))) AS issue,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE user_id % 8 WHEN 0 THEN 'resource_shortage' WHEN 1 THEN 'network_issues'
    WHEN 2 THEN 'authentication' WHEN 3 THEN 'service_failure' WHEN 4 THEN 'instance_issues'
    WHEN 5 THEN 'database' WHEN 6 THEN 'storage' ELSE 'timeout_issues' END AS category,
  CASE WHEN event_id % 2 = 0 THEN 'hybrid' ELSE 'fast' END AS mode,
  CAST(event_id % 51 AS INT) AS relevant_logs, value / 10 AS duration,
  CAST(1 + event_id % 5 AS INT) AS rating, user_id
FROM events"""

SQL_ISSUES = (
    "SELECT CAST(k AS BIGINT) AS issue_id, d AS description FROM "
    f"(VALUES {values(enumerate(ISSUES, start=1))}) AS v(k, d)"
)


def with_logs(body: str, *more: tuple[str, str]) -> str:
    """``body`` with the log table, and further named subqueries, in front."""
    parts = [("logs", SQL_LOGS), *more]
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts) + body


def with_runs(body: str) -> str:
    return f"WITH runs AS ({SQL_RUNS}) {body}"
