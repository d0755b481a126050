"""Declared schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

RAW_LINES = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("line_number", T.LongType()),
])

LOGS = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("service", T.StringType()),
    T.StructField("process_id", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("request_info", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("service_type", T.StringType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("line_number", T.LongType()),
    T.StructField("raw_log", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("ingestion_time", T.TimestampType()),
])

DOCUMENT_STORE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("log_id", T.LongType()),
    T.StructField("document", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("service_type", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("is_chunked", T.BooleanType()),
    T.StructField("log_hash", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("loaded_at", T.TimestampType()),
    T.StructField("rows", T.LongType()),
])

ANALYSIS_RUNS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("issue", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("relevant_logs", T.IntegerType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("user_id", T.LongType()),
])

TRAINING_RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
])
