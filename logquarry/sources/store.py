"""Saved tables: parquet or CSV log tables, and the document table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.operators.documents import new_documents
from logquarry.schemas import DOCUMENT_STORE

EXPORT_COLUMNS = ["document", "id", "timestamp", "service_type", "level", "instance_id", "original_index"]


def table_format(path: str) -> str:
    """``parquet`` or ``csv`` by the suffix; anything else is an error."""
    for suffix in ("parquet", "csv"):
        if path.rstrip("/").endswith(f".{suffix}"):
            return suffix
    raise ValueError(f"unsupported file type: {path}")


def save_logs(df: DataFrame, path: str, mode: str = "overwrite", by_date: bool = False) -> None:
    """Write a log table. Parquet may be laid out by date so that date filters skip files."""
    if table_format(path) == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').option(
            "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
        return
    if by_date:
        df.withColumn("date", F.to_date("timestamp")).write.mode(mode).partitionBy("date").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def load_logs(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a saved log table; CSV needs the schema, so no pass over the data guesses it."""
    if table_format(path) == "csv":
        if schema is None:
            raise ValueError("a CSV table needs its schema")
        return spark.read.schema(schema).option("header", True).option("escape", '"').option(
            "multiLine", False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def logs_union(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables that may lack some columns of each other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


CSV_OPTIONS = {"header": True, "escape": '"', "multiLine": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_rows(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Rows of any table, such as filtered logs or the history of runs, as CSV files with a header, written in parallel.

    Columns are those given, in their order, or all. Lists, maps and structs become JSON; nulls are
    nothing between two commas, empty texts a pair of quotes, and quotes and line ends inside texts are kept.
    """
    names = df.columns if columns is None else columns
    nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    df.select(*[F.to_json(n).alias(n) if n in nested else F.col(n) for n in names]).write.mode("overwrite").options(
        **CSV_OPTIONS).csv(path)


def export_documents(docs: DataFrame, path: str) -> None:
    """The seven columns of a document export as CSV; times keep their microseconds."""
    export_rows(docs.withColumns({"id": F.col("doc_id"), "original_index": F.col("log_id")}), path, EXPORT_COLUMNS)


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An exported table with the types given, nested columns as the JSON they were written as.

    A record may span lines, so a file is read by one task. Spark reads a field that is nothing as its mark for
    nulls; with a mark of its own, an empty text stays one.
    """
    return spark.read.schema(schema).options(**CSV_OPTIONS, nullValue="\0null").csv(path)


class DocumentStore:
    """A parquet table of documents under one path.

    With an ``encoder`` (text column to vector column) documents are stored with their embedding, each encoded
    once, when it comes in; documents that already carry one keep it.
    """

    def __init__(self, spark: SparkSession, path: str, encoder: Callable[[Column], Column] | None = None):
        self.spark, self.path, self.encoder = spark, path, encoder

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], DOCUMENT_STORE)
        return self.spark.read.schema(DOCUMENT_STORE).parquet(self.path)

    def add(self, documents: DataFrame) -> None:
        """Append the documents whose id is not stored yet; only stored ids are read."""
        fresh = new_documents(documents, self.read())
        if self.encoder is not None:
            vector = self.encoder(F.col("document"))
            fresh = fresh.withColumn("embedding", F.coalesce("embedding", vector) if "embedding" in fresh.columns else vector)
        columns = [
            (F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in DOCUMENT_STORE.fields
        ]
        fresh.select(*columns).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], DOCUMENT_STORE).write.mode("overwrite").parquet(self.path)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
