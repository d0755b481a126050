"""The feature table kept on disk and the manifest of the files it was made from."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.schemas import MANIFEST
from logquarry.sources.files import discover_files, read_logs
from logquarry.sources.store import DocumentStore


def changed_files(listing: DataFrame, manifest: DataFrame,
                  max_age_hours: int = dims.SNAPSHOT_MAX_AGE_HOURS) -> DataFrame:
    """Listed files that the manifest does not hold with the same size and time of change, or
    that were loaded too long ago."""
    fresh = manifest.where(
        F.col("loaded_at") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(max_age_hours)))
    return listing.join(fresh, ["path", "size", "mtime"], "left_anti")


def expire(manifest: DataFrame, max_age_hours: int = dims.SNAPSHOT_MAX_AGE_HOURS) -> DataFrame:
    """The entries that are still young enough."""
    return manifest.where(
        F.col("loaded_at") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(max_age_hours)))


def inventory(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.min("loaded_at").alias("oldest"), F.max("loaded_at").alias("newest"),
    )


def level_inventory(logs: DataFrame) -> DataFrame:
    """Rows and level counts per source file."""
    return logs.groupBy("source_file", "level").agg(F.count(F.lit(1)).alias("n"))


GONE = -1  # rows of a manifest entry whose file has been deleted


def _plain(path: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")


class LogSnapshot:
    """Parsed lines under ``path/logs`` with their manifest under ``path/manifest``.

    ``refresh`` parses new and changed files only. Lines are stored by load; the manifest says
    which load of a file counts, so a changed file replaces its earlier lines. A file below the given roots
    that is no longer there gets a last entry without rows, and its lines count no more.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        entries = self._read("manifest")
        if entries is None:
            return self.spark.createDataFrame([], MANIFEST)
        latest = entries.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "loaded_at", "rows"), "loaded_at").alias("e"))
        return latest.select("path", "e.*").where(F.col("rows") != GONE)

    def refresh(self, roots: str | list[str], max_age_hours: int = dims.SNAPSHOT_MAX_AGE_HOURS,
                force: bool = False) -> int:
        """Load what is new and drop what is gone; returns the number of files loaded."""
        listing = discover_files(self.spark, roots)
        folders = [_plain(F.lit(r.rstrip("/"))) for r in ([roots] if isinstance(roots, str) else roots)]
        below = reduce(or_, [F.startswith(_plain(F.col("path")), F.concat(f, F.lit("/"))) | (_plain(F.col("path")) == f) for f in folders])
        gone = self.manifest().where(below).join(listing, "path", "left_anti")
        gone.select("path", "size", "mtime", F.current_timestamp().alias("loaded_at"), F.lit(GONE).cast("long").alias("rows")).write.mode(
            "append").parquet(f"{self.path}/manifest")
        todo = listing if force else changed_files(listing, self.manifest(), max_age_hours)
        paths = [r["path"] for r in todo.select("path").toLocalIterator()]
        if not paths:
            return 0
        loaded_at = self.spark.sql("SELECT current_timestamp() AS t").first()["t"]
        lines = read_logs(self.spark, paths).withColumn("loaded_at", F.lit(loaded_at))
        lines.write.mode("append").parquet(f"{self.path}/logs")
        rows = self.spark.read.parquet(f"{self.path}/logs").where(F.col("loaded_at") == F.lit(loaded_at)).groupBy(
            F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        chosen = listing.join(self.spark.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi")
        chosen.join(rows, "path", "left").select(
            "path", "size", "mtime", F.lit(loaded_at).alias("loaded_at"), F.coalesce("rows", F.lit(0)).alias("rows"),
        ).write.mode("append").parquet(f"{self.path}/manifest")
        return len(paths)

    def read(self) -> DataFrame | None:
        """The current lines of all files, or None when nothing was loaded yet."""
        lines = self._read("logs")
        if lines is None:
            return None
        return lines.join(self.loads(), ["source_file", "loaded_at"], "left_semi")

    def loads(self) -> DataFrame:
        """The loads that count, as ``(source_file, loaded_at)``."""
        return self.manifest().select(F.col("path").alias("source_file"), "loaded_at")

    def all_lines(self) -> DataFrame | None:
        """The lines of every load, also of those that count no more."""
        return self._read("logs")

    def _read(self, name: str) -> DataFrame | None:
        return table_at(self.spark, f"{self.path}/{name}")


def table_at(spark: SparkSession, folder: str) -> DataFrame | None:
    """The parquet table in a folder, or None where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(folder)


def load_first_available(loaders: list[Callable[[], DataFrame | None]]) -> DataFrame | None:
    """First source, in the given order, that exists and holds rows."""
    for load in loaders:
        found = load()
        if found is not None and not found.isEmpty():
            return found
    return None


def default_order(spark: SparkSession, documents: str, snapshot: str, roots: list[str]):
    """Stored documents, else the snapshot, else the files themselves."""
    from logquarry.operators.documents import logs_from_documents

    return [
        lambda: logs_from_documents(DocumentStore(spark, documents).read()),
        lambda: LogSnapshot(spark, snapshot).read(),
        lambda: read_logs(spark, roots),
    ]
