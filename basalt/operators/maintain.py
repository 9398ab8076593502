"""Maintenance of stored tables: copying, compaction, statistics, health rules, configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Writer settings of two ways to ingest: large files for bulk loads, small ones for following the tip.
PROFILES = {"backfill": {"maxRecordsPerFile": 0, "compression": "zstd"}, "streaming": {"maxRecordsPerFile": 1_000_000, "compression": "snappy"}}

#: Fixed values: (rule, column, warning above, critical above).
LIMITS = (("l0_files", "l0_files", 20, 50), ("obsolete_pct", "obsolete_pct", 15.0, 30.0), ("space_amp", "space_amp", 1.5, 2.0), ("memtable", "memtable_bytes", 2 * 1024**3, None), ("pending", "pending_bytes", 10 * 1024**3, None), ("files", "files", 1000, None), ("write_stopped", "write_stopped", None, 0), ("background_errors", "background_errors", None, 0))


def copy(source: DataFrame, path: str, key: str, profile: str = "backfill") -> None:
    """Write a table anew, ordered by its key. The folder must not exist."""
    source.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").options(**PROFILES[profile]).parquet(path)


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes of each file of a stored table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("length").alias("bytes"))


def compact(spark: SparkSession, path: str, to: str, target_bytes: int, dry_run: bool = False) -> DataFrame:
    """Rewrite a table in files of about ``target_bytes``. Returns one row: files and bytes before and after.

    With ``dry_run`` nothing is written and the figures after are those aimed at.
    """
    before = file_stats(spark, path).agg(F.count(F.lit(1)).alias("files_before"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_before"))
    total = before.first()["bytes_before"]
    parts = max(1, -(-total // target_bytes))
    if dry_run:
        return before.withColumn("files_after", F.lit(parts)).withColumn("bytes_after", F.col("bytes_before"))
    spark.read.parquet(path).repartition(parts).write.mode("errorifexists").parquet(to)
    after = file_stats(spark, to).agg(F.count(F.lit(1)).alias("files_after"), F.sum("bytes").alias("bytes_after"))
    return before.crossJoin(after)  # one row each


def compact_chunks(spark: SparkSession, path: str, first: int, last: int) -> int:
    """Rewrite only the chunks of a ledger table that a range of sequence numbers touches, one file each.

    Returns the number of chunks. The new files are complete before the old ones are replaced.
    """
    from ..session import new_path

    chunks = (first - 2) // 10_000, (last - 2) // 10_000
    touched = spark.read.parquet(path).where(F.col("chunk_id").between(*chunks))
    staging = new_path(spark, "compacting")
    touched.repartition("chunk_id").sortWithinPartitions("chunk_id", "ledger_seq").write.partitionBy("chunk_id").parquet(staging)
    rows = spark.read.parquet(staging)
    rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "ledger_seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)
    return rows.select("chunk_id").distinct().count()


def store_summary(levels: DataFrame) -> DataFrame:
    """``levels(store, level, files, bytes, live_bytes, est_keys)`` summed for each store, with ratios."""
    out = levels.groupBy("store").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"), F.sum("est_keys").alias("est_keys"), F.coalesce(F.sum(F.when(F.col("level") == 0, F.col("files"))), F.lit(0)).alias("l0_files"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return out.withColumn("avg_kv_bytes", F.round(ratio(F.col("bytes"), F.col("est_keys")), 6)).withColumn("obsolete_pct", F.round(100 * ratio(F.col("bytes") - F.col("live_bytes"), F.col("bytes")), 6)).withColumn("space_amp", F.round(ratio(F.col("bytes"), F.col("live_bytes")), 6))


def recommendations(stats: DataFrame) -> DataFrame:
    """store, rule, severity for each limit that a store's figures exceed."""
    found = []
    for rule, column, warn, critical in LIMITS:
        value = F.col(column)
        severity = F.lit(None).cast("string")
        if warn is not None:
            severity = F.when(value > warn, "warning")
        if critical is not None:
            severity = F.when(value > critical, "critical").otherwise(severity)
        found.append(F.struct(F.lit(rule).alias("rule"), severity.alias("severity")))
    return stats.select("store", F.inline(F.array(*found))).where("severity is not null")


def parse_options(lines: DataFrame, keys: list[str]) -> DataFrame:
    """key, value: the last ``key=value`` in ``lines(line_no, value)`` for each of ``keys``; patterns match anywhere in a line."""
    pairs = [F.struct(F.lit(k).alias("key"), F.regexp_extract("value", rf"{k}=([^\s]+)", 1).alias("found"), F.col("line_no")) for k in keys]
    every = lines.select(F.inline(F.array(*pairs))).where("found <> ''")
    return every.groupBy("key").agg(F.max_by("found", "line_no").alias("value"))


def config_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """key, expected, actual, matches for two tables of (key, value)."""
    both = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), "key", "left")
    return both.withColumn("matches", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def newest_options(names: DataFrame, number: Column | None = None) -> DataFrame:
    """The file OPTIONS-N of ``names(name)`` with the largest number: N, or ``number`` where names are cut."""
    digits = F.regexp_extract("name", r"^OPTIONS-(\d+)$", 1)
    return names.where(digits != "").agg(F.max_by("name", digits.cast("long") if number is None else number).alias("name"))


def write_amplification(written: Column, flushed: Column) -> Column:
    return F.when(flushed == 0, 0.0).otherwise(written / flushed)
