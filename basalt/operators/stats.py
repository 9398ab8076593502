"""Statistics over batches, phases and queries, and estimates made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import overhead, percent, reduction
from .derive import running


def truncated_means(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Count, sums and whole-number means (towards zero) of each group."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"sum_{v}") for v in values])
    return out.select(*by, "n", *[f"sum_{v}" for v in values], *[F.expr(f"sum_{v} div n").alias(f"avg_{v}") for v in values])


def mean_of_batch_means(df: DataFrame, value: str) -> DataFrame:
    """One row for each query: the unweighted mean of its batches' means, both in whole numbers."""
    per_batch = df.groupBy("query_id", "batch_no").agg(F.expr(f"sum({value}) div count(*)").alias("mean"))
    return per_batch.groupBy("query_id").agg(F.expr("sum(mean) div count(*)").alias("mean_ns"), F.count(F.lit(1)).alias("batches"))


def phase_statistics(samples: DataFrame, by: list[str], ns: str) -> DataFrame:
    """Mean, sample deviation (0 for one), and interpolated percentiles, of whole microseconds and in whole microseconds."""
    us = F.expr(f"{ns} div 1000").cast("double")
    cut = lambda c: F.floor(c).cast("long")
    points = F.percentile("us", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.withColumn("us", us).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("us").alias("m"), F.coalesce(F.stddev_samp("us"), F.lit(0.0)).alias("sd"), points.alias("p"))
    return out.select(*by, "n", cut(F.round("m", 6)).alias("mean_us"), F.round("sd", 3).alias("stddev_us"), *[cut(F.round(F.col("p")[k], 6)).alias(c) for k, c in enumerate(("p50_us", "p95_us", "p99_us"))])


def min_max_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.round(F.sum(value), 4).alias("total"))


def rollup_by_batch(df: DataFrame, batch: Column, **sums: Column) -> DataFrame:
    """Sums for each batch, and for all (batch_no null), in one pass."""
    return df.withColumn("batch_no", batch).rollup("batch_no").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def progress_marks(steps: DataFrame, total: int) -> DataFrame:
    """Steps at which the whole percentage of work done rises: step, done, percent. ``steps(step, done_now)``."""
    percent_of = lambda n: F.floor(100 * n / total).cast("long")
    marked = running(steps, "step", F.col("done_now"), "done").withColumn("percent", percent_of(F.col("done")))
    return marked.where(F.col("percent") > percent_of(F.col("done") - F.col("done_now"))).select("step", "done", "percent")


def estimate(done: Column, total: int, elapsed_s: Column) -> tuple[Column, Column]:
    """Rate for each second, and seconds left at that rate (null before anything is done)."""
    rate = F.when(elapsed_s > 0, done / elapsed_s)
    return rate, F.when(rate > 0, (total - done) / rate)


def wall_clock(df: DataFrame, by: list[str], worker: str, ns: str, workers: int) -> DataFrame:
    """Work of all workers, and the time it takes if it is shared evenly."""
    return df.groupBy(*by).agg(F.sum(ns).alias("work_ns"), F.countDistinct(worker).alias("workers_seen")).withColumn("wall_ns", F.expr(f"work_ns div {workers}"))


def compute_time(total: Column, *others: Column) -> Column:
    out = total
    for c in others:
        out = out - c
    return out


def sizes(df: DataFrame, by: list[str], raw: str, compressed: str) -> DataFrame:
    """Sums, saved bytes, reduction in percent, and whole-number means for an entry."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.sum(raw).alias("raw_bytes"), F.sum(compressed).alias("stored_bytes"))
    out = out.withColumn("saved_bytes", F.col("raw_bytes") - F.col("stored_bytes")).withColumn("reduction_pct", F.round(reduction(F.col("raw_bytes"), F.col("stored_bytes")), 6))
    return out.withColumn("avg_raw", F.expr("raw_bytes div entries")).withColumn("avg_stored", F.expr("stored_bytes div entries"))


def storage_overhead(stores: DataFrame, entry_bytes: int = 36) -> DataFrame:
    """``stores(store, entries, raw_bytes, stored_bytes, disk_bytes)`` with overheads and the effective saving, in percent."""
    return stores.select(
        "store", F.round(overhead(F.col("disk_bytes"), F.col("stored_bytes")), 6).alias("overhead_pct"), (F.col("entries") * entry_bytes).alias("expected_bytes"),
        F.round(overhead(F.col("disk_bytes"), F.col("entries") * entry_bytes), 6).alias("over_expected_pct"), F.round(reduction(F.col("raw_bytes"), F.col("disk_bytes")), 6).alias("saving_pct"),
    )


def index_projection(keys: DataFrame, index_bytes: Column, sizes_to: list[int]) -> DataFrame:
    """Index bytes for other numbers of keys, in proportion. ``keys`` has one row with n_keys."""
    targets = F.explode(F.array(*[F.lit(n).cast("long") for n in sizes_to])).alias("target_keys")
    return keys.select("n_keys", index_bytes.alias("bytes")).select("n_keys", "bytes", targets).withColumn("projected_bytes", F.floor(F.col("bytes").cast("decimal(38,0)") * F.col("target_keys") / F.col("n_keys")).cast("long"))


def index_parts(n_keys: Column, hash_bits: int = 2, filter_bits: int = 9, value_bits: int = 32) -> dict[str, Column]:
    """Bytes of an index's parts, from their bits for a key."""
    part = lambda bits: F.ceil(n_keys * bits / 8).cast("long")
    return {"hash_bytes": part(hash_bits), "filter_bytes": part(filter_bits), "value_bytes": part(value_bits), "raw_bytes": n_keys * 36}


def page_costs(length: Column, depth: Column, page: int = 4096) -> dict[str, Column]:
    """Overflow pages of a value, pages read, bytes read."""
    overflow = F.floor(length / page).cast("long") + 1
    return {"overflow_pages": overflow, "pages_read": depth + overflow, "bytes_read": (depth + overflow) * page}


def tree_usage(branch: Column, leaf: Column, spill: Column, entries: Column, page: int = 4096) -> dict[str, Column]:
    used = (branch + leaf + spill) * page
    return {"used_bytes": used, "avg_entry_bytes": F.when(entries == 0, 0).otherwise(F.floor(used / entries).cast("long"))}


def share(part: Column, whole: Column) -> Column:
    return F.round(percent(part, whole), 6)
