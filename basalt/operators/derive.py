"""Derived tables of a ledger history: exploded transactions, hash to data, hash to sequence; batches and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import batch_of
from ..session import new_path

DATA_FIELDS = ["ledger_seq", "closed_at", "tx_index", "envelope", "result"]


def explode_transactions(nested: DataFrame) -> DataFrame:
    """One row for each transaction of ``nested(ledger_seq, closed_at, txs)``."""
    return nested.select("ledger_seq", "closed_at", F.inline("txs"))


def count_transactions(ledgers: DataFrame, txs: DataFrame) -> DataFrame:
    """Transactions of each ledger; 0 for empty ledgers."""
    counted = txs.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("tx_count"))
    return ledgers.select("ledger_seq").join(counted, "ledger_seq", "left").select("ledger_seq", F.coalesce("tx_count", F.lit(0)).alias("tx_count"))


def tx_data(ledgers: DataFrame, txs: DataFrame) -> DataFrame:
    """tx_hash and the fields stored for it."""
    return txs.join(ledgers, "ledger_seq").select("tx_hash", *DATA_FIELDS)


def hash_to_seq(txs: DataFrame) -> DataFrame:
    """The last ledger of each hash; the place within it makes no difference, so it is not read."""
    return txs.groupBy("tx_hash").agg(F.max("ledger_seq").alias("ledger_seq"))


def derived(ledgers: DataFrame, txs: DataFrame, want: set[str]) -> dict[str, DataFrame]:
    """The enabled ones of the three derived tables, from one set of inputs; nothing is computed for the others."""
    every = {
        "ledger_seq_to_lcm": lambda: ledgers,
        "tx_hash_to_tx_data": lambda: last_wins(tx_data(ledgers, txs), ["tx_hash"], ["ledger_seq", "tx_index"]),
        "tx_hash_to_ledger_seq": lambda: hash_to_seq(txs),
    }
    unknown = want - every.keys()
    if unknown or not want:
        raise ValueError(f"enable at least one of {sorted(every)}; unknown: {sorted(unknown)}")
    return {k: make() for k, make in every.items() if k in want}


def last_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key. A maximum of structs, so it is combined on the map side before the shuffle."""
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of rows of ``old`` with their key."""
    return merge([old, new], keys)


def merge(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All keys of all sources; of a key in several, the row of the last source counts."""
    tagged = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return last_wins(every, keys, ["__source"]).drop("__source")


def dedup_counts(txs: DataFrame, start: int, size: int) -> DataFrame:
    """For each batch: transactions, bytes of their data (both before dedup), different hashes."""
    batched = txs.withColumn("batch_no", batch_of(F.col("ledger_seq"), start, size))
    return batched.groupBy("batch_no").agg(F.count(F.lit(1)).alias("tx_count"), F.sum(F.octet_length("envelope") + F.octet_length("result")).alias("raw_bytes"), F.countDistinct("tx_hash").alias("hash_count"))


def batches(ledgers: DataFrame, start: int, end: int, size: int) -> DataFrame:
    """For each batch of the range: its planned range, ledgers found and skipped, first and last found."""
    total = -(-(end - start + 1) // size)
    plan = ledgers.sparkSession.range(1, total + 1).select(F.col("id").alias("batch_no"), (start + (F.col("id") - 1) * size).alias("first_planned"), F.least(F.lit(end), start + F.col("id") * size - 1).alias("last_planned"))
    found = ledgers.where(F.col("ledger_seq").between(start, end)).groupBy(batch_of(F.col("ledger_seq"), start, size).alias("batch_no")).agg(F.count(F.lit(1)).alias("found"), F.min("ledger_seq").alias("first_found"), F.max("ledger_seq").alias("last_found"))
    out = plan.join(found, "batch_no", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("skipped", F.col("last_planned") - F.col("first_planned") + 1 - F.col("found"))


def compaction_triggers(batch_bytes: DataFrame, threshold: int) -> DataFrame:
    """After which batches a compaction starts: when bytes written since the last one reach the threshold; the rest is dropped.

    ``batch_bytes(stream, batch_no, bytes)``. The sum restarts at each trigger, which no window
    can express, so each stream's batches are folded in order; a stream is one ingestion run.
    """
    ordered = batch_bytes.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("batch_no", "bytes"))).alias("b"))

    def step(acc, x):
        total = acc["total"] + x["bytes"]
        hit = total >= threshold
        return F.struct(F.when(hit, F.lit(0).cast("long")).otherwise(total).alias("total"), F.when(hit, F.concat(acc["at"], F.array(x["batch_no"]))).otherwise(acc["at"]).alias("at"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("at"))
    return ordered.select("stream", F.explode(F.aggregate("b", start, step)["at"]).alias("batch_no"))


def running(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value`` up to and with each, in the order of a column, without bringing them to one task.

    Rows are dealt by ranges and written; sums are those within a range after the totals of the
    ranges before it.
    """
    path = new_path(df.sparkSession, "ranges")
    df.withColumn(name, value).repartitionByRange(order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    totals = dealt.groupBy("__part").agg(F.sum(name).alias("__total"))
    before = totals.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    within = F.sum(name).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, within).join(before, "__part").withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def numbered(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """Rows numbered from 0 in the order of a column, without bringing them to one task."""
    return running(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def split_evenly(df: DataFrame, workers: int, order: str) -> DataFrame:
    """Contiguous slices; the first ones get one more row each."""
    rows = numbered(df, order, "__number")
    least, more = divmod(rows.count(), workers)
    n = F.col("__number")
    if not least:
        return rows.withColumn("worker", n).drop("__number")
    large = more * (least + 1)
    worker = F.when(n < large, F.floor(n / (least + 1))).otherwise(more + F.floor((n - large) / least))
    return rows.withColumn("worker", worker.cast("long")).drop("__number")


def split_for_verify(df: DataFrame, workers: int, order: str) -> DataFrame:
    """Contiguous slices of equal size, rounded up; the last ones may be short or missing."""
    rows = numbered(df, order, "__number")
    size = max(1, -(-rows.count() // workers))
    return rows.withColumn("worker", F.floor(F.col("__number") / size).cast("long")).drop("__number")
