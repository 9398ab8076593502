"""The ledger tables: from stored Parquet, or mapped from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunks import chunk_of

#: DuckDB forms of the same views.
SQL_LEDGERS = "ledgers as (select o_orderkey + 2 as ledger_seq, o_orderdate as closed_at from orders)"
SQL_TXS = """txs as (select sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_shipdate as date) as varchar))) as tx_hash,
l_orderkey + 2 as ledger_seq, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as tx_index,
concat_ws('|', l_partkey, l_suppkey, l_returnflag) as envelope, concat_ws('|', l_linestatus, cast(l_quantity as bigint)) as result from lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ledger_seq, closed_at."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 2).alias("ledger_seq"), F.col("o_orderdate").alias("closed_at"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_hash (hex), ledger_seq, tx_index (from 1 within the ledger), envelope, result."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.sha2(key, 256).alias("tx_hash"),
        (F.col("l_orderkey") + 2).alias("ledger_seq"),
        F.row_number().over(order).cast("long").alias("tx_index"),
        F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag").alias("envelope"),
        F.concat_ws("|", "l_linestatus", F.col("l_quantity").cast("long")).alias("result"),
    )


def nested(ledger_rows: DataFrame, txs: DataFrame) -> DataFrame:
    """Ledgers with their transactions as an array ordered by tx_index (empty for none)."""
    packed = txs.groupBy("ledger_seq").agg(F.sort_array(F.collect_list(F.struct("tx_index", "tx_hash", "envelope", "result"))).alias("txs"))
    empty = F.array().cast("array<struct<tx_index:bigint,tx_hash:string,envelope:string,result:string>>")
    return ledger_rows.join(packed, "ledger_seq", "left").withColumn("txs", F.coalesce("txs", empty))


def write_ledgers(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store a ledger table by chunk, sorted by sequence, replacing the chunks that ``df`` holds."""
    chunked = df.withColumn("chunk_id", chunk_of(F.col("ledger_seq")))
    dealt = chunked.repartitionByRange(partitions, "chunk_id", "ledger_seq") if partitions else chunked.repartitionByRange("chunk_id", "ledger_seq")
    dealt.sortWithinPartitions("chunk_id", "ledger_seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)


def read_range(stored: DataFrame, first: int, last: int) -> DataFrame:
    """Ledgers from ``first`` to ``last`` of a table with chunk_id; the chunk condition prunes folders."""
    chunks = (first - 2) // 10_000, (last - 2) // 10_000
    return stored.where(F.col("chunk_id").between(*chunks) & F.col("ledger_seq").between(first, last))


def missing(found: DataFrame, first: int, last: int) -> DataFrame:
    """Sequence numbers of the range that ``found`` lacks."""
    every = found.sparkSession.range(first, last + 1).withColumnRenamed("id", "ledger_seq")
    return every.join(found.select("ledger_seq").where(F.col("ledger_seq").between(first, last)), "ledger_seq", "left_anti")
