"""Text lists of hashes and of ledger numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import is_hash


def hash_list(lines: DataFrame) -> DataFrame:
    """raw, tx_hash (lower case; null if invalid) of ``lines(value)``; spaces around are cut, empty lines left out."""
    raw = lines.select(F.trim("value").alias("raw")).where("raw <> ''")
    return raw.withColumn("tx_hash", F.when(is_hash(F.col("raw")), F.lower("raw")))


def ledger_list(lines: DataFrame) -> DataFrame:
    """line_no, ledger_seq of ``lines(line_no, value)``; empty lines and # lines are left out.

    A line that is no number from 2 to 4294967295 fails the query with its line number.
    """
    rows = lines.select("line_no", F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    number = F.expr("try_cast(value as bigint)")
    good = F.coalesce(F.col("value").rlike("^[0-9]{1,10}$") & number.between(2, 4294967295), F.lit(False))
    message = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": not a ledger number: "), F.col("value"))
    return rows.select("line_no", F.when(good, number).otherwise(F.raise_error(message).cast("long")).alias("ledger_seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), value of one text file, which is read whole: lists are small, and lines need their number."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value")).select((F.col("at") + 1).cast("long").alias("line_no"), "value")


def shuffled_with_absent(hashes: DataFrame, n_absent: int, seed: int) -> DataFrame:
    """The hashes and ``n_absent`` hashes that no transaction has, in random order: a query list."""
    absent = hashes.sparkSession.range(n_absent).select(F.sha2(F.concat(F.lit("absent|"), F.col("id").cast("string")), 256).alias("tx_hash"))
    return hashes.select("tx_hash").unionByName(absent).orderBy(F.rand(seed))


def sampled_ledgers(spark: SparkSession, first: int, last: int, n: int, seed: int) -> DataFrame:
    """At most ``n`` different ledger numbers of a range, in random order."""
    return spark.range(first, last + 1).select(F.col("id").alias("ledger_seq")).orderBy(F.rand(seed)).limit(n)
